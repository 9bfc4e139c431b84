"""Rows that are hard on text operators, and brute-force versions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside.
EXTRA = ["size", "spans", "key", "seed", "codes", "score", "c0", "rank", "_bucket", "component", "span_id", "gone_id"]


def sentence(random_, words):
    return " ".join(random_.choice("ab cde fgh ijkl mno pqrs tu vwx yz été Straße straße ÉTÉ".split()) + str(random_.randint(0, 400))
                    for _ in range(words))


def hard_rows():
    """(doc_id, text): nulls, empty and white texts, copies, near copies, shared passages, repeated ids."""
    r = random.Random(5)
    long, passage = sentence(r, 9000), sentence(r, 70)
    near = long.split()
    near[100], near[4000] = "changed", "Changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, long), (7, " ".join(near)),
            (9, "x " * 300), (10, "y" * 700), (11, sentence(r, 30) + " " + passage + "\n" + sentence(r, 30)),
            (12, passage), (13, passage), (14, sentence(r, 12) + "  " + passage.upper()), (None, passage), (None, None),
            (15, "\x00 \x1c é́ 文字 " + sentence(r, 5)), (16, sentence(r, 60)), (16, sentence(r, 60)),
            (17, long[20000:20300]), (17, long[20000:20300]), (-5, sentence(r, 49)), (1 << 40, sentence(r, 50))]
    group = sentence(r, 200).split()
    for k in range(12):
        own = list(group)
        own[k * 7] = f"own{k}"
        rows.append((100 + k, " ".join(own)))
    return rows


def frame(spark, rows):
    """Those rows with clashing extra columns."""
    names = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, "x", "y", None, t, *["z"] * len(EXTRA)) for i, t in rows],
                                 f"doc_id long, lang string, source string, n_chars long, text string, {names}")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
