"""Token ids of whole texts with a public tokenizer, a batch at a time inside a task."""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Callable
from string import punctuation

import numpy as np

END_ID = 2
CACHE_WORDS = 350_000  # about 75 MB in a Python worker
LONGEST = 64  # characters of a word that is remembered
BLOCK = 256  # new words encoded at a time
PROBES = ("a", "I", "The", "house", "zqxjk", "tokenIZATION", "s", "Ll", "Pour,", "end.)", "dogs'", "so...!", "a',", "x_", "B~`")

# White space besides the space and the line feed, with the control characters that str.split takes
# for such (fixed values).
_RARE = [chr(c) for c in (9, 11, 12, 13, 0x1c, 0x1d, 0x1e, 0x1f, 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                          0x2028, 0x2029, 0x202f, 0x205f, 0x3000)]
_RUNS = ("  ", "\n\n", "\n ", " \n")

# Kept in the Python worker, which Spark uses for many tasks: ids of words by tokenizer file.
_known: dict[str, dict[str, bytes]] = {}


def encoder(path: str) -> tuple[Callable[[list], list[bytes]], np.dtype]:
    """(encode, kind): `encode` gives the ids of each text, `END_ID` after them, as bytes of `kind`.

    Ids are those of a plain call of the tokenizers library with add_special_tokens=False. Both kinds of tokenizers here end a
    token where a word ends and white space follows, so where words are divided by a single space or
    line feed, a text's ids are those of its words, each with the character before it if the tokenizer
    looks at that. ASCII letters, and a tail of ASCII punctuation, are one piece each of both pre-tokenizers, so the
    library's model alone encodes them. Other texts, and texts
    that may hold the literal of an added token, are encoded as a whole. The ids of the first CACHE_WORDS different words
    a worker meets, which include all common ones, are remembered; others are encoded whenever they
    come.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer  # in the task: the library's objects stay in its process

    tokenizer = Tokenizer.from_file(path)
    kind = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
    known = _known.setdefault(path, {})
    # Literals of added tokens are one token wherever they stand: texts that may hold one are not split.
    literal = os.path.commonprefix([t.content for t in tokenizer.get_added_tokens_decoder().values()])
    added = bool(tokenizer.get_added_tokens_decoder())

    def ids(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=kind).tobytes()
                for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    end = np.array([END_ID], dtype=kind).tobytes()
    spaced = ids(["a a"]) != ids(["a\na"])  # white space is part of tokens
    # A character that is always a token of its own divides many words encoded together.
    mark, divider = ("\n", "\n") if spaced else ("7", " 7 ")
    divider_id = int(np.frombuffer(ids([mark])[0], kind)[0])

    # What the model gets of ASCII letters and a tail of ASCII punctuation, if this tokenizer treats them so: else
    # such words go the whole way.
    lowered, head, tokenize = ids(["A"]) == ids(["a"]), "\u0120" if spaced else "", tokenizer.model.tokenize

    def piece(text: str) -> bytes:
        return array(kind.char, [t.id for t in tokenize(text)]).tobytes()
    tails: dict[str, bytes] = {"": b""}

    def by_model(word: str) -> bytes | None:
        """The ids of a word of letters and a tail, else None."""
        letters = word.rstrip(punctuation)
        if not (letters.isascii() and letters.isalpha()):
            return None
        tail = word[len(letters):]
        if tail not in tails:
            if len(tails) > 10_000:
                tails.clear()
                tails[""] = b""
            tails[tail] = piece(tail)
        return (known.get(letters) or piece(head + (letters.lower() if lowered else letters))) + tails[tail]
    if sys.byteorder != "little" or list(map(by_model, PROBES)) != ids([" " + w if spaced else w for w in PROBES]):
        by_model = None

    def words(text: str) -> list[str]:
        """The words; with `spaced`, a line feed stays before its word and a space before it is implied."""
        return text.replace("\n", " \n").split(" ") if spaced else text.split()

    def learn(new: list[str]) -> None:
        if by_model:
            quick = list(map(by_model, new))
            known.update((w, i) for w, i in zip(new, quick) if i is not None)
            new = [w for w, i in zip(new, quick) if i is None]
        chunks = [w if w[:1] == "\n" else " " + w for w in new] if spaced else new
        alone = [k for k, c in enumerate(chunks) if mark in c]
        known.update(zip([new[k] for k in alone], ids([chunks[k] for k in alone])))
        many = [k for k, c in enumerate(chunks) if mark not in c]
        for low in range(0, len(many), BLOCK):
            part = many[low:low + BLOCK]
            flat = np.frombuffer(ids([divider.join([chunks[k] for k in part])])[0], kind)
            raw, size = flat.tobytes(), kind.itemsize
            cuts = [0, *((np.flatnonzero(flat == divider_id) + 1) * size).tolist(), len(raw) + size]
            known.update(zip([new[k] for k in part], [raw[a:b - size] for a, b in zip(cuts, cuts[1:])], strict=True))

    def encode(texts: list) -> list[bytes]:
        texts = [text or "" for text in texts]
        # Looking for single characters is much faster than a pattern with all of them.
        plain = [not any(map(t.__contains__, _RARE)) and not (spaced and any(map(t.__contains__, _RUNS)))
                 and not (added and literal in t) for t in texts]
        split = [words(t) if p else [] for t, p in zip(texts, plain)]
        # With `spaced`, a text's first word has no white space before it: it is not looked up.
        heads = iter(ids([s[0] for s in split if s])) if spaced else None
        for s in split if spaced else ():
            del s[:1]
        found = [list(map(known.get, s)) for s in split]
        gaps = [[k for k, i in enumerate(f) if i is None] for f in found]
        new = list({s[k] for s, g in zip(split, gaps) for k in g})
        learn(new)
        for s, f, g in zip(split, found, gaps):
            for k in g:
                f[k] = known[s[k]]
        odd = iter(ids([t for t, p in zip(texts, plain) if not p]))
        done = [((next(heads) if spaced else b"") + b"".join(f) if p else next(odd)) + end for f, p in zip(found, plain)]
        over = max(0, len(known) - CACHE_WORDS)
        for at, word in enumerate(new):
            if at < over or len(word) > LONGEST:
                del known[word]
        return done
    return encode, kind
