"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

The block structure of a page is a token stream of tags and texts. Streams of one host are aligned
pairwise (as in RoadRunner, Crescenzi, Mecca, Merialdo 2001): equal tokens match, differing texts
become slots, a mismatch of tags becomes an optional group, equal neighbouring groups become a repeated
group. The result matches every page seen and tells which elements hold the content. Every page is then
read along its host's wrapper, through optional and repeated groups, which gives each text its place
there. Texts that every different page of a host has in the same place, of any length and inside the
content too, are template, unless the pages are near copies of each other; the same text in another
place is content. They are counted, one row per page and then per text and place, so a large host is
spread over all tasks.

Only shapes are aligned, and equal shapes of a host are counted before that, so a host with a third
of all pages is a few rows. Shapes are merged in groups of bounded size, level by level.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tasteloom.llm.html import Element, parse, plain
from tasteloom.session import write_once

GROUP = 64  # shapes merged in one group
TEMPLATE_PAGES = 3  # different pages that must agree on a text before it counts as template
RULES_IN_BROADCAST = 200_000  # hosts
RULE_BYTES_IN_BROADCAST = 32 << 20

# Elements that never hold main text, and words that mark elements as such (fixed values).
DROPPED = frozenset("nav footer aside form head header menu select dialog fieldset".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|consent|"
                   r"disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|"
                   r"related|replies|respond|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget|"
                   r"contentinfo|complementary|search)(?:$|[\s_-])")
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|main|content|story)(?:$|[\s_-])")

# A wrapper node is [label, multiplicity, children]: label "tag", "tag.mark", "#" (text slot) or
# "=<hash>" (a text that is always the same); multiplicity "1", "?", "+" or "*".


def noisy(element: Element, inside: bool) -> bool:
    """Whether an element is no main text; a header inside the content belongs to it."""
    if element.name == "header" and inside:
        return False
    return element.name in DROPPED or bool(element.mark and NOISE.search(element.mark))


def rank(element: Element) -> int:
    """How clearly an element says that it holds the content: 3 article, 2 main, 1 by its class."""
    if element.name == "article":
        return 3
    if element.name == "main" or "main" in element.mark.split():
        return 2
    return 1 if element.name in ("div", "section") and CONTENT.search(element.mark) else 0


def label(element: Element) -> str:
    return f"{element.name}.{element.mark}" if element.mark else element.name


def shape(element: Element, inside: bool = False) -> list:
    """The page's own wrapper: marks as labels, noise without inside, neighbours folded."""
    children = []
    if not noisy(element, inside):
        inside = inside or rank(element) > 1
        for child in element.children:
            if isinstance(child, str):
                text = plain(child)
                if text:
                    children.append(["#" if inside else f"={text_hash(text) & 0xFFFFFFFFFFFFFFFF:016x}", "1", []])
            else:
                children.append(shape(child, inside))
    return [label(element), "1", fold(children)]


def is_text(node: list) -> bool:
    return node[0] == "#" or node[0].startswith("=")


def same(a: list, b: list) -> bool:
    return a[0] == b[0] or (is_text(a) and is_text(b))


def both(a: str, b: str) -> str:
    many, maybe = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return ("*" if maybe else "+") if many else ("?" if maybe else "1")


def maybe(node: list) -> list:
    return [node[0], both(node[1], "?"), node[2]]


def merged(a: list, b: list) -> list:
    """The wrapper of two nodes that match."""
    if is_text(a):
        return [a[0] if a[0] == b[0] else "#", both(a[1], b[1]), []]
    return [a[0], both(a[1], b[1]), aligned(a[2], b[2])]


def fold(nodes: list) -> list:
    """Neighbours with the same label become one repeated group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0] and not is_text(node):
            found = merged(out[-1], node)
            out[-1] = [found[0], both(found[1].replace("?", "1"), "+"), found[2]]
        else:
            out.append(node)
    return out


def aligned(a: list, b: list) -> list:
    """Longest common alignment of two lists of nodes; what has no partner becomes optional."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if same(a[i], b[j]) else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if same(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(maybe(a[i]))
            i += 1
        else:
            out.append(maybe(b[j]))
            j += 1
    return fold(out + [maybe(n) for n in a[i:]] + [maybe(n) for n in b[j:]])


def host(url: Column) -> Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            key = name, json.dumps(shape(parse(html or "")), separators=(",", ":"))
            counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["host", "shape", "n"])


def _merge_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["n", "shape"], ascending=[False, True])
    wrapper = None
    for text in group["shape"]:
        node = json.loads(text)
        wrapper = node if wrapper is None else merged(wrapper, node)
    return pd.DataFrame({"host": [key[0]], "shape": [json.dumps(wrapper, separators=(",", ":"))],
                         "n": [int(group["n"].sum())]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, shape, n): one wrapper per host of `pages` (url, html), and its number of pages."""
    rows = (pages.select(host(F.col("url")).alias("host"), F.col("html").alias("html"))
            .mapInArrow(_shapes, "host string, shape string, n long"))
    found = write_once(rows.groupBy("host", "shape").agg(F.sum("n").alias("n")), "shapes")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        # As many groups as give each about GROUP shapes; a host's wrappers get fewer every time.
        groups = found.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
        found = write_once(found.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.col("groups")))
                           .groupBy("host", "part").applyInPandas(_merge_group, "host string, shape string, n long"), "shapes")


def rule(wrapper: list) -> dict:
    """What pages are read with: the rank of the elements that hold a host's content (0: none does), and
    the wrapper as [label, on every page of its parent, children], texts as "#"."""
    best = 0

    def walk(node: list, inside: bool) -> list:
        nonlocal best
        if is_text(node):
            return ["#", int(node[1] in "1+"), []]
        name, _, mark = node[0].partition(".")
        element = Element(name, mark)
        if noisy(element, inside):
            return [node[0], int(node[1] in "1+"), []]
        best = max(best, rank(element))
        inside = inside or rank(element) > 1
        return [node[0], int(node[1] in "1+"), [walk(child, inside) for child in node[2]]]
    wrapper = walk(wrapper, False)
    return {"rank": best, "wrapper": wrapper}


def numbered(wrapper: list) -> tuple:
    """(label, on every page, number, children) of the nodes of a rule's wrapper."""
    count = 0

    def walk(node: list) -> tuple:
        nonlocal count
        count += 1
        return node[0], node[1], count, tuple([walk(child) for child in node[2]])
    return walk(wrapper)


def partners(nodes: tuple, labels: list[str]) -> list[int]:
    """For each label of a page, neighbours folded, the wrapper node it matches, in order; -1 for none. As
    many match as can, then as many of the nodes that every page has."""
    if len(nodes) == len(labels) and all(n[0] == x for n, x in zip(nodes, labels)):
        return list(range(len(nodes)))
    out = [-1] * len(labels)
    low, i_end, j_end = 0, len(nodes), len(labels)
    # What every page has can only match the page's own first and last.
    while low < min(i_end, j_end) and nodes[low][1] and nodes[low][0] == labels[low]:
        out[low] = low
        low += 1
    while min(i_end, j_end) > low and nodes[i_end - 1][1] and nodes[i_end - 1][0] == labels[j_end - 1]:
        i_end, j_end = i_end - 1, j_end - 1
        out[j_end] = i_end
    unit = i_end - low + 1
    best = [[0] * (j_end - low + 1) for _ in range(unit)]
    for i in range(i_end - 1, low - 1, -1):
        name, always = nodes[i][:2]
        row, below = best[i - low], best[i - low + 1]
        for j in range(j_end - 1, low - 1, -1):
            k = j - low
            row[k] = max(below[k], row[k + 1], below[k + 1] + unit + always if name == labels[j] else 0)
    i = j = low
    while i < i_end and j < j_end:
        here, k = best[i - low][j - low], j - low
        if nodes[i][0] == labels[j] and here == best[i - low + 1][k + 1] + unit + nodes[i][1]:
            out[j] = i
            i, j = i + 1, j + 1
        elif here == best[i - low + 1][k]:
            i += 1
        else:
            j += 1
    return out


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def placed_hash(text: str, place: int) -> int:
    return text_hash(f"{place} {text}")


def placed_texts(html: str, wrapper: tuple | None) -> tuple[list[tuple[str, int, int]], int]:
    """(text, place, over) of the texts of a page outside elements that never hold main text, in page order,
    and the highest rank of its elements. The place is the number of the wrapper's text that the page's
    matches (0: none); bit k of `over` tells that an element of rank k is around it."""
    out: list[tuple[str, int, int]] = []
    best = 0

    def walk(element: Element, node: tuple | None, inside: bool, over: int) -> None:
        nonlocal best
        if noisy(element, inside):
            return
        own = rank(element)
        best, inside, over = max(best, own), inside or own > 1, over | 1 << own
        items, owner, labels = [], [], []
        for child in element.children:
            if isinstance(child, str):
                child = plain(child)
                if not child:
                    continue
                labels.append("#")
            elif (name := label(child)) != (labels[-1] if labels else ""):
                labels.append(name)
            items.append(child)
            owner.append(len(labels) - 1)
        found = partners(node[3], labels) if node else [-1] * len(labels)
        for child, at in zip(items, owner):
            match = node[3][found[at]] if found[at] >= 0 else None
            if isinstance(child, str):
                out.append((child, match[2] if match else 0, over))
            else:
                walk(child, match, inside, over)
    walk(parse(html), wrapper, False, 1)
    return out, best


def reader():
    """Rules by their text, the wrappers with numbers; those met last are kept."""
    known: dict[str, dict] = {}

    def read(text: str | None) -> dict:
        if text not in known:
            if len(known) > 10_000:
                known.clear()
            found = json.loads(text) if text else {"rank": 3, "wrapper": None}
            known[text] = found | {"wrapper": numbered(found["wrapper"]) if found["wrapper"] else None}
        return known[text]
    return read


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = reader()
    for batch in batches:
        pages, texts, content = [], [], []
        for html, told in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist()):
            found, best = placed_texts(html or "", read(told)["wrapper"])
            pages.append(text_hash("\n".join(text for text, _, _ in found)))
            held: dict[int, bool] = {}
            for text, place, over in found:
                key = placed_hash(text, place)
                held[key] = held.get(key, False) or bool(over >> best & 1)
            texts.append(sorted(held))
            content.append([held[key] for key in texts[-1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(pages, pa.int64()), pa.array(texts, pa.list_(pa.int64())),
             pa.array(content, pa.list_(pa.bool_()))], names=["host", "page", "texts", "content"])


def template_texts(pages: DataFrame) -> DataFrame:
    """(host, fixed): hashes of the texts, with their place in the wrapper, that all different pages of a host
    have there, where there are at least TEMPLATE_PAGES of these; `pages` is (host, html, rule). Copies of a
    page count once: they say nothing about a template.

    Near copies say as little: if more than half of the texts in the pages' content are common to all of
    them, the host's pages are versions of one page, and no text is template.
    """
    rows = pages.select("host", "html", "rule").mapInArrow(
        _page_texts, "host string, page long, texts array<long>, content array<boolean>")
    # Pages with the same texts in other places are copies, too: one of them counts, always the same.
    one = F.min(F.struct("texts", "content"))
    rows = write_once(rows.groupBy("host", "page").agg(one.alias("one")).select("host", "page", "one.*"), "page-texts")
    many = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size(F.filter("content", lambda c: c))).alias("held")).where(
        F.col("pages") >= TEMPLATE_PAGES)
    cells = rows.select("host", F.explode(F.arrays_zip("texts", "content")).alias("t"))
    counts = cells.groupBy("host", F.col("t.texts").alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t.content")).alias("inside"))
    return (counts.where(F.col("n") >= TEMPLATE_PAGES).join(many, "host").where("n = pages").groupBy("host")
            .agg(F.sort_array(F.collect_list("text")).alias("fixed"), F.sum("inside").alias("common"), F.first("held").alias("held"))
            .where("2 * common <= held").select("host", "fixed"))


def main_text(html: str, rule: dict, fixed: set[int]) -> str:
    """The blocks of the page that the rule calls content, without the template's, joined by two line feeds."""
    found, present = placed_texts(html, rule["wrapper"])
    wanted = min(rule["rank"], present)
    return "\n\n".join(text for text, place, over in found
                       if (not wanted or over >> wanted & 1) and not (fixed and placed_hash(text, place) in fixed))


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [json.dumps(rule(json.loads(s)), separators=(",", ":")) for s in batch.column("shape").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], names=["host", "rule"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = reader()
    for batch in batches:
        texts = []
        for html, told, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "rule", "fixed"))):
            texts.append(main_text(html, read(told), set(fixed or ())) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def _small(rules: DataFrame) -> DataFrame:
    """The rules, broadcast if they are few and short."""
    fixed = F.size("fixed") * 8 if "fixed" in rules.columns else F.lit(0)
    count, size = rules.agg(F.count(F.lit(1)), F.sum(F.length("rule") + F.greatest(fixed, F.lit(0)))).first()
    return F.broadcast(rules) if count <= RULES_IN_BROADCAST and (size or 0) <= RULE_BYTES_IN_BROADCAST else rules


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    The main text is the content of the page without menus, headers, footers, side bars, notices,
    adverts, forms, scripts, styles, markup and reader comments, and without the texts that all different
    pages of its host have in the same place of the host's wrapper (of three or more pages, not near copies
    of each other). Character references are decoded, white
    space in a block becomes one space, blocks are trimmed, empty ones dropped, and joined by two
    line feeds in page order.

    Null or empty html: empty text. Null urls share the empty host. Broken markup is read as far as it
    goes. Rows that repeat a page are extracted one by one; they count as pages of their host. No rows
    in, no rows out. Other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"),
                        F.col("html").alias("html"), host(F.col("url")).alias("host"))
    rules = write_once(infer_wrappers(pages).mapInArrow(_rules, "host string, rule string"), "rules")
    fixed = template_texts(rows.join(_small(rules), "host", "left"))
    rules = write_once(rules.join(fixed, "host", "left"), "rules")
    return rows.join(_small(rules), "host", "left").select("page_id", "url", "html", "rule", "fixed").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
