"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of block tokens: containers open and close, leaf
blocks (paragraph, heading, list item ...) and loose text are text slots;
inline markup is part of a slot's text.  Repeats that follow each other are
folded into groups, which leaves the page's shape.

The shapes of a host are aligned one after another into its wrapper, a
union-free regular expression: what both have is matched, a block that repeats
on either side becomes a repeated group, what one side lacks becomes an
optional group, and leaf blocks stay text slots.  Only distinct shapes are
aligned, first in salted groups and then the groups' wrappers, so a host with
a third of all pages is no single task's work.

In a wrapper, the slots of an article container (or main container, or content
container, or else the whole page) that lie in no menu, header, footer,
sidebar, notice, advert, form or comment section are the main text.  Pages of
one host may be of several templates: a page's text comes from the first of
these kinds of container that has text on that page.

Of those slots' texts, the ones that are constant over the host are boilerplate
whatever their containers are called: they are counted by path and text over
the pages, copies of a page as one, and dropped.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table

#: Wrappers are sent to all tasks up to this many bytes, else joined by host.
SENT_BYTES = 32 << 20
#: Groups in which the distinct shapes of a host are aligned first.
SALTS = 64
LONGEST_PERIOD = 12
#: A main block is constant on a host if this share of the pages that have its
#: path hold it, and at least so many, beside different texts.
SHARE, LEAST = 0.5, 3

LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption summary address legend option label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt "
                   "u var wbr input picture svg path".split())
VOID = frozenset("area base col embed frame hr link meta param source track".split())
#: Content that is no markup; without its end tag only code runs to the end.
RAW = frozenset("script style textarea title iframe".split())
CODE = frozenset("script style".split())
#: Containers without text of the page; one without its end tag is none.
HIDDEN = frozenset("noscript template object select button".split())
NESTING = frozenset("template object".split())
#: Containers that never hold main text, by tag, and by a word of class or id.
ASIDE_TAGS = frozenset("nav footer aside form head dialog menu".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead "
                        "footer sidebar side aside widget notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login search "
                        "form comment comments reply replies respond disqus discussion share sharing social related recommended pagination pager".split())
MAIN_WORDS = frozenset("article post entry story content main".split())
#: Tags that hold no main text even around an article; a form or a container
#: named like an aside may be the layout around it.
LAYOUT_ASIDE = frozenset("nav footer aside head dialog menu".split())
#: Words of asides by which layouts around an article are named, too.
LAYOUT_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar side aside widget notice alert overlay banner search form social share".split())
RANKS = 10

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


#: Where raw content ends: at its end tag, or, when that is missing, before
#: what can't be in it.
_RAW_END = {t: re.compile(rf"</{t}\s*>" + ("" if t in CODE else rf"|<{t}[\s>]" + (r"|<body[\s>]|<(?=/head\s*>)" if t == "title" else "")), re.I) for t in RAW}


def _label(tag: str, attributes: str) -> str:
    """A container's token: its tag and the words of class, id and role."""
    words = sorted({w for m in _NAMES.finditer(attributes) for w in _PART.findall(next(g for g in m.groups() if g is not None).lower())})
    return ".".join([tag, *words])


def _hidden_end(page: str, tag: str, at: int) -> int:
    """Where a hidden container that opens before ``at`` ends; ``at`` itself if
    its end tag is missing: none follows, the next of its kind opens first, or
    what is around it closes first."""
    opened = Counter()
    for m in _TOKEN.finditer(page, at):
        name = (m[2] or "").lower()
        if name == tag:
            if not m[1]:
                if tag not in NESTING:
                    return at
                opened[tag] += not m[3].endswith("/")
            elif not opened[tag]:
                return m.end()
            else:
                opened[tag] -= 1
        elif name and name not in INLINE and name not in LEAVES and name not in VOID:
            if m[1] and not opened[name]:
                return at
            opened[name] += -1 if m[1] else 1
    return at


def tokens(page: str) -> list[tuple[str, str]]:
    """The page's block tokens: (token, raw text).  Leaf blocks and loose text
    ("#") have text; containers open as "tag.words" and close as "/tag"."""
    out: list[list] = []
    slot, at, skip = None, 0, None

    def text(raw: str):
        nonlocal slot
        if slot is None:
            if not html.unescape(raw).strip():
                return
            slot = ["#", ""]
            out.append(slot)
        slot[1] += raw

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if skip is None:
            text(page[at:m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if skip is not None:
            if m[1] and tag == skip:
                skip = None
            continue
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                if end and end[0][:2] == "</":
                    at = end.end()
                elif tag in CODE:
                    at = len(page)
        elif tag in HIDDEN:
            if not m[1] and not m[3].endswith("/"):
                at = _hidden_end(page, tag, at)
        elif tag in INLINE:
            if tag in ("br", "wbr", "img"):
                text(" " if tag != "wbr" else "")
        elif tag in LEAVES:
            slot = None
            if not m[1]:
                slot = [tag, ""]
                out.append(slot)
        else:
            slot = None
            if tag not in VOID:
                out.append(["/" + tag if m[1] else _label(tag, m[3] or ""), ""])
    if skip is None:
        text(page[at:])
    return [tuple(x) for x in out]


# -- shapes and wrappers ---------------------------------------------------------
# A node is a slot's token, a container ["<", token, nodes], a repeated group
# ["+", nodes] or an optional group ["?", nodes].


def _close(stack: list, tag: str) -> None:
    """Close the innermost open container of a tag, with those open in it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].split(".")[0] == tag:
            del stack[i:]
            return


def _walk(flat: Iterator[str]) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Slots with the containers that are open around them."""
    stack: list[str] = []
    for token in flat:
        if token[0] == "/":
            _close(stack, token[1:])
        elif token == "#" or token in LEAVES:
            yield token, tuple(stack)
        else:
            stack.append(token)


def tree(flat: Iterator[str]) -> list:
    """The tokens as nested containers, closed as :func:`_walk` closes them."""
    root: list = []
    stack, inside = [], [root]
    for token in flat:
        if token[0] == "/":
            _close(stack, token[1:])
            del inside[len(stack) + 1:]
        elif token == "#" or token in LEAVES:
            inside[-1].append(token)
        else:
            node = ["<", token, []]
            inside[-1].append(node)
            stack.append(token)
            inside.append(node[2])
    return root


def _is(node, kind: str) -> bool:
    return isinstance(node, list) and node[0] == kind


def _key(node):
    """What a node begins with: a slot's or a container's token."""
    while _is(node, "+") or _is(node, "?"):
        node = node[1][0]
    return ("<", node[1]) if _is(node, "<") else node


def _single(node) -> bool:
    """A slot or container, or a group of nothing but one."""
    return not (_is(node, "+") or _is(node, "?")) or len(node[1]) == 1 and _single(node[1][0])


def fold(nodes: list) -> list:
    """Immediate repeats as repeated groups, short ones first, until none is
    left; containers of one token repeat whatever is in them."""
    nodes = [["<", n[1], fold(n[2])] if _is(n, "<") else n for n in nodes]
    out: list = []
    for n in nodes:
        if _is(n, "<") and out and _single(out[-1]) and _key(out[-1]) == _key(n):
            last = out[-1][1][0] if _is(out[-1], "+") else out[-1]
            out[-1] = ["+", [_matched(last, n)]]
        else:
            out.append(n)
    nodes, changed = out, True
    while changed:
        changed = False
        for size in range(1, LONGEST_PERIOD + 1):
            out, i = [], 0
            while i < len(nodes):
                part = nodes[i:i + size]
                group = part[0][1] if size == 1 and _is(part[0], "+") else part
                j = i + size
                while len(part) == size and (nodes[j:j + size] == part or size == 1 and nodes[j:j + 1] == group):
                    j += size
                if j > i + size:
                    out.append(["+", group])
                    changed = True
                else:
                    j = i + 1
                    out.append(nodes[i])
                i = j
            nodes = out
    return nodes


def _matched(a, b):
    """One node for two that match."""
    if a == b:
        return a
    if _is(a, "<") and _is(b, "<"):
        return ["<", a[1], merge(a[2], b[2])]
    kinds = {n[0] for n in (a, b) if _is(n, "+") or _is(n, "?")}
    merged = merge(*[n[1] if _is(n, "+") or _is(n, "?") else [n] for n in (a, b)])
    if len(merged) == 1 and isinstance(merged[0], list) and merged[0][0] in kinds:
        return merged[0]
    return ["+" if "+" in kinds else "?", merged]


def merge(a: list, b: list) -> list:
    """The wrapper of two wrappers, by their longest common subsequence."""
    if a == b:
        return a
    same = lambda x, y: _key(x) == _key(y) and (_is(x, "+") and _is(y, "+") or _single(x) and _single(y))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if same(a[i], b[j]) else 0)
    out, gap, i, j = [], [[], []], 0, 0

    def close():
        for part in gap:
            out.extend(x if _is(x, "?") else ["?", [x]] for x in part)
        gap[0], gap[1] = [], []

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and same(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            close()
            out.append(_matched(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            gap[0].append(a[i])
            i += 1
        else:
            gap[1].append(b[j])
            j += 1
    close()
    return out


def shape(stream: list[tuple[str, str]]) -> str:
    return json.dumps(fold(tree(t for t, _ in stream)), separators=(",", ":"))


def _paths(nodes: list, around: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """The containers around each slot of a wrapper."""
    for n in nodes:
        if _is(n, "<"):
            yield from _paths(n[2], (*around, n[1]))
        elif isinstance(n, list):
            yield from _paths(n[1], around)
        else:
            yield around


def _is_aside(container: str, inside_main: bool) -> bool:
    tag, *words = container.split(".")
    if tag == "header":
        return not inside_main  # an article's own header holds its title
    return tag in ASIDE_TAGS or bool(ASIDE_WORDS & set(words)) and tag not in ("html", "body", "article", "main")


def _ranks(path: tuple[str, ...]) -> Iterator[int]:
    """The ranks of main text that a slot with these containers around it has:
    0 to 2 in an article, main or content container; 3 to 5 the same, in a
    layout that is named like an aside; 6 on the page as a whole; 7 to 9 in a
    main container within what is named like a comment section or advert."""
    if any(c.split(".")[0] in LAYOUT_ASIDE for c in path):
        return
    for rank in range(3):
        at = next((i for i, c in enumerate(path) if _is_main(c, rank)), None)
        if at is None or any(_is_aside(c, True) for c in path[at + 1:]):
            continue
        words = set(path[at].split("."))
        if not (ASIDE_WORDS - LAYOUT_WORDS) & words or MAIN_WORDS & (words - {path[at].split(".")[0]}):
            around = [c for c in path[:at] if _is_aside(c, False)]
            yield rank + (0 if not around else 7 if any((ASIDE_WORDS - LAYOUT_WORDS) & set(c.split(".")[1:]) for c in around) else 3)
    if not any(_is_aside(c, False) for c in path):
        yield 6


def _is_main(container: str, rank: int) -> bool:
    tag, *words = container.split(".")
    return (tag == "article", tag == "main" or "main" in words and tag in ("div", "section"),
            tag in ("div", "section") and bool(MAIN_WORDS & set(words)) and not ASIDE_WORDS & set(words))[rank]


def ranked_paths(wrapper: list) -> list[list[str]]:
    """The paths (containers around a slot) of a wrapper's main text, a list
    for each rank; a page's text is that of its first rank with any."""
    kept: list[list[str]] = [[] for _ in range(RANKS)]
    for path in set(_paths(wrapper)):
        for rank in _ranks(path):
            kept[rank].append("/".join(path))
    return [sorted(k) for k in kept]


def main_paths(wrapper: list) -> list[str]:
    """The paths of a wrapper's first rank that has any."""
    return next((k for k in ranked_paths(wrapper) if k), [])


def main_blocks(page: str, ranked: list) -> list[tuple[str, str]]:
    """(path, text) of the page's main blocks: of the first rank whose paths
    give text on this page, so each template of a host has its own."""
    stream = tokens(page)
    raw = iter([t for k, t in stream if k == "#" or k in LEAVES])
    blocks = []
    for _, path in _walk(k for k, _ in stream):
        text = " ".join(html.unescape(next(raw)).split())
        if text:
            blocks.append(("/".join(path), text))
    return next((b for paths in ranked if (b := [x for x in blocks if x[0] in paths])), [])


# -- the job ------------------------------------------------------------------


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([shape(tokens(h)) for h in b.column("html").to_pylist()], pa.string())],
                                         names=["host", "shape"])


def _merged(pdf: pd.DataFrame) -> list:
    wrapper = None
    for s in sorted(pdf["shape"], key=lambda s: (len(s), s)):
        nodes = json.loads(s)
        wrapper = nodes if wrapper is None else merge(wrapper, nodes)
    return wrapper or []


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, paths): the wrapper of each host's pages as JSON and
    the paths of its main text by rank.  ``pages`` has host and html."""
    distinct = pages.mapInArrow(_shapes, "host string, shape string").distinct()

    def partly(pdf):
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "shape": [json.dumps(_merged(pdf), separators=(",", ":"))]})

    def wholly(pdf):
        wrapper = _merged(pdf)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper, separators=(",", ":"))], "paths": [ranked_paths(wrapper)]})

    some = (distinct.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS))).groupBy("host", "salt")
            .applyInPandas(partly, "host string, shape string"))
    return some.groupBy("host").applyInPandas(wholly, "host string, wrapper string, paths array<array<string>>")


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def own(blocks: list[tuple[str, str]], constant) -> str:
    """The text of a page's main blocks without the host's constant ones; a
    page with no others keeps them."""
    kept = [t for p, t in blocks if _number(p, t) not in constant] if constant else []
    return "\n\n".join(kept or [t for _, t in blocks])


def _lines(blocks: list[tuple[str, str]]) -> set[tuple[str, int | None, int]]:
    """(path, line, context) of a page's main blocks, and (path, None, context)
    of their paths.  A block's context is the page's longest other text: that
    is one and the same for copies of a page."""
    longest = sorted({t for _, t in blocks}, key=lambda t: (-len(t), t))[:2]
    numbers = {t: _number(t) for t in longest}
    out = {(p, None, numbers[longest[0]]) for p, _ in blocks}
    if len(longest) == 2:
        out |= {(p, _number(p, t), numbers[longest[t == longest[0]]]) for p, t in set(blocks)}
    return out


def _with_paths(rows: DataFrame, made: DataFrame, size: int, call, schema: str) -> DataFrame:
    """``call(batch, [(main blocks, constant lines) of each page])`` on batches
    of pages, with their hosts' columns of ``made`` sent or joined."""
    sent = None
    if size <= SENT_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast({r.host: ([frozenset(p) for p in r.paths], frozenset(r.constant)) for r in made.collect()})
    else:
        rows = rows.join(made, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            if sent is not None:
                of = [sent.value[h] for h in b.column("host").to_pylist()]
            else:
                of = [([frozenset(p) for p in ps], frozenset(c)) for ps, c in zip(b.column("paths").to_pylist(), b.column("constant").to_pylist())]
            yield call(b, [(main_blocks(h, ps), c) for h, (ps, c) in zip(b.column("html").to_pylist(), of)])

    return rows.mapInArrow(run, schema)


def _size(made: DataFrame) -> int:
    paths = F.coalesce(F.expr("aggregate(flatten(paths), 0, (a, p) -> a + length(p))"), F.lit(0))
    return made.agg(F.sum(F.length("host") + paths + 8 * F.size("constant"))).first()[0] or 0


def _constant(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(host, constant): the main blocks, as numbers of path and text, that at
    least ``SHARE`` of the host's pages with that path have, counted by
    distinct contexts, ``LEAST`` at the least."""
    def lines(b, pages):
        found = [(h, _number(h, p), line, c) for h, (blocks, _) in zip(b.column("host").to_pylist(), pages) for p, line, c in _lines(blocks)]
        cols = list(zip(*set(found))) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "path", "line", "context"])

    schema = "host string, path long, line long, context long"
    counted = (_with_paths(rows, made, _size(made), lines, schema).distinct()
               .groupBy("host", "path", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST))
    counted = materialize(counted, "lines")
    whole = counted.filter("line IS NULL").select("host", "path", F.col("n").alias("all"))
    return (counted.filter("line IS NOT NULL").join(whole, ["host", "path"]).filter(F.col("n") >= SHARE * F.col("all"))
            .groupBy("host").agg(F.collect_set("line").alias("constant")))


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Nulls: a null html is an empty page with an empty text; a null url, or
    one without a host, shares the wrapper of all such pages; null ids and
    repeated rows are kept.  An empty table gives an empty result; extra
    columns are ignored."""
    rows = pick(pages, page_id="long", url="string", html="string").fillna({"html": ""}).withColumn("host", _host(F.col("url")))
    none = F.array().cast("array<bigint>")
    made = materialize(wrappers(rows.select("host", "html")).select("host", "paths", none.alias("constant")), "wrappers")
    constant = _constant(rows.select("host", "html"), made)
    made = materialize(made.drop("constant").join(constant, "host", "left").withColumn("constant", F.coalesce("constant", none)), "templates")

    def texts(b, pages):
        out = [own(blocks, c) for blocks, c in pages]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])

    return _with_paths(rows, made, _size(made), texts, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
