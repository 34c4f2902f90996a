"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its opening tags in their roles, a role being the path
of containers down to the tag (``html>body>div.ad``). For each host, tokens
that share their occurrence vector (as often as each other on every page)
form an equivalence class; vectors are compared by a sum of page hashes, so
they come out of one aggregate that combines before the shuffle, however
many pages a host has. Classes of at least two tokens (or one that holds
others) whose tokens come once a page make the template's containers, the
others its repeated parts; containers nest by their paths.

The template's slots are the text of its containers; a slot is constant
if its text is one and the same on pages that differ otherwise. Going down
from the page's body, the article's containers are the innermost ones that
leave out only constant slots, link text and boilerplate (paths of fewer
than a tenth of the pages do not stop the descent; article and main
elements are not split). All text is extracted but constant slots,
boilerplate elements, and outside the containers blocks of nothing but
links. Hosts of fewer than ``LEAST_PAGES`` pages show too little, and use the template of
all hosts together; a page that lacks its template's containers has its
article elements, main or body instead.

Edge cases: null or empty html gives the empty text; null urls share a
host; unclosed and truncated markup is read as far as it goes; an empty
table gives no rows; equal rows are extracted each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooclens.llm.common import stored

LEAST_PAGES = 8
#: A slot is constant on this many different pages at least (bits of a map of 62).
DIFFERENT = 6

# ---- fixed values: HTML element kinds and names that sites use for what is
# not the article
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "header", "form", "button", "menu", "dialog", "head", *RAW}
BOILERPLATE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie",
    "cookies", "consent", "cta", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "paywall", "popup", "promo", "related", "replies", "respond", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Parts that make a name tell a state, such as no-sidebar or comments-open.
STATES = {"no", "not", "without", "has", "with", "open", "opened", "closed", "enabled", "disabled", "fixed", "sticky"}
#: Elements that are never boilerplate by their names, and those that show where the article is.
WHOLE = {"html", "body", "main", "article"}
LANDMARKS = {"main", "article", "h1"}
# ---- end of fixed values

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][-\w:]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _named(names: list[str]) -> bool:
    parts = (re.split(r"[-_]+", n) for n in names)
    return any(not STATES.intersection(p) and not BOILERPLATE_NAMES.isdisjoint(p) for p in parts)


def parsed(page: str) -> list[tuple[str, tuple[str, ...], bool, bool, str]]:
    """("open" | "text" | "break" | "edge", path, boilerplate, in a link, text)
    in page order: containers opened, stretches of text, line breaks, and
    ends of blocks.

    Navigation and the like are boilerplate by their tags, but not the header
    of an article. Other elements are so by their names, unless they hold the
    page's article: a heading of first order, main or article element, or,
    where none is outside, more than half of the text."""
    events: list[tuple[str, int, bool, str]] = []
    # by element: path, parent, boilerplate by tag, by name, characters, landmarks
    paths: list[tuple[str, ...]] = [()]
    up, by_tag, by_name, chars, marks = [0], [False], [False], [0], [0]
    stack: list[tuple[str, int]] = []  # tag, element
    link, at, n = 0, 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        end = m.start() if m else n
        if end > at:
            e = stack[-1][1] if stack else 0
            events.append(("text", e, link > 0, page[at:end]))
            if not link:
                chars[e] += len(page[at:end].strip())
        if not m:
            break
        at = max(m.end(), end + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link = max(0, link + (-1 if m[1] else 1))
            elif tag == "br":
                events.append(("break", 0, False, " "))
            continue
        events.append(("edge", 0, False, ""))
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                link = 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()  # a block ends an open paragraph, an item the item before
        names = [x.lower() for g in _NAMES.findall(m[3] or "") for x in "".join(g).split()]
        parent, named = stack[-1][1] if stack else 0, _named(names)
        own = tag in BOILERPLATE_TAGS and tag != "form" and not (tag == "header" and any(t in ("article", "main") for t, _ in stack))
        events.append(("open", len(paths), False, ""))
        if tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append((tag, len(paths)))
        paths.append((*paths[parent], ".".join([tag, *names[:1]])))
        up.append(parent)
        by_tag.append(by_tag[parent] or own)
        by_name.append((named or tag == "form") and tag not in WHOLE)
        chars.append(0)
        marks.append(int(tag in LANDMARKS and not named and not by_tag[-1]))
    # an element's text and landmarks are also its parents'
    for e in range(len(paths) - 1, 0, -1):
        if not by_tag[e]:
            chars[up[e]] += chars[e]
            marks[up[e]] += marks[e]
    boiler = [False]
    for e in range(1, len(paths)):
        holds = marks[e] > 0 or marks[0] == 0 and 2 * chars[e] > chars[0]
        boiler.append(boiler[up[e]] or by_tag[e] or by_name[e] and not holds)
    return [(kind, paths[e], boiler[e], linked, text) for kind, e, linked, text in events]


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


_TOKENS = "host string, path string, pages long, total long, vector long, chars long, lo long, hi long, variants long"


def _tokens(pages: DataFrame) -> DataFrame:
    """Occurrences of the tokens, added up within a batch: pages, total, the
    vector's hash, and of the slot text directly in the container the
    characters, the least and greatest hash, and a map of the pages' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, page_id, page in zip(*(t.column(c).to_pylist() for c in ("host", "page_id", "html")), strict=True):
                counts: dict[str, int] = {}
                slots: dict[str, list[str]] = {}
                for kind, path, boiler, link, text in parsed(page or ""):
                    key = ">".join(path)
                    if kind == "open":
                        counts[key] = counts.get(key, 0) + 1
                    elif kind == "text" and path and not boiler and not link:
                        slots.setdefault(key, []).append(text)
                texts = {key: x for key, own in slots.items() if (x := " ".join("".join(own).split()))}
                variant = 1 << xxhash.xxh64_intdigest("\n".join(texts.values())) % 62
                for key, k in counts.items():
                    row = seen.setdefault((host, key), [0, 0, 0, 0, None, None, 0])
                    row[0] += 1
                    row[1] += k
                    row[2] += xxhash.xxh64_intdigest(f"{page_id} {k}") >> 8  # sums stay exact
                    row[2] &= (1 << 62) - 1
                    if key in texts:
                        h = xxhash.xxh64_intdigest(texts[key]) >> 11  # exact as doubles, too
                        row[3] += len(texts[key])
                        row[4], row[5] = (h, h) if row[4] is None else (min(h, row[4]), max(h, row[5]))
                        row[6] |= variant
            rows = [(h, p, *v) for (h, p), v in seen.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["host", "path", "pages", "total", "vector", "chars", "lo", "hi", "variants"],
            )

    return pages.select("host", "page_id", "html").mapInArrow(run, _TOKENS)


_TEMPLATE = "host string, main array<string>, constant array<string>"


def _main_containers(tokens: pd.DataFrame) -> tuple[list[str], int, list[str]]:
    """Paths of the article's containers, pages, and the paths of constant
    slots, from a host's tokens."""
    pages = int(tokens["pages"].max())
    once = tokens[(tokens["total"] == tokens["pages"]) & (tokens["pages"] * 2 >= pages)]
    paths = set(once["path"])
    classes = once.groupby(["pages", "total", "vector"])["path"].transform("size")
    holds = [any(q.startswith(p + ">") for q in paths) for p in once["path"]]
    containers = set(once["path"][(classes >= 2) | np.array(holds, bool)])
    same = (tokens["lo"] == tokens["hi"]) & np.array([int(v).bit_count() >= DIFFERENT for v in tokens["variants"]], bool)
    constant = sorted(tokens["path"][same])
    varying = tokens[~same & (tokens["pages"] * 10 >= pages)]
    text = dict(zip(varying["path"], varying["chars"], strict=True))
    below = lambda p: sum(n for q, n in text.items() if q == p or q.startswith(p + ">"))

    def cover(at: str) -> list[str]:
        inner = [c for c in containers if c.startswith(at + ">" if at else "") and c != at]
        top = [c for c in inner if below(c) and not any(c.startswith(x + ">") for x in inner)]
        held = below(at) if at else sum(text.values())
        whole = at.split(">")[-1].split(".")[0] in ("article", "main") and len(top) > 1
        return [at] if whole or not held or sum(map(below, top)) < held else [p for c in sorted(top) for p in cover(c)]

    return cover(next((p for p in sorted(containers, key=len) if p.split(">")[-1].split(".")[0] == "body"), "")), pages, constant


def templates(pages: DataFrame) -> tuple[DataFrame, tuple[list[str], list[str]]]:
    """(host, main, constant) of hosts whose template differs from the common
    one, and the common one, deduced from all hosts' pages together."""
    tokens = stored(_tokens(pages), "page-tokens")
    mask = F.lit((1 << 62) - 1)
    add = [F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum(F.col("vector").bitwiseAND(F.lit((1 << 40) - 1))).bitwiseAND(mask).alias("vector"), F.sum("chars").alias("chars"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("variants").alias("variants")]
    by_host = stored(tokens.groupBy("host", "path").agg(*add), "host-tokens")
    together = by_host.groupBy("path").agg(*add)
    # paths of a tenth of all pages: the skeleton that hosts share
    n = by_host.where(~F.col("path").contains(">")).agg(F.max("pages")).first()[0]
    if n is None:
        return pages.sparkSession.createDataFrame([], _TEMPLATE), ([], [])
    total = pages.count()
    common = together.where(F.col("pages") * 10 >= total).toPandas()
    shared = _main_containers(common)[::2] if len(common) else ([], [])

    def deduced(own: pd.DataFrame) -> pd.DataFrame:
        main, seen, constant = _main_containers(own)
        told = seen >= LEAST_PAGES and (main, constant) != shared
        return pd.DataFrame([(own["host"].iloc[0], main, constant)] if told else [], columns=["host", "main", "constant"], dtype=object)

    return stored(by_host.groupBy("host").applyInPandas(deduced, _TEMPLATE), "page-templates"), shared


def _blocks(page: str, main: list[str], constant: set[str]) -> str:
    """Text of the page's blocks that are neither boilerplate nor constant,
    outside the main containers nor all links."""
    events = parsed(page)
    opened = {p: b for k, p, b, *_ in events if k == "open"}
    wants = [p for p in opened if ">".join(p) in main]
    if not wants:
        for name in ("article", "main", "body"):
            wants = [p for p, b in opened.items() if p[-1].split(".")[0] == name and (name == "body" or not b)]
            if wants:
                break
        else:
            wants = [()]
    inside = {p: any(p[: len(w)] == w for w in wants) for p in {(), *(p for _, p, *_ in events)}}
    fixed = {p for p in inside if ">".join(p) in constant}
    out, held, told = [], [], False

    def end() -> None:
        nonlocal held, told
        out.append("".join(held) if told else "")
        held, told = [], False

    for kind, path, boiler, link, text in events:
        if kind == "edge" or kind == "open":
            end()
        elif kind == "break":
            held.append(text)
        elif not boiler and path not in fixed:
            held.append(text)
            told = told or inside[path] or not link and not text.isspace()
    end()
    blocks = (" ".join(html.unescape(b).split()) for b in out)
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` with the column ``text``, which replaces one of
    that name."""
    keep = [c for c in pages.columns if c not in ("text", "html")]
    rows = pages.select(F.struct(*keep).alias("_row"), "page_id", "html", host_of().alias("host"))
    other, (main, constant) = templates(rows)
    other = other.select(F.col("host").alias("_host"), "main", "constant")
    shared = [F.array(*map(F.lit, paths)).cast("array<string>").alias(c) for c, paths in (("main", main), ("constant", constant))]
    told = rows.join(other, F.col("host") == F.col("_host"), "left").select(
        "_row", "html", F.coalesce("main", shared[0]).alias("main"), F.coalesce("constant", shared[1]).alias("constant")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            given = zip(*(t.column(c).to_pylist() for c in ("html", "main", "constant")), strict=True)
            texts = [_blocks(p, m, set(c)) if p else "" for p, m, c in given]
            yield pa.RecordBatch.from_arrays([t.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    schema = told.select("_row", F.lit("").alias("text")).schema
    return told.mapInArrow(run, schema).select("_row.*", "text")
