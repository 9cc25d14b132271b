"""Main text of web pages by tag-path ratios.

Text blocks are grouped by the tags from the root to the leaf.  For each path the
text length, the punctuation and the linked text per block are summed up; the
ratios are smoothed over the page, fused into one score, and paths above a threshold
hold the content.  Menus and sentences of an article thus part even where a single
block would not tell.  What a class or id says of a path is a weight of its score.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
OUTSIDE = frozenset("nav footer header aside form menu button select dialog template svg canvas object video audio head fieldset".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that name what is not the article.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus disclaimer footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion related recommend "
    "recommended replies reply share sharing sidebar side social sponsor sponsored subscribe tags toolbar widget warning alert login signup search".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class PathConfig:
    """``spread``: standard deviation of the smoothing, in blocks; ``least``: of the page's best score; weights of paths inside article or main, and of those named like something else."""

    spread: float = 1.0
    least: float = 0.4
    article_weight: float = 4.0
    named_weight: float = 0.1


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    outside: bool  # in an element that never holds the article
    named: bool  # under a class, id or role that names something else
    linked: int  # characters in links


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts at ``at`` ends; a ``>`` in quotes does not count."""
    stop = page.find(">", at)
    if stop < 0:
        return len(page)
    inside = page[at:stop]
    if inside.count('"') % 2 == 0 and inside.count("'") % 2 == 0:
        return stop
    i, quote = at, ""
    while i < len(page):
        c = page[i]
        if quote:
            i = page.find(quote, i)
            if i < 0:
                return stop  # an open quote: the first > ends the tag after all
            quote = ""
        elif c in "\"'" and page[i - 1] in "= \t\n":
            quote = c
        elif c == ">":
            return i
        i += 1
    return stop


def _outside(name: str, attributes: str) -> bool:
    """Elements that never hold the article, and what is hidden."""
    return name in OUTSIDE or "hidden" in attributes and bool(re.search(r"(^|\s)hidden(\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", attributes))


def _named(name: str, attributes: str) -> bool:
    """Whether a class, id or role names something else than the article."""
    if name in ("body", "html", "article", "main"):
        return False
    return any(not NOT_CONTENT.isdisjoint(w.lower() for w in WORD.findall(found[1] or found[2] or found[3] or "")) for found in NAMES.finditer(attributes))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with white space turned into single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    links, in_link, at = 0, 0, 0

    def end_block() -> None:
        nonlocal parts, links
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, tuple(t for t, _, _ in stack), any(o for _, o, _ in stack), any(n for _, _, n in stack), links))
        parts, links = [], 0

    def say(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        links += len(text.strip()) if in_link else 0

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = len(page) if stop < 0 else stop + 1
            continue
        named = TAG_NAME.match(page, lt + 1)
        if not named:
            say("<")
            at = lt + 1
            continue
        end = _tag_end(page, named.end())
        attributes, name = page[named.end() : end], named[0].lower()
        at = end + 1
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                in_link = 0
            if name in INLINE:
                continue
            end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0].split(".")[0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if name not in ("textarea", "noscript"):
                end_block() if name not in INLINE else None
            at = len(page) if not close else _tag_end(page, close.end() - 1) + 1
            continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            elif name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        end_block()
        in_link = 0
        if name in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0].split(".")[0] == "p":
                    del stack[i:]
                    break
        if name in CLOSED_BY:
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i][0].split(".")[0]
                if open_ in CLOSED_BY[name]:
                    del stack[i:]
                elif open_ not in CLOSED_BY["tr"]:
                    break
        if name in VOID or attributes.endswith("/") and name not in ENDS_P:
            continue
        mark = NAMES.search(attributes)
        label = (mark[1] or mark[2] or mark[3] or "").strip() if mark else ""
        stack.append((f"{name}.{label}" if label else name, _outside(name, attributes), _named(name, attributes)))
    end_block()
    return out


def scores(inside: list[Block], conf: PathConfig) -> dict[tuple[str, ...], float]:
    """Per tag path the fused score: length and punctuation per block, smoothed along the page, less what is linked, and weighed."""
    paths: dict[tuple[str, ...], list[float]] = {}
    for b in inside:
        sums = paths.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), 1, b.linked)):
            sums[i] += x
    each = np.array([paths[b.path] for b in inside], float)
    reach = int(3 * conf.spread)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / conf.spread) ** 2)

    def smooth(x: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]
        return np.convolve(x, kernel, "full")[reach : reach + len(x)] / weight

    article = np.array([any(t.split(".")[0] in ("article", "main") for t in b.path) for b in inside])
    named = np.array([b.named for b in inside])
    weight = np.where(article, conf.article_weight, 1.0) * np.where(named, conf.named_weight, 1.0)
    unlinked = np.maximum(0.0, 1 - each[:, 3] / each[:, 0])
    fused = smooth(each[:, 0] / each[:, 2]) * smooth((each[:, 1] + 0.1) / each[:, 2]) * unlinked * weight
    out: dict[tuple[str, ...], float] = {}
    for b, f in zip(inside, fused.tolist(), strict=True):
        out[b.path] = max(out.get(b.path, 0.0), f)
    return out


def select(found: list[Block], conf: PathConfig = PathConfig()) -> list[Block]:
    """The blocks whose tag path scores as content, and headings beside them."""
    inside = [b for b in found if not b.outside]
    if not inside:
        return []
    by_path = scores(inside, conf)
    best = max(by_path.values())
    chosen = {p for p, f in by_path.items() if f >= conf.least * best and f > 0}
    parents = {p[:-1] for p in chosen}
    return [b for b in inside if b.path in chosen or (b.path and b.path[-1].split(".")[0] in HEADINGS and b.path[:-1] in parents)]


def main_text(page: str | None, conf: PathConfig = PathConfig()) -> str:
    """The blocks of content in page order, joined by an empty line; empty for null or empty pages."""
    return "\n\n".join(b.text for b in select(blocks(page or ""), conf))


def extract(pages: DataFrame, conf: PathConfig = PathConfig()) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html), pages parsed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, conf) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
