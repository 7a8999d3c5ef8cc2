"""Main text of web pages by maximum-scoring subsequence (operator 4).

A page is a sequence of tags and runs of words. Every word scores above zero and
every tag below. Weights are learned from labelled pages, which are those that
mark their article themselves: a word weighs the share of words in sections like
its own that stand inside an article, a tag the share of its kind in such sections
that stands outside one (forms, menus and the like count as outside wherever they
stand). One linear scan finds the contiguous region with the largest sum, and
the text is what stands in it. Sections whose tags outweigh their words are left
out of it by the same scores, and do not split an article that they stand in.

Sections and tags that no labelled page has take ``other_word`` and ``other_tag``,
and those whose role the HTML standard fixes take a prior, so that pages of
another make follow the rule of words against tags. Scripts, styles, form controls
and the like are no text anywhere, and an article inside an article is a reader
comment, as the standard says.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by newlines in page order, and nothing is
dropped or capped otherwise.

Cases: null and empty pages, and pages whose best region scores less than
``least``, have an empty text; the earliest of equal regions is taken; unclosed
elements, stray end tags and unfinished markup are read as far as they go, and
pages of any length in linear time: from the first tag that never ends outside
quotes on, the next ``>`` ends a tag, and a tag without one is text. Equal pages
get equal texts, rows that share an id each their own; without labelled pages the
priors decide; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import sample_rows, slices

# Element names of the HTML standard by role.
SECTIONS = {"article", "aside", "body", "dialog", "div", "footer", "form", "header", "main", "menu", "nav", "section"}
HIDDEN = {"button", "datalist", "head", "iframe", "noscript", "object", "select", "svg", "template"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Sections that say nothing of their own without a name.
BARE = {"body", "div", "section"}
#: Role of sections by the standard, for those that no labelled page has: beside the content, or the content.
BESIDE = {"aside", "dialog", "footer", "form", "header", "menu", "nav"}
CONTENT = {"article", "main"}

_STRICT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_BEGINS = re.compile(r"</?[a-zA-Z]|<[!?]")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I) for name in RAW}


@dataclass(frozen=True)
class PageWeights:
    #: Weight of a word by the key of its section, above 0.
    words: dict[str, float]
    #: Weight of a tag by its key, below 0.
    tags: dict[str, float]


@dataclass(frozen=True)
class Extraction:
    #: Labelled pages that weights are learned from, and their characters altogether.
    labelled_pages: int = 500
    sample_chars: int = 50_000_000
    #: Weight of a tag that stands outside articles only, of one inside them only, of an unknown one.
    outer_tag: float = -2.0
    inner_tag: float = -0.001
    other_tag: float = -0.1
    #: Weight of a word in no known section.
    other_word: float = 0.5
    #: Weights of words by the standard's roles.
    beside_word: float = 0.05
    content_word: float = 0.95
    #: Least sum of a region that is content.
    least: float = 0.5


def _keys(name: str, rest: str) -> list[str]:
    """The element's key for each of its names, or its bare name."""
    words = [w for m in _NAMES.finditer(rest) for w in (m[1] or m[2] or m[3] or "").lower().split()] if rest else []
    return [f"{name}.{w}" for w in words] or [name]


def parse(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is 'open', 'close' or 'text'; comments and raw elements are left out."""
    at = begin = 0  # where to look on, and where the text not yet given begins
    tag = _STRICT
    while True:
        found = _BEGINS.search(page, at)
        if found is None:
            break
        lt, m = found.start(), None
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            stop = len(page) if stop < 0 else stop + 3
        elif page[lt + 1] in "!?":
            stop = page.find(">", lt) + 1
        else:
            m = tag.match(page, lt)
            if m is None and tag is _STRICT:
                tag = _LOOSE
                m = tag.match(page, lt)
            stop = m.end() if m else 0
        if not stop:  # nothing ends a tag from here on
            break
        if lt > begin:
            yield "text", page[begin:lt], ""
        at = begin = stop
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            end = _RAW_END[name].search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = begin = len(page) if stop < 0 else stop + 1
        else:
            yield "open", name, m[3]
            if name not in VOID and name not in SECTIONS and m[3].rstrip().endswith("/"):
                yield "close", name, ""
    if begin < len(page):
        yield "text", page[begin:], ""


def _section_word(keys: list[str], weights: PageWeights, c: Extraction, outer: float, in_content: bool) -> float:
    """Weight of words in a section of these keys that stands where words weigh ``outer``."""
    name = keys[0].partition(".")[0]
    known = [weights.words[k] for k in keys if k in weights.words]
    if not known and name in weights.words and name not in BARE:
        known = [weights.words[name]]
    if known:
        return min(known)
    if name in BESIDE and not (name == "header" and in_content):
        return min(outer, c.beside_word)
    return max(outer, c.content_word) if name in CONTENT else outer


def _tag_weight(keys: list[str], here: list[str], weights: PageWeights, c: Extraction, in_content: bool) -> float:
    """Weight of a tag of these keys (end tags begin with a slash) in a section of the keys ``here``."""
    known = [weights.tags[k] for k in keys if "." in k and k in weights.tags]
    name = keys[0].partition(".")[0]
    bare = name.removeprefix("/")
    if not known and bare in SECTIONS:
        known = [weights.tags[name]] if name in weights.tags else []
        if not known and bare in BESIDE and not (bare == "header" and in_content):
            return c.outer_tag
    elif not known and any(k in weights.words for k in here):
        known = [weights.tags[t] for k in here if (t := f"{name}@{k}") in weights.tags]
    elif not known and name in weights.tags:
        known = [weights.tags[name]]
    return min(known, default=c.other_tag)


@dataclass
class _Open:
    name: str
    keys: list[str]
    at: int
    here: list[str]
    word: float
    hidden: bool
    in_content: bool


def scored(page: str, weights: PageWeights, c: Extraction) -> tuple[list[tuple[str, str, float]], list[tuple[int, int, bool]]]:
    """The page's (kind, text or tag, score), and its sections as (first, past the last, whether they stand in content)."""
    out: list[tuple[str, str, float]] = []
    closed: list[tuple[int, int, bool]] = []
    stack: list[_Open] = []
    open_names: Counter = Counter()
    here: list[str] = []
    word, hidden, in_content = c.other_word, False, False
    for kind, value, rest in parse(page):
        if kind == "text":
            if not hidden:
                out.append(("text", value, word * len(value.split())))
            continue
        if kind == "open":
            keys = _keys(value, rest)
            out.append(("tag", value, _tag_weight(keys, here, weights, c, in_content)))
            if value not in VOID:
                stack.append(_Open(value, keys, len(out) - 1, here, word, hidden, in_content))
                open_names[value] += 1
                if value in SECTIONS:
                    # an article inside an article is a reader comment
                    hidden = hidden or (value == "article" and open_names["article"] > 1)
                    word = _section_word(keys, weights, c, word, in_content)
                    in_content = in_content or value in CONTENT
                    here = here if value in BARE and keys == [value] else keys
                hidden = hidden or value in HIDDEN
            continue
        keys, section = [value], None
        if open_names[value]:
            while True:
                last = stack.pop()
                open_names[last.name] -= 1
                here, word, hidden, in_content = last.here, last.word, last.hidden, last.in_content
                if last.name == value:
                    break
            keys = last.keys
            section = (last.at, len(out) + 1, last.in_content) if value in SECTIONS else None
        out.append(("tag", value, _tag_weight(["/" + k for k in keys], here, weights, c, in_content)))
        if section:
            closed.append(section)
    return out, closed


def outweighed(scores: list[float], sections: list[tuple[int, int]]) -> list[bool]:
    """Whether each item stands in one of the sections, given that its scores add up to less than zero."""
    sums = [0.0, *itertools.accumulate(scores)]
    edge = [0] * (len(scores) + 1)
    for i, j in sections:
        if sums[j] - sums[i] < 0:
            edge[i] += 1
            edge[j] -= 1
    return [n > 0 for n in itertools.accumulate(edge[:-1])]


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and past-the-last index of the subsequence with the largest positive sum, the earliest of equals."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: PageWeights, c: Extraction = Extraction()) -> str:
    if not page:
        return ""
    sequence, closed = scored(page, weights, c)
    scores = [e[2] for e in sequence]
    passed = outweighed(scores, [(i, j) for i, j, in_content in closed if in_content])
    bridged = [c.inner_tag if p else x for p, x in zip(passed, scores, strict=True)]
    a, b = best_region(bridged)
    if math.fsum(bridged[a:b]) < c.least:
        return ""
    without = outweighed(scores, [(i, j) for i, j, _ in closed if a <= i and j <= b])
    blocks, parts = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for i in range(a, b):
        kind, value, _ = sequence[i]
        if kind == "text":
            if not without[i]:
                parts.append(value)
        elif value == "br":
            parts.append(" ")
        elif value not in INLINE:
            close()
    close()
    return "\n".join(blocks)


def learn(pages: list[str], c: Extraction = Extraction()) -> PageWeights:
    """Weights from pages that mark one article, beside or around which nothing else is one."""
    count = {(what, side): Counter() for what in ("word", "tag") for side in (True, False)}
    for page in pages:
        parsed = list(parse(page))
        if sum(k == "open" and v == "article" for k, v, _ in parsed) != 1:
            continue
        within, stack, here = False, [], []
        open_names: Counter = Counter()
        for kind, value, rest in parsed:
            if kind == "text":
                for k in here:
                    count["word", within][k] += len(value.split())
                continue
            before, keys = within, [value]
            if kind == "open":
                keys = _keys(value, rest)
                if value not in VOID:
                    stack.append((value, keys, here, within))
                    open_names[value] += 1
                    if value in SECTIONS and not (value in BARE and keys == [value]):
                        here = keys
                    # forms and the like are beside the content inside an article too
                    within = value == "article" or (within and value not in BESIDE - {"header"} and value not in HIDDEN)
            elif open_names[value]:
                while True:
                    name, keys, here, within = stack.pop()
                    open_names[name] -= 1
                    if name == value:
                        break
            slash = "/" * (kind == "close")
            count["tag", before and within].update(slash + k for k in keys)
            if value not in SECTIONS:
                count["tag", before and within].update({f"{slash}{value}@{k}" for k in here} | {slash + value})

    def inner_share(what: str, key: str) -> float:
        inside, outside = count[what, True][key], count[what, False][key]
        return (inside + 0.5) / (inside + outside + 1)

    words = {k: inner_share("word", k) for k in count["word", True] | count["word", False]}
    tags = {
        k: c.inner_tag + (c.outer_tag - c.inner_tag) * (1 - inner_share("tag", k)) ** 2 for k in count["tag", True] | count["tag", False]
    }
    return PageWeights(words, tags)


def fit(pages: DataFrame, c: Extraction = Extraction()) -> PageWeights:
    """Learns from a bounded sample of the pages that mark their article (see :class:`Extraction`)."""
    marked = pages.select(F.col("page_id").alias("id"), F.col("html").cast("string").alias("text"))
    marked = marked.where(F.lower("text").contains("<article"))
    return learn([r.text for r in sample_rows(marked, c.labelled_pages, c.sample_chars)], c)


def main_texts(pages: DataFrame, weights: PageWeights, c: Extraction = Extraction()) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(t, weights, c) for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return src.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
