"""Personal data spans (operator 5, native).

Regular expressions propose spans, validators confirm them (octets of an address,
Luhn for cards, mod 97 for account numbers, digit counts for phones) and words
near a span adjust its score. Everything is DataFrame functions inside one row:
the matches of a text are its ``regexp_extract_all``, their places follow from
the lengths of the pieces that ``split`` leaves between them. Running sums go over
blocks of about the square root of their number (:func:`_scan`), so a text of n
matches costs n * sqrt(n) steps and is passed over a fixed number of times.

Base spans (email, ip, card, phone) are kept whatever their score; the further
kinds (iban, ssn) need ``min_score``. A span's score starts at its kind's weight,
rises by ``context`` when one of the kind's words stands within ``reach``
characters before it, and falls by it when a word for samples does.

The patterns are those of the base definition with starts and repetitions that
cannot backtrack (look-behind for the start of a run, possessive loops), which
leaves the matches as they are and keeps long runs linear.

Cases: a null text is an empty one and has no span (it stays null in
:func:`redact`); spans of different kinds may overlap, spans of one kind never
do, and spans that begin together are listed in the order of their kinds; texts
are searched whole, whatever their length; equal rows get equal spans; an empty
table gives an empty result; other columns stay untouched, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Text that every match holds, so that other texts are not searched.
    hint: str
    #: SQL condition on the match ``m``.
    valid: str
    score: float
    words: str


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Account number: letters as two digits each (10 to 35), first four characters moved behind, mod 97 is 1.
_IBAN = (
    "aggregate(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''), 0, "
    "(a, c) -> CASE WHEN c = '' THEN a WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 "
    "ELSE (a * 10 + ascii(c) - 48) % 97 END) = 1 AND length(replace(m, ' ', '')) BETWEEN 15 AND 34"
)

KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        "true",
        0.9,
        "mail|contact|write|reach",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        ".",
        "forall(split(m, '[.]'), o -> length(ltrim('0', o)) <= 3 AND coalesce(try_cast(o AS BIGINT), 256) <= 255)",
        0.6,
        "ip|host|server|address",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter runs fail the validator anyway
        "",
        f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})",
        0.8,
        "card|visa|credit|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        f"length({_DIGITS}) BETWEEN 10 AND 15",
        0.7,
        "phone|call|tel|mobile|fax",
    ),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", _IBAN, 0.8, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "m NOT RLIKE '^(000|666|9)' AND m NOT RLIKE '-00-|-0000$'", 0.4, "ssn|social|security"),
)
BASE = 4
SAMPLE_WORDS = "example|sample|test|dummy"


@dataclass(frozen=True)
class PiiRules:
    context: float = 0.2
    reach: int = 40
    min_score: float = 0.5


def _sql(pattern: str) -> str:
    return f"r'{pattern}'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, zero: str, step: str, emit: str, kind: str) -> str:
    """SQL array of ``emit`` for each item, with the state ``s`` before it; ``e`` is the item.

    ``step`` gives the state after an item. A first pass folds whole blocks to the
    state each begins with, a second emits inside the blocks, so no appending goes
    over more than a block.
    """
    width = "CAST(ceil(sqrt(size(items))) AS INT)"
    cut = f"transform(sequence(0, (size(items) - 1) DIV {width}), k -> slice(items, k * {width} + 1, {width}))"
    begins = (
        f"aggregate(blocks, array({zero}), (done, block) -> concat(done, array("
        f"aggregate(block, element_at(done, -1), (s, e) -> {step}))))"
    )
    inside = (
        f"aggregate(block, named_struct('s', first, 'out', CAST(array() AS ARRAY<{kind}>)), (a, e) -> "
        f"{_let('s', 'a.s', f"named_struct('s', {step}, 'out', concat(a.out, array({emit})))")}, a -> a.out)"
    )
    body = _let("blocks", cut, f"flatten(zip_with(blocks, slice({begins}, 1, size(blocks)), (block, first) -> {inside}))")
    return _let("items", items, f"CASE WHEN size(items) = 0 THEN CAST(array() AS ARRAY<{kind}>) ELSE {body} END")


def _found(kind: Kind, rank: int, p: PiiRules, always: bool) -> Column:
    """Array of (start, kind rank, end, score) of one kind; starts from 0, ends exclusive."""
    pattern = _sql(kind.pattern)
    # the pieces between matches give each match its place and the text before it; the last piece has no match after it
    pairs = _let(
        "hits",
        f"regexp_extract_all(text, {pattern}, 0)",
        f"zip_with(slice(split(text, {pattern}), 1, size(hits)), hits, (piece, hit) -> named_struct('piece', piece, 'hit', hit))",
    )
    placed = _scan(
        pairs,
        "named_struct('at', 0, 'tail', '')",
        f"named_struct('at', s.at + length(e.piece) + length(e.hit), 'tail', right(concat(s.tail, e.piece, e.hit), {p.reach}))",
        f"named_struct('b', s.at + length(e.piece), 'm', e.hit, 'near', lower(right(concat(s.tail, e.piece), {p.reach})))",
        "STRUCT<b: INT, m: STRING, near: STRING>",
    )
    score = (
        f"round({kind.score}D + CASE WHEN h.near RLIKE '({kind.words})' THEN {p.context}D ELSE 0D END "
        f"- CASE WHEN h.near RLIKE '({SAMPLE_WORDS})' THEN {p.context}D ELSE 0D END, 2)"
    )
    valid = f"filter({placed}, h -> {_on('h', kind.valid)})"
    scored = f"transform({valid}, h -> named_struct('start', h.b, 'kind', {rank}, 'stop', h.b + length(h.m), 'score', {score}))"
    if not always:
        scored = f"filter({scored}, s -> s.score >= {p.min_score})"
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, stop: INT, score: DOUBLE>>)"
    asked = f"contains(text, '{kind.hint}') AND " if kind.hint else ""
    return F.expr(f"CASE WHEN {asked}text RLIKE {pattern} THEN {scored} ELSE {empty} END")


def _on(var: str, sql: str) -> str:
    """The SQL with ``m`` read from a struct variable."""
    return re.sub(r"(?<![\w.'])\bm\b(?![\w'(])", rf"{var}.m", sql)


def _with_spans(df: DataFrame, p: PiiRules) -> DataFrame:
    """``df`` with columns c0, c1, ... for its own, ``text`` without null, and ``pii``.

    ``pii``: spans as structs (start, kind, stop, score), by start, then kind.
    """
    at = df.columns.index("text")
    own = [f"c{i}" for i in range(len(df.columns))]
    src = df.toDF(*own).select(*own, F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")).alias("text"))
    parts = [_found(k, i, p, i < BASE) for i, k in enumerate(KINDS)]
    return src.select(*own, "text", F.sort_array(F.concat(*parts)).alias("pii"))


def _text_form(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k.name}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.stop)), ',')"


def report(df: DataFrame, p: PiiRules = PiiRules()) -> DataFrame:
    """(doc_id, counts, digest of the base spans, all spans) for every row."""
    found = _with_spans(df.select("doc_id", "text"), p).withColumnRenamed("c0", "doc_id")
    counts = [F.expr(f"CAST(size(filter(pii, s -> s.kind = {i})) AS BIGINT)").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    base = f"filter(pii, s -> s.kind < {BASE})"
    return found.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({_text_form(base)}, 256)").alias("base_sha256"),
        F.expr(_text_form("pii")).alias("spans"),
        F.expr("round(coalesce(array_max(transform(pii, s -> s.score)), 0D), 2)").alias("max_score"),
    )


def redact(df: DataFrame, p: PiiRules = PiiRules()) -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, by the kind of the first. A null text
    stays null; columns and their order stay.
    """
    names = df.columns
    at = names.index("text")
    marks = "array(" + ", ".join(f"'<{k.name.upper()}>'" for k in KINDS) + ")"
    # a span that begins behind all ends so far begins a new mark, with the text between before it
    heads = _scan(
        "pii",
        "0",
        "greatest(s, e.stop)",
        f"named_struct('head', e.start >= s, 'a', s, 'b', e.start, 'mark', {marks}[e.kind])",
        "STRUCT<head: BOOLEAN, a: INT, b: INT, mark: STRING>",
    )
    # texts are cut in two steps, so that no piece is sought from the beginning of a long one
    width = "CAST(ceil(sqrt(size(heads))) AS INT)"
    blocks = f"transform(sequence(0, (size(heads) - 1) DIV {width}), k -> slice(heads, k * {width} + 1, {width}))"
    cut = _let(
        "part",
        "substring(text, block[0].a + 1, element_at(block, -1).b - block[0].a)",
        "array_join(transform(block, h -> concat(substring(part, h.a - block[0].a + 1, h.b - h.a), h.mark)), '')",
    )
    joined = f"concat(array_join(transform({blocks}, block -> {cut}), ''), substring(text, array_max(transform(pii, s -> s.stop)) + 1))"
    built = _let("heads", f"filter({heads}, h -> h.head)", joined)
    changed = F.expr(f"CASE WHEN size(pii) = 0 THEN c{at} ELSE {built} END")
    own = [f"c{i}" for i in range(len(names))]
    out = _with_spans(df, p).select(*[changed.alias(c) if i == at else F.col(c) for i, c in enumerate(own)])
    return out.toDF(*names)
