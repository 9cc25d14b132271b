"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule rejects documents.  On a sample every rule is timed and its share of
rejections counted; the cascade then asks the rules in order of rejections per
second, each only about the documents that no earlier rule rejected.  The order
changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SYMBOLS = b"#*$%&|<>"
NOT_SPACE = bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r")
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS, SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that is found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    windows = np.zeros(n, np.uint64)
    if len(known) < 1 << (63 // width):
        for j in range(width):
            windows = windows * np.uint64(len(known)) + ids[j : j + n]
    else:
        windows = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(n)], np.uint64)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(words), bool)
    for j in range(width):
        marked[j : j + n] |= twice
    return int(marked.sum())


class Text:
    """A document's counts, each made when first asked for."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    def __getattr__(self, name: str):
        value = COUNTS[name](self)
        setattr(self, name, value)
        return value


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


COUNTS: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.raw.split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.raw) - len(t.raw.translate(None, NOT_SPACE)) - (len(t.raw) - len(t.raw.translate(None, CONTINUATION))),
    "n_symbols": lambda t: len(t.raw) - len(t.raw.translate(None, SYMBOLS)),
    "n_lines": lambda t: t.raw.count(b"\n") + 1,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": lambda t: repeated_words(t.words),
    "n_capitals": lambda t: len(t.raw) - len(t.raw.translate(None, CAPITALS)),
    "n_small": lambda t: len(t.raw) - len(t.raw.translate(None, SMALL)),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The base rules of the contract, and the method's own.
BASE_RULES = (
    Rule("too_few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
OWN_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 30 * t.n_lines),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 14 * t.n_words),
    Rule("capitals", lambda t: t.n_capitals > t.n_small),
)


@dataclass(frozen=True)
class CascadeConfig:
    """``sample`` rows, those with the smallest hashes of their ids, are used to order the rules."""

    sample: int = 2000


def measured(docs: DataFrame, rules: tuple[Rule, ...], conf: CascadeConfig = CascadeConfig()) -> dict[str, tuple[float, float]]:
    """Per rule (seconds per document, share rejected) on a sample of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = dict.fromkeys((r.name for r in rules), 0.0)
        hits, seen = dict.fromkeys(spent, 0), 0
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                seen += 1
                for rule in rules:
                    text, began = Text(raw or b""), time.perf_counter()
                    hits[rule.name] += bool(rule.rejects(text))
                    spent[rule.name] += time.perf_counter() - began
        names = list(spent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([spent[n] for n in names]), pa.array([hits[n] for n in names], pa.int64()), pa.array([seen] * len(names), pa.int64())],
            names=["rule", "seconds", "rejected", "seen"],
        )

    total = docs.count()
    share = min(1.0, conf.sample / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    found = sample.mapInArrow(run, "rule string, seconds double, rejected long, seen long")
    rows = found.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n")).collect()
    return {r["rule"]: (r["s"] / r["n"], r["r"] / r["n"]) for r in rows if r["n"]}


def ordered(rules: tuple[Rule, ...], measures: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejections per second, highest first; rules without a measure last, ties by name."""

    def key(rule: Rule) -> tuple[float, str]:
        seconds, share = measures.get(rule.name, (1.0, 0.0))
        return (-share / max(seconds, 1e-9), rule.name)

    return tuple(sorted(rules, key=key))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
JUDGED = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def judge(docs: DataFrame, own: tuple[Rule, ...] = OWN_RULES, conf: CascadeConfig = CascadeConfig()) -> DataFrame:
    """(doc_id, counts, base_failed, kept) per row of ``docs`` (doc_id, text).

    A null or empty text has no words, fails the base rules and is not kept.  The
    cascade runs over the documents that pass the base rules.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [r.name for r in ordered(own, measured(rows, own, conf))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = sorted(own, key=lambda r: names.index(r.name))
        for batch in batches:
            counts: list[list[int]] = [[] for _ in COLUMNS]
            failed, kept = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                text = Text(raw or b"")
                for out, column in zip(counts, COLUMNS, strict=True):
                    out.append(getattr(text, column))
                failed.append(any(r.rejects(text) for r in BASE_RULES))
                kept.append(not failed[-1] and not any(r.rejects(text) for r in cascade))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=["doc_id", *COLUMNS, "base_failed", "kept"],
            )

    return rows.mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES, conf: CascadeConfig = CascadeConfig()) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns; here only what the cascade asks for is counted."""
    names = [r.name for r in ordered(rules, measured(docs, rules, conf))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = sorted(rules, key=lambda r: names.index(r.name))
        for batch in batches:
            raws = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            stay = [not any(r.rejects(text) for r in cascade) for text in (Text(raw or b"") for raw in raws)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
