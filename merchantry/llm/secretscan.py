"""Secrets in texts by a trigram inverted index.

What a rule's regex must hold is turned into a Boolean query of trigrams: whichever
way the regex matches, all trigrams of one of the query's alternatives are in the
text.  An index lists the texts of each trigram; intersecting its postings gives the
candidates of a rule, and only those are searched with the regex itself.  A rule that
has to hold no trigram is run over every text.

Texts are known by a hash.  Two texts with one hash only share candidates, and the
regex tells them apart, so results do not hang on it.  All of it is DataFrame
functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from merchantry.llm.common import LOWER, UPPER, ascii_lower, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (syntax that Java and Python share, no flags but a leading ``(?i)`` for ASCII letters), of which ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # a run that is too short matches nowhere inside itself either, so the length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Forms of keys as their issuers document them.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[prs]k_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)
RULES = BASE + ADDED

# trigram queries -------------------------------------------------------------------
#: Alternatives, each a set of trigrams that all have to be there.  One without a trigram lets everything pass.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings that a part of a regex may spell, members of a character class, and alternatives of a query: beyond these a part asks for less.
MOST_STRINGS, MOST_MEMBERS, MOST_ALTERNATIVES = 64, 8, 256


def _least(query: Query) -> Query:
    """Without alternatives that ask for more than another one."""
    return frozenset(q for q in query if not any(other < q for other in query))


def _both(a: Query, b: Query) -> Query:
    product = _least(frozenset(x | y for x in a for y in b))
    return product if len(product) <= MOST_ALTERNATIVES else min(a, b, key=len)


def _spelled(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _lower(c: int) -> str:
    return chr(c).translate(str.maketrans(UPPER, LOWER))


def _members(items: list) -> set[str] | None:
    """The lower-cased members of a small character class, else None."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(_lower(value))
        elif op is sre.RANGE and value[1] - value[0] < 4 * MOST_MEMBERS:
            found |= {_lower(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_MEMBERS else None


def _part(op, value) -> tuple[set[str] | None, Query]:
    """What one node of a regex can spell, if that is little, and what it asks for."""
    if op is sre.LITERAL:
        return {_lower(value)}, ANY
    if op is sre.IN:
        return _members(value), ANY
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        each = [_sequence(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in each) and sum(len(strings) for strings, _ in each) <= MOST_STRINGS:
            return set().union(*(strings for strings, _ in each)), ANY
        return None, _least(frozenset().union(*(query if strings is None else _spelled(strings) for strings, query in each)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ANY
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            return reduce(lambda made, _: {a + b for a in made for b in strings}, range(least), {""}), ANY
        return None, ANY if least == 0 else query if strings is None else _spelled(strings)
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    query, run, whole = ANY, {""}, True
    for op, value in nodes:
        strings, asked = _part(op, value)
        joined = {a + b for a in run for b in strings} if strings is not None and len(run) * len(strings) <= MOST_STRINGS else None
        if joined is None:  # what was spelled up to here is asked for, and spelling begins anew
            query, whole = _both(_both(query, _spelled(run)), asked), False
            run = strings if strings is not None else {""}
        else:
            run = joined
    return (run, ANY) if whole else (None, _both(query, _spelled(run)))


def trigram_query(pattern: str) -> Query:
    """What lower-cased texts that the pattern matches must hold; :data:`ANY` if nothing."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _spelled(strings)


# index and search -----------------------------------------------------------------------------
def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def trigram_index(docs: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """(trigram, h): each distinct trigram of each text, lower-cased, with the text's hash.

    ``wanted`` keeps the index to those trigrams; others that no rule asks for are then
    not even gathered.  One pass over a text finds them, overlapping ones too.
    """
    any_of = "..." if wanted is None else "|".join(rf"\Q{t}\E" for t in sorted(wanted))
    text = text_of(docs)
    grams = F.regexp_extract_all(ascii_lower(text), F.lit(f"(?s)(?=({any_of}))"), F.lit(1))
    return docs.select(F.explode(F.array_distinct(grams)).alias("trigram"), F.xxhash64(text).alias("h")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(h, kinds): for which rules a text's trigrams satisfy the query."""
    rows = [(kind, i, t, len(need)) for kind, query in queries.items() for i, need in enumerate(sorted(query, key=sorted)) for t in sorted(need)]
    asked = index.sparkSession.createDataFrame(rows, "kind string, alternative int, trigram string, need int")
    met = index.join(F.broadcast(asked), "trigram").groupBy("h", "kind", "alternative").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    return met.where("n = need").groupBy("h").agg(F.collect_set("kind").alias("kinds"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)


def ends(steps: Column, block: int = 256) -> Column:
    """Running sums of an array, in time that grows with its length: within blocks, after the sums of the blocks before."""

    def summed(blocks: Column) -> Column:
        after = lambda x, base: F.transform(x, lambda _, i: base + total(F.slice(x, 1, i + 1)))
        return let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda x, b: let(total(F.slice(sums, F.lit(1), b)), lambda base: after(x, base)))))

    def cut(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, F.lit(block)))

    return let(steps, lambda s: let(cut(s), summed))


SPANS = "array<struct<start:bigint,rule:int,end:bigint>>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Where the rule's matches are, in code points, end exclusive: a text is what lies between the matches and the matches in turn."""
    none = F.array().cast(SPANS)
    pattern = F.lit(rule.pattern)

    def placed(found: Column) -> Column:
        groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else found
        measured = F.zip_with(
            F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct((F.length(p) + F.length(m)).cast("long").alias("step"), F.length(m).alias("long"))),
            groups,
            lambda x, g: F.struct(x.step.alias("step"), x.long.alias("long"), F.length(g).alias("group")),
        )
        ended = let(measured, lambda x: F.zip_with(x, ends(F.transform(x, lambda y: y.step)), lambda y, e: F.struct((e - y.long).alias("start"), F.lit(number).alias("rule"), e.alias("end"), y.group.alias("group"))))
        kept = F.filter(ended, lambda x: x.group >= rule.least)
        return F.transform(kept, lambda x: F.struct(x.start.alias("start"), x.rule.alias("rule"), x.end.alias("end")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found).cast(SPANS)))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, secrets) per row of ``docs`` (doc_id, text): ``secrets`` lists (start, rule, end) of all matches by start, then by the rule's place in ``rules``.

    Matches of one rule do not overlap, those of several may.  A null or empty text has
    none.  Rows are kept as they are, with null and repeated ids and repeated texts;
    other columns are not looked at.  An empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q != ANY}
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    if indexed:
        wanted = sorted(set().union(*(need for q in indexed.values() for need in q)))
        index = written(trigram_index(cut, wanted), "trigrams")
        # written, so that Spark knows its size when it picks a join
        chosen = written(candidates(index, indexed), "secret-candidates")
        cut = cut.withColumn("h", F.xxhash64("text")).join(chosen, "h", "left")
    found = [F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r, i)).otherwise(F.array().cast(SPANS)) if r.kind in indexed else spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    return cut.select("doc_id", F.array_sort(F.concat(*found)).alias("secrets"))


def listed(secrets: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", F.element_at(kinds, x.rule + 1), x.start.cast("string"), x.end.cast("string"))), ",")
