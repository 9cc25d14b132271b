"""The registered queries over the benchmark tables, and their SQL where SQL can say it.

No SQL: op1 (its rounding is random), op2 (mined rules), op3 and op5 (trained
models), op8 (HTML parsing), op9 (a tokenizer) and op10 (components); their tests
hold them against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantry.llm import bagsearch, bpe, brown, cascade, exact, htmlpaths, lines, minhash, mixing, secretscan, segments, toxicity, urls
from merchantry.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]

#: Shingles and similarity of op10's contract.
OP10 = minhash.NearConfig(words=4, percent=80)


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op3_brown_scores(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def toxic_model(docs: DataFrame, labels: DataFrame, conf: toxicity.ToxicConfig = toxicity.ToxicConfig()) -> toxicity.ToxicModel:
    """Learned from the labelled rows whose crc32(doc_id) mod 4 is not 2."""
    return toxicity.train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2), conf)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, conf = table(spark, folder, "documents"), toxicity.ToxicConfig()
    scored = toxicity.score(docs, toxic_model(docs, table(spark, folder, "labels"), conf), conf)
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= conf.threshold).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )


def op6_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.judge(table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmlpaths.extract(table(spark, folder, "pages"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, folder, "documents"))


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), OP10)


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x.rule == k)).cast("long")
    base = F.filter("secrets", lambda x: x.rule < len(secretscan.BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(secretscan.BASE)],
        F.sha2(secretscan.listed(base).cast("binary"), 256).alias("base_sha256"),
        secretscan.listed(F.col("secrets")).alias("spans"),
    )


def op12_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    return bagsearch.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows, seventh = table(spark, folder, "embeddings"), F.col("vec_id") % 7 == 0
    relabelled = rows.withColumn("label", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return segments.hard_negatives(relabelled, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_url_rules,
        op3_brown_scores,
        op4_exact_dedup,
        op5_toxicity,
        op6_quality_cascade,
        op7_line_dedup,
        op8_main_text,
        op9_bpe,
        op10_near_duplicates,
        op11_secrets,
        op12_bag_search,
        op13_hard_negatives,
    )
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_KINDS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "forge": "gh[opsur]_[A-Za-z0-9]{36,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "chat": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "cloud": "AIza[A-Za-z0-9_-]{35}",
    "payment": "[prs]k_live_[A-Za-z0-9]{16,}",
    "login": r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@",
}
_SECRETS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[:-2]) AS before,"
    f" unnest(regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0})) AS part, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i"
    f" FROM documents WHERE regexp_matches(text, '{p}')"
    for k, (kind, p) in enumerate(_KINDS.items())
)

SQL: dict[str, str] = {
    "op4_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
""",
    "op6_quality_cascade": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM grams),
marked AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM windows, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY doc_id),
lined AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lined.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words,
         length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^a-z]', '', 'g')) AS small
  FROM d LEFT JOIN lined USING (doc_id) LEFT JOIN marked USING (doc_id)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR capitals > small) AS kept
FROM based
""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {_LOWERED.format(f"trim(line, {_SPACES})")} AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, last_doc IS NOT NULL AND last_doc <> doc_id AS dropped FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_secrets": f"""
WITH hits AS ({_SECRETS}),
placed AS (SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM hits),
kept AS (
  SELECT doc_id, k, e - length(m) AS s, kind || ':' || (e - length(m)) || ':' || e AS span
  FROM placed WHERE k > 0 OR length(part) >= 12),
joined AS (
  SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c,
         string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
""",
    "op12_bag_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
words AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, stats GROUP BY term),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN weighed USING (term) JOIN counted USING (term), stats GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER w::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 50
""",
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM r a, r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> p.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
""",
}
