"""URL filters: listed rules, and association rules mined from labelled URLs.

FP-growth finds the token combinations that go with a label.  Rules are pruned by
support and confidence, and a rule is dropped if a part of it says the same as
surely.  An inverted index posts each rule under its rarest token; a URL meets
the rules of its tokens there, and those that it contains in full decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from merchantry.llm.common import ascii_lower, written


@dataclass(frozen=True)
class UrlConfig:
    """Rules are (host, path, verdict); ``support`` and ``confidence`` prune what is mined.

    A token set that at least ``hot_share`` of the undecided URLs have is hot; there
    are 1 / hot_share hot sets at most.
    """

    rules: tuple[tuple[str, str, str], ...] = (
        ("net", "/", "block"),
        ("example.net", "/en/", "allow"),
        ("example.com", "/de/", "block"),
        ("org", "/fr/", "allow"),
    )
    support: float = 0.002
    confidence: float = 0.8
    default: str = "allow"
    hot_share: float = 0.001


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent of it, and whose path starts the URL's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rhost, rpath, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        rule, verdict = F.when(fits, rhost + rpath).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host endings of each length (``h:``) and path segments with their depth; digits become 0."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))
    endings = F.when(F.size(labels) > 0, endings).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    return F.array_distinct(F.concat(endings, segments))


def mine(labelled: DataFrame, conf: UrlConfig = UrlConfig()) -> DataFrame:
    """Rules (rule_id, needs, says, confidence, support) from (needs: array of tokens, says: label)."""
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "needs array<string>, says string, confidence double, support double, rule_id long")
    items = labelled.select(F.concat("needs", F.array(F.concat(F.lit("="), "says"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=conf.support, minConfidence=conf.confidence).fit(items)
    # an itemset with its label over the same itemset without it is the rule's confidence
    is_label = lambda x: x.startswith("=")
    label = F.array_max(F.filter("items", is_label))
    sets = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("needs"), F.substring(label, 2, 1 << 30).alias("says"), "freq")
    sets = written(sets.where("size(needs) > 0"), "itemsets")
    wholes = sets.where("says is null").select("needs", F.col("freq").alias("total"))
    rules = sets.where("says is not null").join(wholes, "needs").withColumn("confidence", F.col("freq") / F.col("total"))
    rules = rules.where(F.col("confidence") >= conf.confidence).select("needs", "says", "confidence", (F.col("freq") / n).alias("support"))
    rules = written(rules, "rules")
    # a rule with one token less, of the same label and no less sure, makes it superfluous
    shorter = rules.where("size(needs) > 1").select("needs", "says", "confidence", F.explode("needs").alias("t"))
    shorter = shorter.select("needs", "says", "confidence", F.array_remove("needs", F.col("t")).alias("part"))
    known = rules.select(F.col("needs").alias("part"), "says", F.col("confidence").alias("c"))
    idle = shorter.join(known, ["part", "says"]).where("c >= confidence").select("needs", "says").distinct()
    rules = rules.join(idle, ["needs", "says"], "left_anti")
    return rules.withColumn("rule_id", F.xxhash64("needs", "says"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(needs, rule_needs, says, confidence) of the best rule that each distinct token array of ``sets`` contains.

    Best is the surest, then the best supported, then the longest, then the first by tokens and label.
    Postings go to as many slots as a shuffle has partitions and each set asks one slot,
    so a token of all URLs is met in many tasks.
    """
    slots = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = rules.select("rule_id", F.explode("needs").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = rules.select("*", F.explode("needs").alias("token")).join(postings, "token")
    index = index.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("post"), F.first("needs").alias("rule_needs"), F.first("says").alias("says"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    index = index.select(F.col("post.token").alias("token"), "rule_needs", "says", "confidence", "support")
    index = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    asked = sets.select("needs", F.pmod(F.xxhash64("needs"), F.lit(slots)).cast("int").alias("slot"), F.explode("needs").alias("token"))
    hits = asked.join(index, ["token", "slot"]).where(F.size(F.array_except("rule_needs", "needs")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("rule_needs"), F.array_join("rule_needs", " "), F.col("says"))
    best = hits.groupBy("needs").agg(F.min_by(F.struct("rule_needs", "says", "confidence"), order).alias("b"))
    return best.select("needs", "b.rule_needs", "b.says", "b.confidence")


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, conf: UrlConfig = UrlConfig()) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) per row of ``pages`` (page_id, url).

    A listed rule decides where one fits.  The others are decided by rules mined from
    labelled URLs: ``labels`` (url, says), or the URLs that listed rules decided.
    ``mined`` is the rule that decided, null if none fits and the default holds.  Null
    URLs, and those without ``://``, have empty parts and get the default.
    """
    rows = pages.select("page_id", "url")
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = listed(F.col("host"), F.col("path"), conf.rules)
    rows = written(rows.select("*", rule.alias("rule"), says.alias("says"), F.array_sort(tokens(F.col("host"), F.col("path"))).alias("needs")), "urls")
    if labels is None:
        known = rows.where("says is not null").select("needs", "says")
    else:
        lhost, lpath = parts(F.col("url"))
        known = labels.where("says is not null").select(lhost.alias("host"), lpath.alias("path"), "says")
        known = known.select(F.array_sort(tokens(F.col("host"), F.col("path"))).alias("needs"), "says")
    rules = written(mine(known, conf), "url-rules")
    # equal token sets are matched once; hot ones go back by broadcast, the others by a shuffle
    open_rows = rows.where("says is null")
    hot_rows = F.lit(conf.hot_share * open_rows.count())
    sets = written(open_rows.groupBy("needs").agg((F.count("*") >= hot_rows).alias("hot")), "url-sets")
    best = match(sets, rules).withColumnRenamed("says", "mined_says")
    best = written(sets.join(best, "needs", "left"), "url-matches")
    hot, others = F.broadcast(best.where("hot")), best.where("not hot")
    found = open_rows.join(hot, "needs").unionByName(open_rows.join(hot.select("needs"), "needs", "left_anti").join(others, "needs", "left"))
    found = found.unionByName(rows.where("says is not null"), allowMissingColumns=True)
    return found.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("says", "mined_says", F.lit(conf.default)).alias("verdict"),
        F.array_join("rule_needs", " ").alias("mined"),
        "confidence",
    )
