"""Exact duplicates by a minimal perfect hash over historical digests.

Digests are dealt to shards by their own bits.  In each shard a minimal perfect
hash is built: digests fall into small buckets, and for each bucket, largest
first, a pilot number is searched that sends its digests to free slots.  A slot
holds the full digest and the locator of the winner.  A lookup computes the slot
and compares all bytes; what is not a member is grouped among the newcomers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from merchantry.llm.common import SPACES, keep_rows, written

INDEX = "shard int, pilots binary, digests binary, n_points binary, doc_ids binary, sizes binary, has_id binary"
ENTRY = "digest binary, n_points long, doc_id long, size long"


@dataclass(frozen=True)
class ExactConfig:
    """Digests per shard of the index and per bucket of a shard, on average."""

    per_shard: int = 512
    per_bucket: int = 4


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_points): SHA-256 of the normalised text, code points of the original."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _digest(F.col("text")).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One entry per digest: the winner's locator (most code points, then smallest doc_id, null ids last) and the number of rows."""
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("low")))
    return rows.groupBy("digest").agg(best.alias("w"), F.count("*").alias("size")).select("digest", "w.n_points", (-F.col("w.low")).alias("doc_id"), "size")


def _lanes(digests_: np.ndarray) -> np.ndarray:
    """Three 64-bit numbers of each digest; its first eight bytes chose the shard."""
    return np.ascontiguousarray(digests_).view("<u8").reshape(-1, 4)[:, 1:]


def _slots(lanes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = lanes[:, 1] + pilots.astype(np.uint64) * (lanes[:, 2] | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_pilots(digests_: np.ndarray, per_bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(pilots per bucket, slot per digest) of distinct 32-byte digests: slots are 0 .. n-1, each once."""
    n, lanes = len(digests_), _lanes(digests_)
    n_buckets = max(1, -(-n // per_bucket))
    bucket = (lanes[:, 0] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
    members = np.split(order, ends[:-1])
    taken, slots, pilots = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n_buckets, np.uint32)
    for b in sorted(range(n_buckets), key=lambda x: -len(members[x])):
        own = lanes[members[b]]
        if not len(own):
            continue
        first, width = 0, 64
        while True:
            tries = np.arange(first, first + width)
            at = np.stack([_slots(np.broadcast_to(row, (width, 3)), tries, n) for row in own], axis=1)
            good = ~taken[at].any(axis=1)
            if len(own) > 1:
                ranked = np.sort(at, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                pilots[b], slots[members[b]], taken[at[k]] = tries[k], at[k], True
                break
            first, width = first + width, min(4096, width * 2)
    return pilots, slots


def _shard(n_shards: int) -> Column:
    lead = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return F.pmod(lead, F.lit(n_shards)).cast("int")


def build_index(entries: DataFrame, n_shards: int, conf: ExactConfig = ExactConfig()) -> DataFrame:
    """One row per shard of ``entries`` (digest, n_points, doc_id, size; digests distinct)."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, 32)
        pilots, slots = build_pilots(found, conf.per_bucket)
        at = np.argsort(slots)
        ids = pdf["doc_id"]
        columns = [found[at], pdf["n_points"].to_numpy(np.int64)[at], ids.fillna(0).to_numpy(np.int64)[at], pdf["size"].to_numpy(np.int64)[at], ids.notna().to_numpy()[at]]
        return pd.DataFrame([[key[0], pilots.tobytes(), *(c.tobytes() for c in columns)]], columns=["shard", "pilots", "digests", "n_points", "doc_ids", "sizes", "has_id"])

    return entries.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(build, INDEX)


def look_up(index: DataFrame, entries: DataFrame, n_shards: int) -> DataFrame:
    """Winners (digest, n_points, doc_id, size) after ``entries`` have met the index.

    A member's locator is compared with the slot's and sizes add up; nonmembers are
    returned as they are.  Both sides hold each digest once, so shards stay small.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        new = right[["digest", "n_points", "doc_id", "size"]]
        if left.empty:
            return new
        row = left.iloc[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        n, pilots = len(held), np.frombuffer(row["pilots"], np.uint32)
        points, ids, sizes, has = (np.frombuffer(row[c], t) for c, t in (("n_points", np.int64), ("doc_ids", np.int64), ("sizes", np.int64), ("has_id", bool)))
        old = pd.DataFrame({"digest": [d.tobytes() for d in held], "n_points": points, "doc_id": pd.Series(ids).astype("Int64").where(has), "size": sizes})
        if new.empty:
            return old
        asked = np.frombuffer(b"".join(new["digest"]), np.uint8).reshape(-1, 32)
        lanes = _lanes(asked)
        slot = _slots(lanes, pilots[(lanes[:, 0] % np.uint64(len(pilots))).astype(np.int64)], n)
        member = (held[slot] == asked).all(axis=1)
        known = new[member].set_index(slot[member])
        at = known.index
        old.loc[at, "size"] += known["size"]
        was, now = old.loc[at], known
        big = np.int64(2**63 - 1)
        before, after = was["doc_id"].astype("Int64").fillna(big), now["doc_id"].astype("Int64").fillna(big)
        wins = (now["n_points"] > was["n_points"]) | ((now["n_points"] == was["n_points"]) & (after < before))
        old.loc[at[wins.to_numpy(bool)], ["n_points"]] = now.loc[wins.to_numpy(bool), "n_points"]
        old.loc[at[wins.to_numpy(bool)], ["doc_id"]] = now.loc[wins.to_numpy(bool), "doc_id"].astype("Int64")
        return pd.concat([old, new[~member]], ignore_index=True)

    mine = entries.withColumn("shard", _shard(n_shards))
    return index.groupBy("shard").cogroup(mine.groupBy("shard")).applyInPandas(meet, ENTRY)


def winners(history: DataFrame, arrivals: DataFrame, conf: ExactConfig = ExactConfig()) -> DataFrame:
    """One winner per digest of both; ``history`` is indexed, ``arrivals`` are looked up (rows as from ``digests``)."""
    old = written(grouped(history), "history")
    n_shards = max(1, -(-old.count() // conf.per_shard))
    index = written(build_index(old, n_shards, conf), "digest-index")
    return look_up(index, grouped(arrivals), n_shards)


def exact_duplicates(docs: DataFrame, conf: ExactConfig = ExactConfig()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs`` (doc_id, text).

    Rows are dealt by a hash of their id into history, which is indexed, and
    arrivals, which are looked up.  Null and blank texts are equal to the empty
    text.  Rows with equal text and null doc_id lose against any id.  A row is kept
    if its doc_id is the group's keep_id; rows that repeat that doc_id are all marked
    (``drop_exact_duplicates`` leaves one).  Other columns are ignored.
    """
    rows = written(digests(docs), "digests")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    best = winners(rows.where(old), rows.where(~old), conf)
    best = written(best.select("digest", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size")), "winners")
    return rows.join(best, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, conf: ExactConfig = ExactConfig()) -> DataFrame:
    """One row of ``docs`` per normalised text, with its columns: the winner's.  Rows are told apart by text, so null and repeated ids lose none."""
    found = exact_duplicates(docs, conf).where("kept")
    keys = found.groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.count("*").alias("n"))
    return keep_rows(docs, _digest(F.col("text")), written(keys, "kept-rows"))
