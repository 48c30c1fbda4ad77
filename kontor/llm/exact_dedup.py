"""Exact duplicates through a minimal perfect hash over the distinct digests of a history.

The digests are dealt to small shards. Each shard's hash is a cascade of bit arrays: a key settles in the first level
where it has a bit to itself, and the number of bits set before it is its slot. Slots hold the full digest and the
locator of the winner. A lookup compares all bytes of the digest, so a text that history lacks is never taken for a
member; nonmembers are grouped among themselves.

Texts are equal when they are so without their white space; null counts as empty. Of equal texts the row with the most
characters stays, then the smallest id; a null id comes last. Rows that are alike in id and text stay or go together
in ``exact_groups``; ``deduplicated`` keeps one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.llm.common import SPACE, attach, stored, text_of

SHARD_KEYS = 1024
LEVELS = 48
_INDEX = "shard long, levels binary, level_bits array<int>, digests binary, keep_ids array<long>, lengths array<long>, rows array<long>"
_FOUND = "digest binary, member boolean, keep_id long, length long, rows long, own_id long, own_length long, own_rows long"


def _mixed(halves: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 128 bits of each digest, another one for each level."""
    x = halves[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + halves[:, 1]
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :16]).view("<u8")


def perfect_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of every (distinct) digest: 0..n-1 without gaps."""
    left, levels = np.arange(len(digests)), []
    slots, base = np.zeros(len(digests), np.int64), 0
    halves = _halves(digests)
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("digests are not distinct")
        size = max(64, 2 * len(left))
        at = (_mixed(halves[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slots


def slots_of(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of every digest, -1 where no level has its bit; a nonmember may be given any slot."""
    out, base, open_ = np.full(len(digests), -1, np.int64), 0, np.arange(len(digests))
    halves = _halves(digests)
    for level, bits in enumerate(levels):
        at = (_mixed(halves[open_], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        open_ = open_[~hit]
    return out


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("digest", ignore_index=True)
    digests = _matrix(shard["digest"])
    levels, slots = perfect_hash(digests)
    order = np.argsort(slots)
    ids = shard["own_id"].astype("Int64").iloc[order]
    return pd.DataFrame([{
        "shard": int(shard["shard"].iloc[0]), "levels": np.packbits(np.concatenate(levels)).tobytes(),
        "level_bits": [len(x) for x in levels], "digests": digests[order].tobytes(),
        "keep_ids": [None if x is pd.NA else int(x) for x in ids],
        "lengths": shard["own_length"].iloc[order].tolist(), "rows": shard["own_rows"].iloc[order].tolist()}])


def _lookup(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    out = asked[["digest", "own_id", "own_length", "own_rows"]].copy()
    out["own_id"] = out["own_id"].astype("Int64")
    member, places, held = np.zeros(len(out), bool), np.zeros(len(out), np.int64), None
    if len(index) and len(out):
        held = index.iloc[0]
        edges = np.cumsum(held["level_bits"])[:-1]
        bits = np.unpackbits(np.frombuffer(held["levels"], np.uint8), count=int(sum(held["level_bits"]))).astype(bool)
        wanted, stored_digests = _matrix(out["digest"]), np.frombuffer(held["digests"], np.uint8).reshape(-1, 32)
        slots = slots_of(np.split(bits, edges), wanted)
        places = np.maximum(slots, 0)
        member = (slots >= 0) & (stored_digests[places] == wanted).all(axis=1)
    out["member"] = member
    for name, column in (("keep_id", "keep_ids"), ("length", "lengths"), ("rows", "rows")):
        out[name] = pd.array([held[column][p] if m else None for m, p in zip(member, places)], "Int64")
    return out[["digest", "member", "keep_id", "length", "rows", "own_id", "own_length", "own_rows"]]


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE}+", "").cast("binary"), 256))


def text_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, length, digest) of every row."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.length(text_of(text)).cast("long").alias("length"),
                       text_digest(text_of(text)).alias("digest"))


def _candidates(digests: DataFrame) -> DataFrame:
    """One row per digest: how many rows have it, and the one to stay."""
    first = F.min(F.struct((-F.col("length")).alias("short"), F.col("doc_id").isNull().alias("last"), "doc_id"))
    return digests.groupBy("digest").agg(first.alias("best"), F.count(F.lit(1)).alias("own_rows")).select(
        "digest", F.col("best.doc_id").alias("own_id"), (-F.col("best.short")).alias("own_length"), "own_rows")


def history_index(digests: DataFrame, shard_keys: int = SHARD_KEYS, asked_rows: int = 0) -> tuple[DataFrame, int]:
    """The perfect hash of all distinct digests, one row per shard, and the number of shards.

    ``asked_rows`` is how many digests will be looked up at most: a short history is spread as wide as these need.
    """
    members = stored(_candidates(digests), "members")
    shards = max(1, math.ceil(max(members.count(), asked_rows) / shard_keys))
    dealt = members.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return stored(dealt.groupBy("shard").applyInPandas(_build, _INDEX), "digest-index"), shards


def looked_up(digests: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, keep_length, group_size, member) of every distinct digest asked for."""
    asked = _candidates(digests).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    found = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_lookup, _FOUND)
    pick = lambda held, own: F.when(F.col("member"), F.col(held)).otherwise(F.col(own))
    return found.select("digest", pick("keep_id", "own_id").alias("keep_id"), pick("length", "own_length").alias("keep_length"),
                        pick("rows", "own_rows").alias("group_size"), "member")


def exact_groups(docs: DataFrame, history: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    ``history`` holds the documents that came before (and are in ``docs`` no more): their winners stay, and texts that
    it has are repeats. Without it, the table is its own history.
    """
    own = stored(text_digests(docs, text, key), "digests")
    index, shards = history_index(own) if history is None else history_index(text_digests(history, text, key), asked_rows=own.count())
    verdict = looked_up(own, index, shards)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if history is not None:
        kept = kept & ~F.col("member")
    return attach(own, verdict, "digest").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    own = stored(text_digests(docs, text, key), "digests")
    index, shards = history_index(own)
    stay = stored(looked_up(own, index, shards).select(
        F.col("digest").alias("__stay_digest"), F.col("keep_id").alias("__stay_id"), F.col("keep_length").alias("__stay_length")), "stay")
    names = docs.columns
    tagged = docs.withColumns({"__digest": text_digest(text_of(text)), "__length": F.length(text_of(text)).cast("long")})
    # every key names one winner, so no key is hot unless the very same row is repeated
    left = tagged.join(stay, F.col(key).cast("long").eqNullSafe(F.col("__stay_id")) & (F.col("__digest") == F.col("__stay_digest"))
                       & (F.col("__length") == F.col("__stay_length")), "left_semi")
    one = W.partitionBy(F.col(key).cast("long"), "__digest", "__length").orderBy("__length")
    return left.withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(*[F.col(f"`{c}`") for c in names])
