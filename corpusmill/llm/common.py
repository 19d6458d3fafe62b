"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a map of numbers, and of its chunks.
MAP_BITS, CHUNK_BITS = 26, 15
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; one of our own only in a single JVM where it is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def freeing(df: DataFrame) -> DataFrame:
    """``df`` for one action, at whose end its shuffle files are removed; else they stay until the driver collects garbage.

    Spark reads the setting when the frame is made.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*")
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, and free the shuffle files before it."""
    checkpoint_dir(df.sparkSession)
    return freeing(df).checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words; of the whole sequence if it has fewer; none of nothing."""
    k = min(k, len(h))
    if k == 0:
        return np.empty(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix64(out * _GOLD + h[j : j + n])
    return out


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, at least one: polynomials in the words' hashes, put together by doubling."""
    n = len(h) - k + 1
    out, have, size, done = None, h, 1, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                piece = have[done : done + n]
                out = piece + np.uint64(k) if out is None else out * _power(size) + piece
                done += size
            if done == k:
                return mix64(out)
            have = have[: len(have) - size] * _power(size) + have[size:]
            size *= 2


@cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_GOLD), n, 1 << 64))


def one_text_an_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the smallest text of each id; only texts of repeated ids are shuffled."""
    again = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.take(1):
        return docs
    chosen = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(chosen)


def _chunks(batches):
    """(chunk, bits) of the map, where a bit is set."""
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    for pdf in batches:
        bits[pdf["bit"].to_numpy()] = True
    size = 1 << CHUNK_BITS
    used = np.flatnonzero(bits.reshape(-1, size).any(axis=1))
    yield pd.DataFrame({"chunk": used, "bits": [np.packbits(bits[c * size : (c + 1) * size]).tobytes() for c in used]})


def bit_map(rows: DataFrame, number: str):
    """Broadcast map of the low bits of a column of longs: its size is fixed, so collisions only cost time."""
    spark = rows.sparkSession
    bit = F.col(number).bitwiseAND(F.lit((1 << MAP_BITS) - 1)).cast("int")
    dealt = rows.select(bit.alias("bit")).repartition(shuffle_partitions(spark), F.shiftright("bit", CHUNK_BITS))
    size, bits = 1 << (CHUNK_BITS - 3), bytearray(1 << (MAP_BITS - 3))
    for r in freeing(dealt.mapInPandas(_chunks, "chunk int, bits binary")).collect():
        bits[r["chunk"] * size : (r["chunk"] + 1) * size] = r["bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def in_map(shared, numbers: np.ndarray) -> np.ndarray:
    """Whether the map has the low bits of each number (int64 or uint64)."""
    bits = np.frombuffer(shared.value, dtype=np.uint8)
    bit = (numbers.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (7 - (bit & 7))) & 1 == 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Alternates the large-star and small-star steps; each is one aggregation with map-side combine and one join, so a
    hub with very many links is split by the skew join and never gathered in one row.  The lineage is cut after each
    round, and only a count and a checksum reach the driver.  The rounds grow with the square of the logarithm of the ids at
    most, a few in practice; if ``max_rounds`` are not enough it raises.
    """
    cur = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u point to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: each id and the ids below it point to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        cur = materialize(small.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct())
        now = freeing(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))).collect()[0]
        if seen == tuple(now):
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    top = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return top.select(F.col("u").alias("id"), "component").unionByName(roots)


def groups_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, columns) of rows with equal keys from batches sorted by them; a group may go on in the next batch."""
    rest: list[dict[str, np.ndarray]] = []
    last = None

    def whole():
        return rest[0] if len(rest) == 1 else {c: np.concatenate([r[c] for r in rest]) for c in rest[0]}

    for pdf in batches:
        if not len(pdf):
            continue
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        values = [columns[k] for k in keys]
        change = np.zeros(len(pdf), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(v[start] for v in values)
            if last is not None and key != last:
                yield last, whole()
                rest = []
            last = key
            rest.append({c: v[start:stop] for c, v in columns.items()})
    if rest:
        yield last, whole()


def in_frames(parts: Iterator[dict[str, np.ndarray]], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small pieces of columns gathered into frames of about ``rows`` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(next(iter(part.values())))
        if n >= rows:
            yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            held, n = [], 0
    if n:
        yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})
