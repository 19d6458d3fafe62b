"""MinHash near-duplicates with sequential Bayesian verification.

Every text becomes the set of its distinct ``k``-word shingles.  Texts with equal sets form one class, of which only the
smallest doc_id goes on.  128 min-hashes are banded 32 x 4; texts that share a band are candidates.  A candidate pair's
signatures are compared batch by batch, and the pair is dropped as soon as the posterior probability (uniform prior) of a
similarity at or above the threshold falls below ``MISS``.  Survivors are confirmed on the full sets.

Only connectivity is wanted, so a bucket of m texts never yields m*m pairs: first each bucket proposes its pivot to its
members.  Pivots come first in one order of all texts, so similar texts meet few of them; each text is tested against the
pivot that it meets in most bands.  Buckets that still hold several
components are cut into tiles, with the bucket's largest component on one side only, so it is never compared with itself.
A first pass carries signatures and keeps the texts with a promising partner; a second one carries their sets too, and
tests, confirms and links inside the tile, best pairs first.  Only a spanning forest leaves a tile, never its pairs.

Defined results: a null or empty text, or one of white space only, has no shingles and is linked with nothing (it is kept
as its own component); rows with the same doc_id are one node and each is returned; a null doc_id is returned with a null
component and kept false; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, connected_components, gram_hashes, groups_of, in_frames, in_map, materialize, mix64, shuffle_partitions, word_hashes

PERMUTATIONS, BANDS = 128, 32
ROWS = PERMUTATIONS // BANDS
BATCH = 32
#: Probability with which the sequential test may lose a pair at the threshold.
MISS = 1e-6
#: A side of a tile: texts while only signatures are compared, shingles once sets are carried.
TILE_TEXTS, TILE_SHINGLES = 1024, 1 << 19
_DOCS_AT_ONCE = 256


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes.  Words are runs of non-space ASCII-wise; A-Z are lower-cased."""
    return np.unique(gram_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split()), k))


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int = PERMUTATIONS) -> np.ndarray:
    """uint32 min-hashes, a row for each (non-empty) set."""
    out = np.empty((len(sets), n), dtype=np.uint32)
    if sets:
        values = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for j, a in enumerate(_multipliers(n)):
            out[:, j] = np.minimum.reduceat(((values * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def fewest_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """Fewest equal hashes among n for which P(similarity >= threshold) is at least ``miss``.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail at t is P(Binomial(n+1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _describe(k: int):
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), _DOCS_AT_ONCE):
                part = pdf.iloc[at : at + _DOCS_AT_ONCE]
                sets = [shingle_set(t, k) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full])
                keys = mix64(sig.reshape(-1, ROWS).astype(np.uint64) * _multipliers(ROWS))
                keys = np.bitwise_xor.reduce(keys, axis=1).reshape(-1, BANDS)
                keys = mix64(keys + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)  # a key belongs to one band
                low = np.hstack([sig.astype(np.uint8), keys.astype("<u4").view(np.uint8).reshape(len(sig), -1)])
                d1, d2 = [None] * len(sets), [None] * len(sets)
                bands, sigs = [None] * len(sets), [None] * len(sets)
                for row, i in enumerate(full):
                    digest = xxhash.xxh3_128_digest(sets[i].tobytes())
                    d1[i], d2[i] = (int(v) for v in np.frombuffer(digest, dtype=np.int64))
                    bands[i], sigs[i] = keys[row], low[row].tobytes()
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "no_id": part["no_id"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "d1": pd.array(d1, dtype="Int64"),
                        "d2": pd.array(d2, dtype="Int64"),
                        "sig": sigs,
                        "bands": bands,
                    }
                )

    return run


def _sets(k: int, wanted):
    """Full sets of the texts whose ids the map may hold."""

    def run(batches):
        for pdf in batches:
            some = pdf[in_map(wanted, mix64(pdf["doc_id"].to_numpy().view(np.uint64)))]
            yield pd.DataFrame({"doc_id": some["doc_id"], "shingles": [shingle_set(t, k).tobytes() for t in some["text"]]})

    return run


def _mixed(batches):
    for pdf in batches:
        yield pd.DataFrame({"mixed": mix64(pdf["doc_id"].to_numpy().view(np.uint64)).view(np.int64)})


def _unpacked(sigs) -> tuple[np.ndarray, np.ndarray]:
    """(low eighth of each hash, so that matches are never missed; low half of each band's key) of packed signatures."""
    both = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(-1, PERMUTATIONS + 4 * BANDS)
    return both[:, :PERMUTATIONS], np.ascontiguousarray(both[:, PERMUTATIONS:]).view("<u4")


def _promising(threshold: float):
    """Sequential test of signature batches."""
    least = {n: fewest_matches(n, threshold) for n in range(BATCH, PERMUTATIONS + 1, BATCH)}

    def run(batches):
        for pdf in batches:
            (a, _), (b, _) = _unpacked(pdf["sig_a"]), _unpacked(pdf["sig_b"])
            alive = np.arange(len(pdf))
            matches = np.zeros(len(pdf), dtype=np.int64)
            for n, fewest in least.items():
                s = slice(n - BATCH, n)
                matches[alive] += (a[alive, s] == b[alive, s]).sum(axis=1)
                alive = alive[matches[alive] >= fewest]
            yield pdf.iloc[alive]

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int):
    """The sequential test, then the exact check of its survivors."""
    test, check = _promising(percent / 100), _confirmed(percent)

    def run(batches):
        yield from check(test(batches))

    return run


def _confirmed(percent: int):
    def run(batches):
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["set_a"], pdf["set_b"]):
                ok.append(_linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent))
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


def _alive(left: dict, right: dict, key: int, least: dict[int, int]) -> tuple[np.ndarray, ...]:
    """(row of left, row of right, matches) of the pairs of different components that pass the sequential test.

    Pairs that an earlier band's bucket holds are left to it.
    """
    (a, keys_a), (b, keys_b) = _unpacked(left["sig"]), _unpacked(right["sig"])
    ca, cb = left["component"], right["component"]
    band = int(np.flatnonzero(keys_a[0] == np.uint32(int(key) & 0xFFFFFFFF))[0])
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    found = []
    step = max(1, (1 << 20) // max(1, len(cb)))
    for at in range(0, len(ca), step):
        rows = slice(at, at + step)
        on = ca[rows, None] != cb[None, :]
        for column in range(band):
            on &= keys_a[rows, column, None] != keys_b[None, :, column]
        matches = np.zeros(on.shape, dtype=np.uint8)
        for n, fewest in least.items():
            if not on.any():
                break
            for column in range(n - BATCH, n):
                matches += a[column, rows, None] == b[column, None, :]
            on &= matches >= fewest
        i, j = np.nonzero(on)
        found.append((i + at, j, matches[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile_sides(batches):
    """(key, left, right) of the tiles that have both sides."""
    for (key, _, _), rows in groups_of(batches, _TILE):
        side = rows["side"]
        left, right = ({c: v[side != other] for c, v in rows.items()} for other in (1, 0))
        if len(left["side"]) and len(right["side"]):
            yield key, left, right


def _with_partner(threshold: float):
    """The rows of a tile that have a promising partner."""
    least = {n: fewest_matches(n, threshold) for n in range(BATCH, PERMUTATIONS + 1, BATCH)}

    def found(batches):
        for key, left, right in _tile_sides(batches):
            i, j, _ = _alive(left, right, key, least)
            if len(i):
                ids = np.union1d(left["doc_id"][i], right["doc_id"][j])
                yield {"key": np.full(len(ids), key), "doc_id": ids}

    return lambda batches: in_frames(found(batches))


def _forest(percent: int):
    """Confirmed links of a tile that join components not joined before in it."""
    least = {n: fewest_matches(n, percent / 100) for n in range(BATCH, PERMUTATIONS + 1, BATCH)}

    def run(batches):
        for key, left, right in _tile_sides(batches):
            i, j, matches = _alive(left, right, key, least)
            ids, comps = ([d[c].tolist() for d in (left, right)] for c in ("doc_id", "component"))
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in d["shingles"]] for d in (left, right)]
            root, links = {}, []

            def find(x):
                while x in root:
                    x = root[x]
                return x

            for at in np.argsort(-matches.astype(np.int16), kind="stable"):
                x, y = i[at], j[at]
                a, b = find(comps[0][x]), find(comps[1][y])
                if a != b and _linked(sets[0][x], sets[1][y], percent):
                    root[max(a, b)] = min(a, b)
                    links.append((ids[0][x], ids[1][y]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _tiled(rows: DataFrame, weight: str, capacity: int) -> DataFrame:
    """Rows of buckets with several components, copied to their tiles (x, y).

    ``y`` numbers parts of the texts outside the bucket's largest component, ``x`` parts of that component and, after
    them, the same parts again.  Side 0 holds x, side 1 holds y, and 2 both, where a part meets itself.
    """
    own = rows.groupBy("key", "component").agg(F.sum(weight).alias("w"))
    sized = own.groupBy("key").agg(
        F.max_by("component", F.struct("w", "component")).alias("main"), F.max("w").alias("inner"), F.sum("w").alias("all"), F.count("*").alias("n")
    )
    part = lambda w: F.greatest(F.lit(1), F.ceil(w / capacity)).cast("int")
    sized = materialize(sized.where("n > 1").select(
        "key", "main", part(F.col("inner")).alias("gm"), part(F.col("all") - F.col("inner")).alias("go")
    ))
    rows = rows.join(sized, "key")
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    at = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    zero, one, two = (F.lit(v).cast("int") for v in range(3))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    inner = F.transform(upto("go"), lambda y: at(mine("gm"), y, zero))
    outer = F.concat(
        F.transform(upto("gm"), lambda x: at(x, mine("go"), one)),
        F.transform(upto("go"), lambda y: at(
            F.col("gm") + F.least(y, mine("go")), F.greatest(y, mine("go")),
            F.when(y == mine("go"), two).when(y > mine("go"), zero).otherwise(one),
        )),
    )
    tiles = rows.withColumn("t", F.explode(F.when(F.col("component") == F.col("main"), inner).otherwise(outer)))
    tiles = tiles.select("*", "t.x", "t.y", "t.side").drop("t", "main", "gm", "go", weight)
    return tiles.repartition(shuffle_partitions(rows.sparkSession), *_TILE).sortWithinPartitions(*_TILE)


_TILE = ["key", "x", "y"]


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


class _Linker:
    """Confirms candidate pairs and carries the components found so far."""

    def __init__(self, active: DataFrame, percent: int):
        self.active, self.percent = active, percent
        self.components: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Test and check in one pass: for pairs most of which will stand."""
        full = self.active.select("doc_id", "sig", "shingles")
        both = pairs.join(full.toDF("a", "sig_a", "set_a"), "a").join(full.toDF("b", "sig_b", "set_b"), "b")
        return both.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInPandas(_verified(self.percent), "a long, b long")

    def add(self, links: DataFrame) -> None:
        if self.components is None:
            self.components = materialize(connected_components(links))
            return
        c = self.components
        ends = links.join(c.toDF("a", "ca"), "a", "left").join(c.toDF("b", "cb"), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = connected_components(ends).toDF("component", "root")
        known = c.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        new = merged.select(F.col("component").alias("id"), F.col("root").alias("component"))
        self.components = materialize(known.unionByName(new).groupBy("id").agg(F.min("component").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # pandas would turn ids beside a null into floats
    marked = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    described = marked.mapInPandas(
        _describe(k), "doc_id long, no_id boolean, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"
    )
    base = materialize(described.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id"))
    known = base.where("n_shingles > 0 and doc_id is not null")
    # repeated rows of an id count once; without any, nothing is shuffled for that
    again = materialize(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    repeated = bool(again.take(1))
    if repeated:
        once = known.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
        known = known.join(again, "doc_id", "left_anti").unionByName(once)
    # tables of their own, so that the joins with them can split a hot class or bucket
    classes = materialize(known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    members = known.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"])
    members = materialize(members.select("doc_id", "rep").distinct())
    reps = known.join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    pivots = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("pivot")
    )
    buckets = materialize(rows.join(materialize(pivots.where("size > 1")), "key"))

    ids = materialize(buckets.select("doc_id").distinct())
    wanted = bit_map(ids.mapInPandas(_mixed, "mixed long"), "mixed")
    texts = docs.where("doc_id is not null and text is not null").mapInPandas(_sets(k, wanted), "doc_id long, shingles binary")
    texts = texts.distinct() if repeated else texts
    some = reps.select("doc_id", "sig", "n_shingles").join(ids, "doc_id")
    active = materialize(texts.join(some, "doc_id"))
    link = _Linker(active, percent)

    # 1. each text against the pivot that it meets in most bands
    met = buckets.where("doc_id != pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("bands"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("p"))).alias("m"))
    link.add(link.verified(_ordered(best.select("doc_id", (-F.col("m.p")).alias("pivot")), "doc_id", "pivot")))

    # 2. buckets that still hold several components
    comp = link.components.toDF("doc_id", "component")
    seen = buckets.select("key", "doc_id").join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    seen = materialize(seen.join(mixed.where("lo < hi").select("key"), "key"))
    tiles = _tiled(seen.join(active.select("doc_id", "sig"), "doc_id").withColumn("one", F.lit(1)), "one", TILE_TEXTS)
    some = tiles.mapInPandas(_with_partner(percent / 100), "key long, doc_id long").distinct()
    seen = materialize(seen.join(some, ["key", "doc_id"]))
    tiles = _tiled(seen.join(active, "doc_id"), "n_shingles", TILE_SHINGLES)
    link.add(tiles.mapInPandas(_forest(percent), "a long, b long"))

    comp = link.components.toDF("rep", "component")
    found = members.join(comp, "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id")
    )
    out = base.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
