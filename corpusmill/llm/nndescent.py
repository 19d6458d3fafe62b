"""Near-duplicate embeddings by NN-descent.

Vectors with equal components form one class.  A forest of random hyperplanes starts the neighbour graph: vectors are
sorted by their sign code in each tree and compared within overlapping blocks of the sorted order, so equal codes never
make a large block.  NN-descent rounds then refine the lists: every vector introduces its neighbours (and those that list
it) to each other, where one of them is new to it, and an introduction counts if it beats the worst entry of a list.
Lists hold the ``K`` nearest with a cosine of ``FLOOR`` or more: two vectors linked to a common one at 0.95 have at least
2*0.95^2-1 = 0.805, so what the floor leaves out can't introduce a link.

Links are counted from the lists.  A list full of links is saturated and may hide more, so it is enlarged to all of its
component.  The component's core, the vectors within half the threshold's angle of the mean of its saturated vectors, are
all linked with each other, so they are counted without comparing them.  Other saturated vectors are compared with the
whole component in square tiles, which only counts leave.

The recall is audited against brute force on ``AUDIT`` vectors and as many linked ones, over their links and over the
vectors; below ``RECALL`` the forest is doubled, and after ``ATTEMPTS`` it raises.  Without any link there is nothing to audit.

Defined results: null, zero and empty vectors, and those with null or non-finite components, link with nothing; vectors
of different length are never compared; rows with the same vec_id and vector are counted as copies; of different vectors
of one vec_id one is compared, by a hash, and the others link with nothing; a null vec_id gives a null component and kept
false, and links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, groups_of, in_frames, materialize, shuffle_partitions

THRESHOLD, FLOOR, K = 0.95, 0.8, 16
BLOCK, TILE = 256, 512
CODE_BITS = 48
ROUNDS, CHANGED = 4, 0.002
AUDIT, RECALL, ATTEMPTS = 256, 0.98, 4
#: Vectors this near to a common one are linked with each other; a little more, for rounding.
_HALF = sqrt((1 + THRESHOLD) / 2) + 1e-9
#: Probability of a pair at the threshold to lie on one side of a random hyperplane, and the miss the forest aims at.
_SAME_SIDE = 1 - float(np.arccos(THRESHOLD)) / np.pi
_MISS = 0.005


def _normed(rows) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(dim: int, tree: int) -> np.ndarray:
    return np.random.default_rng([dim, tree, 7]).standard_normal((dim, CODE_BITS))


def _packed(batches):
    """Components as bytes of doubles."""
    for pdf in batches:
        yield pd.DataFrame(
            {"id": pdf["id"], "m": pdf["m"], "dim": [len(v) for v in pdf["v"]], "v": [np.asarray(v, dtype=np.float64).tobytes() for v in pdf["v"]]}
        )


def _codes(trees: int):
    weights = np.int64(1) << np.arange(CODE_BITS, dtype=np.int64)

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = _normed(part["v"].tolist())
                for tree in range(trees):
                    code = (x @ _planes(int(dim), tree) > 0) @ weights
                    yield pd.DataFrame({"dim": part["dim"], "tree": tree, "code": code, "id": part["id"], "v": part["v"]})

    return run


def _best(ids: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
    """The K nearest of each row at FLOOR or more; the diagonal is left out."""
    np.fill_diagonal(sims, -2.0)
    k = min(K, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, near, axis=1)
    row, col = np.nonzero(value >= FLOOR)
    return pd.DataFrame({"a": ids[row], "b": ids[near[row, col]], "sim": value[row, col]})


def _blocks(batches):
    for (dim, tree), pdf in _chunks(batches):
        if len(pdf) > 1:
            x = _normed(pdf["v"].tolist())
            yield _best(pdf["id"].to_numpy(), x @ x.T)


def _chunks(batches):
    """Blocks of the sorted order, each overlapping half of the one before."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        for key, part in pdf.groupby(["dim", "tree"], sort=False):
            if held is not None and (held["dim"].iloc[0], held["tree"].iloc[0]) == key:
                part = pd.concat([held, part])
            elif held is not None:
                yield (held["dim"].iloc[0], held["tree"].iloc[0]), held
            while len(part) >= BLOCK:
                yield key, part.iloc[:BLOCK]
                part = part.iloc[BLOCK // 2 :]
            held = part
    if held is not None and len(held):
        yield (held["dim"].iloc[0], held["tree"].iloc[0]), held


def _introduce(batches):
    for _, rows in groups_of(batches, ["u"]):
        ids, fresh = rows["id"], rows["fresh"]
        if len(ids) > 1 and fresh.any():
            x = _normed(rows["v"].tolist())
            sims = x @ x.T
            sims[~(fresh[:, None] | fresh[None, :])] = -2.0
            found = _best(ids, sims)
            worst = rows["worst"][np.searchsorted(ids, found["a"])]
            yield found[found["sim"].to_numpy() > worst]


def _sums(batches):
    """(component, sum of its normed vectors) of each batch."""
    for pdf in batches:
        for (component, dim), part in pdf.groupby(["component", "dim"]):
            yield pd.DataFrame({"component": [component], "dim": [dim], "v": [_normed(part["v"].tolist()).sum(axis=0).tobytes()]})


def _centres(batches):
    for (component, dim), rows in groups_of(batches, ["component", "dim"]):
        total = np.frombuffer(b"".join(rows["v"]), dtype=np.float64).reshape(len(rows["v"]), -1).sum(axis=0)
        yield pd.DataFrame({"component": [component], "centre": [total.tobytes()]})


def _in_core(batches):
    """Whether each vector is within half the angle of its component's centre."""
    for pdf in batches:
        for _, part in pdf.groupby("dim"):
            near = (_normed(part["v"].tolist()) * _normed(part["centre"].tolist())).sum(axis=1) >= _HALF
            yield part.drop(columns="centre").assign(core=near)


def _tiles(threshold: float):
    """Links of the wide vectors (x) with all of their component (y), counted for both sides but not twice."""

    def counted(batches):
        for _, rows in groups_of(batches, ["component", "x", "y"]):
            left, right = ({c: v[rows["side"] == side] for c, v in rows.items()} for side in (0, 1))
            if len(left["id"]) and len(right["id"]):
                linked = _normed(left["v"].tolist()) @ _normed(right["v"].tolist()).T >= threshold
                linked &= left["id"][:, None] != right["id"][None, :]
                yield {"id": left["id"], "links": linked @ right["m"]}
                other = ~right["wide"]
                yield {"id": right["id"][other], "links": left["m"] @ linked[:, other]}

    return lambda batches: in_frames(counted(batches))


def _audit(shared, threshold: float):
    def run(batches):
        ids, vectors = shared.value
        total = np.zeros(len(ids), dtype=np.int64)
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                mine = [i for i, v in enumerate(vectors) if len(v) == 8 * dim]
                if mine:
                    linked = _normed([vectors[i] for i in mine]) @ _normed(part["v"].tolist()).T >= threshold
                    linked &= ids[mine][:, None] != part["id"].to_numpy()[None, :]
                    total[mine] += linked @ part["m"].to_numpy()
        yield pd.DataFrame({"id": ids, "links": total})

    return run


def forest_size(n: int) -> int:
    """Trees for which a pair at the threshold shares a block in one of them but for a chance of _MISS."""
    together = _SAME_SIDE ** max(0.0, log2(max(n, 1) / (BLOCK / 2)))
    return max(4, ceil(log(_MISS) / log(1 - min(together, 0.9))))


def _nearest(edges: DataFrame) -> DataFrame:
    """The K nearest of each vector; an entry stays fresh unless it was there before."""
    edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= K).drop("r")


def neighbour_graph(vectors: DataFrame, trees: int) -> DataFrame:
    """(a, b, sim): neighbour lists after NN-descent over (id, m, dim, v)."""
    parts = shuffle_partitions(vectors.sparkSession)
    coded = vectors.mapInPandas(_codes(trees), "dim int, tree int, code long, id long, v binary")
    ordered = coded.repartitionByRange(parts, "dim", "tree", "code", "id").sortWithinPartitions("dim", "tree", "code", "id")
    graph = ordered.mapInPandas(_blocks, "a long, b long, sim double").withColumn("fresh", F.lit(True))
    graph = materialize(_nearest(graph))
    size = graph.count()
    for _ in range(ROUNDS):
        # who takes part in u's introductions: its neighbours, and as many of those that list it, by a hash
        back = graph.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))))
        members = graph.select(F.col("a").alias("u"), F.col("b").alias("id"), "fresh").unionByName(
            back.where(F.col("r") <= K).select(F.col("b").alias("u"), F.col("a").alias("id"), "fresh")
        )
        members = members.groupBy("u", "id").agg(F.max("fresh").alias("fresh"))
        full = graph.groupBy("a").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= K)
        state = vectors.select("id", "v").join(full.select(F.col("a").alias("id"), "worst"), "id", "left")
        state = state.withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        members = members.join(state, "id").repartition(parts, "u").sortWithinPartitions("u", "id")
        found = members.select("u", "id", "fresh", "worst", "v").mapInPandas(_introduce, "a long, b long, sim double")
        known = graph.withColumn("fresh", F.lit(False))
        graph = materialize(_nearest(known.unionByName(found.withColumn("fresh", F.lit(True)))))
        changed = graph.where("fresh").count()
        if changed <= CHANGED * size:
            break
        size = graph.count()
    return graph.drop("fresh")


def _link_counts(vectors: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, component, links) of the vectors that have a link."""
    parts = shuffle_partitions(vectors.sparkSession)
    links = graph.where(F.col("sim") >= THRESHOLD).select("a", "b")
    components = materialize(connected_components(links))
    full = links.groupBy("a").count().where(F.col("count") >= K).select(F.col("a").alias("id"), F.lit(True).alias("full"))
    rows = vectors.join(components, "id").join(full, "id", "left")
    rows = materialize(rows.withColumn("full", F.coalesce("full", F.lit(False))))
    # the core of each component with saturated lists
    sums = rows.where("full").select("component", "dim", "v").mapInPandas(_sums, "component long, dim int, v binary")
    sums = sums.repartition(parts, "component").sortWithinPartitions("component", "dim")
    centres = materialize(sums.mapInPandas(_centres, "component long, centre binary"))
    near = rows.join(centres, "component").select("id", "component", "m", "dim", "v", "full", "centre")
    near = near.mapInPandas(_in_core, "id long, component long, m long, dim int, v binary, full boolean, core boolean")
    dense = materialize(near.select("id", "component", "m", "v", "core", (F.col("full") & ~F.col("core")).alias("wide")))
    within = dense.where("core").groupBy("component").agg(F.sum("m").alias("all"))
    counted = [dense.where("core").join(within, "component").select("id", (F.col("all") - F.col("m")).alias("links"))]
    # the saturated vectors outside it against their component
    part = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
    sized = dense.groupBy("component").agg(F.count_if("wide").alias("w"), F.count("*").alias("n"))
    sized = materialize(sized.where("w > 0").select("component", part(F.col("w")).alias("gw"), part(F.col("n")).alias("ga")))
    spread = dense.join(sized, "component")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread.where("wide").select("component", mine("gw").alias("x"), upto("ga").alias("y"), F.lit(0).alias("side"), "id", "m", "v", "wide")
    right = spread.select("component", upto("gw").alias("x"), mine("ga").alias("y"), F.lit(1).alias("side"), "id", "m", "v", "wide")
    tiles = left.unionByName(right).repartition(parts, "component", "x", "y").sortWithinPartitions("component", "x", "y")
    counted.append(tiles.mapInPandas(_tiles(THRESHOLD), "id long, links long"))
    # all other links are in the lists
    kinds = rows.select("id", "m").join(dense.where("core or wide").select("id", "core", "wide"), "id", "left")
    kinds = materialize(kinds.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("core", "wide")}))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.join(kinds.select(F.col("id").alias("a"), F.col("core").alias("core_a"), F.col("wide").alias("wide_a")), "a")
    both = both.join(kinds.select(F.col("id").alias("b"), "core", "wide", "m"), "b")
    rest = both.where("not wide and not wide_a and not (core and core_a)")
    counted.append(rest.select(F.col("a").alias("id"), F.col("m").alias("links")))
    total = counted[0].unionByName(counted[1]).unionByName(counted[2]).groupBy("id").agg(F.sum("links").alias("links"))
    return components.join(total, "id")


def _audit_sample(vectors: DataFrame) -> list:
    return vectors.orderBy(F.xxhash64("id", F.lit("audit"))).limit(AUDIT).select("id", "v").collect()


def _recall(vectors: DataFrame, found: DataFrame) -> tuple[float, float]:
    """Shares of the links of the audited vectors that were found: over all links, and the mean over vectors."""
    linked = vectors.join(found.select("id"), "id", "left_semi")
    sample = {r["id"]: bytes(r["v"]) for r in [*_audit_sample(vectors), *_audit_sample(linked)]}
    ids = np.array(list(sample), dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, list(sample.values())))
    brute = vectors.mapInPandas(_audit(shared, THRESHOLD), "id long, links long").groupBy("id").agg(F.sum("links"))
    true = {r[0]: r[1] for r in brute.collect() if r[1]}
    got = {r["id"]: r["links"] for r in found.where(F.col("id").isin(*map(int, ids))).select("id", "links").collect()}
    kept = {i: min(n, got.get(i, 0)) for i, n in true.items()}
    return (sum(kept.values()) / sum(true.values()), sum(kept[i] / true[i] for i in true) / len(true)) if true else (1.0, 1.0)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid).withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit("vector"), "v")})
    # classes are known by two hashes of the vector, which are small to group and to join by
    named = rows.where("valid").groupBy("vec_id", "d1", "d2").agg(F.count("*").alias("m"))
    own = named.groupBy("vec_id").agg(F.min(F.struct("d1", "d2")).alias("d"))
    named = named.join(own, "vec_id").where("d1 = d.d1 and d2 = d.d2").drop("d")
    classes = materialize(named.groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.sum("m").alias("m")))
    first = rows.where("valid").join(classes, ["d1", "d2"]).where("vec_id = id").dropDuplicates(["id"])
    vectors = materialize(first.select("id", "m", "v").mapInPandas(_packed, "id long, m long, dim int, v binary"))
    trees = forest_size(vectors.count())
    for _ in range(ATTEMPTS):
        found = materialize(_link_counts(vectors, neighbour_graph(vectors, trees)))
        shares = _recall(vectors, found)
        if min(shares) >= RECALL:
            break
        trees *= 2
    else:
        raise ValueError(f"of the audited vectors' links {shares[0]:.3f} were found, {shares[1]:.3f} by vector, with {trees // 2} trees")
    by_class = classes.join(found, "id", "left").select(
        "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    compared = named.join(by_class, ["d1", "d2"]).select("vec_id", "d1", "d2", "n_links", "component_id")
    out = rows.where("valid").select("vec_id", "d1", "d2").join(compared, ["vec_id", "d1", "d2"], "left")
    lone = rows.where("not valid").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(lone)
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
