"""DataFrame -> DataFrame operators."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# Keyword lists and bounds of the cleaning configuration.  Slurs are a parameter without a default.
HARMFUL = (
    "how to make a bomb", "how to manufacture drugs", "self-harm instructions", "suicide methods", "how to hack into",
    "exploit vulnerability", "build a weapon", "incite violence", "terrorist propaganda", "buy illegal drugs",
)
SLANG = ("finna", "gonna", "lemme", "wanna", "ain't")
LENGTH = (200, 100_000)


def clean(docs: DataFrame, offensive=(), length=LENGTH, rules=None) -> DataFrame:
    """Add cleaned text, cleaning_status and the first cleaning_reason; no row is lost and no shuffle is needed."""
    c = F.col("cleaned")
    reasons = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty")
    reasons = reasons.when(c.rlike(T.any_of(HARMFUL)), "harmful")
    if offensive:
        reasons = reasons.when(c.rlike(T.any_of(offensive, True)), "offensive")
    reasons = reasons.when(c.rlike(T.any_of(SLANG, True)), "slang")
    reasons = reasons.when(~F.char_length(c).between(*length), "length")
    out = docs.withColumn("cleaned", T.apply_rules(F.col("text"), T.all_rules() if rules is None else rules))
    out = out.withColumn("cleaning_reason", reasons)
    return out.withColumn("cleaning_status", F.when(F.col("cleaning_reason").isNull(), "kept").otherwise("removed"))


def dedup_exact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row with the smallest key of each text; only digests are shuffled for the decision."""
    first = docs.groupBy(F.sha2(text, 256).alias("h")).agg(F.min(key).alias(key))
    return docs.join(first.select(key), key, "left_semi")


def shingles(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, shingle) of the distinct k-word shingles."""
    words = F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))
    rows = docs.select("doc_id", words.alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= k)
    return rows.select("doc_id", F.explode(F.array_distinct(grams)).alias("shingle"))


def _bands(permutations: int, rows: int):
    """Function of a column of hash sets giving a key a band, in Arrow batches."""
    rng = random.Random(permutations)
    orders = np.array([rng.getrandbits(64) for _ in range(permutations)], dtype=np.uint64)[:, None]

    def keys(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            values, least = np.asarray(s).astype(np.int64).view(np.uint64), np.full(permutations, np.iinfo(np.uint64).max)
            for at in range(0, len(values), 4096):
                # xor with a constant orders all hashes anew, so the smallest is a sample of the set like any min-hash
                least = np.minimum(least, (values[None, at : at + 4096] ^ orders).min(axis=1))
            mixed, factor = np.arange(permutations // rows, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
            for r in range(rows):
                mixed = (mixed ^ least[r::rows]) * factor
                mixed = mixed ^ (mixed >> np.uint64(29))
            out.append(mixed.view(np.int64))
        return pd.Series(out)

    return F.pandas_udf(keys, "array<long>")


def minhash_pairs(docs: DataFrame, threshold: float = 0.85, permutations: int = 128, rows: int = 4, k: int = 5) -> DataFrame:
    """(a, b, jaccard) at the threshold.  Shingles stay in arrays and signatures are made in Arrow batches, so only band keys are shuffled; texts with equal sets
    meet once, by a digest, and their copies are joined on at the end; candidates are verified exactly."""
    words = F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))
    sets = docs.select("doc_id", words.alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= k)
    sets = sets.select("doc_id", F.array_sort(F.array_distinct(grams)).alias("s")).withColumn("d", F.xxhash64(F.lit(1), "s"))
    members = sets.select("doc_id", "d", F.xxhash64("s").alias("d2"))
    reps = members.groupBy("d", "d2").agg(F.min("doc_id").alias("rep"))
    members = members.join(reps, ["d", "d2"]).select("rep", "doc_id")
    one = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = _bands(permutations, rows)(F.col("s"))
    keys = one.select("doc_id", F.explode(bands).alias("band"))
    left, right = keys.toDF("a", "band"), keys.toDF("b", "band")
    pairs = left.join(right, "band").where("a < b").select("a", "b").distinct()
    full = one.select("doc_id", "s")
    both = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    near = both.select("a", "b", (inter / (F.size("sa") + F.size("sb") - inter)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    near = near.unionByName(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard")))
    x, y = members.toDF("a", "x"), members.toDF("b", "y")
    out = near.join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def seen_shingles(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, total, seen): shingles that an earlier document has; the exact form of a Bloom-filter pass."""
    grams = docs.transform(shingles, k)
    first = grams.groupBy("shingle").agg(F.min("doc_id").alias("first"))
    return grams.join(first, "shingle").groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("first") < F.col("doc_id")).alias("seen")
    )


def hash_split(rows: DataFrame, key: str, seed: str = "42", shares=(0.8, 0.9)) -> DataFrame:
    """Add split: distinct keys ranked by a seeded hash, cut at the shares.  Ranks come from buckets of the hash, so no
    task orders all keys; only the bucket counts are gathered."""
    spark = rows.sparkSession
    keys = rows.select(key).distinct().withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    keys = keys.withColumn("bucket", F.substring("h", 1, 2))
    counts = {r["bucket"]: r["count"] for r in keys.groupBy("bucket").count().collect()}
    total, before, starts = sum(counts.values()), 0, []
    for b in sorted(counts):
        starts.append((b, before))
        before += counts[b]
    starts_df = F.broadcast(spark.createDataFrame(starts or [("", 0)], "bucket string, before long"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h")) - 1 + F.col("before")
    keys = keys.join(starts_df, "bucket").withColumn("rank", rank)
    first, second = int(total * shares[0]), int(total * shares[1])
    split = F.when(F.col("rank") < first, "train").when(F.col("rank") < second, "valid").otherwise("test")
    return rows.join(keys.select(key, split.alias("split")), key)


def sample_per_group(rows: DataFrame, group: str, key: str, n: int = 50, seed: str = "42", salts: int = 16) -> DataFrame:
    """n rows of each group by a seeded hash; the n first of each salted part are taken before the group is ordered."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    rows = rows.withColumn("__h", h).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = Window.partitionBy(group, "__s").orderBy("__h")
    rows = rows.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h")))
    return rows.where(F.col("__r") <= n).drop("__h", "__s", "__r")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, checkpoint=lambda df: df) -> DataFrame:
    """(url, depth) of the pages reached from the seeds, one row a normalised URL; a round is a join and an anti join."""
    known = pages.select(U.url_normalize(F.col("url")).alias("url"), F.col("url").alias("page_url"), "html").dropDuplicates(["url"])
    frontier = seeds.select(U.url_normalize(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for depth in range(1, max_depth + 1):
        links = frontier.join(known, "url").select("page_url", F.explode(U.html_links(F.col("html"))).alias("href"))
        found = links.select(U.url_normalize(U.url_absolute(F.col("page_url"), F.col("href"))).alias("url")).distinct()
        frontier = checkpoint(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def topk_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """First run, last two, and the k best of either kind; stable, then base runs before tuned ones with x positions.
    ``runs`` (run_dir, ts, model, score) is one row a benchmark run, so one ordered window is enough."""
    order = Window.orderBy(F.coalesce("ts", F.lit("")), "run_dir")
    rows = runs.withColumn("idx", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    rows = rows.withColumn("is_sft", F.contains("model", F.lit("-SFT"))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy("is_sft").orderBy(F.desc("score"), "idx"))
    rows = rows.withColumn("best", best).where((F.col("idx") == 0) | (F.col("idx") >= F.col("n") - 2) | (F.col("best") <= k))
    place = F.row_number().over(Window.partitionBy("is_sft").orderBy("idx")) - 1
    base = F.count_if(~F.col("is_sft")).over(Window.partitionBy())
    x = F.when(F.col("is_sft"), base + 1.2 + place).otherwise(place.cast("double"))
    return rows.select("run_dir", "model", "score", "is_sft", "idx", x.alias("x"))


def bench_stats(scores: DataFrame, category: str = "category", score: str = "score") -> DataFrame:
    """Totals, average and full/partial/wrong counts and shares, by category and (category null) over all."""
    s = F.col(score)
    sets = scores.rollup(category).agg(
        F.grouping_id().alias("level"), F.count("*").alias("total"), F.avg(s).alias("average"), F.count_if(s == 1).alias("full"),
        F.count_if(s == 0.5).alias("partial"), F.count_if(s == 0).alias("wrong"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0)
    return sets.select("*", *(share(c).alias(f"{c}_pct") for c in ("full", "partial", "wrong")))


def pack_blocks(tokens: DataFrame, block: int = 2048, end_id: int = 0, order: str = "doc_id", salts: int = 64) -> DataFrame:
    """(block, ids): token arrays with an end id, concatenated and cut; the short tail is kept.  Offsets are running sums
    within ranges of the order plus the sums of the ranges before, so no task sees the whole order."""
    spark = tokens.sparkSession
    rows = tokens.select(F.col(order), F.concat("ids", F.array(F.lit(end_id))).alias("ids"))
    cuts = rows.agg(F.percentile_approx(order, [i / salts for i in range(1, salts)], 10 * salts)).first()[0] or []
    part = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<long>"), lambda b: b <= F.col(order)))
    rows = rows.withColumn("part", part)
    sums = sorted(rows.groupBy("part").agg(F.sum(F.size("ids"))).collect())
    starts, before = [], 0
    for p, n in sums:
        starts.append((p, before))
        before += n
    starts_df = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part int, before long"))
    w = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(F.size("ids")).over(w), F.lit(0))).join(starts_df, "part")
    at, size = F.col("before") + F.col("within"), F.size("ids")
    rows = rows.select(at.alias("at"), "ids", (at + size).alias("end"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)
    rows = rows.select("at", "ids", "end", F.explode(F.sequence(first, last)).alias("block"))
    # a document's part of a block is one slice of its array
    start, stop = F.greatest("at", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    piece = F.slice("ids", (start - F.col("at") + 1).cast("int"), (stop - start).cast("int"))
    slices = rows.select("block", F.struct(start.alias("at"), piece.alias("ids")).alias("piece"))
    blocks = slices.groupBy("block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return blocks.select("block", F.flatten(F.transform("pieces", lambda t: t["ids"])).alias("ids"))


def _ranges(rows: DataFrame, key: Column, n: int) -> Column:
    """The number of the range of ``key``, among about ``n`` of equal size, that a row lies in."""
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda b: b <= key))


def lag_equal(rows: DataFrame, key: str, value: str, ranges: int = 200) -> DataFrame:
    """Add ``same``: whether the row before in the order of ``key`` (a distinct long) has the same value.  Each range of the
    key is ordered by itself; only the last value of each range is gathered."""
    rows = rows.withColumn("__part", _ranges(rows, F.col(key), ranges))
    before, earlier = None, []
    for r in sorted(rows.groupBy("__part").agg(F.max_by(value, key).alias("last")).collect()):
        earlier.append((r["__part"], before))
        before = r["last"]
    earlier = F.broadcast(rows.sparkSession.createDataFrame(earlier or [(0, None)], "__part int, __before string"))
    order = Window.partitionBy("__part").orderBy(key)
    rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__lag", F.lag(value).over(order)).join(earlier, "__part")
    same = F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__lag")) == F.col(value)
    return rows.withColumn("same", F.coalesce(same, F.lit(False))).drop("__part", "__n", "__lag", "__before")


def global_rank(rows: DataFrame, measure: str, key: str, ranges: int = 200) -> DataFrame:
    """Add ``rank`` from 1 in the order of (measure, key), key a distinct long.  Rows are ranked within ranges of the key for
    each measure, so a frequent measure is split; the ranges' counts, few as they are, are summed in order."""
    rows = rows.withColumn("__part", _ranges(rows, F.col(key), ranges))
    sums = rows.groupBy(measure, "__part").agg(F.count("*").alias("__c"))
    order = Window.orderBy(measure, "__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__c").over(order), F.lit(0))).drop("__c")
    within = F.row_number().over(Window.partitionBy(measure, "__part").orderBy(key))
    rows = rows.withColumn("__w", within).join(sums, [measure, "__part"])
    return rows.withColumn("rank", (F.col("__before") + F.col("__w")).cast("long")).drop("__part", "__w", "__before")
