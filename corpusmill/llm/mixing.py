"""Mixing sources to target weights by Poisson replication.

A source with weight w among the listed ones and n of their N documents gets the mean repetition rate w * N / n.  Each
document's number of copies inverts the Poisson distribution of that mean at a uniform number hashed from (seed, doc_id),
so it is the same in every run and on any partitioning.  Copies are exploded and shuffled globally by another hash.

Only one count a listed source reaches the driver; the rates are literals of the plan, so there is no join and no skew by
source.  The inversion adds up the distribution's terms from their logarithms, between bounds of its tails: the
work for a row is at most in proportion to its copies, whatever the rate.

Defined results: sources that aren't listed, null ones included, have ``other_rate``; a listed source without documents has
none; rows with the same doc_id get the same number of copies; rows with a null doc_id are known by their text instead;
other columns are carried along, but columns named copy or shuffle_key are replaced.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, shuffle_partitions

SEED = "mix-1"
#: Production weights: the same for each of twenty sources.
WEIGHTS = {f"src{i}": 0.05 for i in range(20)}
_UNIT = float(1 << 52)


def hashed_uniform(seed: str, *keys: str | Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("long") / F.lit(_UNIT)


def log_term(rate: Column, k: Column) -> Column:
    """Logarithm of P(X = k): by the factorial of small k, else by Stirling's series about the mean."""
    x = k.cast("double")
    small = x * F.log(rate) - rate - F.log(F.factorial(F.least(k, F.lit(15))).cast("double"))
    over = rate - x
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    large = x * F.log1p(over / x) - over - F.log(F.lit(2 * pi) * x) / 2 - series
    return F.when(k < 16, small).otherwise(large)


def poisson_count(rate: Column, u: Column) -> Column:
    """How many values P(X <= 0), P(X <= 1), ... of the Poisson distribution with that mean are at most ``u`` (0 <= u < 1)."""
    # below ``first`` P(X <= k) <= exp(-x*x / (2 * rate)) is under any hashed u but 0
    first = F.greatest(F.lit(0), F.floor(rate - 9.2 * F.sqrt(rate)) - 1).cast("int")
    # P(X >= rate + x) <= exp(-x*x / (2 * (rate + x/3))) (Bernstein), so no more than rate + x can be counted
    spare = F.greatest(-F.log1p(-u), F.lit(0.0))
    last = F.ceil(rate + spare / 3 + F.sqrt(spare * spare / 9 + 2 * rate * spare)).cast("int") + 1

    def step(state: Column, k: Column) -> Column:
        total = state["total"] + F.exp(log_term(rate, k))
        return F.struct(total.alias("total"), (state["n"] + (total <= u).cast("int")).alias("n"))

    start = F.struct(F.lit(0.0).alias("total"), first.alias("n"))
    return F.when((rate > 0) & (u > 0), F.aggregate(F.sequence(first, last), start, step, lambda s: s["n"])).otherwise(0)


def target_rates(counts: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    listed = {s: counts[s] for s in weights if counts.get(s)}
    total, weight = sum(listed.values()), sum(weights[s] for s in listed)
    return {s: weights[s] / weight * total / n for s, n in listed.items()}


def replicate(docs: DataFrame, weights: dict[str, float] = WEIGHTS, seed: str = SEED, other_rate: float = 1.0) -> DataFrame:
    """All columns of ``docs`` plus copy (from 0) and shuffle_key, globally shuffled."""
    found = docs.where(F.col("source").isin(*weights)).groupBy("source").count().collect()
    rates = target_rates({r["source"]: r["count"] for r in found}, weights)
    rate = F.lit(float(other_rate))
    if rates:
        known = F.create_map(*(F.lit(x) for s, r in rates.items() for x in (s, float(r))))
        rate = F.coalesce(F.try_element_at(known, F.col("source")), rate)
    n, r, u = (free_name(docs, x) for x in ("n", "rate", "u"))
    known_by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))) if "text" in docs.columns else F.lit(""))
    rows = docs.drop("copy", "shuffle_key").withColumns({r: rate, u: hashed_uniform(seed, known_by)})
    copies = rows.withColumn(n, poisson_count(F.col(r), F.col(u))).where(F.col(n) > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "/order"), known_by, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    copies = copies.withColumn("shuffle_key", key).drop(n, r, u)
    return copies.repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
