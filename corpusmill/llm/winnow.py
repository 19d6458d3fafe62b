"""Document fingerprints by winnowing, in DataFrame functions only.

A text's units are its lower-cased words (runs of non-space); words of over ``LONG`` characters, and all words of texts of
under ``SHORT``, give their characters instead, so texts without spaces and short ones have grams too.  Units are hashed; rolling hashes of all ``K`` consecutive units are built by
doubling; of each ``WINDOW`` consecutive ones the smallest is chosen, the rightmost among equals, and kept with its
position.  So two texts that share ``WINDOW + K - 1`` units in a row share a fingerprint entry, whose positions place
the match.  Doubling takes log2 steps over whole arrays: no row is exploded and nothing is quadratic in the text.

``with_next`` pairs each document with the one after it by doc_id (the last with the first).  Rows are dealt to ranges of
doc_id whose bounds are ids of the table, rows without an id to ranges of a hash of their text; the first row of each
range is sent to the range before it as well, so one shuffle of the texts is enough and no task sees the whole order.

Defined results: null texts count as empty; a text without words has an empty fingerprint, one with fewer than K units that
of the longest runs that doubling can build; likeness of two empty fingerprints is 1, of an empty and another one 0.  Rows are ordered by (doc_id, text);
rows with a null doc_id come first, by a hash of their text.  A single row is its own next document.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions

#: Units in a gram and grams in a window: powers of two.
K, WINDOW = 4, 4
#: Characters of the longest word that is one unit, and of the shortest text that has such units: half of it, all that an
#: edit leaves, holds WINDOW + K - 1 of them.
LONG, SHORT = 12, 200
#: Low bits of a packed value, for positions: more than a text can have words.
_POSITION_BITS = 30
_MASK = (1 << _POSITION_BITS) - 1


def _doubled(size: int, merge) -> list:
    """Steps that turn an array into the merge of each ``size`` consecutive elements; shorter arrays stop early."""
    steps, have = [], 1
    while have < size:
        shift = have

        def step(c: Column, shift=shift) -> Column:
            both = F.zip_with(F.slice(c, 1, F.size(c) - shift), F.slice(c, shift + 1, F.size(c) - shift), merge)
            return F.when(F.size(c) > shift, both).otherwise(c)

        steps.append(step)
        have *= 2
    return steps


def fingerprints(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<hash long, position int>>, by position."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(rf"(?<!\S)\S{{1,{LONG}}}(?!\S)|\S"), F.lit(0))
    words = F.when(F.char_length(text) < SHORT, F.regexp_extract_all(low, F.lit(r"\S"), F.lit(0))).otherwise(words)
    tmp = f"__{out}"
    df = df.withColumn(tmp, F.transform(words, lambda w: F.xxhash64(w)))
    for step in _doubled(K, lambda a, b: F.xxhash64(a, b)):
        df = df.withColumn(tmp, step(F.col(tmp)))
    packed = F.transform(tmp, lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.lit(_MASK) - i.cast("long")))
    low = f"{tmp}_low"
    df = df.withColumn(low, packed)
    for step in _doubled(WINDOW, lambda a, b: F.least(a, b)):
        df = df.withColumn(low, step(F.col(low)))
    df = df.withColumn(low, F.transform(F.array_distinct(low), lambda p: (F.lit(_MASK) - p.bitwiseAND(F.lit(_MASK))).cast("int")))
    entry = F.transform(low, lambda p: F.struct(F.get(tmp, p).alias("hash"), p.alias("position")))
    return df.withColumn(out, entry).drop(tmp, low)


def text_of(fingerprint: str | Column) -> Column:
    """The entries as HASH:position, in hexadecimal and decimal, in the order of positions."""
    return F.array_join(F.transform(fingerprint, lambda e: F.concat_ws(":", F.hex(e["hash"]), e["position"].cast("string"))), " ")


def hashes(fingerprint: str | Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda e: e["hash"]))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Dice likeness of two arrays of distinct hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def _among(bounds: list[int], key: Column) -> Column:
    """The number of the range that begins at the largest bound up to ``key``."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= key)) - 1


def _bounds(rows: DataFrame, key: Column) -> list[int]:
    """The smallest keys of about as many ranges as there are partitions; none of an empty table."""
    parts = shuffle_partitions(rows.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    about = rows.agg(F.percentile_approx(key, shares, 100 * parts)).first()[0] or []
    # percentiles pass through doubles, so the ranges' own smallest keys are looked up
    least = rows.groupBy(_among(sorted(set(about)), key).alias("range")).agg(F.min(key).alias("least"))
    return sorted(r["least"] for r in least.collect())


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, real, part): ``real`` is false on the copies that only end a range."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # two orders, one after the other: rows without an id by a hash of the text, the others by id
    lone = F.col("doc_id").isNull()
    ids = _bounds(docs.where(~lone), F.col("doc_id"))
    texts = _bounds(docs.where(lone), F.xxhash64("text"))
    docs = docs.withColumns({"lone": lone, "key": F.when(lone, F.xxhash64("text")).otherwise(F.col("doc_id"))})
    part = F.when(F.col("lone"), _among(texts, F.col("key"))).otherwise(_among(ids, F.col("key")) + len(texts))
    docs = docs.withColumn("part", part)
    starts = F.when(F.col("lone"), F.col("key").isin(texts)).otherwise(F.col("key").isin(ids))
    before = F.pmod(F.col("part") - 1, F.lit(max(1, len(ids) + len(texts)))).cast("int")
    here = F.struct(F.col("part").alias("part"), F.lit(True).alias("real"))
    there = F.struct(before.alias("part"), F.lit(False).alias("real"))
    rows = docs.select("doc_id", "key", "text", F.explode(F.when(starts, F.array(here, there)).otherwise(F.array(here))).alias("x"))
    rows = rows.select("doc_id", "key", "text", "x.part", "x.real")
    order = Window.partitionBy("part").orderBy(F.desc("real"), "key", "text")
    return rows.withColumn("next_text", F.lead("text").over(order))


def edited(text: str = "text", next_text: str = "next_text") -> Column:
    """The last half of the code points replaced by the first as many of the next document."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col(next_text), F.lit(1), half))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next document."""
    rows = fingerprints(with_next(docs), "text", "fp").withColumn("fp_hashes", hashes("fp"))
    order = Window.partitionBy("part").orderBy(F.desc("real"), "key", "text")
    rows = rows.withColumn("next_hashes", F.lead("fp_hashes").over(order)).where("real")
    rows = rows.withColumn("edited", edited())
    rows = fingerprints(rows, "edited", "edited_fp").withColumn("edited_hashes", hashes("edited_fp"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        text_of("fp").alias("fingerprint"), text_of("edited_fp").alias("edited_fingerprint"),
        likeness("fp_hashes", "edited_hashes").alias("near_edited"), likeness("fp_hashes", "next_hashes").alias("near_next"),
    )
