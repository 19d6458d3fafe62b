"""Best-fit sequence packing planned over the histogram of lengths.

Documents are tokenised once, with the ids that the ``tokenizers`` file of a fixed public vocabulary gives without added
special tokens: the string of a special token in a text gives its id.  The same vocabulary's rank form encodes several
times faster, so it does the work, with the special tokens of that file.  Then comes id 0.  Longer ones are cut
into pieces of the capacity, the first one shorter.  Best-fit decreasing then runs over the *counts* of the at most ``capacity``
different lengths: sequences with equal contents are one group, so the work and the plan depend on the capacity and not
on the number of documents.  The pieces take their planned slots by joining on their rank within their length; ranks are
counted within salted parts of a length, as many as its count asks for, so no length is gathered in one task.

Defined results: a null text counts as empty (one piece holding only id 0); repeated rows are packed each; a null doc_id
is packed as such; pieces of equal length are ranked by doc_id, piece and checksum; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

CAPACITY, TOKENIZER, RANKS, END_ID = 2048, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 0
#: Pieces in a salted part of a length, and parts of all lengths beyond one each: the counts that reach the driver are few.
PART_PIECES, MAX_PARTS = 1000, 1 << 15
#: A plan has a few rows a length; more than this and it isn't broadcast.
BROADCAST_ROWS = 200_000


def encoder(path: str | None = None, ranks: str | None = None):
    """Function giving a text's ids as little-endian unsigned 32-bit bytes, with a final ``END_ID``."""
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    with open(ranks or public_tokenizers.path(RANKS), "rb") as file:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    bpe = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)

    def encode(text: str) -> bytes:
        ids = array("I", bpe.encode(text, allowed_special="all"))
        ids.append(END_ID)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    return encode


def _cut(capacity: int, path: str | None, with_ids: bool):
    names = ["doc_id", "no_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        encode = encoder(path)
        for pdf in batches:
            rows = []
            for doc, no_id, text in zip(pdf["doc_id"], pdf["no_id"], pdf["text"]):
                ids = encode(text or "")
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if piece == 0 else start + capacity
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc, no_id, piece, start, stop - start, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names)

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): what is to be packed."""
    schema = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    doc_id = F.col("doc_id").cast("long")
    # pandas would turn ids beside a null into floats
    docs = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), "text")
    pieces = docs.mapInPandas(_cut(capacity, path, with_ids), schema)
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """[(length, first rank, count, first sequence, offset)] from {length: count}, best-fit decreasing."""
    plan, next_sequence = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, sequences)]
    rooms: list[int] = []

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, count = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            take = min(left, count)
            plan.append((length, rank, take, first, capacity - room))
            put(room - length, first, take)
            put(room, first + take, count - take)
            left, rank = left - take, rank + take
        each = capacity // length
        for sequences, fill in ((left // each, each), (1 if left % each else 0, left % each)):
            if sequences:
                for slot in range(fill):
                    plan.append((length, rank, sequences, next_sequence, slot * length))
                    rank += sequences
                put(capacity - fill * length, next_sequence, sequences)
                next_sequence += sequences
    return plan


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity, path))
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    most = max(PART_PIECES, sum(sizes.values()) // MAX_PARTS)
    salts = spark.createDataFrame([(n, -(-count // most)) for n, count in sizes.items()], "length long, salts int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", salt).drop("salts")
    # at most capacity + MAX_PARTS counts
    counts = sorted((r["length"], r["salt"], r["count"]) for r in pieces.groupBy("length", "salt").count().collect())
    histogram: dict[int, int] = {}
    before = []
    for length, part, count in counts:
        before.append((length, part, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + count
    plan = plan_best_fit(histogram, capacity)
    small = F.broadcast if len(plan) <= BROADCAST_ROWS else (lambda df: df)
    before_df = spark.createDataFrame(before, "length long, salt int, before long")
    plan_df = spark.createDataFrame(plan, "length long, first_rank long, n long, first_sequence long, offset long")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(F.broadcast(before_df), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(small(plan_df), "length").where("rank >= first_rank and rank < first_rank + n")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )


def packed_sequences(docs: DataFrame, placements: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed token ids themselves; a sequence holds at most ``capacity`` of them."""
    keys = ["doc_id", "piece", "ids_crc32"]
    tokens = token_pieces(docs, capacity, path, with_ids=True).select(*keys, "ids").dropDuplicates(keys)
    rows = placements.join(tokens, keys)
    whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex")).select(
        "sequence_id", F.unhex("hex").alias("ids")
    )
