"""Operator 2: best-fit packing of documents into sequences, planned on a length histogram.

Documents become token ids with an end id; those longer than a sequence are cut into full
pieces behind a first piece of what is left over. Only the count of each piece length goes
to the driver (as many rows as a sequence has tokens, at most). Best fit decreasing runs over
these counts: bins of equal content are one row of the plan, however many they are. Pieces
then take the planned slots by their rank within their length, which is a local rank, given
while the pieces are cut, plus the counts of the partitions before.

Cases: a null or empty text is a document of the end id alone; repeated rows are packed each;
ties in length take slots in the order of partition and row; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typeweave.llm import bpe_words
from typeweave.llm.common import slices, staged

SEQUENCE_TOKENS = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: The plan is broadcast up to these rows, beyond them it is joined by length. They grow with the sequence
#: length, not with the data.
BROADCAST_ROWS = 200_000

PIECES = "doc_id {}, piece int, start bigint, length int, ids binary, part int, local_rank bigint"


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> bpe_words.RankEncoder | bpe_words.PieceEncoder:
    return bpe_words.load_json_ranks(path, public_tokenizers.PATTERN)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what full pieces leave."""
    first = n % size or min(n, size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of the documents with ids (little-endian unsigned 32-bit), partition and rank.

    local_rank counts the pieces of the same length before this one in the partition; it holds
    for one run only, so stage the result before it is used twice.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part_no = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for part in slices(batches):
            keys = part.column(0)
            rows, starts, lengths, numbers, blobs, ranks = [], [], [], [], [], []
            for row, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                ids += end
                for number, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(length)
                    blobs.append(ids[4 * start : 4 * (start + length)])
                    ranks.append(seen[length])
                    seen[length] += 1
            columns = [keys.take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(blobs, pa.binary()), pa.array([part_no] * len(rows), pa.int32()), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "local_rank"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES.format(kind))


@dataclass
class Bins:
    """Sequences of equal content: (length, times) in the order they lie there."""

    count: int
    free: int
    content: list[tuple[int, int]]


def plan(histogram: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[Bins]:
    """Best fit decreasing over counts of lengths."""
    by_free: dict[int, list[Bins]] = {}
    done: list[Bins] = []

    def put(bins: Bins) -> None:
        if bins.count:
            (by_free.setdefault(bins.free, []) if bins.free else done).append(bins)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = min((f for f, own in by_free.items() if f >= length and own), default=0)
            group = by_free[free].pop() if free else Bins(left, size, [])
            fits = group.free // length
            full, rest = divmod(left, fits)
            used = min(group.count, full)
            if used:
                put(Bins(used, group.free - fits * length, [*group.content, (length, fits)]))
                left -= used * fits
                group.count -= used
            if group.count and left:  # fewer than fill one more bin
                put(Bins(1, group.free - left * length, [*group.content, (length, left)]))
                group.count -= 1
                left = 0
            if free:
                put(group)
    return done + [bins for own in by_free.values() for bins in own]


def plan_rows(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, times in a bin, first sequence, offset)."""
    rows, next_rank, sequence = [], {}, 0
    for group in bins:
        offset = 0
        for length, times in group.content:
            first = next_rank.get(length, 0)
            next_rank[length] = first + group.count * times
            rows.append((length, first, next_rank[length], times, sequence, offset))
            offset += length * times
        sequence += group.count
    return rows


def place(cut_pieces: DataFrame, columns: list[Column | str], size: int = SEQUENCE_TOKENS) -> DataFrame:
    """The columns of staged pieces, with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    counts = cut_pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_rows(plan(histogram, size))
    schema = "of_length int, rank_from bigint, rank_to bigint, times bigint, first_sequence bigint, first_offset bigint"
    slots = spark.createDataFrame(rows, schema)
    if len(rows) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    at = F.col("rank") - F.col("rank_from")
    return (
        cut_pieces.select(*columns, "length", "part", "local_rank")
        .join(earlier, ["length", "part"])
        .withColumn("rank", F.col("earlier") + F.col("local_rank"))
        .join(slots, (F.col("of_length") == F.col("length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - rank_from) div times"))
        .withColumn("offset", F.col("first_offset") + at % F.col("times") * F.col("length"))
        .drop("of_length", "part", "local_rank", "earlier", "rank", "rank_from", "rank_to", "times", "first_sequence", "first_offset")
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, ids, length, sequence_id, offset): every piece in its place."""
    return place(staged(pieces(df, id_col, text_col, size, end_id, path), "pieces"), ["doc_id", "piece", "start", "ids"], size)


def placed_digests(docs: DataFrame) -> DataFrame:
    """Each piece of every document: its place, and a digest of its ids."""
    cut_pieces = staged(pieces(docs), "pieces")
    digest = F.crc32("ids").alias("ids_crc32")
    return place(cut_pieces, ["doc_id", "piece", "start", digest]).withColumn("length", F.col("length").cast("bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of every document: its place, and a digest of its ids."""
    return placed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_best_fit_packing": query}
