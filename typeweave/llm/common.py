"""What the operators share: the shared folder, staged tables, slices and text hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.functions import shipping

__all__ = ["SpanHasher", "clear", "list_array", "mix64", "new_path", "normal_words", "redealt", "release", "rows_of", "shared_dir", "ship", "slices", "staged", "word_bounds", "word_places"]

#: Rows of an Arrow batch that are worked on at a time, so that long texts stay within memory.
SLICE_ROWS = 256
SLICE_BYTES = 2 << 20

#: Bytes of an Arrow batch, where the session has Spark's default: a batch is there several times while it is worked on.
BATCH_BYTES = 8 << 20

_M64 = (1 << 64) - 1


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and bounds the batches that Python workers get."""
    shipping.ship(spark)
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir; where that is unset, a master of one process gets a temporary
    folder of its own and any other master is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="typeweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/typeweave/{spark.sparkContext.applicationId}/llm"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of an execution when that has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage.

    The shuffle files of the write are deleted with its end. The table stays until release() or
    clear(), for what is made of it reads it when it is run.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._typeweave_path = path
    return made


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(*frames: DataFrame) -> None:
    """Deletes what staged() wrote, once no other frame needs it."""
    for df in frames:
        _delete(df.sparkSession, df._typeweave_path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has staged; for when its results are written or taken."""
    _delete(spark, _own_folder(spark))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches of so many rows and bytes at most; a larger row is a part of its own."""
    for batch in batches:
        waiting = [(at, min(rows, batch.num_rows - at)) for at in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            at, n = waiting.pop()
            part = batch.slice(at, n)
            if n > 1 and part.nbytes > size:
                waiting += [(at + n // 2, n - n // 2), (at, n // 2)]
            else:
                yield part
        pa.default_memory_pool().release_unused()


def redealt(df: DataFrame, key: str) -> DataFrame:
    """df, whose rows a join on key is to deal anew though a grouping has just dealt them so.

    A join of a table with its own grouped keys would stand on the grouping's exchange, and Spark
    splits large partitions only of joins whose sides are both dealt for the join itself. The
    grouped side is small; the other one may have hot keys.
    """
    kind = df.schema[key].dataType.simpleString()
    same = F.col(key).bitwiseXOR(F.lit(0).cast(kind)) if kind in ("bigint", "int") else F.concat(F.col(key), F.lit("").cast(kind))
    return df.withColumn(key, same)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def rows_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The values of each row of a list column of numbers without nulls."""
    offsets, values = column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: two rounds of shift, xor and odd multiplier."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Two sets of one random 64-bit value a byte, from a fixed seed: the digits of two polynomial hashes.
_DIGITS = np.random.Generator(np.random.PCG64(20240607)).integers(1, _M64, size=(2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, kind: int, inverse: bool) -> np.ndarray:
    """At least n powers of a base, or of its inverse, modulo 2**64."""
    table = _POWERS.get((kind, inverse))
    if table is None or len(table) < n:
        size = 1 << int(n - 1).bit_length()
        table, step = np.ones(1, np.uint64), pow(_BASES[kind], -1 if inverse else 1, 1 << 64)
        while len(table) < size:
            table, step = np.concatenate([table, table * np.uint64(step)]), step * step & _M64
        _POWERS[kind, inverse] = table
    return table


class SpanHasher:
    """64-bit hashes of any spans of one byte string, from prefix sums of a polynomial.

    Equal spans have equal hashes wherever they stand; spans of different bytes share a
    hash with a probability of about 2**-64. Hashes of kinds 0 and 1 are independent.
    """

    def __init__(self, data: bytes, kind: int = 0):
        raw = np.frombuffer(data, np.uint8)
        self.inverse = _powers(len(raw) + 1, kind, True)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_DIGITS[kind][raw] * _powers(len(raw) + 1, kind, False)[: len(raw)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix64(x ^ (ends - starts).astype(np.uint64))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte string whose words are parted by single blanks."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])


#: Scripts that put no blanks between words. Each of their characters is a word of its own.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_UNSPACED = regex.compile(f"([{UNSPACED}])")
_WORD_PART = regex.compile(f"[{UNSPACED}]|[^{UNSPACED}]+")


def normal_words(text: str | None) -> bytes:
    """Lower-cased words parted by single blanks, in UTF-8; nothing for a null text.

    Words end at white space; each character of a script without blanks is a word.
    """
    if not text:
        return b""
    data = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    if data and np.frombuffer(data, np.uint8).max() >= 0xE0:  # such scripts begin at U+0E00
        text = data.decode("utf-8", "surrogatepass")
        if _UNSPACED.search(text):
            data = " ".join(_UNSPACED.sub(r" \1 ", text).split()).encode("utf-8", "surrogatepass")
    return data


def word_places(text: str) -> list[tuple[int, int]]:
    """First character and end of each word that normal_words() makes of a text."""
    places, at = [], 0
    unspaced = _UNSPACED.search(text) is not None
    for word in text.split():
        at = text.index(word, at)
        places += [(at + m.start(), at + m.end()) for m in _WORD_PART.finditer(word)] if unspaced else [(at, at + len(word))]
        at += len(word)
    return places
