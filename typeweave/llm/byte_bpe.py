"""Operator 8: byte-level BPE encoding and decoding.

The tokenizers library encodes over Arrow batches; each byte stands for a character in its
vocabulary. Offsets lead from tokens to characters of the text. Decoding reverses the byte
table, so that characters that tokens split come back whole.

Cases: a null or empty text has no tokens and decodes to an empty byte string; other columns
are not read; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm import bpe_words
from typeweave.llm.common import list_array, slices

RANKS = "byte_bpe_multi_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> bpe_words.PieceEncoder:
    return bpe_words.load_ranks(path, pattern)[0]


class Table:
    """Token bytes by id, laid end to end; ids that no rank names stand for nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and the place in them where each id's bytes end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[at].tobytes(), ends


@functools.lru_cache(maxsize=2)
def _table(path: str) -> Table:
    return Table(bpe_words.read_ranks(path))


def _decoded(ids: pa.ListArray, table: Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The bytes of each row's ids, the flat ids, and where each row of them begins."""
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    raw, ends = table.decode(flat)
    cuts = np.concatenate([[0], ends])[offsets].tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], flat, offsets


def char_offsets(text: str, ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last; a split character counts whole."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(table.lengths[ids])
    return char_of[ends - table.lengths[ids]], char_of[ends - 1] + 1


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """Rows (id, ids array<int>[, starts array<int>, ends array<int>]) for each row of df.

    starts and ends are offsets in characters (code points).
    """
    path = path or public_tokenizers.path(RANKS)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = _encoder(path, pattern)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            got = encoder.encode(texts)
            lengths = np.fromiter((len(x) // 4 for x in got), np.int64, len(got))
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            columns = [part.column(0), list_array(flat, lengths, pa.int32())]
            if offsets:
                table = _table(path)
                spans = [char_offsets(t, np.frombuffer(x, "<u4"), table) if x else (np.empty(0), np.empty(0)) for t, x in zip(texts, got, strict=True)]
                for side in (0, 1):
                    columns.append(list_array(np.concatenate([s[side] for s in spans]).astype(np.int32), lengths, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "ids", *(["starts", "ends"] if offsets else [])]
    schema = f"id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Rows (id, ids, bytes, text): the bytes of the ids, and their text.

    Bytes that are no UTF-8, as ids of cut texts may give, become U+FFFD in text only.
    Null ids decode to nothing.
    """
    path = path or public_tokenizers.path(RANKS)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        table = _table(path)
        for part in slices(batches):
            raw = _decoded(part.column(1), table)[0]
            text = [codecs.decode(x, "utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary()), pa.array(text, pa.string())], ["id", "ids", "bytes", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, bytes binary, text string")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of what encode() returns, decoded again."""
    path = path or public_tokenizers.path(RANKS)
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        table = _table(path)
        for part in slices(batches):
            raw, flat, offsets = _decoded(part.column(1), table)
            flat, spans = flat.astype("<u4"), list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            columns = [part.column(0), pa.array([b - a for a, b in spans], pa.int64()), pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in spans]), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode(docs)).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_byte_bpe": query}
