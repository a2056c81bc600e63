"""Operator 6: substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text's words; a chunk ends behind the word whose hash is the
smallest of some run of words, so the ends depend on the words around only and an insertion shifts
no others. Chunks are matched by digest. A window of MIN_WORDS words is looked at if all chunks that
its own words fix are held by more than one place: it is matched by its hash, and of equal windows
all but the first (by document, then place) are duplicates. Texts that equal an earlier one word for
word are known by the digest of their words: all of such a text is duplicate, and only the first of
them goes on, so copies cost nothing further, however many there are. Hashes of windows have 96 bits. What is removed is the union of a text's
duplicate windows, so a removed span has at least MIN_WORDS words, all of which stand elsewhere, and
every repeated passage of that length stays in its first place only.

No repeated window escapes, whatever the bytes of its words. The hash behind each of its words but the
first GEAR_WORDS depends on its own bytes, and these words hold two runs of run_words() words without
one in common. So at least two ends are fixed by the window alone, and between the first and the last
such end there is no other: an end that a run reaching outside gave would have a smaller hash than one
of the two. Equal windows hence have the same chunks there.

Cases: null and empty texts have no chunks and stay as they are; white space and case don't count
in a comparison; each character of a script without blanks is a word; repeats within one text count as well; repeated ids are told apart by their
texts' hashes, and equal rows of one id are one document; rows with a null id are left alone;
an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.common import UNSPACED, SpanHasher, list_array, normal_words, redealt, release, rows_of, slices, staged, word_bounds, word_places

#: A repeated passage has at least this many words.
MIN_WORDS = 50
MAX_CHUNK = 512
#: Bytes on which a gear hash depends, and the words that hold so many bytes even if each has one letter.
GEAR_BYTES = 32
GEAR_WORDS = 16

_GEAR = np.random.Generator(np.random.PCG64(611)).integers(0, 1 << 32, size=256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: the sum of the last 32 bytes' random values, each shifted
    left by its distance; by doubling windows."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h


def run_words(min_words: int) -> int:
    """The words of a run, of which the smallest hash ends a chunk: two runs fit into what a window fixes."""
    if min_words < GEAR_WORDS + 2:
        raise ValueError(f"passages must have {GEAR_WORDS + 2} words at least")
    return (min_words - GEAR_WORDS) // 2


def picked_words(raw: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
    """For each run of width words, by its first one: the word with the smallest gear hash behind it,
    the last of equal ones. These never decrease."""
    n = len(stops)
    if n < width:
        return np.empty(0, np.int64)
    least = gear(raw)[stops - 1].astype(np.uint64) << np.uint64(32) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n - width + 1], least[width - size :])
    return n - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chunk_ends(raw: np.ndarray, width: int = run_words(MIN_WORDS)) -> np.ndarray:
    """Ends of the chunks of a byte string; no chunk is longer than MAX_CHUNK."""
    stops = np.append(np.flatnonzero(raw == 32), len(raw))
    ends = stops[np.unique(np.append(picked_words(raw, stops, width), len(stops) - 1))]
    lengths = np.diff(ends, prepend=0)
    if lengths.max() > MAX_CHUNK:
        pieces = -(-lengths // MAX_CHUNK)
        last = np.repeat(ends - lengths, pieces)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.minimum(last + (within + 1) * MAX_CHUNK, np.repeat(ends, pieces))
    return ends


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, of, text): of is a hash of the text, which tells repeated ids apart."""
    text = F.col(text_col).cast("string")
    return df.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))


def chunks(texts: DataFrame, min_words: int) -> DataFrame:
    """Rows (id, of, digests array<bigint>, whole binary, words int, row): a text's chunks, the digest and
    number of its words. row is unique once the result is staged.

    A digest is that of the chunk and of the bytes before it on which its beginning depends.
    """
    width = run_words(min_words)

    def run(batches):
        for part in slices(batches):
            digests, whole, words = [], [], []
            for text in part.column(2).to_pylist():
                data = normal_words(text)
                whole.append(hashlib.md5(data).digest())
                words.append(data.count(b" ") + 1 if data else 0)
                if not data:
                    digests.append(np.empty(0, np.int64))
                    continue
                ends = chunk_ends(np.frombuffer(data, np.uint8), width)
                starts = np.concatenate([[0], ends[:-1]])
                digests.append(SpanHasher(data).spans(np.maximum(starts - GEAR_BYTES, 0), ends).view(np.int64))
            lengths = np.asarray(list(map(len, digests)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), list_array(np.concatenate(digests), lengths, pa.int64()), pa.array(whole, pa.binary()), pa.array(words, pa.int32())], ["id", "of", "digests", "whole", "words"])

    kind = texts.schema["id"].dataType.simpleString()
    made = texts.mapInArrow(run, f"id {kind}, of bigint, digests array<bigint>, whole binary, words int")
    return made.withColumn("row", F.monotonically_increasing_id())


def copied(chunked: DataFrame, min_words: int) -> DataFrame:
    """Rows (id, of, words, rep_id, rep_of) of texts that have the same words as an earlier one, the rep."""
    each = chunked.where(F.col("words") >= min_words).groupBy("id", "of").agg(F.min("row").alias("row"), F.min("whole").alias("whole"), F.min("words").alias("words"))
    first = each.groupBy("whole").agg(F.min(F.struct("id", "row", "of")).alias("rep"), F.count("*").alias("n")).where("n > 1").select("whole", F.col("rep.id").alias("rep_id"), F.col("rep.of").alias("rep_of"), F.col("rep.row").alias("rep_row"))
    return each.join(redealt(first, "whole"), "whole").where("row <> rep_row").select("id", "of", "words", "rep_id", "rep_of")


def repeated(items: DataFrame, item: str) -> DataFrame:
    """The rows of items whose value of a column more than one row has; no group comes together."""
    many = items.groupBy(item).agg(F.count("*").alias("n")).where("n > 1").select(item)
    return items.join(redealt(many, item), item)


def candidate_runs(chunked: DataFrame) -> DataFrame:
    """Rows (row, id, of, runs array<struct<first, last>>): all runs of repeated chunks."""
    each = chunked.select("row", F.posexplode("digests").alias("at", "digest"))
    found = repeated(each, "digest").groupBy("row").agg(F.collect_set("at").alias("places"))
    names = ["row", "id", "of", "runs"]

    def run(batches):
        for part in slices(batches):
            runs = []
            for places in rows_of(part.column(3)):
                at = np.sort(places)
                breaks = np.flatnonzero(np.diff(at) > 1)
                firsts, lasts = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
                runs.append([{"first": a, "last": b} for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names)

    kind = chunked.schema["id"].dataType.simpleString()
    joined = found.join(chunked.select("row", "id", "of"), "row").select("row", "id", "of", "places")
    return joined.mapInArrow(run, f"row bigint, id {kind}, of bigint, runs array<struct<first:int,last:int>>")


def windows(texts: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """Rows (row, id, of, at array<int>, hashes array<bigint>, more array<int>): the windows of min_words words,
    by the number of their first word, whose own chunks are all in runs: those between the first and
    the last end that the window fixes.
    """
    kind = texts.schema["id"].dataType.simpleString()
    width = run_words(min_words)

    def run(batches):
        for part in slices(batches):
            all_at, all_hashes, all_more = [], [], []
            for text, own in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                data = normal_words(text)
                raw = np.frombuffer(data, np.uint8)
                ends = chunk_ends(raw, width)
                starts, stops = word_bounds(data)
                lone = np.ones(len(ends) + 1, np.int32)
                for span in own:
                    lone[span["first"] + 1 : span["last"] + 2] = 0
                lone = np.cumsum(lone)
                n = max(0, len(starts) - min_words + 1)
                behind = np.searchsorted(ends, stops[picked_words(raw, stops, width)]) + 1
                first, last = (behind[at : at + n] for at in (GEAR_WORDS, min_words - width))
                at = np.flatnonzero(lone[last] == lone[first]) if n else np.empty(0, np.int64)
                all_at.append(at.astype(np.int32))
                both = [SpanHasher(data, kind).spans(starts[at], stops[at + min_words - 1]) if len(at) else np.empty(0, np.uint64) for kind in (0, 1)]
                all_hashes.append(both[0].view(np.int64))
                all_more.append(both[1].astype(np.uint32).view(np.int32))
            lengths = np.asarray(list(map(len, all_at)))
            flat = [list_array(np.concatenate(x), lengths, t) for x, t in ((all_at, pa.int32()), (all_hashes, pa.int64()), (all_more, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *flat], ["row", "id", "of", "at", "hashes", "more"])

    once = runs.groupBy("id", "of").agg(F.min(F.struct("row", "runs")).alias("r"))
    joined = texts.join(once, ["id", "of"]).select(F.col("r.row").alias("row"), "id", "of", "text", F.col("r.runs").alias("runs"))
    return joined.mapInArrow(run, f"row bigint, id {kind}, of bigint, at array<int>, hashes array<bigint>, more array<int>")


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, of, spans array<struct<first_word, words, first_id>>) of texts that repeat a passage.

    of is the xxhash64 of the text. A span begins at the word first_word (from 0) and has words
    words; first_id is the document that holds the first place of the span's first window.
    """
    texts = _texts(df, id_col, text_col)
    chunked = staged(chunks(texts, min_words), "chunks")
    copies = staged(copied(chunked, min_words), "copies")
    runs = staged(candidate_runs(chunked.join(copies.select("id", "of"), ["id", "of"], "left_anti")), "runs")
    release(chunked)
    looked = staged(windows(texts, runs, min_words), "windows")
    release(runs)
    each = looked.select("row", "id", F.explode(F.arrays_zip("at", "hashes", "more")).alias("w")).select("row", "id", F.col("w.at").alias("at"), F.col("w.hashes").alias("hash"), F.col("w.more").alias("more"))
    first = each.groupBy("hash", "more").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "more", "first.*")
    first = redealt(staged(first, "first"), "hash").toDF("hash", "more", "first_id", "first_row", "first_at")
    later = each.select("row", "at", "hash", "more").join(first, ["hash", "more"]).where("row <> first_row OR at <> first_at").select("row", "at", "first_id")
    found = later.groupBy("row").agg(F.collect_list(F.struct("at", "first_id")).alias("found"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            spans = []
            found = part.column(2)
            offsets = found.offsets.to_numpy()
            all_at, ids = found.values.field("at").to_numpy(), found.values.field("first_id")
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                order = np.argsort(all_at[a:b], kind="stable")
                at = all_at[a:b][order]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(at) > min_words) + 1])
                ends = np.concatenate([begins[1:] - 1, [len(at) - 1]])
                own = zip(at[begins].tolist(), (at[ends] - at[begins] + min_words).tolist(), order[begins].tolist(), strict=True)
                spans.append([{"first_word": first, "words": words, "first_id": ids[a + k].as_py()} for first, words, k in own])
            of_id = part.schema.field(0).type
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("first_id", of_id)])))], ["id", "of", "spans"])

    joined = found.join(looked.select("row", "id", "of").dropDuplicates(["row"]), "row").select("id", "of", "found")
    out = staged(joined.mapInArrow(run, f"id {kind}, of bigint, spans array<struct<first_word:int,words:int,first_id:{kind}>>"), "spans")
    release(looked)
    begins = out.where(F.col("spans")[0]["first_word"] == 0).select(F.col("id").alias("rep_id"), F.col("of").alias("rep_of"), F.col("spans")[0]["first_id"].alias("first_id"))
    whole = F.struct(F.lit(0).alias("first_word"), "words", F.coalesce("first_id", "rep_id").alias("first_id"))
    return out.unionByName(copies.join(redealt(begins, "rep_of"), ["rep_id", "rep_of"], "left").select("id", "of", F.array(whole).alias("spans")))


def cut_text(text: str, spans: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """text without the words of spans, and the spans in characters; white space around stays once."""
    bounds = word_places(text)
    pieces, removed, last = [], [], 0
    for span in sorted(spans, key=lambda s: s["first_word"]):
        a = bounds[span["first_word"]][0]
        after = span["first_word"] + span["words"]
        b = bounds[after][0] if after < len(bounds) else len(text)
        pieces.append(text[last:a])
        removed.append((a, b))
        last = b
    return "".join([*pieces, text[last:]]), removed


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with repeated passages cut from its text column."""
    spans = duplicate_spans(df, id_col, text_col, min_words)
    text = F.col(text_col).cast("string")
    own = df.select(F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_of"), text.alias("text"), F.struct("*").alias("row"))
    joined = own.join(spans, (F.col("own_id") == F.col("id")) & (F.col("own_of") == F.col("of")), "left")
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("spans")))
    return joined.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))


def cut(text: Column, spans: Column) -> Column:
    """text without the words of spans, as a column."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if s is None or t is None else cut_text(t, s)[0] for t, s in pairs], pa.string())

    return F.arrow_udf(run, "string")(text, spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each repeated passage that goes: doc_id, first_word, words, first_doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = duplicate_spans(docs).select(F.col("id").alias("doc_id"), F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.first_word", "s.words", F.col("s.first_id").alias("first_doc_id"))


QUERIES = {"op6_substring_dedup": query}
ORACLES = {
    "op6_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '([UNSPACED])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(len(w) - 49)) AS pos,
             unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i+49], ' ')))) AS h
      FROM t WHERE len(w) >= 50),
n AS (SELECT doc_id, pos, row_number() OVER e AS place, first_value(doc_id) OVER e AS first_id
      FROM g WINDOW e AS (PARTITION BY h ORDER BY doc_id, pos)),
b AS (SELECT doc_id, pos, first_id, pos - lag(pos, 1, -999) OVER (PARTITION BY doc_id ORDER BY pos) > 50 AS begins
      FROM n WHERE place > 1),
s AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM b)
SELECT doc_id, min(pos)::INTEGER AS first_word, (max(pos) - min(pos) + 50)::INTEGER AS words, arg_min(first_id, pos) AS first_doc_id
FROM s GROUP BY doc_id, span
""".replace("UNSPACED", UNSPACED)
}
