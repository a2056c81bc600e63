"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Documents are compared by the sets of their n-grams of words (lower case, split at white space; each
character of a script without blanks is a word; fewer than n words are one n-gram). Two different
texts are linked where the Jaccard similarity of their sets reaches a threshold.

1. A sketch of MinHash values is made of each text; equal texts become one class.
2. Classes that agree in a band of values are candidates. Pairs of small buckets are listed;
   pruning compares their values a few at a time and drops a pair when the posterior probability
   of reaching the threshold falls below TOLERANCE. Buckets of many classes are never paired:
   their members are tied to one of them instead.
3. Ties and remaining pairs give groups, inside which alone a link can be. A group is dealt into
   blocks, each two of which are a unit. Sketches alone, of 128 bytes, go through all units, which
   prune their pairs in the same way; only classes that a unit leaves a partner go on in it.
4. These are verified exactly, on sets that are written as differences from the set of one class of
   their group where that is shorter: near copies are sent and compared by the few n-grams in
   which they differ, and no text is sent more than once.
5. Units give, for each text, its number of links and one tie of a spanning forest, so a group of
   m texts gives no m*m rows, but every link is counted.

The chance that a pair at the threshold shares no band is about 5e-8; above it, less.

Cases: equal texts are one class, never linked to itself; a null text is a class of its own; a text
without words has no links; rows with a null id come back with a null class and no links; repeated
ids and rows are documents each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.common import UNSPACED, SpanHasher, mix64, normal_words, redealt, release, slices, staged, word_bounds
from typeweave.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 4
VALUES = BANDS * BAND_ROWS
#: Values looked at before each decision to drop a pair.
CHECKS = (16, 32, 64, 96, 128)
TOLERANCE = 1e-6
#: Classes of a bucket that are paired at most; larger buckets are tied.
PAIRED = 40
#: Classes, and bytes of their differences, of a block at most, about.
BLOCK_TEXTS = 2048
BLOCK_BYTES = 8 << 20
#: Below that, a group has this many blocks, of so many classes at least: many units of one size share tasks evenly.
SPREAD_BLOCKS, LEAST_TEXTS = 24, 64

_RNG = np.random.Generator(np.random.PCG64(98))
_A = _RNG.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def ngram_hashes(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams of words."""
    data = normal_words(text)
    if not data:
        return np.empty(0, np.uint64)
    starts, ends = word_bounds(data)
    n = min(n, len(starts))
    return np.unique(SpanHasher(data).spans(starts[: len(starts) - n + 1], ends[n - 1 :]))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set that isn't empty."""
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = hashes.astype(np.uint32)
    for at in range(0, len(x), 2048):
        v = x[None, at : at + 2048] * _A[:, None] + _B[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of values."""
    halves = values.reshape(BANDS, 2, 2).astype(np.uint64)
    first, second = (halves[:, k, 0] << np.uint64(32) | halves[:, k, 1] for k in (0, 1))
    return mix64(mix64(first + np.arange(1, BANDS + 1, dtype=np.uint64)) ^ second * np.uint64(0x9FB21C651E98DF25))


def least_matches(threshold: float, checks: tuple[int, ...] = CHECKS, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values looked at, the matches below which a pair is dropped.

    Values are kept to 8 bits, so they match with p = s + (1 - s) / 256 at a similarity s. With a
    uniform prior of p, m matches of n give a Beta posterior, whose tail above the threshold's p is
    the chance of at most m successes in n + 1 draws.
    """
    p = threshold + (1 - threshold) / 256
    out = {}
    for n in checks:
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def surviving(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of aligned rows of 8-bit values survive pruning."""
    alive, matches, last = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in least_matches(threshold).items():
        matches = matches + (left[alive, last:n] == right[alive, last:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, last = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def surviving_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row of left and a row of right that survive pruning; of one block, each once."""
    matches, last, keep = np.zeros((len(left), len(right)), np.int16), 0, None
    for n, least in least_matches(threshold).items():
        for k in range(last, n):
            matches += left[:, k, None] == right[None, :, k]
        last, keep = n, matches >= least
        if same:
            keep = np.triu(keep, 1)
        if keep.sum() * 8 < keep.size:
            break
    a, b = np.nonzero(keep)
    alive = surviving(left[a], right[b], threshold)
    return a[alive], b[alive]


def difference(own: np.ndarray, pivot: np.ndarray) -> tuple[bool, np.ndarray, int, int]:
    """(near, keys, drops, shared): a set written by another one, if that is shorter, else as it is.

    Near sets are the pivot without the last drops keys and with the others; shared is the number
    of n-grams that both have.
    """
    shared = len(np.intersect1d(own, pivot, assume_unique=True))
    if len(own) + len(pivot) - 2 * shared >= len(own):
        return False, own, 0, shared
    drops = np.setdiff1d(pivot, own, assume_unique=True)
    return True, np.concatenate([np.setdiff1d(own, pivot, assume_unique=True), drops]), len(drops), shared


@dataclass
class Sets:
    """Sets of one group as differences from its pivot's set of pivot_size n-grams."""

    near: np.ndarray
    keys: list[np.ndarray]
    drops: np.ndarray
    sizes: np.ndarray
    shared: np.ndarray
    pivot_size: int

    def signs(self, k: int) -> np.ndarray:
        made = np.ones(len(self.keys[k]), np.float32)
        made[len(made) - int(self.drops[k]) :] = -1
        return made

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs (a, b).

        What two sets share is what their pivot parts share, corrected by the keys: one that both
        add or both drop counts 1, one that a near set drops and a whole set has counts -1.
        """
        both = self.near[a].astype(np.int64) + self.near[b]
        base = np.where(both == 2, self.shared[a] + self.shared[b] - self.pivot_size, 0)
        base = np.where(both == 1, np.where(self.near[a], self.shared[b], self.shared[a]), base)
        return base + (self._few(a, b) if len(a) <= 64 else self._many(a, b))

    def _few(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            _, x, y = np.intersect1d(self.keys[i], self.keys[j], assume_unique=True, return_indices=True)
            out.append(int(self.signs(i)[x] @ self.signs(j)[y]))
        return np.asarray(out, np.int64)

    def _many(self, a: np.ndarray, b: np.ndarray, width: int = 8192) -> np.ndarray:
        """By products of matrices of 1, -1 and 0, a range of the keys at a time."""
        sides = [np.unique(x) for x in (a, b)]
        shared = np.intersect1d(*(np.unique(np.concatenate([self.keys[k] for k in own.tolist()])) for own in sides), assume_unique=True)
        counts = np.zeros((len(sides[0]), len(sides[1])))
        for at in range(0, len(shared), width):
            part = shared[at : at + width]
            made = []
            for own in sides:
                matrix = np.zeros((len(own), len(part)), np.float32)
                for row, k in enumerate(own.tolist()):
                    place = np.searchsorted(part, self.keys[k])
                    place[place == len(part)] = 0
                    there = part[place] == self.keys[k]
                    matrix[row, place[there]] = self.signs(k)[there]
                made.append(matrix)
            counts += made[0] @ made[1].T
        return np.rint(counts[np.searchsorted(sides[0], a), np.searchsorted(sides[1], b)]).astype(np.int64)

    def linked(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the pairs (a, b) reach the threshold, exactly."""
        common = self.common(a, b)
        return common >= threshold * (self.sizes[a] + self.sizes[b] - common) - 1e-9


def sketch(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, id, digest, bands array<bigint>, sig binary): row is unique once the result is staged."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    own = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))

    def run(batches):
        for part in slices(batches):
            bands, sigs = [], []
            for t in part.column(2).to_pylist():
                hashes = ngram_hashes(t, n)
                if len(hashes):
                    values = minhash(hashes)
                    bands.append(band_keys(values).view(np.int64))
                    sigs.append((values & np.uint32(0xFF)).astype(np.uint8).tobytes())
                else:
                    bands.append(np.empty(0, np.int64))
                    sigs.append(b"")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "digest", "bands", "sig"])

    made = own.mapInArrow(run, f"id {kind}, digest binary, bands array<bigint>, sig binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _prune(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches sig_a and sig_b survive pruning."""

    def run(batches):
        for part in slices(batches, 8192):
            left, right = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, VALUES) for k in (2, 3))
            alive = pa.array(surviving(left, right, threshold))
            yield pa.RecordBatch.from_arrays([part.column(0).take(alive), part.column(1).take(alive)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def candidate_groups(reps: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, component): groups of classes (row, bands, sig) outside which no two are linked."""
    each = reps.select("row", F.explode("bands").alias("key"))
    buckets = each.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("pivot")).where("n > 1")
    members = staged(each.join(redealt(buckets, "key"), "key"), "buckets")
    listed = members.where(F.col("n") <= PAIRED).groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("l"))
    pairs = listed.select(F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b").distinct()
    sigs = reps.select("row", "sig")
    with_sigs = pairs.join(sigs.select(F.col("row").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("row").alias("b"), F.col("sig").alias("sig_b")), "b")
    tied = members.where((F.col("n") > PAIRED) & (F.col("row") != F.col("pivot"))).select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct()
    out = components(_prune(with_sigs, threshold).unionByName(tied))
    release(members)
    return out


def spanning(rows: list[int], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, links, root) of the rows that the links (x, y), by place, connect."""
    links = np.bincount(np.concatenate([x, y]), minlength=len(rows))
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [(rows[k], int(links[k]), rows[find(k)]) for k in np.flatnonzero(links).tolist()]


def unit_pairs(side: list[int], sigs: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a unit, by place, that survive pruning.

    side tells the block: 0 or 1 of a unit of two blocks, 2 of a unit of one.
    """
    side = np.asarray(side)
    same = bool(side[0] == 2)
    left = np.flatnonzero(side != 1)
    right = left if same else np.flatnonzero(side == 1)
    if not len(right) or not len(left):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, VALUES)
    a, b = surviving_pairs(values[left], values[right], threshold, same)
    return left[a], right[b]


def in_units(dealt: DataFrame, work: Callable[..., list[tuple]], names: list[str]) -> DataFrame:
    """Rows of long columns that work gives for the columns behind (component, x, y) of each unit."""
    width = len(dealt.columns)

    def run(batches):
        key, columns, out = None, [[] for _ in range(width - 3)], []
        for part in slices(batches):
            own = [c.to_pylist() for c in part.columns]
            for k in range(part.num_rows):
                unit = own[0][k], own[1][k], own[2][k]
                if unit != key:
                    if columns[0]:
                        out += work(key, *columns)
                    key, columns = unit, [[] for _ in range(width - 3)]
                for to, values in zip(columns, own[3:], strict=True):
                    to.append(values[k])
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                out = []
        if columns[0]:
            out += work(key, *columns)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    ordered = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "row")
    return ordered.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def with_sets(members: DataFrame, n: int) -> DataFrame:
    """Rows (row, component, sig, size, near, keys, drops, shared, pivot_size) for members(row, component, sig, text).

    The pivot of a group is its class with the smallest row. Members are dealt into shares of
    about LEAST_TEXTS, each of which is led by the pivot's set, so no group comes together.
    """
    kinds = "row bigint, component bigint, sig binary, size bigint, near boolean, keys binary, drops bigint, shared bigint, pivot_size bigint"
    names = [kind.split()[0] for kind in kinds.split(", ")]

    def hashed(batches):
        for part in slices(batches):
            own = [ngram_hashes(t, n) for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([h.tobytes() for h in own], pa.binary())], ["row", "component", "sig", "hashes"])

    def written(batches):
        pivot = np.empty(0, np.uint64)
        for part in slices(batches):
            keep, sizes, near, keys, drops, shared, pivots = [], [], [], [], [], [], []
            for k, (leads, data) in enumerate(zip(part.column(2).to_pylist(), part.column(5).to_pylist(), strict=True)):
                own = np.frombuffer(data, np.uint64)
                if leads:
                    pivot = own
                    continue
                got = difference(own, pivot)
                keep.append(k)
                sizes.append(len(own))
                pivots.append(len(pivot))
                for to, value in zip((near, keys, drops, shared), got, strict=True):
                    to.append(value)
            rest = part.take(pa.array(keep, pa.int32()))
            made = [pa.array(sizes, pa.int64()), pa.array(near, pa.bool_()), pa.array([k.tobytes() for k in keys], pa.binary()), *(pa.array(c, pa.int64()) for c in (drops, shared, pivots))]
            yield pa.RecordBatch.from_arrays([rest.column(3), rest.column(0), rest.column(4), *made], names)

    sets = staged(members.select("row", "component", "sig", "text").mapInArrow(hashed, "row bigint, component bigint, sig binary, hashes binary"), "sets")
    groups = sets.groupBy("component").agg(F.min("row").alias("pivot"), F.ceil(F.count("*") / LEAST_TEXTS).cast("int").alias("shares"))
    dealt = sets.join(redealt(groups, "component"), "component")
    own = dealt.select("component", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int").alias("share"), F.lit(False).alias("leads"), "row", "sig", "hashes")
    pivots = sets.join(groups.select(F.col("pivot").alias("row"), "shares"), "row")
    led = pivots.select("component", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(True).alias("leads"), "row", "sig", "hashes")
    ordered = own.unionByName(led).repartition("component", "share").sortWithinPartitions("component", "share", F.col("leads").desc(), "row")
    out = staged(ordered.mapInArrow(written, kinds), "differences")
    release(sets)
    return out


def verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows (row, links, root) for members(row, component, sig, text) of candidate groups; staged."""
    sets = with_sets(members, n)
    sizes = sets.groupBy("component").agg(F.count("*").alias("texts"), F.sum(F.length("keys").cast("bigint")).alias("bytes"))
    even = F.least(F.lit(SPREAD_BLOCKS), F.ceil(F.col("texts") / LEAST_TEXTS))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES), even).cast("int")
    blocked = sizes.select("component", blocks.alias("blocks"))
    placed = sets.select("row", "component", "sig").join(redealt(blocked, "component"), "component").withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # a unit (x, x) holds one block; (x, y) holds both
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "row", "sig"
    )

    def partners(unit, side, rows, sigs):
        left = np.unique(np.concatenate(unit_pairs(side, sigs, threshold)))
        return [(*unit, side[k], rows[k]) for k in left.tolist()]

    def links(unit, side, rows, sigs, size, near, keys, drops, shared, pivot_size):
        a, b = unit_pairs(side, sigs, threshold)
        if not len(a):
            return []
        own = Sets(np.asarray(near), [np.frombuffer(k, np.uint64) for k in keys], np.asarray(drops), np.asarray(size), np.asarray(shared), pivot_size[0])
        good = own.linked(a, b, threshold)
        return spanning(rows, a[good], b[good]) if good.any() else []

    alive = staged(in_units(units, partners, ["component", "x", "y", "side", "row"]), "partners")
    columns = ["sig", "size", "near", "keys", "drops", "shared", "pivot_size"]
    dealt = alive.join(sets.select("row", *columns), "row").select("component", "x", "y", "side", "row", *columns)
    out = staged(in_units(dealt, links, ["row", "links", "root"]), "links")
    release(sets, alive)
    return out


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, digest, class_id, keeper, n_links, n_copies), one for each row of df.

    class_id is the smallest id among the documents that links and copies connect; keeper is
    the digest of the one text that stands for them: of that id's texts, if it has more, the smallest; n_links counts
    the different texts that this text is linked to; n_copies the documents of this very text;
    digest is the MD5 of the text.
    """
    made = staged(sketch(df, n, id_col, text_col), "sketch")
    known = made.where("digest is not null")
    classes = staged(known.groupBy("digest").agg(F.min("row").alias("rep"), F.min("id").alias("first_id"), F.count("*").alias("n_copies")), "classes")
    reps = staged(known.where(F.size("bands") > 0).join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "digest", "bands", "sig"), "reps")
    candidates = candidate_groups(reps, threshold)
    wanted = reps.select("row", "digest", "sig").join(candidates.withColumnRenamed("id", "row"), "row")
    text = F.col(text_col).cast("string")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    first = made.select("row", "id").join(wanted, "row")  # one document's text stands for its class
    members = staged(texts.join(first, ["id", "digest"]).groupBy("row").agg(F.first("component").alias("component"), F.first("sig").alias("sig"), F.first("text").alias("text")), "members")
    found = verified(members, n, threshold)
    release(members, reps)
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    tied = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links.withColumnRenamed("row", "rep"), "rep", "left").join(tied.withColumnRenamed("id", "rep"), "rep", "left")
    joined = joined.withColumn("component", F.coalesce("component", "rep"))
    names = joined.groupBy("component").agg(F.min(F.struct("first_id", "digest")).alias("k")).select("component", F.col("k.first_id").alias("class_id"), F.col("k.digest").alias("keeper"))
    by_class = joined.join(names, "component").select("digest", "class_id", "keeper", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = known.select("id", "digest").join(redealt(by_class, "digest"), "digest").select("id", "digest", "class_id", "keeper", "n_links", "n_copies")
    alone = made.where("digest is null").select("id", "digest", F.col("id").alias("class_id"), F.col("digest").alias("keeper"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    nameless = df.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.lit(None).cast("binary").alias("digest"), F.col(id_col).alias("class_id"), F.lit(None).cast("binary").alias("keeper"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return out.unionByName(alone).unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links and n_copies for every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


QUERIES = {"op1_ngram_jaccard": query}
ORACLES = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE c AS (
  SELECT text, min(doc_id) AS first_id, count(*) AS n_copies,
         list_filter(string_split_regex(regexp_replace(lower(text), '([UNSPACED])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS (
  SELECT DISTINCT first_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM c WHERE len(w) > 0),
n AS (SELECT first_id, count(*) AS size FROM s GROUP BY first_id),
p AS (SELECT x.first_id AS a, y.first_id AS b, count(*) AS common
      FROM s x JOIN s y ON x.g = y.g AND x.first_id <> y.first_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.first_id = a JOIN n nb ON nb.first_id = b
      WHERE common >= 0.8 * (na.size + nb.size - common) - 1e-9),
r(a, b) AS (SELECT first_id, first_id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS first_id, min(b) AS class_id FROM r GROUP BY a),
d AS (SELECT a AS first_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM documents JOIN c USING (text) JOIN k USING (first_id) LEFT JOIN d USING (first_id)
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM documents WHERE text IS NULL
""".replace("UNSPACED", UNSPACED)
}
