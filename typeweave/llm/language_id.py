"""Operator 4: language identification by hierarchical discrimination.

Features are the mean weights of a text's byte n-grams (lower case, everything but letters as
blanks). A linear model tells the language family first; within a family, one-versus-one linear
support vector machines tell its languages apart, and the language with most votes, then the
largest sum of margins, is taken. Scores are probabilities: that of the family, from its margin,
times the mean of the pairwise ones.

Scores only compare the languages of the model. Whether a text is in one of them at all is told by
the share of its trigrams that the labelled rows hold: foreign texts and random letters have a low
one, however many languages there are. Its least value is taken from the labelled rows themselves.
All labelled rows of all languages are counted for both, in two readings of their texts; the driver
gets BUCKETS rows of counts, and no more rows for each step towards the least value.

The models are fitted on the driver to a bounded sample of labelled rows: about FIT_ROWS_EACH rows
of a language, FIT_ROWS and FIT_BYTES of text in all, drawn by the hashes of their ids, of the
FIT_LANGUAGES most frequent languages. Whole texts are read, in fitting and in prediction. A
binary model has 128 KB; those of all languages in FAMILIES have 31 MB, and are broadcast.

Cases: a null text, or one without letters, is `und` with score 0; where no row is labelled,
everything is `und`; languages that FAMILIES doesn't name are a family of their own each;
repeated rows are predicted each; long texts are rows like others; an empty table gives an empty result; lang is read for fitting
only, other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.common import release, slices, staged

UNKNOWN = "und"
#: Bounds of the sample to which the models are fitted; with fewer rows all are taken.
FIT_ROWS_EACH, FIT_ROWS, FIT_BYTES, FIT_LANGUAGES = 400, 8192, 32 << 20, 256
#: Of fewer labelled rows no least share of known trigrams is taken: they hold too little of a language.
SHARE_ROWS = 50
#: A trigram is known if a labelled row has it, and one more for each so many, so that a few odd rows add none;
#: or if two rows of a language have it, and one more for each so many of that language, however rare it is.
ROWS_A_VOTE = 500
#: The least share is taken from that below which one in so many labelled rows are. Languages count alike there,
#: as SHARE_ROWS rows each, so that the rows of a frequent one decide no more than others.
LOW_ROWS = 100
#: Languages whose counts a task holds at a time, 256 KB each.
COUNTED_LANGUAGES = 32
#: Known trigrams that each text is given, or one odd word would be too many in a short one.
GIVEN = 8
#: The least share is this part of the share that 99 % of the labelled rows have.
SHARE_PART = 0.9
#: Buckets of hashed n-grams, and the lengths of n-grams in bytes.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Language codes by family.
FAMILIES: dict[str, tuple[str, ...]] = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
}

_LETTER = regex.compile(r"\p{L}")
#: Bytes below 128 that are no letters become blanks; letters of other scripts are higher bytes.
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letters(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """For each text the buckets (orders x places) of the n-grams that begin at each of its bytes.

    Every text stands between blanks, of which those at its end that a longest n-gram would pass begin none;
    so a text's n-grams do not depend on the text behind it.
    """
    behind = max(ORDERS) - 1
    parts = [b" " + " ".join(t.lower().split()).encode("utf-8", "replace").translate(_BLANKS) + b" " * (behind + 1) for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    out, code = np.empty((len(orders), len(raw)), np.uint16), np.zeros(len(raw), np.uint32)
    for order in range(1, max(orders) + 1):
        shifted = np.zeros(len(raw), np.uint32)
        shifted[: len(raw) - order + 1] = raw[order - 1 :]
        code = (code << np.uint32(8)) | shifted
        if order in orders:
            mixed = (code + np.uint32(order * 0x51ED)) * np.uint32(0x9E3779B1)
            out[orders.index(order)] = (mixed ^ mixed >> np.uint32(15)) >> np.uint32(17)
    return [out[:, a : b - behind] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


#: The bucket of a blank.
_BLANK = int(grams([""])[0][0, 0])


def trigrams(codes: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's trigrams that begin with a letter, and the number of each; from its grams() of these orders."""
    at, counts = np.unique(codes[orders.index(3)][codes[orders.index(1)] != _BLANK], return_counts=True)
    return at, counts.astype(np.uint32)


def usable(df: DataFrame) -> DataFrame:
    """The labelled rows of df(id, text, lang): those with a lang and a letter."""
    return df.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def trigram_rows(df: DataFrame) -> DataFrame:
    """Rows (lang, bucket, n): how many of the labelled rows df(lang, text) of a language have a trigram of the bucket."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def counted():
            for lang, rows_of in held.items():
                at = np.flatnonzero(rows_of)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(rows_of[at])], ["lang", "bucket", "n"])
            held.clear()

        for part in slices(batches):
            for lang, codes in zip(part.column(0).to_pylist(), grams(part.column(1).to_pylist(), (1, 3)), strict=True):
                if lang not in held and len(held) == COUNTED_LANGUAGES:
                    yield from counted()
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))[trigrams(codes, (1, 3))[0]] += 1
        yield from counted()

    return df.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def known_trigrams(df: DataFrame) -> tuple[np.ndarray, float]:
    """Whether each bucket is one of a known trigram, and the least share of them in a text; from
    all labelled rows of df(id, text, lang). For these shares a trigram needs a vote more, so a row's own doesn't count."""
    own = usable(df).select("lang", "text")
    sizes = staged(own.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    spare = F.col("n") - (2 + F.floor(F.col("rows") / ROWS_A_VOTE))
    got = trigram_rows(own).join(sizes, "lang").groupBy("bucket").agg(F.greatest(F.sum("n") - (1 + total // ROWS_A_VOTE), F.max(spare)).alias("spare")).where("spare >= 0").toArrow()
    known, sure = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, bool)
    at, spares = got.column("bucket").to_numpy(), got.column("spare").to_numpy()
    known[at], sure[at[spares > 0]] = True, True
    least = 0.0
    if total >= SHARE_ROWS:
        shares = staged(known_shares(own, sure), "shares")
        least = SHARE_PART * low_share(shares, sizes)
        release(shares)
    release(sizes)
    return known, least


def known_shares(df: DataFrame, known: np.ndarray) -> DataFrame:
    """Rows (lang, bits): the share of known trigrams of each row of df(lang, text), as the bits of a double."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for part in slices(batches):
            shares = [known_share(*trigrams(codes, (1, 3)), shared.value) for codes in grams(part.column(1).to_pylist(), (1, 3))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.asarray(shares, np.float64).view(np.int64))], ["lang", "bits"])

    return df.mapInArrow(run, "lang string, bits long")


def low_share(df: DataFrame, sizes: DataFrame) -> float:
    """The share below which one in LOW_ROWS is, rounded down; of all rows df(lang, bits), where every language
    counts as SHARE_ROWS rows, or as its own if it has fewer. sizes(lang, rows) has the rows of each.

    Bits of doubles of 0 or more are in the order of the numbers. They are counted by their first 16, then by 16 more
    of those that begin as the wanted one does, so that the driver gets 65,536 rows at most each time.
    """
    unit = 1 << 36
    weight = F.expr(f"least(rows, {SHARE_ROWS}) * {unit}L div rows")
    sought = (sizes.agg(F.sum(F.col("rows") * weight)).first()[0] - unit) // LOW_ROWS
    for shift in (48, 32, 16, 0):
        first = F.shiftright("bits", shift)
        found = df.groupBy("lang", first.alias("first")).agg(F.count("*").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high")).join(sizes, "lang")
        found = found.groupBy("first").agg(F.sum(F.col("n") * weight).alias("weight"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by("first")
        ends = np.cumsum(found.column("weight").to_numpy())
        at = int(np.searchsorted(ends, sought, side="right"))
        begin, low, high = (found.column(c)[at].as_py() for c in ("first", "low", "high"))
        if low == high:
            break
        sought -= int(ends[at - 1]) if at else 0
        df = df.where(first == begin)
    return float(np.int64(low).view(np.float64))


def known_share(at: np.ndarray, counts: np.ndarray, known: np.ndarray) -> float:
    return float((counts[known[at]].sum() + GIVEN) / (counts.sum() + GIVEN))


def mean_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares among its n-grams."""
    (codes,) = grams([text])
    counts = np.bincount(codes.ravel(), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / codes.size).astype(np.float32)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, seed: int = 3, epochs: int = 12, c: float = 10.0) -> tuple[np.ndarray, float, float]:
    """Weights, bias and margin scale of a linear SVM by dual coordinate descent.

    Rows are (buckets, values), scaled to length 1 while fitting. The margin scale turns margins
    into log odds: it is fitted to the rows' own margins by a few Newton steps.
    """
    norms = [float(np.sqrt((v * v).sum())) or 1.0 for _, v in rows]
    own = [(b, v / n) for (b, v), n in zip(rows, norms, strict=True)]
    w, bias, alpha = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(len(own))
    share = np.where(signs > 0, len(signs) / max(1, 2 * (signs > 0).sum()), len(signs) / max(1, 2 * (signs < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            at, values = own[i]
            slope = signs[i] * (float(w[at] @ values) + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), c * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[at] += step * values
                bias += step
                alpha[i] = new
    margins = np.asarray([float(w[b] @ v) + bias for b, v in own]) * signs
    scale = float(np.log(19) / max(1e-3, np.quantile(margins, 0.25)))
    return w, bias, min(scale, 10.0)


@dataclass
class Model:
    """families: names and their languages; weights: a column for each binary model.

    one_versus_rest[f] is family f's column; pairs has (family, first, second, column).
    known: whether each bucket is one of a known trigram; least_share: what a text must have of them.
    """

    families: list[tuple[str, list[str]]]
    weights: np.ndarray
    biases: np.ndarray
    scales: np.ndarray
    one_versus_rest: list[int]
    pairs: list[tuple[int, int, int, int]]
    known: np.ndarray | None = None
    least_share: float = 0.0

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, score and share of known trigrams of each text."""
        codes = grams(texts)
        sums = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        norms = np.empty(len(texts))
        for row, buckets in enumerate(codes):
            counts = np.bincount(buckets.ravel(), minlength=BUCKETS) if buckets.size > BUCKETS else None
            if counts is None:
                at, own = np.unique(buckets, return_counts=True)
            else:
                at = np.flatnonzero(counts)
                own = counts[at]
            own = own.astype(np.float32)
            norms[row] = np.sqrt(float(own @ own))
            sums[row] = own @ self.weights[at]
        odds = (sums / norms[:, None] + self.biases) * self.scales
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out = []
        for row in range(len(texts)):
            family = 0
            family_chance = 1.0
            if len(self.families) > 1:
                own = chance[row, self.one_versus_rest]
                family = int(np.argmax(odds[row, self.one_versus_rest]))
                family_chance = float(own[family] / own.sum())
            names = self.families[family][1]
            votes, margins, likely = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
            for f, i, j, column in self.pairs:
                if f == family:
                    p = chance[row, column]
                    votes[i if p >= 0.5 else j] += 1
                    margins[i] += odds[row, column]
                    margins[j] -= odds[row, column]
                    likely[i] += p
                    likely[j] += 1 - p
            best = max(range(len(names)), key=lambda k: (votes[k], margins[k]))
            within = likely[best] / (len(names) - 1) if len(names) > 1 else 1.0
            share = 1.0 if self.known is None else known_share(*trigrams(codes[row]), self.known)
            out.append((names[best], float(min(1.0, family_chance * within)), share))
        return out


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """A model from (language, buckets, values); None without rows."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    family_of = {lang: name for name, own in FAMILIES.items() for lang in own}
    grouped: dict[str, list[str]] = {}
    for lang in languages:
        grouped.setdefault(family_of.get(lang, lang), []).append(lang)
    families = sorted(grouped.items())
    models, one_versus_rest, pairs = [], [], []

    def add(positive: set[str], negative: set[str]) -> int:
        own = [(lang, b, v) for lang, b, v in rows if lang in positive or lang in negative]
        signs = np.asarray([1.0 if lang in positive else -1.0 for lang, _, _ in own])
        models.append(train_svm([(b, v) for _, b, v in own], signs))
        return len(models) - 1

    if len(families) > 1:
        for _, own in families:
            one_versus_rest.append(add(set(own), set(languages) - set(own)))
    for f, (_, own) in enumerate(families):
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                pairs.append((f, i, j, add({own[i]}, {own[j]})))
    if not models:
        models.append((np.zeros(BUCKETS, np.float32), 0.0, 1.0))
    weights = np.stack([m[0] for m in models], axis=1)
    return Model(families, weights, np.asarray([m[1] for m in models]), np.asarray([m[2] for m in models]), one_versus_rest, pairs)


def labelled_sample(df: DataFrame) -> DataFrame:
    """Rows (lang, buckets binary of int32, values binary of float32): a sample of df(id, text, lang) within the bounds.

    A language's rows are thinned by a threshold on the hash of their id, so no task gets all
    rows of a frequent language; so bounds hold on average, and one row may pass that of bytes.
    """
    spark = df.sparkSession
    labelled = usable(df)
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    found = sizes.orderBy(F.col("n").desc(), "lang").limit(FIT_LANGUAGES).collect()
    if not found:
        return spark.createDataFrame([], "lang string, buckets binary, values binary")
    rows, size = min(FIT_ROWS_EACH, FIT_ROWS // len(found)), FIT_BYTES // len(found)
    shares = {r["lang"]: min(1.0, rows / r["n"], size / r["bytes"]) for r in found}
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    draw = F.pmod(F.xxhash64(F.lit("language id"), F.col("id")), F.lit(1 << 20)) / (1 << 20)

    def run(batches):
        for part in slices(batches):
            got = [mean_features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["lang", "buckets", "values"])

    return labelled.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(run, "lang string, buckets binary, values binary")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shares: bool = True) -> Model | None:
    """A model of the labelled rows; without shares it knows of no trigrams, and all shares are 1."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = labelled_sample(own).collect()
    model = fit(sorted(((r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))
    if model is not None and shares:
        model.known, model.least_share = known_trigrams(own)
    return model


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows (id, lang_pred, score, share) for each row of df; with keep, (row, lang_pred, score, share),
    where row is a struct of all its columns. share is that of known trigrams."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = df.select(F.struct("*").alias("row")) if keep else df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    first = own.schema[0]
    schema = f"{first.name} {first.dataType.simpleString()}, lang_pred string, score double, share double"

    def run(batches):
        model = shared.value
        for part in slices(batches):
            column = part.column(0).field(text_col) if keep else part.column(1)
            texts = column.cast(pa.string()).to_pylist()
            known = [i for i, t in enumerate(texts) if model and has_letters(t)]
            got = [(UNKNOWN, 0.0, 0.0)] * len(texts)
            for i, p in zip(known, model.predict([texts[i] for i in known]) if known else [], strict=True):
                got[i] = p
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g for g, _, _ in got], pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([k for _, _, k in got], pa.float64())], [first.name, "lang_pred", "score", "share"])

    return own.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of fitting: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))), shares=False)
    out = predict(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": query}
