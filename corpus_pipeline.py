"""A training corpus from raw documents: language ID, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents, and any others, whatever
their names. An empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm import language_id, ngram_jaccard, packing, substring_dedup
from typeweave.llm.common import ship, staged

#: Documents of a lower score have no language that can be told. A score is a product of chances, so it is
#: kept low: short texts, and texts among many families, have low scores. No clean document of the test tables is below.
MIN_LANGUAGE_SCORE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = MIN_LANGUAGE_SCORE) -> DataFrame:
    """Drops documents without a language that can be told; fills in lang where it is null.

    A document goes if its text is null or has no letters, if its score is below min_score, or if it
    has a smaller share of known trigrams than the model asks for. Repeated rows are judged each;
    rows of a null id like others. Where no row has a lang, only texts without letters go.
    """
    ship(spark)
    model = language_id.train(docs)
    if model is None:  # nothing to learn from: only texts without letters go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs, model, keep=True)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("share") >= model.least_share))
    return kept.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates one document, that of the smallest id; rows without id stay.

    Of a repeated id with several texts in one group, the text with the smallest digest stays. Equal rows become
    one. Null and empty texts are near nothing but equal texts: null ones all stay, each empty one after
    the first goes.
    """
    ship(spark)
    found = ngram_jaccard.groups(docs).where("id = class_id AND digest <=> keeper").select("id", "digest").distinct()
    own = docs.select(F.col("doc_id").alias("own_id"), F.unhex(F.md5("text")).alias("own_digest"), F.struct("*").alias("row"))
    kept = own.join(found, (F.col("own_id") == F.col("id")) & F.col("own_digest").eqNullSafe(F.col("digest")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_digest"]).select("row.*").unionByName(docs.where("doc_id IS NULL"))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; texts keep the rest.

    Every row stays, with n_chars as the text now is, though a text may become empty. Null and empty
    texts stay as they are, and rows without id are left alone. Among equal ids the order is that of the rows.
    """
    ship(spark)
    return substring_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 1024, a row for each piece.

    A null or empty text is a piece of the end id alone; repeated rows are packed each, rows of a null id too.
    """
    ship(spark)
    return packing.placed_digests(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", no_near_duplicates),
    ("substring_dedup", no_repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL can't express language ID; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of a folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
