"""Operator 5: licence scans by canonical digest, in DataFrame functions alone.

A text is brought to canonical words: lower case, copyright notices dropped, bullets dropped,
punctuation and white space made single blanks, equivalent spellings made one. The digest
of the whole canonical text is hash-joined to the digests of known licences, each with and without
its usual titles. The known side is broadcast only while its own size is within a bound; past it
the join shuffles digests.

A copyright notice is a line of bounded length, or what stands before a licence's first words in a
longer line; a text that is one line keeps the licence itself.

Cases: a null text, or one without letters or digits, has a null digest and matches nothing;
repeated rows are matched each; two known licences of one canonical text give the smaller id;
an empty table on either side gives no match; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.licence_texts import EQUAL_SPELLINGS, FULL_TEXT_DIGESTS, LICENCES, OPENINGS, TITLES

#: Known digests up to this number are broadcast: 48 bytes each.
BROADCAST_ROWS = 100_000

#: A notice: the word or sign, then a year, a holder or nothing more; with its line's end, of which \\z is one.
NOTICE = r"(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]|by |holder|all rights)"
RIGHTS = r"all rights reserved[^\na-z0-9]*"
#: Lines in a row that only claim rights. One match takes all of them, so none keeps the next from matching.
CLAIM_LINES = rf"(^|\n)([^\na-z0-9]*({NOTICE}[^\n]{{0,200}}|{RIGHTS})(\n|\z))+"
#: A claim with a sign or year in the line in which the licence begins, whose first words are the last group.
CLAIM_BEFORE = rf"(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9])[^\n]{{0,200}}?({RIGHTS})?({'|'.join(OPENINGS)})"
#: Without any of these a text has no claim.
CLAIM_SIGNS = ("copyright", "(c)", "©", "all rights")
#: Numbers and letters of a list, at the beginning of a line or behind the end of what was before.
BULLETS = r"(?:^|\n|[.:;][ \t])[ \t]*(?:[0-9]{1,2}|[a-z])[.)][ \t]"
#: Everything but ASCII letters and digits and the letters of other scripts.
NO_WORD = r"[^\p{L}\p{N}]+"


def _spellings() -> list[tuple[str, str]]:
    """(words to find, words to put), those of more words first. Every word has blanks of its own."""
    framed = lambda words: " " + "  ".join(words.split()) + " "
    return [(framed(old), framed(new)) for old, new in sorted(EQUAL_SPELLINGS, key=lambda pair: -len(pair[0].split()))]


def canonical(text: Column) -> Column:
    """The canonical words of a text, parted by single blanks."""
    out = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    claims = functools.reduce(Column.__or__, (F.contains(out, F.lit(sign)) for sign in CLAIM_SIGNS))
    out = F.when(claims, F.regexp_replace(F.regexp_replace(out, CLAIM_LINES, "\n"), CLAIM_BEFORE, "$4")).otherwise(out)
    out = F.regexp_replace(out, BULLETS, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NO_WORD, "  "), F.lit(" "))
    for old, new in _spellings():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, " +", " "))


def digests(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows (key, digest): lower-case hex SHA-256 of the canonical text; null where it is empty.

    The canonical text is a column of its own first, or it would be made twice.
    """
    words = df.select(F.col(key), canonical(text).alias("words"))
    return words.select(key, F.when(F.col("words") != "", F.sha2("words", 256)).alias("digest"))


def _titled() -> list[tuple[str, str]]:
    """(licence id, text) of the texts that are known in full, with each of their titles and without."""
    return [(name, title + "\n\n" + text) for name, text in sorted(LICENCES.items()) for title in ("", *TITLES.get(name, ()))]


def _literal_rows(spark: SparkSession, rows: list[tuple[str, str]], *names: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))))


def known_licences(spark: SparkSession) -> DataFrame:
    """Rows (licence_id, digest) of all licences known here."""
    made = digests(_literal_rows(spark, _titled(), "licence_id", "licence_text"), "licence_id", F.col("licence_text"))
    return made.unionByName(_literal_rows(spark, FULL_TEXT_DIGESTS, "licence_id", "digest"))


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, digest, licence_id) for each row of df; known has licence_id and digest, as digests() makes them."""
    own = digests(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", F.col("text"))
    sides = known.where("digest IS NOT NULL").groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    if sides.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sides = F.broadcast(sides)
    return own.join(sides, "digest", "left").select("id", "digest", "licence_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the digest of the whole canonical text, and the licence it is, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, known_licences(spark)).withColumnRenamed("id", "doc_id")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, new in ((r"\r\n?", "\n"), (CLAIM_LINES, "\n"), (CLAIM_BEFORE, r"\4"), (BULLETS, "\n"), (NO_WORD, "  ")):
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    out = f"concat(' ', {out}, ' ')"
    for old, new in _spellings():
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _sql() -> str:
    values = lambda rows: ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in rows)
    return f"""
WITH canon AS (SELECT doc_id, {_sql_canonical("text")} AS words FROM documents WHERE text IS NOT NULL),
own AS (SELECT d.doc_id, CASE WHEN c.words <> '' THEN sha256(c.words) END AS digest
        FROM (SELECT doc_id, text FROM documents) d LEFT JOIN canon c ON c.doc_id = d.doc_id),
every AS (SELECT sha256({_sql_canonical("licence_text")}) AS digest, licence_id FROM (VALUES {values(_titled())}) t(licence_id, licence_text)
          UNION ALL SELECT digest, licence_id FROM (VALUES {values(FULL_TEXT_DIGESTS)}) t(licence_id, digest)),
known AS (SELECT digest, min(licence_id) AS licence_id FROM every GROUP BY digest)
SELECT own.doc_id, own.digest, known.licence_id FROM own LEFT JOIN known ON known.digest = own.digest
"""


QUERIES = {"op5_licence_scan": query}
ORACLES = {"op5_licence_scan": _sql()}
