"""A corpus pipeline over `documents`: STAGES in order, each a (name, function) of (spark, docs, sf_dir).

Every stage works on all rows that its predecessor kept and calls one operator of ``tidemark.llm``; all but the last
return the columns of `documents`, and columns beside those, whatever their names, are left out.  Null ids and texts pass
through each stage as the operators define; texts of any length are worked on whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _common as c
from tidemark.llm import contamination, minhash, pieces, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the top grade (good and clean) is at least one half stay.  A null or empty text
    is scored by its shape, equal texts alike (so repeated rows stay or go together), a very long one whole."""
    return quality.selected(docs.select(*COLUMNS), c.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8 or more); a text that nothing
    else resembles always does, whatever other rows share its id."""
    return minhash.one_of_each(docs.select(*COLUMNS), percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths of a benchmark item's shingles go, exactly four fifths included.  Null and blank
    texts contain nothing and stay; repeated rows stay or go together; a long text counts with all its shingles."""
    return contamination.without_contaminated(docs.select(*COLUMNS), c.table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; all documents stay, repeated rows too.  A null text stays null; of
    spans that overlap each byte is replaced once; lines of any length are decoded whole."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: doc_id, n_tokens, ids, round_trip.  Null and empty texts have no ids; each
    row is encoded by itself, whole, so repeated rows repeat."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", redact_pii),
    ("sentencepiece", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stage written and read again."""
    docs = c.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = c.written(docs, f"stage{k}")
    return docs
