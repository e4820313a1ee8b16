"""A corpus pipeline of five stages; run() applies them to the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. Rows may repeat after mixing, as copies.

Cases: nulls in any column, empty and very long texts, repeated rows and empty tables pass as each operator's docstring says; a null text goes
at language ID. A document is known by its id and text together: rows that share only the id are never dropped for each other's text. Other
columns than those of documents are left out, whatever their names. Rows equal in id and text are one document in near-dedup and stay all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminet.llm import langid, linededup, minhash, mixing
from laminet.llm.catalog import digests
from laminet.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those without text or a letter, and those coded worse than by a uniform code. lang
    becomes the predicted language."""
    got = langid.predict(docs.select(*COLUMNS), langid.trained(docs))
    return got.where((F.col("lang_pred") != "und") & (F.col("bits") <= langid.REJECT_BITS)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one is like go, and documents that thereby have no word left."""
    got = linededup.dedup_lines(docs.select(*COLUMNS))
    lost = F.size("gone") > 0
    got = got.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return got.where(~lost | F.col("text").rlike(r"\S")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    own = docs.select(*COLUMNS)
    return own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all to three times."""
    got = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), "copies")
    got = cut(got.groupBy("_id", "_size", "_source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "copies")
    # Rows alike in id, source and size share their copies: the first ones get one more where they don't come out even.
    own = docs.select(*COLUMNS).withColumn("_words", mixing.words(F.col("text")))
    rows = own.join(got, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))
    single = rows.where("rows = 1").withColumn("_n", F.col("copies"))
    w = F.row_number().over(_alike())
    shared = rows.where("rows > 1").withColumn("_n", F.floor(F.col("copies") / F.col("rows")) + F.when(w <= F.col("copies") % F.col("rows"), 1).otherwise(0))
    both = single.select(*COLUMNS, "_n").unionByName(shared.select(*COLUMNS, "_n")).where("_n > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*COLUMNS)


def _alike():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id", "source", "_words").orderBy("text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    return digests(docs, ["doc_id"])


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing", mixture), ("byte-level BPE", tokens)]

#: The stages hash and train; SQL can't express them. tests/llm/test_pipeline.py compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
