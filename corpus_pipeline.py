"""From raw documents to token ids: every stage reads what the one before it wrote.

All stages but the last return the columns of ``documents``. From the second stage on equal rows are one document; rows
that share an id, or have none, and differ in any column are documents of their own. An empty table passes through all
stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gravitas.llm import anchors, neardup, queries, runindex, winnow
from gravitas.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_own_ids(docs: DataFrame) -> DataFrame:
    """Equal rows once, and ``doc_id`` as (id, digest of the row) where an id, or none, stands in several rows.

    The ids keep their order. Texts are shuffled only if an id does repeat.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    row = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).cast("binary")
    return docs.withColumn("doc_id", F.struct("doc_id", F.sha2(row, 256).alias("row"))).dropDuplicates(["doc_id"])


def plain_id(docs: DataFrame) -> Column:
    """The id as it was before ``with_own_ids``."""
    return F.col("doc_id.doc_id" if isinstance(docs.schema["doc_id"].dataType, StructType) else "doc_id")


def with_plain_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", plain_id(docs))


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score below ``queries.ACCEPTED`` go, all others stay as they are."""
    scored = queries.quality_scores(docs.select(COLUMNS), queries.table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= queries.ACCEPTED).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash: of each group of linked documents (5 words, similarity 0.8) the one with the smallest id stays.

    Of linked documents under one id the one whose row has the smallest digest stays. Documents without an id are linked
    with nothing and stay.
    """
    docs = with_own_ids(docs.select(COLUMNS))
    gone = neardup.near_duplicates(docs.where(plain_id(docs).isNotNull())).where("not kept").select("doc_id")
    return with_plain_ids(anchors.same_id(docs, gone, "left_anti").select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of strings that also start earlier go, with the rest of a character cut in two.

    Every document stays, with what is left of its text; ``n_chars`` follows. A null text stays null.
    """
    docs = with_own_ids(docs.select(COLUMNS))
    kept = runindex.kept_texts(anchors.with_spans(docs, runindex.repeated_bytes(docs)))
    rest = docs.select("doc_id", F.col("text").isNull().alias("missing"), "lang", "source")
    text = F.when(~F.col("missing"), F.col("kept"))
    cut = anchors.same_id(rest, kept, "inner").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    return with_plain_ids(cut)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold ten consecutive words of a benchmark item (or a whole shorter
    one) go."""
    docs = with_own_ids(docs.select(COLUMNS))
    found = winnow.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    return with_plain_ids(anchors.same_id(docs, found.where(F.size("spans") > 0).select("doc_id"), "left_anti").select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number and digests."""
    return queries.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", accept),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL cannot express a trained network, MinHash components, byte spans or the tokenizer; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table of documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
