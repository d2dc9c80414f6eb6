"""From documents to token ids in five stages. Each takes ``(spark, docs, sf_dir)``, and all but the last return the columns of documents.

Between stages the rows are written as Parquet to the shared folder and read again. Everything works on all rows that the stage before
kept. Repeated rows stay repeated until the join keeps one of each group. An empty table passes through as one.

Stages set the session's size of Arrow batches to ``BATCH_BYTES``. Spark's own bound (64 MB, 10,000 rows) holds that much of every running
task outside the heap, several times over, and in Python too; a long run does not give back what lies outside the heap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm import bpe, jaccard, language, mixing, pii
from odflow.llm.queries import tokenizer
from odflow.llm.tables import read, shielded
from odflow.session import write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of an Arrow batch; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 20


def small_batches(stage: Stage) -> Stage:
    """The setting stays, since the stage's rows are read after it returns; a smaller one is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, and texts without letters. ``lang`` becomes the predicted one; without any labelled text it stays as it was."""
    docs, named = shielded(docs, ("doc_id", "text", "lang"))
    model = language.learn(docs)
    judged = language.identify(docs, model).where("has_letters")
    return named(judged.withColumn("lang", F.col("lang_pred")) if model["langs"] else judged)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents linked by a Jaccard similarity of 0.8 or more: that of the smallest id.

    Documents without words are in no group and stay. Rows of null ids yield to others; of repeated rows one stays.
    """
    found = jaccard.components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row_key").alias("_key"))
    docs, named = shielded(docs, ("doc_id", "text"))
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return named(keyed.join(kept, "_key").dropDuplicates(["_key"]))


@small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows."""
    return pii.redact(docs, pii.learn(docs))


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, as documents: one row for each round in which words of a document are taken, with those words alone.

    A document that fills no slot is not part of the mix. At most ``mixing.MOST_ROUNDS`` rows share an id.
    """
    return mixing.mixed_documents(docs)


@small_batches
def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text: ``doc_id, n_tokens, ids, exact``."""
    coded = bpe.encode(docs, *tokenizer(), decoded=True, keep_text=True)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_pairs),
]

#: Learned models and seeded draws are not SQL; the tests check the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
