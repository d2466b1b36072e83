"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import quality_model, quality_rules, queries, repeats, shingle_join
from wardlight.llm.tables import small_batches, tidy, written
from wardlight.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Repeated passages go from this many words on, and from 400 bytes on, whichever they have first.
PASSAGE_WORDS = 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score is 0.3 or more."""
    small_batches(spark)
    model = quality_model.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs, model).where("score >= 0.3").select(*COLUMNS)


def robust_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and lie within their group's estimate."""
    small_batches(spark)
    tidy(spark)
    model = quality_rules.fit(quality_rules.statistics(docs, keep=["lang", "source"]))
    return quality_rules.judge(quality_rules.statistics(docs), model).where("kept").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies.

    Rows are numbered first, so rows that repeat an id or have none take part
    like any other.  The row with the smallest id stays; no id comes last.
    """
    small_batches(spark)
    tidy(spark)
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = shingle_join.near_duplicates(rows, key="_row").where("n_links > 0")
    tidy(spark)
    linked = written(found.select("_row", "component_id").join(rows.select("_row", "doc_id"), "_row"), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    survivors = linked.groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    dropped = written(linked.select("_row").join(survivors, "_row", "left_anti"), "dropped")
    return rows.join(dropped, "_row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages of over 50 words, or of 400 bytes, out of the texts; a character goes as a whole."""
    small_batches(spark)
    tidy(spark)
    cut = repeats.remove_repeats(docs, keep=["doc_id", "lang", "source"], whole_characters=True, passage_words=PASSAGE_WORDS)
    text = F.col("kept_bytes").cast("string")
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise the documents and pack them into training sequences, token ids included."""
    small_batches(spark)
    tidy(spark)
    return queries.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", robust_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: The classifiers and the outlier estimate are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
