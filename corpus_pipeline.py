"""From raw documents to training shards: each stage takes what the one before it kept.

``STAGES`` lists the stages; ``run`` applies them to the ``documents`` of a folder, each written as Parquet below the shared
folder and read again. Rows without a ``doc_id`` pass every stage on the same terms as others. Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofid.llm import decontamination, merkle, mixing, ngram_join, sharding, toxicity
from chronofid.session import checkpointed, shared_folder

#: Shares of the expected tokens after mixing.
TARGETS = {"clean": 0.98, "junk": 0.02}
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity."""
    return toxicity.split_toxic(docs, table(spark, sf_dir, "labels"))


def named_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_name``: a number of its own for each different text of a ``doc_id``, and for each text without one.

    It is the ``doc_id`` for the first text (by digest) of an id; the others, if there are any, get numbers beyond all ids.
    """
    digest = F.coalesce(F.md5("text"), F.lit(""))
    texts = docs.select("doc_id", digest.alias("digest")).distinct()
    first = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.digest") == F.col("r.digest"))
    others = checkpointed(texts.alias("l").join(first.alias("r"), same, "left_anti"))
    if others.isEmpty():
        return docs.withColumn("_name", F.col("doc_id"))
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    numbers = merkle.numbered(others.withColumn("grp", F.lit("")), ["doc_id", "digest"])
    free = F.col("pos") + (1 + (most or 0)) if (most or 0) < 1 << 62 else F.lit(least - 1) - F.col("pos")
    joined = docs.withColumn("digest_", digest).alias("l").join(
        checkpointed(numbers.select("doc_id", "digest", free.alias("name"))).alias("r"),
        F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.digest_") == F.col("r.digest")),
        "left",
    )
    return checkpointed(joined.select(*[F.col(f"l.`{c}`") for c in docs.columns], F.coalesce("r.name", "l.doc_id").alias("_name")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the document with the smallest id, once.

    Different texts under one id are documents of their own, and so are texts without an id; a row that repeats
    both id and text goes, of its rows the first by their other columns stays.
    """
    named = named_texts(docs)
    groups = ngram_join.near_duplicates(named.select(F.col("_name").alias("doc_id"), "text"), width=5, percent=80)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first"))
    kept = named.join(first, F.col("_name") == F.col("_first"), "left_semi")
    rest = [F.col(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    place = F.row_number().over(Window.partitionBy("_name").orderBy(*rest or [F.lit(0)]))
    return kept.withColumn("_place", place).where("_place = 1").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontamination.decontaminate_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that clean and junk tokens meet ``TARGETS``."""
    domain = F.when(F.coalesce("toxic", F.lit(0)) == 1, None).when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")
    labelled = table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    return mixing.mixed_documents(docs, labelled, TARGETS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ``shard`` and ``slot``."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages learn models and follow links, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
