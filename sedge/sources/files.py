"""Files in and out: documents by media type, message logs, archives, and tables that are rebuilt instead of updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
MEDIA_BY_SUFFIX = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json"}
# Ends of fixed values.


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MEDIA_BY_SUFFIX.items() for x in kv)), suffix)


def text_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, refused): path, media, text, sha256 of text files below a folder; others are refused, never decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).withColumn("media", media_type(F.col("path")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", "")
    good = files.where("media is not null").select("path", "media", text.alias("text"), F.sha2("content", 256).alias("sha256"))
    return good, files.where("media is null").select("path", "length")


def message_log(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of messages, each (source, message id) once: the one that came first."""
    rows = spark.read.schema("thread string, role string, text string, at timestamp, source string, message_id string").json(folder)
    first = Window.partitionBy("source", "message_id").orderBy("at", "thread")
    return rows.withColumn("_n", F.when(F.col("message_id").isNull(), 1).otherwise(F.row_number().over(first))).where("_n = 1").drop("_n")


def upserted(held: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest version of each key; a change whose `deleted` holds takes the key away. Tables are rebuilt, as files aren't updated."""
    both = held.withColumn("deleted", F.lit(False)).unionByName(changes.select(*held.columns, "deleted"))
    newest = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("deleted"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1 and not deleted").drop("_n", "deleted")


def purge(index: DataFrame, fresh: DataFrame, document: str, key: str) -> DataFrame:
    """index without entries of re-parsed documents that the new parse no longer has."""
    touched = fresh.select(document).distinct()
    stale = index.join(touched, document, "left_semi").join(fresh.select(key), key, "left_anti").select(key)
    return index.join(stale, key, "left_anti")


def write_archive(segments: DataFrame, folder: str, tenant: Column, month: Column, shards: int = 64) -> None:
    """Segments below tenant-shard, tenant and month; a manifest is the table without the payload."""
    keyed = segments.withColumn("tenant", tenant).withColumn("month", month).withColumn("tenant_shard", F.pmod(F.xxhash64("tenant"), F.lit(shards)))
    keyed.write.mode("append").partitionBy("tenant_shard", "tenant", "month").parquet(folder)


def reconcile(manifest: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """key.., state of segments that are missing, not listed, or whose checksum differs."""
    both = manifest.select(*key, F.col("sha256").alias("listed")).join(stored.select(*key, F.sha2("raw", 256).alias("found")), key, "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "not_listed").when(F.col("found") != F.col("listed"), "differs")
    return both.withColumn("state", state).where("state is not null").select(*key, "state")
