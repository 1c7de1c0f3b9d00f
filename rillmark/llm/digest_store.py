"""Results kept by content: a table of ``digest, version`` and what was computed for them.

``resolve`` looks every document's content up by its SHA-256, computes only what no earlier run has stored for the same
version, appends that, and joins the stored results back to all documents. Equal texts are computed once: they are
reduced to one before the shuffle, so a large group of copies costs one row a map task, and on the way back digests of many
documents are joined by a broadcast of theirs alone. The store is a folder of Parquet files that driver and executors share; runs
append, and a pair appended twice by concurrent runs is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm.graph import join_lookup
from rillmark.llm.text import whole
from rillmark.scratch import materialize, new_folder


def open_store(spark: SparkSession, name: str) -> str:
    """The store in the folder that ``rillmark.store.dir`` names, where runs find what earlier ones have kept; without that setting a
    new, empty one in the shared scratch folder."""
    lasting = spark.conf.get("rillmark.store.dir", None)
    return f"{lasting.rstrip('/')}/{name}" if lasting else new_folder(spark, name)


def stored(spark: SparkSession, path: str, fields: str, version: str) -> DataFrame | None:
    """``digest`` and the fields kept for the version, or None while nothing has been written to the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    schema = T.StructType.fromDDL(f"digest string, version string, {fields}")
    return spark.read.schema(schema).parquet(path).where(F.col("version") == version).drop("version").dropDuplicates(["digest"])


def digest(text: Column) -> Column:
    """SHA-256 of the normalised content: a null text is the empty one, nothing else changes."""
    return F.sha2(whole(text).cast("binary"), 256)


def resolve(docs: DataFrame, store: str, version: str, compute, fields: str, text: str = "text") -> DataFrame:
    """``docs`` packed in ``row``, without its text but with ``n_bytes``, and the result in ``found``.

    ``compute`` maps a text column to a struct with the fields of the DDL ``fields``."""
    spark = docs.sparkSession
    known = stored(spark, store, fields, version)
    blobs = docs.select(digest(docs[text]).alias("digest"), whole(docs[text]).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = blobs if known is None else blobs.join(known, "digest", "left_anti")
    misses.select("digest", F.lit(version).alias("version"), compute(F.col("text")).alias("r")).select("digest", "version", "r.*").write.mode("append").parquet(store)
    known = stored(spark, store, fields, version)
    names = [f.name for f in T.StructType.fromDDL(fields)]
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"),
        F.octet_length(whole(docs[text])).cast("long").alias("n_bytes"),
        digest(docs[text]).alias("digest"),
    )
    rows = materialize(rows, "digests")
    return join_lookup(rows, known.select("digest", F.struct(*names).alias("found")), "digest")
