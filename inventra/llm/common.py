"""What the corpus operators share: the contract's word pattern, table access, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inventra.operators.graph import components, delete_staged, staged  # noqa: F401

#: A word is a run of anything but these six white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The same as a literal inside a SQL expression, where backslashes are doubled.
WORD_SQL = "'" + WORD.replace("\\", "\\\\") + "'"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions, as a table in one small file does; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 where the id is null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(n), F.lit(-1))


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within the limit; otherwise the planner's shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_chars: int, held_out: tuple[int, tuple[int, ...]], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int]]:
    """Up to per_class documents of each of the labels 0 and 1, in the order of a hash of the id, as (id, whole text, label).

    Documents of over max_chars characters are not sampled, so at most 2 * per_class * max_chars characters are gathered.
    held_out = (n, remainders): ids whose crc32 modulo n is one of these are left out."""
    n, out = held_out
    clean = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    clean = clean.where(~crc_mod(F.col("_id"), n).isin(*out, -1)).groupBy("_id").agg(F.max("_label").alias("_label"))
    order = F.xxhash64(F.col("_id"), F.lit("sample"))
    ids = None
    for label in (0, 1):
        own = clean.where(F.col("_label") == label).orderBy(order, "_id").limit(2 * per_class)
        ids = own if ids is None else ids.unionByName(own)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") <= max_chars)
    # at most 4 * per_class ids; of those that have a text, per_class of each label are gathered
    found = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).withColumn("_order", order)
    first = W.partitionBy("_label").orderBy("_order", "_id")
    rows = found.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= per_class).collect()
    return [(r["_id"], r["_text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["_label"], r["_order"], r["_id"]))]
