"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: its weight's share of the budget, stopped at `cap` times what the source
has, the excess reshared by weight until none is above. Within a source, documents stand in order of size (then id), each
is expected rate = target / size-of-source times, the expectations are prefix-summed, one random offset is added, and a
document is emitted once for each integer that the sum crosses on it. As the order is by size, the words taken differ
from the target by less than the source's largest document.

The rank within a source never needs a source in one task: rows are range-partitioned by (source, size, id), numbered
inside their partition, and shifted by the counts of the partitions before.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source, ordered last; an empty table
gives an empty result; repeated rows are ranked and taken one by one; other columns are ignored by plan() and kept by mix().
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SHARE = 1.0
SEED = "inventra"
#: Offsets have so many values; a power of two keeps sums exact.
GRAIN = 2**32


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("_text").cast(pa.binary()).to_pylist()
        size = pa.array([len(t.split()) if t is not None else 0 for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], size], ["_id", "_source", "_key", "_size"])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, _source, _key, _size): one row per document; _key tells documents of one id apart by their text."""
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_sizes, f"_id {kind}, _source string, _key long, _size long")


def targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds weight and target to (source, size): one row per source, so a window over all of them is small.

    With sources in order of cap/weight, capping the first k leaves level(k) words per unit of weight for the rest; the
    level rises while sources must be capped and falls after, so the largest is where resharing comes to rest."""
    by_name = W.orderBy(F.col("_source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    values = F.array(*[F.lit(float(w)) for w in weights])
    df = per_source.withColumn("_weight", F.element_at(values, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    before = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    df = df.withColumn("_level", left / rest)
    return df.withColumn("target", F.least("_cap", F.col("_weight") * F.max("_level").over(everything))).drop("_cap", "_level")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (_id, _source, _key, size, source_size, target, copies, taken)."""
    ordered = sized(docs, id_col, text_col, source_col).repartitionByRange(F.col("_source").asc_nulls_last(), F.col("_size"), F.col("_id"), F.col("_key"))
    ordered = ordered.sortWithinPartitions(F.col("_source").asc_nulls_last(), "_size", "_id", "_key")
    # partition number in the upper bits, row number in the partition in the lower 33
    rows = staged(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "mix")
    parts = rows.groupBy("_source", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum("_size").alias("_words"))
    sums = targets(parts.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    earlier = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    shift = shift.join(sums, shift["_s"].eqNullSafe(sums["_source"])).drop("_source")
    df = rows.join(shift, rows["_source"].eqNullSafe(shift["_s"]) & (rows["_part"] == shift["_p"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_s"), F.lit("")))
    offset = F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(GRAIN))
    rank = F.col("_at") + F.col("_shift")
    crossed = F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset)
    copies = F.least(crossed, F.lit(math.ceil(cap))).cast("long")
    return df.select("_id", F.col("_source"), "_key", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every column of docs, each row as often as the plan takes it (not at all for 0)."""
    taken = plan(docs, weights, share, cap, seed, id_col, text_col, source_col)
    # repeated rows share (id, source, text); they are the same document, so their copies are summed and dealt out evenly
    same = taken.groupBy("_id", "_source", "_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_same"))
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_i"), F.col(source_col).cast("string").alias("_s"), F.xxhash64(F.col(text_col)).alias("_k"))
    joined = each.join(same, each["_i"].eqNullSafe(same["_id"]) & each["_s"].eqNullSafe(same["_source"]) & (each["_k"] == same["_key"]))
    lot = W.partitionBy("_i", "_s", "_k").orderBy(F.lit(0))
    several = joined.where("_same > 1").withColumn("_nth", F.row_number().over(lot))
    times = F.floor(F.col("_copies") / F.col("_same")) + F.when(F.col("_nth") <= F.col("_copies") % F.col("_same"), 1).otherwise(0)
    once = joined.where("_same = 1").select("_row", F.col("_copies").cast("int").alias("_times"))
    dealt = once.unionByName(several.select("_row", times.cast("int").alias("_times"))).where("_times > 0")
    return dealt.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
