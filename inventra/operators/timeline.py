"""Snapshot differences and time-gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, before_id, after_id): NEW, MISSING, UNCHANGED, METADATA_CHANGED or CONTENT_POSSIBLY_CHANGED. Unknown equals unknown."""
    b = before.select("path", *[F.col(c).alias(f"b_{c}") for c in ("id", "size", "mtime", "device", "inode")], F.lit(True).alias("_b"))
    a = after.select("path", *[F.col(c).alias(f"a_{c}") for c in ("id", "size", "mtime", "device", "inode")], F.lit(True).alias("_a"))
    same = lambda *cols: F.expr(" and ".join(f"a_{c} <=> b_{c}" for c in cols))
    status = F.when(F.col("_b").isNull(), "NEW").when(F.col("_a").isNull(), "MISSING").when(same("size", "mtime", "device", "inode"), "UNCHANGED").when(same("size", "mtime"), "METADATA_CHANGED").otherwise("CONTENT_POSSIBLY_CHANGED")
    return b.join(a, "path", "full_outer").select("path", status.alias("status"), F.col("b_id").alias("before_id"), F.col("a_id").alias("after_id"), "b_size", "a_size")


def status_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("paths"), F.round(F.sum(F.coalesce("a_size", "b_size")), 2).alias("size"))


def largest_changes(changes: DataFrame, n: int = 10) -> DataFrame:
    """The largest of each status: Spark limits each window group before the shuffle."""
    w = W.partitionBy("status").orderBy(F.desc(F.coalesce("a_size", "b_size")), "path")
    return changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("status", "rank", "path")


def moves(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(new_path, old_path, evidence) of NEW paths that a MISSING one may have become; of several old paths the first. before and after have
    (id, path, size, device, inode, quick, digest); the strongest evidence counts: equal verified digests, then equal quick hashes and sizes, then
    equal (device, inode, size). An unknown value is evidence of nothing. Hints only: digests are not carried over by them."""
    cols = ("path", "size", "device", "inode", "quick", "digest")
    new = changes.where("status = 'NEW'").select(F.col("after_id").alias("id")).join(after.select("id", *cols), "id")
    old = changes.where("status = 'MISSING'").select(F.col("before_id").alias("id")).join(before.select("id", *cols), "id")
    out = new
    kinds = (("VERIFIED_CONTENT", ["digest"]), ("QUICK_HASH", ["quick", "size"]), ("SAME_DEVICE_INODE", ["device", "inode", "size"]))
    for k, (_, keys) in enumerate(kinds):
        known = old.dropna(subset=keys).groupBy(*keys).agg(F.min("path").alias(f"old_{k}"))
        out = out.join(known, keys, "left")
    found = [F.when(F.col(f"old_{k}").isNotNull(), F.struct(F.col(f"old_{k}").alias("old"), F.lit(name).alias("evidence"))) for k, (name, _) in enumerate(kinds)]
    return out.withColumn("_m", F.coalesce(*found)).where("_m is not null").select(F.col("path").alias("new_path"), F.col("_m.old").alias("old_path"), F.col("_m.evidence").alias("evidence"))


def reappeared(changes: DataFrame, history: DataFrame) -> DataFrame:
    """(path, previous_id) of NEW paths that an earlier change recorded as MISSING; history has (change_id, path, status, entry_id), and the latest
    record counts. The content needs a full hash to confirm."""
    gone = history.where("status = 'MISSING'").groupBy("path").agg(F.max_by("entry_id", "change_id").alias("previous_id"))
    return changes.where("status = 'NEW'").select("path").join(gone, "path")


def carried(changes: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests that need no new reading: those of unchanged files."""
    return changes.where("status = 'UNCHANGED'").join(digests, F.col("before_id") == digests["id"]).select(F.col("after_id").alias("id"), "digest")


def stale(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose path changed or went."""
    return decisions.join(changes.where("status in ('MISSING', 'CONTENT_POSSIBLY_CHANGED')"), "path", "left_semi")


def sessions(events: DataFrame, gap_seconds: int, by: str | None = None, least: int = 2, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(event, cluster, sequence_index, members): events in order of (time, id), a new cluster when the gap is exceeded, clusters numbered with the dropped
    small ones counted.

    Nothing is ordered in a single task, with a key (`by`) or without: events are grouped by buckets of the gap's
    length, a cluster can only break where a bucket's first event is more than a gap after the last of the bucket before, so breaks are found inside
    buckets and between neighbouring bucket summaries; numbers and positions come from running sums over the (far fewer) summaries, which are
    themselves summed by blocks of buckets first. A position is the event's rank among all less that of its cluster's first."""
    order = [F.col(ts), F.col(id_col)]
    key = [by] if by is not None else []
    gap = gap_seconds * 1_000_000
    e = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_b", F.expr(f"_t div {gap}"))
    w = W.partitionBy(*key, "_b").orderBy(*order)
    inner = W.partitionBy(*key, "_block").orderBy("_b")
    outer = W.partitionBy(*key).orderBy("_block")
    past = (W.unboundedPreceding, -1)
    ends = e.groupBy(*key, "_b").agg(F.max("_t").alias("_hi"), F.count("*").alias("_n")).withColumn("_block", F.expr("_b div 4096"))
    blocks = ends.groupBy(*key, "_block").agg(F.max("_hi").alias("_bhi"), F.sum("_n").alias("_bn"))
    blocks = blocks.select(*key, "_block", F.lag("_bhi").over(outer).alias("_before"), F.coalesce(F.sum("_bn").over(outer.rowsBetween(*past)), F.lit(0)).alias("_ranked"))
    ends = ends.join(blocks, [*key, "_block"]).select(*key, "_b", F.coalesce(F.lag("_hi").over(inner), F.col("_before")).alias("_prev"), (F.col("_ranked") + F.coalesce(F.sum("_n").over(inner.rowsBetween(*past)), F.lit(0))).alias("_ahead"))
    e = e.join(ends, [*key, "_b"]).withColumn("_rank", F.col("_ahead") + F.row_number().over(w))
    e = e.withColumn("_new", F.coalesce(F.col("_t") - F.coalesce(F.lag("_t").over(w), F.col("_prev")) > gap, F.lit(True)).cast("long"))
    per = e.groupBy(*key, "_b").agg(F.sum("_new").alias("_n")).withColumn("_block", F.expr("_b div 4096"))
    sums = per.groupBy(*key, "_block").agg(F.sum("_n").alias("_bn"))
    sums = sums.select(*key, "_block", F.coalesce(F.sum("_bn").over(outer.rowsBetween(*past)), F.lit(0)).alias("_base"))
    per = per.join(sums, [*key, "_block"]).select(*key, "_b", (F.col("_base") + F.coalesce(F.sum("_n").over(inner.rowsBetween(*past)), F.lit(0))).alias("_start"))
    e = e.join(per, [*key, "_b"]).withColumn("cluster", F.col("_start") + F.sum("_new").over(w))
    sized = e.groupBy(*key, "cluster").agg(F.count("*").alias("members"), F.min("_rank").alias("_first")).where(F.col("members") >= least)
    return e.join(sized, [*key, "cluster"]).select(*key, id_col, "cluster", (F.col("_rank") - F.col("_first")).alias("sequence_index"), "members")


def current_runs(runs: DataFrame) -> DataFrame:
    """Newest complete run of each source."""
    return runs.where("status = 'COMPLETE'").groupBy("source").agg(F.max("run_id").alias("run_id"))


def prunable(runs: DataFrame, keep: int, holds: DataFrame) -> DataFrame:
    """Runs beyond the newest `keep` of their source, without those on hold."""
    w = W.partitionBy("source").orderBy(F.desc("run_id"))
    return runs.withColumn("age", F.row_number().over(w)).where(F.col("age") > keep).join(holds, "run_id", "left_anti").select("run_id", "source", "age")


def page_after(rows: DataFrame, keys: dict[str, object], limit: int) -> DataFrame:
    """Keyset paging: the rows after the given key values, in order of the keys."""
    names = list(keys)
    after: Column = F.struct(*[F.col(k) for k in names]) > F.struct(*[F.lit(v).alias(k) for k, v in keys.items()])
    return rows.where(after).orderBy(*names).limit(limit)
