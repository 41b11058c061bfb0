"""Queries over snapshots, sessions and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.operators import timeline as op
from inventra.plans.registry import query
from inventra.sources.bindings import SNAPSHOTS, snapshots, table

_DIFF = f"""WITH {SNAPSHOTS}, d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.id IS NULL THEN 'NEW' WHEN b.id IS NULL THEN 'MISSING'
 WHEN a.size IS NOT DISTINCT FROM b.size AND a.mtime IS NOT DISTINCT FROM b.mtime AND a.device IS NOT DISTINCT FROM b.device AND a.inode IS NOT DISTINCT FROM b.inode THEN 'UNCHANGED'
 WHEN a.size IS NOT DISTINCT FROM b.size AND a.mtime IS NOT DISTINCT FROM b.mtime THEN 'METADATA_CHANGED' ELSE 'CONTENT_POSSIBLY_CHANGED' END AS status,
 a.id AS before_id, b.id AS after_id, a.size AS b_size, b.size AS a_size FROM snap_a a FULL JOIN snap_b b ON a.path = b.path)"""


@query(_DIFF + " SELECT * FROM d")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return op.diff(*snapshots(spark, sf))


@query(_DIFF + " SELECT status, count(*) AS paths, round(sum(coalesce(a_size, b_size)), 2) AS size FROM d GROUP BY 1")
def diff_totals(spark: SparkSession, sf: str) -> DataFrame:
    return op.status_totals(op.diff(*snapshots(spark, sf)))


@query(_DIFF + " SELECT status, row_number() OVER (PARTITION BY status ORDER BY coalesce(a_size, b_size) DESC, path)::INT AS rank, path FROM d QUALIFY rank <= 10")
def largest_changes(spark: SparkSession, sf: str) -> DataFrame:
    return op.largest_changes(op.diff(*snapshots(spark, sf)))


@query(_DIFF + " SELECT path, before_id FROM d WHERE status = 'MISSING'")
def missing_entries(spark: SparkSession, sf: str) -> DataFrame:
    a, b = snapshots(spark, sf)
    return a.join(b, "path", "left_anti").select("path", F.col("id").alias("before_id"))


@query(_DIFF + " SELECT after_id AS id, sha256(before_id::VARCHAR) AS digest FROM d WHERE status = 'UNCHANGED'")
def carried_digests(spark: SparkSession, sf: str) -> DataFrame:
    a, b = snapshots(spark, sf)
    return op.carried(op.diff(a, b), a.select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest")))


_DIGESTS = "CASE WHEN id % 4 = 0 THEN NULL ELSE 'q' || id % 1000 END AS quick, CASE WHEN id % 6 = 0 THEN NULL ELSE sha256(id::VARCHAR) END AS digest"


@query(f"""WITH {SNAPSHOTS}, a1 AS (SELECT *, {_DIGESTS} FROM snap_a),
 b1 AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'moved/' || path ELSE path END AS path, size, CASE WHEN id % 15 = 0 THEN 9 ELSE device END AS device, inode, quick, CASE WHEN id % 2 = 0 THEN NULL ELSE digest END AS digest FROM a1),
 fresh AS (SELECT * FROM b1 WHERE path NOT IN (SELECT path FROM a1)), gone AS (SELECT * FROM a1 WHERE path NOT IN (SELECT path FROM b1)),
 c AS (SELECT n.path AS new_path, (SELECT min(g.path) FROM gone g WHERE g.digest = n.digest) AS v, (SELECT min(g.path) FROM gone g WHERE g.quick = n.quick AND g.size = n.size) AS q,
  (SELECT min(g.path) FROM gone g WHERE g.device = n.device AND g.inode = n.inode AND g.size = n.size) AS i FROM fresh n)
SELECT new_path, coalesce(v, q, i) AS old_path, CASE WHEN v IS NOT NULL THEN 'VERIFIED_CONTENT' WHEN q IS NOT NULL THEN 'QUICK_HASH' ELSE 'SAME_DEVICE_INODE' END AS evidence FROM c WHERE coalesce(v, q, i) IS NOT NULL""")
def moved_entries(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = snapshots(spark, sf)
    a = a.withColumns({"quick": F.expr("IF(id % 4 = 0, NULL, concat('q', id % 1000))"), "digest": F.expr("IF(id % 6 = 0, NULL, sha2(CAST(id AS STRING), 256))")})
    b = a.withColumns({"path": F.expr("IF(id % 5 = 0, concat('moved/', path), path)"), "device": F.expr("IF(id % 15 = 0, 9, device)"), "digest": F.expr("IF(id % 2 = 0, NULL, digest)")})
    return op.moves(op.diff(a, b), a, b)


@query(_DIFF + ", h AS (SELECT o_orderkey AS change_id, (o_orderkey % 4000) || '/' || o_orderpriority AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING' ELSE 'NEW' END AS status, o_orderkey AS entry_id FROM orders), g AS (SELECT path, arg_max(entry_id, change_id) AS previous_id FROM h WHERE status = 'MISSING' GROUP BY 1) SELECT d.path, previous_id FROM d JOIN g ON g.path = d.path WHERE d.status = 'NEW'")
def reappeared_entries(spark: SparkSession, sf: str) -> DataFrame:
    history = table(spark, sf, "orders").selectExpr("o_orderkey AS change_id", "concat(o_orderkey % 4000, '/', o_orderpriority) AS path", "IF(o_orderkey % 3 = 0, 'MISSING', 'NEW') AS status", "o_orderkey AS entry_id")
    return op.reappeared(op.diff(*snapshots(spark, sf)), history)


@query(_DIFF + ", s AS (SELECT o_orderkey AS decision_id, o_orderkey || '/' || o_orderpriority AS path FROM orders WHERE o_orderkey % 3 = 0) SELECT decision_id, path FROM s WHERE path IN (SELECT path FROM d WHERE status IN ('MISSING', 'CONTENT_POSSIBLY_CHANGED'))")
def stale_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decisions = table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS decision_id", "concat(o_orderkey, '/', o_orderpriority) AS path")
    return op.stale(op.diff(*snapshots(spark, sf)), decisions).select("decision_id", "path")


@query(_DIFF + " SELECT path, after_id FROM d WHERE status NOT IN ('UNCHANGED', 'MISSING')")
def changed_only(spark: SparkSession, sf: str) -> DataFrame:
    return op.diff(*snapshots(spark, sf)).where("status NOT IN ('UNCHANGED', 'MISSING')").select("path", "after_id")


def _sessions_sql(gap: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""WITH l AS (SELECT event_id, user_id, event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > {gap * 1_000_000} THEN 1 ELSE 0 END AS n FROM events WINDOW w AS ({part}ORDER BY ts, event_id)),
 c AS (SELECT *, (sum(n) OVER ({part}ORDER BY ts, event_id))::BIGINT AS cluster FROM l), s AS (SELECT {cols}event_id, cluster, row_number() OVER (PARTITION BY {cols}cluster ORDER BY ts, event_id) - 1 AS sequence_index, count(*) OVER (PARTITION BY {cols}cluster) AS members FROM c)
SELECT * FROM s WHERE members >= 2"""


@query(_sessions_sql(5400))
def photo_events(spark: SparkSession, sf: str) -> DataFrame:
    return op.sessions(table(spark, sf, "events"), 5400)


@query(_sessions_sql(28800, "user_id"))
def work_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return op.sessions(table(spark, sf, "events"), 28800, by="user_id")


@query(_sessions_sql(1800, "event_type"))
def acquisition_batches(spark: SparkSession, sf: str) -> DataFrame:
    return op.sessions(table(spark, sf, "events"), 1800, by="event_type")


_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS source, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' ELSE 'RUNNING' END AS status FROM orders)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "o_custkey AS source", "IF(o_orderstatus = 'F', 'COMPLETE', 'RUNNING') AS status")


@query(f"WITH {_RUNS} SELECT source, max(run_id) AS run_id FROM runs WHERE status = 'COMPLETE' GROUP BY 1")
def current_runs(spark: SparkSession, sf: str) -> DataFrame:
    return op.current_runs(_runs(spark, sf))


@query(f"WITH {_RUNS}, c AS (SELECT max(run_id) AS run_id FROM runs WHERE status = 'COMPLETE' GROUP BY source) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT run_id FROM c)")
def current_entries(spark: SparkSession, sf: str) -> DataFrame:
    current = op.current_runs(_runs(spark, sf)).select(F.col("run_id").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(current, "l_orderkey", "left_semi")


@query(f"WITH {_RUNS} SELECT * FROM (SELECT run_id, source, row_number() OVER (PARTITION BY source ORDER BY run_id DESC)::INT AS age FROM runs) x WHERE age > 3 AND run_id % 20 <> 0")
def snapshot_retention_plan(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    return op.prunable(runs, 3, runs.where("run_id % 20 = 0").select("run_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 5000) ORDER BY 1, 2 LIMIT 100")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return op.page_after(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), {"o_custkey": 100, "o_orderkey": 5000}, 100)


@query(_DIFF + " SELECT max(after_id) FILTER (status <> 'UNCHANGED') AS last_change, sha256(concat_ws(chr(0), count(*)::VARCHAR, (max(after_id) FILTER (status <> 'UNCHANGED'))::VARCHAR)) AS token FROM d")
def snapshot_token(spark: SparkSession, sf: str) -> DataFrame:
    """What a stage's input is known by: it runs again only if the token changes."""
    d = op.diff(*snapshots(spark, sf)).agg(F.max(F.when(F.col("status") != "UNCHANGED", F.col("after_id"))).alias("last_change"), F.count("*").alias("n"))
    return d.select("last_change", F.sha2(F.concat_ws("\0", F.col("n").cast("string"), F.col("last_change").cast("string")), 256).alias("token"))
