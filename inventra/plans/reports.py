"""Queries over report models, review facets, manifests, assertions and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.functions.paths import top_level
from inventra.operators import duplicates as du
from inventra.operators import graph
from inventra.operators import reports as op
from inventra.plans.registry import query
from inventra.plans.review import _CLASSES, classified
from inventra.sources.bindings import ENTRIES, RELATIONS, entries, relationships, table

_IDENTITY = "CASE WHEN device IS NOT NULL AND inode IS NOT NULL AND nlink > 1 THEN device || ':' || inode ELSE 'entry:' || entry_id END"
_C = f"ct AS (SELECT full_hash, size_bytes, count(*) AS n, count(DISTINCT {_IDENTITY}) AS files FROM entries WHERE full_hash IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {_CLASSES}, {_C} SELECT (SELECT count(DISTINCT source_root) FROM entries) AS sources, (SELECT count(*) FROM entries) AS entries, (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM entries) AS logical_bytes,
 count(*) AS content_objects, coalesce(sum(size_bytes), 0)::BIGINT AS unique_bytes, count(*) FILTER (n > 1) AS duplicate_groups, (SELECT count(*) FROM classed WHERE starts_with(classification, 'REVIEW_')) AS review_candidates,
 (SELECT count(*) FROM classed WHERE classification = 'PROTECTED') AS protected, coalesce(sum(size_bytes * (files - 1)) FILTER (n > 1), 0)::BIGINT AS reclaimable_bytes FROM ct""")
def overview_model(spark: SparkSession, sf: str) -> DataFrame:
    return op.overview_model(entries(spark, sf), classified(spark, sf))


@query(f"""WITH {_CLASSES}, {_C}, k AS (SELECT count(*) FILTER (classification = 'PROTECTED') AS protected, count(*) FILTER (classification = 'UNKNOWN') AS unknown, count(*) FILTER (classification = 'ERROR') AS errors FROM classed),
 files AS (SELECT count(*) AS file_count, coalesce(sum(size_bytes), 0)::BIGINT AS byte_count, count(*) FILTER (scan_status = 'ERROR') AS unreadable FROM entries),
 x AS (SELECT count(*) FILTER (n > 1) AS exact_duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS redundant_members, coalesce(sum((n - 1) * size_bytes), 0)::BIGINT AS exact_duplicate_bytes, count(*) AS content_objects FROM ct) SELECT * FROM files, k, x""")
def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    return op.summary(entries(spark, sf), classified(spark, sf))


@query(f"WITH {_CLASSES} SELECT classification, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM classed WHERE starts_with(classification, 'REVIEW_') GROUP BY 1")
def reviewable_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return op.reviewable_by_class(classified(spark, sf))


@query(f"WITH {RELATIONS} SELECT relationship_type, evidence_tier, count(*) AS edges FROM rel WHERE status = 'ACTIVE' GROUP BY 1, 2")
def relationship_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return op.tier_counts(relationships(spark, sf))


_RUNS = f"""{_CLASSES}, rr AS (SELECT e.source_root, split_part(e.relative_path, '/', 1) AS run, e.full_hash, e.size_bytes, count(*) AS n, count(*) FILTER (classification = 'PROTECTED') AS protected,
 coalesce(sum(e.size_bytes) FILTER (starts_with(classification, 'REVIEW_')), 0) AS reviewable FROM entries e JOIN classed c USING (entry_id) GROUP BY 1, 2, 3, 4),
 totals AS (SELECT source_root, run, sum(n)::BIGINT AS files, 0::BIGINT AS directories, count(*) FILTER (full_hash IS NOT NULL) AS content_objects, count(*) FILTER (full_hash IS NOT NULL AND n > 1) AS duplicate_groups,
 coalesce(sum(n - 1) FILTER (full_hash IS NOT NULL), 0)::BIGINT AS duplicate_files, sum(protected)::BIGINT AS protected, sum(reviewable)::BIGINT AS reviewable_bytes, bool_or(full_hash IS NOT NULL) AS identity_available FROM rr GROUP BY 1, 2)"""


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return op.run_totals(entries(spark, sf).withColumn("run", top_level("relative_path")), classified(spark, sf), "source_root", "run")


@query(f"WITH {_RUNS} SELECT * FROM totals")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf)


@query(f"""WITH {_RUNS}, d AS (SELECT *, lag(run) OVER w AS previous, lag(duplicate_groups) OVER w AS bg, lag(identity_available) OVER w AS bi, lag(reviewable_bytes) OVER w AS br FROM totals WINDOW w AS (PARTITION BY source_root ORDER BY run))
SELECT source_root, run, previous, CASE WHEN identity_available AND bi THEN duplicate_groups - bg END AS duplicate_groups, reviewable_bytes - br AS reviewable_bytes FROM d WHERE previous IS NOT NULL""")
def change_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return op.run_deltas(_totals(spark, sf), "source_root", "run")


@query("""WITH r AS (SELECT l_suppkey AS session, sha256(concat_ws('|', length(l_orderkey::VARCHAR) || ':' || l_orderkey, length(l_linenumber::VARCHAR) || ':' || l_linenumber, length(l_returnflag) || ':' || l_returnflag)) AS h FROM lineitem),
 p AS (SELECT session, h[1:2] AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1, 2) SELECT session, sum(n)::BIGINT AS decisions, sha256(string_agg(part || d, '' ORDER BY part)) AS digest FROM p GROUP BY 1""")
def session_export_digest(spark: SparkSession, sf: str) -> DataFrame:
    return op.export_digest(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "session"), "session", "l_orderkey", "l_linenumber", "l_returnflag")


_MANIFEST = """SELECT CASE WHEN e.entry_id % 19 = 0 THEN e.entry_id + 1000000 ELSE e.entry_id END AS entry_id, coalesce(quality = 1, false) AS approved, CASE WHEN e.entry_id % 5 = 0 THEN relative_path || 'x' ELSE relative_path END AS source_path,
 CASE WHEN e.entry_id % 23 = 0 THEN -1 ELSE size_bytes END AS size_bytes, CASE WHEN e.entry_id % 7 = 0 THEN NULL ELSE full_hash END AS expected_hash, CASE WHEN e.entry_id % 13 = 0 THEN 'other' ELSE 'SHA256' END AS algorithm"""
_STATUS = "CASE WHEN entry_id % 31 = 0 THEN 'FAILED' ELSE 'OK' END"


@query(f"""WITH {ENTRIES}, twice AS (SELECT e.entry_id, quality, relative_path, size_bytes, full_hash FROM entries e JOIN labels ON doc_id = e.entry_id, range(2) t(i) WHERE i = 0 OR e.entry_id % 29 = 0), m AS ({_MANIFEST} FROM twice e),
 own AS (SELECT entry_id, 'DUPLICATE_ID' AS error, count(*) - 1 AS times FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT entry_id, 'INVALID_APPROVED', count(*) FROM m WHERE approved AND (expected_hash IS NULL OR size_bytes < 0) GROUP BY 1),
 x AS (SELECT m.entry_id, CASE WHEN e.entry_id IS NULL THEN 'MISSING' WHEN e.relative_path <> source_path OR e.size_bytes <> m.size_bytes THEN 'SOURCE_DRIFT' WHEN approved AND lower(algorithm) <> 'sha256' THEN 'HASH_ALGORITHM'
  WHEN approved AND (full_hash IS DISTINCT FROM expected_hash OR e.entry_id % 31 = 0) THEN 'UNVERIFIED_APPROVED' END AS error FROM m LEFT JOIN entries e USING (entry_id))
SELECT * FROM own UNION ALL SELECT entry_id, error, count(*) FROM x WHERE error IS NOT NULL GROUP BY 1, 2""")
def manifest_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    twice = e.join(table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), "quality"), "entry_id").withColumn("i", F.explode(F.expr("IF(entry_id % 29 = 0, array(0, 1), array(0))")))
    m = spark.sql(_MANIFEST + " FROM {twice} e", twice=twice)
    return op.manifest_errors(m, e.select("*", F.lit("sha256").alias("hash_algorithm"), F.expr(_STATUS).alias("hash_status")))


_ASSERTED = "SELECT 'photos' AS assertion, 'PATH_PATTERN' AS scope_type, 'b3/' AS scope_value UNION ALL SELECT 'tax', 'PATH_PATTERN', 'invoice' UNION ALL SELECT 'backup', 'PATH_PATTERN', '/backup/'"


@query(f"WITH {ENTRIES}, a AS ({_ASSERTED} UNION ALL SELECT DISTINCT 'harmful', 'CONTENT_OBJECT', full_hash FROM entries JOIN labels ON doc_id = entry_id WHERE toxic = 1 AND full_hash IS NOT NULL) SELECT entry_id, assertion, scope_type, scope_value FROM entries JOIN a ON (scope_type = 'PATH_PATTERN' AND contains(relative_path, scope_value)) OR (scope_type = 'CONTENT_OBJECT' AND full_hash = scope_value)")
def asserted_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    harmful = e.join(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("entry_id")), "entry_id").where("full_hash IS NOT NULL").selectExpr("'harmful' AS assertion", "'CONTENT_OBJECT' AS scope_type", "full_hash AS scope_value").distinct()
    return op.assertions(e, spark.sql(_ASSERTED).unionByName(harmful))


_DECIDED = "decided AS (SELECT doc_id AS entry_id, CASE WHEN toxic = 1 THEN 'REJECT' ELSE 'APPROVE' END AS decision, coalesce(quality = 0, false) AS stale FROM labels)"


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr("doc_id AS entry_id", "IF(toxic = 1, 'REJECT', 'APPROVE') AS decision", "coalesce(quality = 0, false) AS stale")


@query(f"WITH {_CLASSES}, {_DECIDED} SELECT entry_id, relative_path, classification FROM classed WHERE starts_with(classification, 'REVIEW_') AND entry_id NOT IN (SELECT entry_id FROM decided) AND confidence BETWEEN 0.5 AND 1.0 AND size_bytes BETWEEN 100 AND 100000 AND (relative_path = 'en' OR starts_with(relative_path, 'en/')) AND reason = 'EXACT_SHA256_DUPLICATE'")
def review_actionable(spark: SparkSession, sf: str) -> DataFrame:
    found = op.review_filter(classified(spark, sf), _decided(spark, sf), actionable=True, minimum_confidence=0.5, maximum_confidence=1.0, minimum_size=100, maximum_size=100_000, top_level="en", reason="EXACT_SHA256_DUPLICATE")
    return found.select("entry_id", "relative_path", "classification")


@query(f"WITH {_CLASSES}, {_DECIDED} SELECT c.entry_id, relative_path, classification FROM classed c JOIN decided d USING (entry_id) JOIN entries e USING (entry_id) JOIN g ON g.full_hash = e.full_hash AND g.size_bytes = e.size_bytes WHERE decision = 'APPROVE' AND NOT stale AND c.modified_at BETWEEN 1400000000 AND 1690000000 AND classification <> 'PROTECTED'".replace("relative_path, classification FROM classed", "c.relative_path, c.classification FROM classed"))
def review_decided(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    found = op.review_filter(classified(spark, sf), _decided(spark, sf), du.members(e, du.groups(e)), decision="APPROVE", stale=False, duplicate_only=True, protected=False, modified_from=1.4e9, modified_to=1.69e9)
    return found.select("entry_id", "relative_path", "classification")


_SHOWN = f"""{RELATIONS}, kinds AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, * FROM rel WHERE ({c})" + (" AND status = 'ACTIVE'" if k in graph.ACTIVE_ONLY else "") for k, c in graph.PROJECTIONS.items())}),
 shown AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id, source_id, target_id)::INT AS rank FROM kinds WHERE confidence >= 0.9 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id, source_id, target_id) <= 300)"""


@query(f"WITH {_SHOWN} SELECT kind, rank, id, relationship_type, confidence FROM shown")
def projection_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.typed_projections(relationships(spark, sf), floor=0.9, max_edges=300).select("kind", "rank", "id", "relationship_type", "confidence")


@query(f"WITH {ENTRIES}, {_SHOWN}, n AS (SELECT source_type AS type, source_id AS id FROM shown UNION SELECT target_type, target_id FROM shown) SELECT type, id, coalesce(name, type || ' ' || id) AS label FROM n LEFT JOIN entries ON type = 'ENTRY' AND id = entry_id")
def projection_labels(spark: SparkSession, sf: str) -> DataFrame:
    shown = graph.typed_projections(relationships(spark, sf), floor=0.9, max_edges=300)
    ends = shown.select(F.explode(F.array(F.struct(F.col("source_type").alias("type"), F.col("source_id").alias("id")), F.struct(F.col("target_type").alias("type"), F.col("target_id").alias("id")))).alias("n")).select("n.*")
    return graph.labels(ends, entries(spark, sf).select(F.lit("ENTRY").alias("type"), F.col("entry_id").alias("id"), "name"))


_NODES = "SELECT 'ENTRY' AS type, p_partkey AS id FROM part WHERE p_size > 10 UNION ALL SELECT 'DIRECTORY', p_partkey FROM part WHERE p_size > 10 UNION ALL SELECT 'CONTENT_OBJECT', p_partkey FROM part WHERE p_size > 20 UNION ALL SELECT 'PROJECT', p_partkey FROM part WHERE p_size > 5"


@query(f"WITH {RELATIONS}, nodes AS ({_NODES}) SELECT id, source_type, source_id, target_type, target_id FROM rel WHERE (source_type, source_id) IN (SELECT type, id FROM nodes) AND (target_type, target_id) IN (SELECT type, id FROM nodes)")
def live_relationships(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark.sql(_NODES.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return graph.live_edges(relationships(spark, sf), nodes).select("id", "source_type", "source_id", "target_type", "target_id")


@query(f"""WITH {RELATIONS}, b AS (SELECT source_type, source_id, target_type, target_id, relationship_type, version, CASE WHEN status = 'STALE' THEN 1 ELSE 0 END AS new, id, confidence FROM rel)
SELECT source_type, source_id, target_type, target_id, relationship_type, version, min({{'n': new, 'i': id}}).i AS id, max({{'n': new, 'i': id, 'c': confidence}}).c AS confidence FROM b GROUP BY 1, 2, 3, 4, 5, 6""")
def relationship_upsert(spark: SparkSession, sf: str) -> DataFrame:
    r = relationships(spark, sf)
    return graph.upsert(r.where("status = 'ACTIVE'"), r.where("status = 'STALE'"))
