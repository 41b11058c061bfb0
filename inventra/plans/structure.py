"""Queries over directory trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.functions import paths
from inventra.operators import directories as op
from inventra.operators import graph
from inventra.plans.registry import query
from inventra.sources.bindings import ENTRIES, TREE, entries, table, tree

_ANC = "unnest([array_to_string(string_split(relative_path, '/')[1:n], '/') FOR n IN range(1, len(string_split(relative_path, '/')))])"


@query(f"""WITH {ENTRIES}, a AS (SELECT source_root, {_ANC} AS dir, size_bytes, modified_at, full_hash FROM entries)
SELECT source_root, dir, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(DISTINCT full_hash) AS unique_hashes, min(modified_at) AS oldest, max(modified_at) AS newest,
 coalesce(bit_xor(DISTINCT ('0x' || substr(full_hash, 1, 15))::BIGINT), 0) AS digest_1, coalesce(bit_xor(DISTINCT ('0x' || substr(full_hash, 16, 15))::BIGINT), 0) AS digest_2, count(*) - count(DISTINCT full_hash) AS duplicates FROM a GROUP BY 1, 2""")
def directory_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return op.summaries(entries(spark, sf))


@query(f"WITH {ENTRIES}, a AS (SELECT source_root, {_ANC} AS dir, suffix FROM entries) SELECT source_root, dir, suffix, count(*) AS files FROM a GROUP BY 1, 2, 3")
def directory_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return op.extension_map(entries(spark, sf))


def _overlap_sql(least: int, containment: float) -> str:
    return f"""WITH {TREE}, s AS (SELECT DISTINCT dir AS g, hash AS i FROM tree), z AS (SELECT g, count(*) AS size FROM s GROUP BY 1 HAVING count(*) >= {least}),
 t AS (SELECT s.* FROM s JOIN z USING (g)), r AS (SELECT i FROM t GROUP BY 1 HAVING count(*) > 1),
 p AS (SELECT DISTINCT x.g AS a, y.g AS b FROM t x JOIN t y USING (i) JOIN r USING (i) WHERE x.g < y.g),
 c AS (SELECT a, b, count(*) AS shared FROM p JOIN t x ON x.g = a JOIN t y ON y.g = b AND y.i = x.i GROUP BY 1, 2),
 o AS (SELECT a, b, shared, za.size AS size_a, zb.size AS size_b, shared / least(za.size, zb.size)::DOUBLE AS containment, shared / (za.size + zb.size - shared)::DOUBLE AS jaccard
  FROM c JOIN z za ON za.g = a JOIN z zb ON zb.g = b WHERE shared / least(za.size, zb.size)::DOUBLE >= {containment})"""


@query(_overlap_sql(5, 0.5) + " SELECT a, b, shared, size_a, size_b, containment, jaccard FROM o")
def set_containment(spark: SparkSession, sf: str) -> DataFrame:
    return op.set_overlap(tree(spark, sf), "dir", "hash", 5, 0.5).select("a", "b", "shared", "size_a", "size_b", "containment", "jaccard")


@query(_overlap_sql(5, 0.85) + " SELECT CASE WHEN size_a <= size_b THEN a ELSE b END AS source, CASE WHEN size_a <= size_b THEN b ELSE a END AS target, 'MOSTLY_CONTAINED_IN' AS type, shared, round(containment, 6) AS confidence FROM o")
def directory_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return op.overlap_edges(tree(spark, sf), least_items=5, containment=0.85)


@query(_overlap_sql(1, 0.85) + " SELECT a, b, shared, round(containment, 6) AS confidence, 'LIKELY_BACKUP_SUCCESSOR' AS type FROM o")
def backup_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Directories by their direct members; every shared member counts."""
    found = op.set_overlap(tree(spark, sf), "dir", "hash", 1, 0.85)
    return found.select("a", "b", "shared", F.round("containment", 6).alias("confidence"), F.lit("LIKELY_BACKUP_SUCCESSOR").alias("type"))


@query(f"""WITH {TREE}, m AS (SELECT DISTINCT 'arc ' || o_orderpriority AS archive, sha256(l_orderkey::VARCHAR) AS hash FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 z AS (SELECT archive, count(*) AS size FROM m GROUP BY 1), d AS (SELECT DISTINCT dir, hash FROM tree), c AS (SELECT archive, dir, count(*) AS shared FROM m JOIN d USING (hash) GROUP BY 1, 2)
SELECT archive, dir, shared, round(shared / size::DOUBLE, 6) AS containment, CASE WHEN shared = size THEN 'ARCHIVE_OF_DIRECTORY' ELSE 'ARCHIVE_PARTIAL_SNAPSHOT_OF' END AS type, CASE WHEN shared = size THEN 2 ELSE 4 END AS tier
FROM c JOIN z USING (archive) WHERE shared / size::DOUBLE >= 0.9""")
def archive_of_directory(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return op.archive_matches(lines.selectExpr("concat('arc ', o_orderpriority) AS archive", "sha2(CAST(l_orderkey AS STRING), 256) AS hash"), tree(spark, sf))


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_PROJECTS = f"""WITH {ENTRIES}, m AS (SELECT source_root, dir, list_sort(list(DISTINCT name)) AS ms FROM entries WHERE name IN ({_in(op.MARKERS)}) GROUP BY 1, 2),
 k AS (SELECT * FROM m WHERE len(list_filter(ms, lambda x: x NOT IN ('README', 'README.md'))) > 0)"""


@query(_PROJECTS + f""" SELECT source_root, dir, array_to_string(ms, ',') AS markers,
 CASE WHEN list_has_any(ms, ['pyproject.toml', 'requirements.txt', 'Pipfile', 'environment.yml']) THEN 'python' WHEN list_has_any(ms, ['package.json']) THEN 'javascript' WHEN list_has_any(ms, ['Cargo.toml']) THEN 'rust' WHEN list_has_any(ms, ['go.mod']) THEN 'go' WHEN list_has_any(ms, ['pom.xml', 'build.gradle']) THEN 'java' ELSE 'source' END AS kind,
 list_has_any(ms, [{_in(op.DEPENDENCY_SPECS)}]) AS has_dependency_spec, list_has_any(ms, [{_in(op.LOCKFILES)}]) AS has_lockfile, list_has_any(ms, ['.git']) AS has_git, list_has_any(ms, ['Dockerfile']) AS has_dockerfile FROM k""")
def project_detection(spark: SparkSession, sf: str) -> DataFrame:
    return op.projects(entries(spark, sf))


@query(f"""WITH {ENTRIES} SELECT source_root, CASE WHEN list_has_any(string_split(dir, '/'), [{_in(op.ENVIRONMENT_DIRS)}]) THEN 'environment' WHEN list_has_any(string_split(dir, '/'), [{_in(op.GENERATED_DIRS)}]) THEN 'generated' ELSE 'source' END AS use,
 count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries GROUP BY 1, 2""")
def project_storage(spark: SparkSession, sf: str) -> DataFrame:
    return op.storage_breakdown(entries(spark, sf))


@query(f"WITH {ENTRIES}, b AS (SELECT * FROM entries WHERE starts_with(relative_path, 'en/')) SELECT split_part(relative_path, '/', 2) AS child, len(string_split(relative_path, '/')) > 2 AS is_dir, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM b GROUP BY 1, 2 ORDER BY is_dir DESC, bytes DESC, child LIMIT 51")
def explorer_level(spark: SparkSession, sf: str) -> DataFrame:
    return op.children(entries(spark, sf), "en")


@query(f"WITH {ENTRIES} SELECT split_part(relative_path, '/', 1) AS child, len(string_split(relative_path, '/')) > 1 AS is_dir, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries GROUP BY 1, 2 ORDER BY is_dir DESC, bytes DESC, child LIMIT 51")
def explorer_roots(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    is_dir = F.size(F.split("relative_path", "/")) > 1
    g = e.groupBy(paths.top_level("relative_path").alias("child"), is_dir.alias("is_dir")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return g.orderBy(F.desc("is_dir"), F.desc("bytes"), "child").limit(51)


@query(f"WITH {ENTRIES} SELECT entry_id, dir AS parent_dir, count(*) OVER (PARTITION BY source_root, dir) AS siblings FROM entries")
def parent_links(spark: SparkSession, sf: str) -> DataFrame:
    return op.parents(entries(spark, sf))


_EDGES = """edges AS (SELECT o_custkey AS src, 100000 + l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'RETURNS' ELSE 'ORDERS' END AS type, round(1 - l_discount, 2) AS confidence
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS src", "100000 + l_suppkey AS dst", "IF(l_returnflag = 'R', 'RETURNS', 'ORDERS') AS type", "round(1 - l_discount, 2) AS confidence")


@query(f"WITH {_EDGES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, type, max(confidence) AS confidence FROM edges GROUP BY 1, 2, 3")
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return graph.canonical_edges(edges(spark, sf))


@query(f"WITH {_EDGES} SELECT DISTINCT * FROM (SELECT src AS node, dst AS neighbour, type, confidence FROM edges UNION ALL SELECT dst, src, type, confidence FROM edges) x WHERE node % 50 = 0 AND node < 100000")
def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes are ends of edges, as in the SQL, whether or not a customer row exists. From 100,000 on an id may be a customer's and a supplier's, so the SQL asks for those below."""
    ends = table(spark, sf, "orders").selectExpr("o_custkey AS node").unionByName(table(spark, sf, "lineitem").selectExpr("100000 + l_suppkey AS node"))
    return graph.neighbours(edges(spark, sf), ends.where("node % 50 = 0 AND node < 100000"))


@query(f"""WITH RECURSIVE {_EDGES}, e2 AS (SELECT DISTINCT src AS x, dst AS y FROM edges WHERE confidence >= 0.95 UNION SELECT DISTINCT dst, src FROM edges WHERE confidence >= 0.95),
 r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT y, depth + 1 FROM r JOIN e2 ON x = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def graph_reach(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reach(edges(spark, sf), spark.sql("SELECT 1L AS node"), 3, 0.95)


@query(f"WITH {_EDGES} SELECT * FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, type, max(confidence) AS confidence FROM edges WHERE type = 'RETURNS' GROUP BY 1, 2, 3) x WHERE confidence >= 0.92 ORDER BY confidence DESC, src, dst, type LIMIT 500")
def graph_projection(spark: SparkSession, sf: str) -> DataFrame:
    return graph.projection(graph.canonical_edges(edges(spark, sf)), ("RETURNS",), 0.92, 500)


@query()
def graph_projection_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.capped_nodes(graph.canonical_edges(edges(spark, sf)), 500, 200)


@query(f"""WITH {_EDGES}, p AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, type, max(confidence) AS confidence FROM edges GROUP BY 1, 2, 3), q AS (SELECT * FROM p ORDER BY confidence DESC, src, dst, type LIMIT 500),
 n AS (SELECT src AS node FROM q UNION SELECT dst FROM q), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM n)
SELECT node, round(400 + 240 * cos(2.0::DOUBLE * pi() * i / n), 3) AS x, round(300 + 240 * sin(2.0::DOUBLE * pi() * i / n), 3) AS y FROM i""")
def circular_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of a projection of at most 500 edges."""
    shown = graph.projection(graph.canonical_edges(edges(spark, sf)), max_edges=500)
    return graph.circle(shown.select(F.explode(F.array("src", "dst")).alias("node")))


@query("""WITH RECURSIVE tree AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
 up(node, ancestor, depth) AS (SELECT node, parent, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT up.node, t.parent, up.depth + 1 FROM up JOIN tree t ON t.node = up.ancestor WHERE t.parent IS NOT NULL AND up.depth < 16) SELECT * FROM up""")
def job_lineage(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS node", "concat('r', n_regionkey) AS parent")
    t = t.unionByName(table(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS node", "concat('n', c_nationkey) AS parent"))
    return graph.lineage(t.unionByName(table(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS node", "CAST(NULL AS STRING) AS parent")))


@query(f"WITH {ENTRIES}, c AS (SELECT source_root, split_part(relative_path, '/', 1) AS top_level, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries GROUP BY 1, 2) SELECT sha1(source_root || chr(0) || top_level) AS node_id, source_root, top_level, files, bytes FROM c")
def universe_clusters(spark: SparkSession, sf: str) -> DataFrame:
    g = entries(spark, sf).groupBy("source_root", paths.top_level("relative_path").alias("top_level")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return g.select(F.sha1(F.concat("source_root", F.char(F.lit(0)), "top_level")).alias("node_id"), "source_root", "top_level", "files", "bytes")


@query(f"""WITH {ENTRIES}, {_EDGES}, t AS (SELECT src, dst, type, confidence FROM edges WHERE type LIKE 'ORD%')
SELECT src, dst, a.relative_path AS src_path, b.modified_at AS dst_mtime FROM (SELECT DISTINCT src, dst FROM t) x LEFT JOIN entries a ON a.entry_id = src LEFT JOIN entries b ON b.entry_id = dst - 100000 + 500""")
def derivation_timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    t = edges(spark, sf).where("type LIKE 'ORD%'").select("src", "dst").distinct()
    a, b = e.select(F.col("entry_id").alias("src"), F.col("relative_path").alias("src_path")), e.select((F.col("entry_id") + 99500).alias("dst"), F.col("modified_at").alias("dst_mtime"))
    return t.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "src_path", "dst_mtime").orderBy(F.asc_nulls_last("dst_mtime"), "src", "dst")
