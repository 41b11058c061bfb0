"""The inventory's relations over the shared tables: plain projections, and the same in DuckDB SQL for the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 that age rules measure from; a parameter of every operator that needs it.
NOW = 1_720_000_000.0



def _pick(values: tuple[str, ...], index: str) -> str:
    return f"split_part('{'|'.join(values)}', '|', CAST({index} AS INT) + 1)"


_VARIANT = _pick(("", " final", "_v2", " (1)"), "doc_id % 4")
_SUFFIX = _pick((".docx", ".md", ".xlsx", ".pdf", ".html", ".txt", ".csv", ".jpg", ".zip", ".exe", ".pyc", ".db"), "doc_id % 4 * 3 + DIV(doc_id, 4) % 3")
_SEGMENT = _pick(("/.venv/lib", "/node_modules/x", "/__pycache__", "/backup", "", ""), "DIV(doc_id, 29) % 6")
_NAME = f"""CASE doc_id % 29 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'package-lock.json' WHEN 3 THEN '~$budget.docx'
 WHEN 4 THEN 'README.md' WHEN 5 THEN 'budget.docx' WHEN 6 THEN concat('tax_invoice_', doc_id, '.pdf') WHEN 7 THEN 'vault.kdbx' WHEN 8 THEN concat('setup_', DIV(doc_id, 8), '.exe')
 ELSE concat('doc_', DIV(doc_id, 4), {_VARIANT}, {_SUFFIX}) END"""
_DIR = f"concat(coalesce(lang, 'xx'), '/b', DIV(doc_id, 4) % 10, {_SEGMENT})"
_ENTRIES = f"""SELECT entry_id, source_root, concat(dir, '/', name) AS relative_path, dir, name, lower(regexp_extract(name, '([.][^.]*)$', 1)) AS suffix, 'file' AS entry_type,
 size_bytes, modified_at, full_hash, scan_status, analysis_failed, device, inode, nlink FROM (
 SELECT doc_id AS entry_id, source AS source_root, {_DIR} AS dir, {_NAME} AS name, CAST(BYTES(text) AS BIGINT) AS size_bytes,
 CAST(1400000000 + doc_id % 1000 * 300000 AS DOUBLE) AS modified_at, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE SHA(text) END AS full_hash,
 CASE WHEN doc_id % 97 = 0 THEN 'ERROR' ELSE 'OK' END AS scan_status, doc_id % 89 = 0 AS analysis_failed, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE DIV(doc_id, 600) END AS device, (doc_id - doc_id % 3) % 600 AS inode, CASE WHEN doc_id % 41 = 0 THEN 1 ELSE 3 END AS nlink FROM documents) x"""


def render(sql: str, engine: str) -> str:
    """The few spellings that differ between the engines."""
    spark = engine == "spark"
    sql = re.sub(r"DIV\(([^,()]+), (\d+)\)", r"(\1 div \2)" if spark else r"(\1 // \2)", sql)
    sql = sql.replace("BYTES(text)", "octet_length(text)" if spark else "strlen(text)")
    return sql.replace("SHA(text)", "sha2(text, 256)" if spark else "sha256(text)")


_KINDS = ("EXACT_DUPLICATE_MEMBER", "DUPLICATE_CONTENT", "BACKUP_OF", "IN_PROJECT", "DOCUMENT_VERSION", "IMAGE_SIMILAR", "LIKELY_EXPORT", "LIKELY_COPY", "RELATED")
_TIERS = ("TIER_1_EXACT", "TIER_2_NORMALIZED_EXACT", "TIER_3_STRONG_EQUIVALENCE", "TIER_4_PARTIAL_OVERLAP", "TIER_5_WEAK")
_RELATIONS = f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_pick(("ENTRY", "DIRECTORY", "CONTENT_OBJECT"), "l_linenumber % 3")} AS source_type, l_partkey AS source_id,
 {_pick(("PROJECT", "DUPLICATE_GROUP", "CONTENT_OBJECT", "ENTRY"), "l_suppkey % 4")} AS target_type, l_suppkey AS target_id, {_pick(_KINDS, "l_orderkey % 9")} AS relationship_type,
 {_pick(_TIERS, "l_orderkey % 5")} AS evidence_tier, CAST(1 AS INT) AS version, round(1 - l_discount, 2) AS confidence, CASE WHEN l_returnflag = 'R' THEN 'STALE' ELSE 'ACTIVE' END AS status FROM lineitem"""

#: WITH clauses for the oracles.
RELATIONS = "rel AS (" + render(_RELATIONS, "duckdb") + ")"
ENTRIES = "entries AS (" + render(_ENTRIES, "duckdb") + ")"
CONTENT = "content AS (SELECT full_hash, size_bytes, count(*) AS n, min(entry_id) AS first_id FROM entries WHERE full_hash IS NOT NULL GROUP BY full_hash, size_bytes)"
CHUNKS = """chunks AS (SELECT doc_id, seq, sha256(line) AS chunk_hash, strlen(line)::BIGINT AS size_bytes FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents) WHERE line <> '')"""
TREE = """tree AS (SELECT s || '/' || o_orderpriority AS dir, sha256(o_orderkey::VARCHAR) AS hash, o_orderkey FROM orders, (VALUES ('A'), ('B')) v(s)
 WHERE (s = 'A' AND o_orderkey % 10 <> 0) OR (s = 'B' AND o_orderkey % 11 <> 0))"""
SNAPSHOTS = """snap_a AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR || '/' || o_orderpriority AS path, o_totalprice AS size, o_orderdate AS mtime, (o_orderkey % 3)::INT AS device, o_custkey AS inode FROM orders WHERE o_orderkey % 10 <> 0),
snap_b AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR || '/' || o_orderpriority AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size, o_orderdate AS mtime,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 3)::INT END AS device, o_custkey AS inode FROM orders WHERE o_orderkey % 11 <> 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions, as one small file does; larger tables stay as they are. For work that is heavy on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the inventory, one for each document."""
    return spark.sql(render(_ENTRIES.replace("FROM documents", "FROM {documents}"), "spark"), documents=table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, chunk_hash, size_bytes) of the non-empty lines."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (seq, line)").where("line <> ''").selectExpr("doc_id", "CAST(seq AS BIGINT) AS seq", "sha2(line, 256) AS chunk_hash", "CAST(octet_length(line) AS BIGINT) AS size_bytes")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, hash): two backups of the orders, one directory for each priority."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority", "explode(array('A', 'B')) AS s")
    kept = orders.where("(s = 'A' AND o_orderkey % 10 <> 0) OR (s = 'B' AND o_orderkey % 11 <> 0)")
    return kept.selectExpr("concat(s, '/', o_orderpriority) AS dir", "sha2(CAST(o_orderkey AS STRING), 256) AS hash")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, path, size, mtime, device, inode) of two scans of one source."""
    orders = table(spark, sf_dir, "orders")
    path = "concat(o_orderkey, '/', o_orderpriority) AS path"
    a = orders.where("o_orderkey % 10 <> 0").selectExpr("o_orderkey AS id", path, "o_totalprice AS size", "o_orderdate AS mtime", "CAST(o_orderkey % 3 AS INT) AS device", "o_custkey AS inode")
    b = orders.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey AS id", path, "IF(o_orderkey % 7 = 0, o_totalprice + 1, o_totalprice) AS size", "o_orderdate AS mtime", "IF(o_orderkey % 13 = 0, NULL, CAST(o_orderkey % 3 AS INT)) AS device", "o_custkey AS inode")
    return a, b


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of the inventory, one for each line item."""
    return spark.sql(render(_RELATIONS.replace("FROM lineitem", "FROM {lineitem}"), "spark"), lineitem=table(spark, sf_dir, "lineitem"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, bits): bit i is set where a value is above the median of all but the first; and each descriptor once more, of a rescan, with a run of up to ten
    bits turned."""
    from inventra.functions.bits import median_bits

    first = table(spark, sf_dir, "embeddings").select("vec_id", median_bits("embedding").alias("bits"))
    turned = F.expr("bits ^ shiftleft(shiftleft(1L, CAST(vec_id % 11 AS INT)) - 1L, CAST(vec_id % 50 AS INT))")
    return first.select(F.explode(F.array(F.struct("vec_id", "bits"), F.struct((F.col("vec_id") + 10_000_000).alias("vec_id"), turned.alias("bits")))).alias("d")).select("d.*")
