"""Queries over content identity: duplicates, hard links, coverage, marginal value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.operators import duplicates as op
from inventra.plans.registry import query
from inventra.sources.bindings import ENTRIES, entries, table

_GROUPS = f"""WITH {ENTRIES}, g AS (
 SELECT full_hash, size_bytes, count(*) AS members, arg_min(entry_id, (length(relative_path), lower(relative_path), entry_id)) AS canonical_entry_id
 FROM entries WHERE full_hash IS NOT NULL GROUP BY full_hash, size_bytes HAVING count(*) > 1)"""


@query(_GROUPS + " SELECT * FROM g")
def exact_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return op.groups(entries(spark, sf))


@query(_GROUPS + " SELECT full_hash, size_bytes, members, CASE WHEN ascii(full_hash) % 2 = 0 THEN (SELECT max(entry_id) FROM entries e WHERE e.full_hash = g.full_hash) ELSE canonical_entry_id END AS canonical_entry_id FROM g")
def duplicate_groups_with_overrides(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    chosen = e.where("ascii(full_hash) % 2 = 0").groupBy("full_hash").agg(F.max("entry_id").alias("canonical"))
    return op.groups(e, chosen).select("full_hash", "size_bytes", "members", "canonical_entry_id")


@query(_GROUPS + " SELECT e.full_hash, e.entry_id, e.relative_path, e.entry_id = g.canonical_entry_id AS is_canonical FROM entries e JOIN g USING (full_hash, size_bytes)")
def duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return op.members(e, op.groups(e))


@query(_GROUPS + " SELECT e.full_hash, e.entry_id, row_number() OVER (PARTITION BY e.full_hash ORDER BY length(relative_path), lower(relative_path), entry_id)::INT AS rank FROM entries e JOIN g USING (full_hash, size_bytes)")
def duplicate_member_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return op.rank_members(entries(spark, sf))


@query(f"WITH {ENTRIES}, s AS (SELECT size_bytes, count(*) AS same_size FROM entries GROUP BY 1 HAVING count(*) > 1) SELECT entry_id, size_bytes, same_size FROM entries JOIN s USING (size_bytes)")
def size_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return op.size_candidates(entries(spark, sf))


_INODES = f"""WITH {ENTRIES}, g AS (SELECT full_hash, size_bytes, count(*) AS members, count(DISTINCT CASE WHEN device IS NOT NULL AND inode IS NOT NULL AND nlink > 1 THEN device || ':' || inode ELSE 'entry:' || entry_id END) AS files, min(entry_id) AS first_id
 FROM entries WHERE full_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
 r AS (SELECT *, size_bytes * (files - 1) AS reclaimable_inode, size_bytes * (members - 1) AS reclaimable_paths FROM g)"""


@query(_INODES + " SELECT * FROM r")
def duplicate_groups_by_inode(spark: SparkSession, sf: str) -> DataFrame:
    return op.inode_groups(entries(spark, sf))


@query(_INODES + " SELECT count(*) AS groups, coalesce(sum(reclaimable_inode), 0)::BIGINT AS reclaimable_inode, coalesce(sum(reclaimable_paths), 0)::BIGINT AS reclaimable_paths FROM r")
def reclaimable_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return op.reclaimable(entries(spark, sf))


@query(f"""WITH {ENTRIES}, s AS (SELECT full_hash, count(DISTINCT source_root) AS n FROM entries WHERE full_hash IS NOT NULL GROUP BY 1)
SELECT source_root, CASE WHEN full_hash IS NULL THEN 'unknown' WHEN n > 1 THEN 'covered' ELSE 'unique' END AS bucket, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries LEFT JOIN s USING (full_hash) GROUP BY 1, 2""")
def coverage_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return op.coverage(entries(spark, sf))


@query(f"""WITH {ENTRIES}, s AS (SELECT full_hash FROM entries WHERE full_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_root) = 1)
SELECT entry_id, relative_path, size_bytes FROM entries JOIN s USING (full_hash) ORDER BY size_bytes DESC, relative_path, entry_id LIMIT 20""")
def coverage_unique_files(spark: SparkSession, sf: str) -> DataFrame:
    return op.unique_files(entries(spark, sf))


_VALUE = f"""WITH {ENTRIES}, h AS (SELECT DISTINCT full_hash, size_bytes, source_root || '/' || split_part(relative_path, '/', 1) AS collection FROM entries WHERE full_hash IS NOT NULL),
 s AS (SELECT *, count(*) OVER (PARTITION BY full_hash, size_bytes) AS holders FROM h),
 c AS (SELECT collection, count(*) AS objects, sum(size_bytes)::BIGINT AS total_bytes, count(*) FILTER (holders = 1) AS unique_objects, coalesce(sum(size_bytes) FILTER (holders = 1), 0)::BIGINT AS unique_bytes FROM s GROUP BY 1)
 SELECT *, CASE WHEN total_bytes = 0 THEN 'UNRESOLVED' WHEN unique_bytes = 0 THEN 'FULLY_CONTENT_REDUNDANT_CONTEXT_REMAINS' WHEN unique_bytes / total_bytes::DOUBLE < 0.05 THEN 'MOSTLY_REDUNDANT_WITH_UNIQUE_ITEMS'
 WHEN unique_bytes / total_bytes::DOUBLE < 0.25 AND unique_objects < 10 THEN 'LOW_BYTE_VALUE_HIGH_CONTEXT_VALUE' WHEN unique_bytes / total_bytes::DOUBLE < 0.5 THEN 'MODERATE_MARGINAL_VALUE' ELSE 'HIGH_MARGINAL_VALUE' END AS value FROM c"""


@query(_VALUE)
def collection_marginal_value(spark: SparkSession, sf: str) -> DataFrame:
    return op.collection_value(entries(spark, sf))


@query(f"SELECT * FROM ({_VALUE}) x WHERE collection = 'src0/en'")
def removal_simulation(spark: SparkSession, sf: str) -> DataFrame:
    return op.collection_value(entries(spark, sf)).where("collection = 'src0/en'")


@query(f"WITH {ENTRIES} SELECT full_hash, size_bytes, count(*) AS members FROM entries WHERE full_hash IS NOT NULL GROUP BY 1, 2 HAVING bool_and(entry_id % 3 <> 0)")
def roles_lost_if_moved(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return op.survivors(e, e.where("entry_id % 3 <> 0"))


@query(_GROUPS + " SELECT full_hash, canonical_entry_id AS entry_id, 'CANONICAL_LOCATION' AS role FROM g")
def canonical_roles(spark: SparkSession, sf: str) -> DataFrame:
    return op.canonical_roles(op.groups(entries(spark, sf)))


@query(f"""WITH {ENTRIES}, f AS (SELECT *, CASE WHEN device IS NOT NULL AND inode IS NOT NULL AND nlink > 1 THEN device || ':' || inode ELSE 'entry:' || entry_id END AS file FROM entries),
 r AS (SELECT file, min(full_hash) AS digest, coalesce(min(entry_id) FILTER (full_hash IS NOT NULL), min(entry_id)) AS hashed_entry FROM f GROUP BY 1)
SELECT entry_id, hashed_entry, (SELECT full_hash FROM entries e WHERE e.entry_id = hashed_entry) AS digest, entry_id = hashed_entry AS read FROM f JOIN r USING (file)""")
def hash_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return op.representatives(entries(spark, sf))


def _keeper_sql(fits: str, newest: str) -> str:
    return _GROUPS + f""", m AS (SELECT e.*, g.canonical_entry_id FROM entries e JOIN g USING (full_hash, size_bytes)),
 k AS (SELECT full_hash, arg_min(entry_id, (-{newest}, entry_id <> canonical_entry_id, entry_id)) FILTER ({fits}) AS keeper, count(*) - 1 AS proposals, bool_or(scan_status = 'ERROR') AS blocked FROM m GROUP BY full_hash, size_bytes)
 SELECT * FROM k WHERE keeper IS NOT NULL"""


@query(_keeper_sql("entry_id = canonical_entry_id", "0"))
def wizard_keep_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return op.keeper(entries(spark, sf), "keep-canonical")


@query(_keeper_sql("true", "coalesce(modified_at, 0)"))
def wizard_keep_newest(spark: SparkSession, sf: str) -> DataFrame:
    return op.keeper(entries(spark, sf), "keep-newest")


@query(_keeper_sql("starts_with(relative_path, 'en/b3/')", "0"))
def wizard_keep_under(spark: SparkSession, sf: str) -> DataFrame:
    return op.keeper(entries(spark, sf), "keep-under", "en/b3")


@query(_GROUPS + " SELECT full_hash, members, size_bytes, size_bytes * (members - 1) AS redundant_bytes FROM g ORDER BY redundant_bytes DESC, full_hash LIMIT 500")
def top_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return op.top_groups(entries(spark, sf))


@query("SELECT doc_id, sha256(text) AS full_digest, sha256(text[1:64] || text[length(text) // 2 + 1:length(text) // 2 + 64] || text[greatest(length(text) - 63, 1):length(text)]) AS quick_digest FROM documents")
def full_and_quick_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Whole digest, and one of three samples: start, middle, end."""
    quick = F.expr("concat(substring(text, 1, 64), substring(text, length(text) div 2 + 1, 64), substring(text, greatest(length(text) - 63, 1), 64))")
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("full_digest"), F.sha2(quick, 256).alias("quick_digest"))
