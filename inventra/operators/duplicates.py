"""Content identity: exact duplicates, canonical members, hard links, coverage and marginal value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inventra.functions.paths import top_level

CONTENT = ("full_hash", "size_bytes")


def _preference() -> Column:
    """Shortest path, then its lower-case form, then id."""
    return F.struct(F.length("relative_path"), F.lower("relative_path"), F.col("entry_id"))


def groups(entries: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(full_hash, size_bytes, members, canonical_entry_id) of contents that occur more than once. Only sizes that occur
    more than once can hold a duplicate; aggregating by content needs one shuffle and combines on the map side.
    overrides: (full_hash, canonical) chosen by a user."""
    found = entries.where(F.col("full_hash").isNotNull()).groupBy(*CONTENT).agg(F.count("*").alias("members"), F.min_by("entry_id", _preference()).alias("canonical_entry_id")).where("members > 1")
    if overrides is not None:
        found = found.join(overrides, "full_hash", "left").withColumn("canonical_entry_id", F.coalesce("canonical", "canonical_entry_id")).drop("canonical")
    return found


def members(entries: DataFrame, found: DataFrame) -> DataFrame:
    """(full_hash, entry_id, relative_path, is_canonical)."""
    own = found.select(*CONTENT, "canonical_entry_id")
    return entries.join(own, list(CONTENT)).select("full_hash", "entry_id", "relative_path", (F.col("entry_id") == F.col("canonical_entry_id")).alias("is_canonical"))


def size_candidates(entries: DataFrame) -> DataFrame:
    """Files whose size occurs more than once: the only ones worth hashing. Sizes are counted with map-side combining
    and joined back, so a size of very many files is not gathered as a window would."""
    sizes = entries.groupBy("size_bytes").agg(F.count("*").alias("same_size")).where("same_size > 1")
    return entries.join(sizes, "size_bytes").select("entry_id", "size_bytes", "same_size")


def file_identity() -> Column:
    """What hard links of one file share: device and inode, if both are known and the file system reports further links; else the entry itself."""
    linked = F.col("device").isNotNull() & F.col("inode").isNotNull() & (F.col("nlink") > 1)
    return F.when(linked, F.concat_ws(":", "device", "inode")).otherwise(F.concat(F.lit("entry:"), F.col("entry_id")))


def inode_groups(entries: DataFrame) -> DataFrame:
    """Duplicate groups with the number of distinct files behind them (hard links count once), and both kinds of reclaimable bytes."""
    g = entries.where(F.col("full_hash").isNotNull()).groupBy(*CONTENT).agg(F.count("*").alias("members"), F.count_distinct(file_identity()).alias("files"), F.min("entry_id").alias("first_id")).where("members > 1")
    return g.select("full_hash", "size_bytes", "members", "files", "first_id", (F.col("size_bytes") * (F.col("files") - 1)).alias("reclaimable_inode"), (F.col("size_bytes") * (F.col("members") - 1)).alias("reclaimable_paths"))


def reclaimable(entries: DataFrame) -> DataFrame:
    g = inode_groups(entries)
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("reclaimable_inode"), F.lit(0)).alias("reclaimable_inode"), F.coalesce(F.sum("reclaimable_paths"), F.lit(0)).alias("reclaimable_paths"))


def coverage(entries: DataFrame) -> DataFrame:
    """(source_root, bucket, files, bytes): covered if the content is in another source too, unique if not, unknown without a digest."""
    held = entries.where(F.col("full_hash").isNotNull()).select("full_hash", "source_root").distinct()
    spread = held.groupBy("full_hash").agg(F.count("*").alias("sources"))
    bucket = F.when(F.col("full_hash").isNull(), "unknown").when(F.col("sources") > 1, "covered").otherwise("unique")
    return entries.join(spread, "full_hash", "left").groupBy("source_root", bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def unique_files(entries: DataFrame, limit: int = 20) -> DataFrame:
    """The largest files whose content is in no other source."""
    held = entries.where(F.col("full_hash").isNotNull()).select("full_hash", "source_root").distinct()
    single = held.groupBy("full_hash").agg(F.count("*").alias("n")).where("n = 1").select("full_hash")
    return entries.join(single, "full_hash", "left_semi").select("entry_id", "relative_path", "size_bytes").orderBy(F.desc("size_bytes"), "relative_path", "entry_id").limit(limit)


def collection_value(entries: DataFrame) -> DataFrame:
    """Marginal value of each top-level collection of a source: what would be lost with it."""
    key = F.concat_ws("/", "source_root", top_level("relative_path"))
    held = entries.where(F.col("full_hash").isNotNull()).select(*CONTENT, key.alias("collection")).distinct()
    spread = held.groupBy(*CONTENT).agg(F.count("*").alias("holders"))
    df = held.join(spread, list(CONTENT))
    only = F.col("holders") == 1
    out = df.groupBy("collection").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("total_bytes"), F.count_if(only).alias("unique_objects"), F.coalesce(F.sum(F.when(only, F.col("size_bytes"))), F.lit(0)).alias("unique_bytes"))
    ratio = F.col("unique_bytes") / F.col("total_bytes")
    value = (
        F.when(F.col("total_bytes") == 0, "UNRESOLVED")
        .when(F.col("unique_bytes") == 0, "FULLY_CONTENT_REDUNDANT_CONTEXT_REMAINS")
        .when(ratio < 0.05, "MOSTLY_REDUNDANT_WITH_UNIQUE_ITEMS")
        .when((ratio < 0.25) & (F.col("unique_objects") < 10), "LOW_BYTE_VALUE_HIGH_CONTEXT_VALUE")
        .when(ratio < 0.5, "MODERATE_MARGINAL_VALUE")
        .otherwise("HIGH_MARGINAL_VALUE")
    )
    return out.withColumn("value", value)


def survivors(entries: DataFrame, approved: DataFrame) -> DataFrame:
    """Duplicate groups that would lose every member: division of the group by the approved set."""
    marked = entries.join(approved.select("entry_id", F.lit(True).alias("approved")), "entry_id", "left").where(F.col("full_hash").isNotNull())
    return marked.groupBy(*CONTENT).agg(F.count("*").alias("members"), F.every(F.coalesce("approved", F.lit(False))).alias("all_approved")).where("all_approved").select("full_hash", "size_bytes", "members")


def canonical_roles(groups_: DataFrame) -> DataFrame:
    return groups_.select(F.col("full_hash"), F.col("canonical_entry_id").alias("entry_id"), F.lit("CANONICAL_LOCATION").alias("role"))


def representatives(entries: DataFrame) -> DataFrame:
    """One entry of each file is read, the others take its digest; if reading the first failed, the next one that has a digest stands in."""
    e = entries.withColumn("_file", file_identity())
    order = F.struct(F.col("full_hash").isNull(), F.col("entry_id"))
    first = e.groupBy("_file").agg(F.min_by("full_hash", order).alias("digest"), F.min_by("entry_id", order).alias("hashed_entry"))
    return e.join(first, "_file").select("entry_id", "hashed_entry", "digest", (F.col("entry_id") == F.col("hashed_entry")).alias("read"))


def keeper(entries: DataFrame, rule: str, prefix: str = "") -> DataFrame:
    """Bulk review: (full_hash, keeper, proposals) by keep-canonical, keep-newest or keep-under; a group without a keeper is left out.
    Ties go to the canonical member, then the smallest id; the choice is one aggregate, no window."""
    own = entries.join(groups(entries).select(*CONTENT, "canonical_entry_id"), list(CONTENT))
    canonical = F.col("entry_id") == F.col("canonical_entry_id")
    if rule == "keep-canonical":
        fits = canonical
    elif rule == "keep-newest":
        fits = F.lit(True)
    elif rule == "keep-under":
        if not prefix.strip("/"):
            raise ValueError("keep-under needs a path prefix")
        p = prefix.strip("/")
        fits = (F.col("relative_path") == p) | F.col("relative_path").startswith(p + "/")
    else:
        raise ValueError(f"unknown rule: {rule}")
    newest = F.coalesce(F.col("modified_at"), F.lit(0.0)) if rule == "keep-newest" else F.lit(0.0)
    order = F.when(fits, F.struct((-newest).alias("a"), (~canonical).alias("b"), F.col("entry_id").alias("c")))
    blocked = F.bool_or(F.col("scan_status") == "ERROR")
    g = own.groupBy(*CONTENT).agg(F.min_by("entry_id", order).alias("keeper"), F.min(order).isNotNull().alias("_fits"), (F.count("*") - 1).alias("proposals"), blocked.alias("blocked"))
    return g.where("_fits").select("full_hash", "keeper", "proposals", "blocked")


def top_groups(entries: DataFrame, limit: int = 500) -> DataFrame:
    g = groups(entries)
    return g.select("full_hash", "members", "size_bytes", (F.col("size_bytes") * (F.col("members") - 1)).alias("redundant_bytes")).orderBy(F.desc("redundant_bytes"), "full_hash").limit(limit)


def rank_members(entries: DataFrame) -> DataFrame:
    """Rank of every member in its group; a group is as large as its copies, so the window is over (content) keys with a few ids only."""
    w = W.partitionBy(*CONTENT).orderBy(F.length("relative_path"), F.lower("relative_path"), "entry_id")
    found = groups(entries).select(*CONTENT)
    return entries.join(found, list(CONTENT), "left_semi").select("full_hash", "entry_id", F.row_number().over(w).alias("rank"))
