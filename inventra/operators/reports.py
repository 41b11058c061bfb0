"""Report models, review facets, manifests and assertions over the inventory's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inventra.operators.duplicates import CONTENT, reclaimable

#: Digests without a recorded function are of this one.
DEFAULT_ALGORITHM = "sha256"
#: Path patterns that are tested together on each entry.
PATTERN_BLOCK = 500


def _contents(entries: DataFrame) -> DataFrame:
    """Content groups, one row each, so totals over them need no distinct counts."""
    return entries.where(F.col("full_hash").isNotNull()).groupBy(*CONTENT).agg(F.count("*").alias("n"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def overview_model(entries: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: the metrics of the first page. Review candidates are all entries of a REVIEW_ class; reclaimable bytes count hard links once."""
    e = entries.agg(F.count_distinct("source_root").alias("sources"), F.count("*").alias("entries"), _zero(F.sum("size_bytes")).alias("logical_bytes"))
    c = _contents(entries).agg(F.count("*").alias("content_objects"), _zero(F.sum("size_bytes")).alias("unique_bytes"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    k = classified.agg(F.count_if(F.col("classification").startswith("REVIEW_")).alias("review_candidates"), F.count_if(F.col("classification") == "PROTECTED").alias("protected"))
    r = reclaimable(entries).select(_zero(F.col("reclaimable_inode")).alias("reclaimable_bytes"))
    return e.crossJoin(c).crossJoin(k).crossJoin(r)  # one row each


def summary(entries: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: the figures of the summary report."""
    e = entries.where("entry_type = 'file'").agg(F.count("*").alias("file_count"), _zero(F.sum("size_bytes")).alias("byte_count"))
    e = e.crossJoin(entries.agg(F.count_if(F.col("scan_status") == "ERROR").alias("unreadable")))
    c = F.col("classification")
    k = classified.agg(F.count_if(c == "PROTECTED").alias("protected"), F.count_if(c == "UNKNOWN").alias("unknown"), F.count_if(c == "ERROR").alias("errors"))
    more = F.col("n") - 1
    d = _contents(entries).agg(F.count_if(more > 0).alias("exact_duplicate_groups"), _zero(F.sum(more)).alias("redundant_members"), _zero(F.sum(more * F.col("size_bytes"))).alias("exact_duplicate_bytes"), F.count("*").alias("content_objects"))
    return e.crossJoin(k).crossJoin(d)  # one row each


def reviewable_by_class(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("classification").startswith("REVIEW_")).groupBy("classification").agg(F.count("*").alias("files"), _zero(F.sum("size_bytes")).alias("bytes"))


def tier_counts(edges: DataFrame) -> DataFrame:
    """Active content relationships by type and tier."""
    return edges.where("status = 'ACTIVE'").groupBy("relationship_type", "evidence_tier").agg(F.count("*").alias("edges"))


def run_totals(entries: DataFrame, classified: DataFrame, *by: str) -> DataFrame:
    """Per run (columns by): files, directories, contents, duplicate groups and redundant files inside the run, protected entries, reviewable bytes, and
    whether any content is known. A copy in another run makes no duplicate."""
    kinds = entries.join(classified.select("entry_id", "classification"), "entry_id", "left")
    part = kinds.groupBy(*by, *CONTENT).agg(
        F.count_if(F.col("entry_type") == "file").alias("files"), F.count_if(F.col("entry_type") == "directory").alias("directories"), F.count("*").alias("n"),
        F.count_if(F.col("classification") == "PROTECTED").alias("protected"), F.sum(F.when(F.col("classification").startswith("REVIEW_"), F.col("size_bytes"))).alias("reviewable"),
    )
    known, group = F.col("full_hash").isNotNull(), F.col("full_hash").isNotNull() & (F.col("n") > 1)
    return part.groupBy(*by).agg(
        F.sum("files").alias("files"), F.sum("directories").alias("directories"), F.count_if(known).alias("content_objects"), F.count_if(group).alias("duplicate_groups"), _zero(F.sum(F.when(group, F.col("n") - 1))).alias("duplicate_files"),
        F.sum("protected").alias("protected"), _zero(F.sum("reviewable")).alias("reviewable_bytes"), F.bool_or(known).alias("identity_available"),
    )


def run_deltas(totals: DataFrame, source: str, run: str) -> DataFrame:
    """Change from each run to the next one of its source. Duplicate groups are comparable only where contents are known on both sides; else null.
    The first run of a source has no row."""
    w = W.partitionBy(source).orderBy(run)
    before = totals.select("*", *[F.lag(c).over(w).alias(f"b_{c}") for c in (run, "duplicate_groups", "identity_available", "reviewable_bytes")]).where(F.col(f"b_{run}").isNotNull())
    groups = F.when(F.col("identity_available") & F.col("b_identity_available"), F.col("duplicate_groups") - F.col("b_duplicate_groups"))
    return before.select(source, run, F.col(f"b_{run}").alias("previous"), groups.alias("duplicate_groups"), (F.col("reviewable_bytes") - F.col("b_reviewable_bytes")).alias("reviewable_bytes"))


def export_digest(decisions: DataFrame, session: str, *columns: str) -> DataFrame:
    """(session, decisions, digest) of any row order: rows are hashed, gathered by the first two digits of their hash, and the 256 parts hashed again, so no
    task holds a whole session. Null has a mark of its own; texts are preceded by their length, so fields can't run together."""
    text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in columns]
    rows = decisions.select(session, F.sha2(F.concat_ws("|", *text), 256).alias("_h"))
    parts = rows.groupBy(session, F.substring("_h", 1, 2).alias("_part")).agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ""), 256).alias("_d"))
    whole = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("_part", "_d"))), ""), 256)
    return parts.groupBy(session).agg(F.sum("_n").alias("decisions"), whole.alias("digest"))


def manifest_errors(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, error, times) of a manifest (entry_id, approved, source_path, size_bytes, expected_hash, algorithm) against entries (entry_id,
    relative_path, size_bytes, full_hash, hash_algorithm, hash_status). Two kinds of errors are the manifest's own: an id's further rows, and approved rows
    without a hash or with a negative size. Of the others each row has the first: missing, source drift, another hash function, not verified."""
    own = manifest.groupBy("entry_id").agg((F.count("*") - 1).alias("DUPLICATE_ID"), F.count_if(F.col("approved") & ((F.coalesce("expected_hash", F.lit("")) == "") | (F.col("size_bytes") < 0))).alias("INVALID_APPROVED"))
    own = own.select("entry_id", F.explode(F.create_map(*[x for e in ("DUPLICATE_ID", "INVALID_APPROVED") for x in (F.lit(e), F.col(e))])).alias("error", "times")).where("times > 0")
    e = entries.select("entry_id", F.lit(True).alias("_found"), "relative_path", F.col("size_bytes").alias("_size"), "full_hash", "hash_algorithm", "hash_status")
    algorithm = lambda c: F.lower(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DEFAULT_ALGORITHM)))
    drift = ~F.col("relative_path").eqNullSafe(F.col("source_path")) | ~F.col("_size").eqNullSafe(F.col("size_bytes"))
    verified = F.col("full_hash").eqNullSafe(F.col("expected_hash")) & F.coalesce(F.col("hash_status").isin("OK", "VERIFIED"), F.lit(False))
    error = F.when(F.col("_found").isNull(), "MISSING").when(drift, "SOURCE_DRIFT").when(F.col("approved") & (algorithm("hash_algorithm") != algorithm("algorithm")), "HASH_ALGORITHM").when(F.col("approved") & ~verified, "UNVERIFIED_APPROVED")
    against = manifest.join(e, "entry_id", "left").withColumn("error", error).where("error IS NOT NULL").groupBy("entry_id", "error").agg(F.count("*").alias("times"))
    return own.unionByName(against)


def assertions(entries: DataFrame, asserted: DataFrame) -> DataFrame:
    """(entry_id, assertion, scope_type, scope_value) of assertions (assertion, scope_type, scope_value) that hold for an entry: by its content, an equal-key join, or
    by a pattern its path contains. Patterns are tested in blocks: every entry meets one row for each PATTERN_BLOCK of them, whatever matches."""
    content = asserted.where("scope_type = 'CONTENT_OBJECT'").select("assertion", "scope_type", F.col("scope_value").alias("full_hash"))
    by_content = entries.select("entry_id", "full_hash").join(content, "full_hash").select("entry_id", "assertion", "scope_type", F.col("full_hash").alias("scope_value"))
    patterns = asserted.where("scope_type = 'PATH_PATTERN'").select("assertion", "scope_value").distinct()
    blocks = max(1, -(-patterns.count() // PATTERN_BLOCK))
    packed = patterns.groupBy(F.pmod(F.xxhash64("assertion", "scope_value"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("assertion", "scope_value")).alias("_p"))
    hits = entries.select("entry_id", "relative_path").crossJoin(packed).select("entry_id", F.explode(F.expr("filter(_p, p -> contains(relative_path, p.scope_value))")).alias("p"))
    return by_content.unionByName(hits.select("entry_id", "p.assertion", F.lit("PATH_PATTERN").alias("scope_type"), "p.scope_value"))


def review_filter(
    classified: DataFrame, decisions: DataFrame | None = None, duplicates: DataFrame | None = None, projects: DataFrame | None = None, *, classification: str | None = None, source_root: str | None = None,
    minimum_confidence: float | None = None, maximum_confidence: float | None = None, suffix: str | None = None, minimum_size: int | None = None, maximum_size: int | None = None, decision: str | None = None,
    reason: str | None = None, modified_from: float | None = None, modified_to: float | None = None, duplicate_only: bool = False, project_only: bool = False, stale: bool | None = None, protected: bool | None = None,
    top_level: str | None = None, actionable: bool = False,
) -> DataFrame:
    """The classified entries that all given facets allow. decisions (entry_id, decision, stale) are the current ones, duplicates and projects (entry_id) the
    members and roots; they enter by semi- and anti-joins, the other facets as one conjunction that reaches the scan."""
    c, df = F.col, classified
    tests = [
        (classification, c("classification") == classification), (source_root, c("source_root") == source_root), (minimum_confidence, c("confidence") >= minimum_confidence), (maximum_confidence, c("confidence") <= maximum_confidence),
        (suffix, c("suffix") == (suffix or "").lower()), (minimum_size, c("size_bytes") >= minimum_size), (maximum_size, c("size_bytes") <= maximum_size), (reason, c("reason") == reason),
        (modified_from, c("modified_at") >= modified_from), (modified_to, c("modified_at") <= modified_to),
        (top_level, (c("relative_path") == top_level) | c("relative_path").startswith(f"{top_level}/")),
        (protected, c("classification") == "PROTECTED" if protected else c("classification").isNull() | (c("classification") != "PROTECTED")), (actionable or None, c("classification").startswith("REVIEW_")),
    ]
    for given, test in tests:
        if given is not None:
            df = df.where(test)
    wanted = [("left_anti", decisions)] if actionable else []
    if decision is not None:
        wanted.append(("left_semi", decisions.where(c("decision") == decision)))
    if stale is not None:
        wanted.append(("left_semi", decisions.where(c("stale") == stale)))
    if duplicate_only:
        wanted.append(("left_semi", duplicates))
    if project_only:
        wanted.append(("left_semi", projects))
    for how, other in wanted:
        df = df.join(other.select("entry_id"), "entry_id", how)
    return df
