"""Queries over classification, scores and review decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.operators import directories as di
from inventra.operators import policy as op
from inventra.plans.registry import query
from inventra.sources.bindings import ENTRIES, NOW, entries, table


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CLASSES = f"""{ENTRIES}, g AS (SELECT full_hash, size_bytes, count(*) AS n, arg_min(entry_id, (length(relative_path), lower(relative_path), entry_id)) AS canonical FROM entries WHERE full_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
 spec AS (SELECT DISTINCT source_root, dir FROM entries WHERE name IN ({_in(di.DEPENDENCY_SPECS)})), locks AS (SELECT DISTINCT source_root, dir FROM entries WHERE name IN ({_in(di.LOCKFILES)})),
 f AS (SELECT e.*, g.n, g.canonical,
  CASE WHEN '/' || relative_path LIKE '%/.venv/%' THEN ltrim(split_part('/' || relative_path, '/.venv/', 1), '/') WHEN '/' || relative_path LIKE '%/venv/%' THEN ltrim(split_part('/' || relative_path, '/venv/', 1), '/') WHEN '/' || relative_path LIKE '%/env/%' THEN ltrim(split_part('/' || relative_path, '/env/', 1), '/') END AS venv,
  CASE WHEN '/' || relative_path LIKE '%/node_modules/%' THEN ltrim(split_part('/' || relative_path, '/node_modules/', 1), '/') END AS node FROM entries e LEFT JOIN g USING (full_hash, size_bytes)),
 h AS (SELECT f.*, EXISTS (SELECT 1 FROM spec s WHERE s.source_root = f.source_root AND s.dir = f.venv) AS venv_spec, EXISTS (SELECT 1 FROM locks s WHERE s.source_root = f.source_root AND s.dir = f.node) AS node_lock,
  EXISTS (SELECT 1 FROM spec s WHERE s.source_root = f.source_root AND (s.dir = '' OR starts_with(f.relative_path, s.dir || '/'))) AS in_project, EXISTS (SELECT 1 FROM entries s WHERE s.source_root = f.source_root AND s.dir = f.dir AND '~$' || s.name = f.name) AS sibling FROM f),
 r AS (SELECT *, [x FOR x IN [
  CASE WHEN scan_status = 'ERROR' OR analysis_failed THEN {{'k': 0, 'c': -1.0, 'i': 0, 'id': 'parser-or-filesystem-error', 'cls': 'ERROR', 'why': 'PARSER_OR_FILESYSTEM_ERROR'}} END,
  CASE WHEN suffix IN ({_in(op.PROTECTED_SUFFIXES)}) OR name IN ({_in(op.PROTECTED_NAMES)}) OR list_has_any(string_split(dir, '/'), [{_in(op.PROTECTED_DIRS)}]) THEN {{'k': 1, 'c': -0.95, 'i': 1, 'id': 'protected-signal', 'cls': 'PROTECTED', 'why': 'PROTECTED_SIGNAL'}} END,
  CASE WHEN n >= 2 AND canonical <> entry_id THEN {{'k': 9, 'c': -1.0, 'i': 2, 'id': 'exact-duplicate-noncanonical', 'cls': 'REVIEW_SAFE', 'why': 'EXACT_SHA256_DUPLICATE'}} END,
  CASE WHEN starts_with(name, '~$') AND size_bytes <= 65536 AND suffix IN ({_in(op.OFFICE)}) AND sibling THEN {{'k': 9, 'c': -0.9, 'i': 3, 'id': 'office-temporary-lock', 'cls': 'REVIEW_SAFE', 'why': 'OFFICE_TEMPORARY_LOCK_FILE'}} END,
  CASE WHEN '/' || relative_path LIKE '%/~_~_pycache~_~_/%' ESCAPE '~' AND suffix = '.pyc' AND in_project THEN {{'k': 9, 'c': -0.9, 'i': 4, 'id': 'python-bytecode-cache', 'cls': 'REVIEW_SAFE', 'why': 'PYTHON_BYTECODE_CACHE'}} END,
  CASE WHEN venv_spec THEN {{'k': 8, 'c': -0.75, 'i': 5, 'id': 'virtualenv-regenerable', 'cls': 'REVIEW_PROBABLE', 'why': 'VIRTUAL_ENVIRONMENT'}} END,
  CASE WHEN node_lock THEN {{'k': 8, 'c': -0.75, 'i': 6, 'id': 'node-modules-regenerable', 'cls': 'REVIEW_PROBABLE', 'why': 'NODE_MODULES'}} END,
  CASE WHEN suffix IN ({_in(op.INSTALLERS)}) AND n >= 2 AND {NOW} - modified_at > 31536000 THEN {{'k': 8, 'c': -0.6, 'i': 7, 'id': 'old-duplicate-installer', 'cls': 'REVIEW_PROBABLE', 'why': 'INSTALLER_OR_IMAGE'}} END] IF x IS NOT NULL] AS m FROM h),
 classed AS (SELECT entry_id, coalesce(list_sort(m)[1].cls, 'KEEP') AS classification, coalesce(-list_sort(m)[1].c, 0.5)::DOUBLE AS confidence, coalesce(list_sort(m)[1].why, 'NO_REMOVAL_SIGNAL') AS reason,
  array_to_string(list_transform(list_sort(m), lambda x: x.id), ',') AS rules, canonical AS canonical_entry_id, source_root, relative_path, name, suffix, size_bytes, modified_at, scan_status, analysis_failed FROM r)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return op.classify(entries(spark, sf), NOW)


@query(f"WITH {_CLASSES} SELECT entry_id, classification, confidence, reason, rules FROM classed")
def rule_classification(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("entry_id", "classification", "confidence", "reason", "rules")


@query(f"WITH {_CLASSES} SELECT classification, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM classed GROUP BY 1")
def classification_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).groupBy("classification").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


_BROKEN = "(scan_status = 'ERROR' OR analysis_failed)"
_RISKS = f"""risks AS (SELECT entry_id, CASE WHEN suffix IN ({_in(op.LEGACY_OFFICE)}) THEN 'medium' ELSE 'none' END AS format_risk, CASE WHEN {_BROKEN} THEN 'high' ELSE 'none' END AS integrity_risk,
 CASE WHEN suffix IN ({_in(op.DISK_IMAGE)}) THEN 'medium' ELSE 'none' END AS context_loss_risk, CASE WHEN suffix IN ({_in(op.DISK_IMAGE)}) THEN 'medium' ELSE 'none' END AS accessibility_risk,
 CASE WHEN suffix IN ({_in(op.ENCRYPTED)}) THEN 'high' ELSE 'none' END AS encryption_risk, CASE WHEN suffix IN ({_in(op.EMAIL)}) THEN 'high' WHEN suffix IN ({_in(op.DATABASE + op.LEGACY_OFFICE)}) THEN 'medium' ELSE 'none' END AS application_dependency_risk,
 CASE WHEN suffix IN ({_in(op.EMAIL + op.DATABASE)}) THEN 'KEEP_WITH_APPLICATION_CONTEXT' WHEN suffix IN ({_in(op.DISK_IMAGE)}) THEN 'NEEDS_FORMAT_IDENTIFICATION' WHEN suffix IN ({_in(op.ENCRYPTED)}) THEN 'NEEDS_KEY_DOCUMENTATION' WHEN suffix IN ({_in(op.LEGACY_OFFICE)}) THEN 'KEEP_AND_MIGRATE' WHEN {_BROKEN} THEN 'NEEDS_INTEGRITY_REVIEW' END AS recommended_action FROM entries)"""


@query(f"WITH {ENTRIES}, {_RISKS} SELECT * FROM risks WHERE recommended_action IS NOT NULL")
def preservation_risk(spark: SparkSession, sf: str) -> DataFrame:
    return op.preservation(entries(spark, sf))


@query(f"WITH {ENTRIES}, {_RISKS} SELECT recommended_action, count(*) AS entries FROM risks WHERE recommended_action IS NOT NULL GROUP BY 1")
def preservation_actions(spark: SparkSession, sf: str) -> DataFrame:
    return op.preservation(entries(spark, sf)).groupBy("recommended_action").agg(F.count("*").alias("entries"))


_W = op.WEIGHTS
_PRIORITY = f"""{_CLASSES}, {_RISKS}, p AS (SELECT c.*, k.entry_id IS NOT NULL AS risk, classification = 'REVIEW_SAFE' AND starts_with(reason, 'EXACT') AS exact, reason IN ({_in(op.REGENERABLE)}) AS regen FROM classed c LEFT JOIN (SELECT entry_id FROM risks WHERE recommended_action IS NOT NULL) k USING (entry_id)),
 prio AS (SELECT entry_id, round({_W['recoverable_bytes']}::DOUBLE * log10(size_bytes + 1) + {_W['redundancy_confidence']}::DOUBLE * (CASE WHEN exact THEN 1 ELSE 0 END) + {_W['regeneration_confidence']}::DOUBLE * (CASE WHEN regen THEN 1 ELSE 0 END)
  + {_W['loss_risk']}::DOUBLE * (CASE WHEN exact OR regen THEN 0 ELSE 0.6::DOUBLE END) + {_W['preservation_risk']}::DOUBLE * (CASE WHEN risk THEN 1 ELSE 0 END) + {_W['review_effort']}::DOUBLE * (CASE WHEN exact OR regen THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END), 6) AS score,
  CASE WHEN risk THEN 'PRESERVATION_FIRST' WHEN exact OR regen THEN 'QUICK_SAFE_WIN' WHEN classification IN ('REVIEW_BACKUP', 'REVIEW_VERSION_FAMILY') THEN 'CONTEXT_REQUIRED' WHEN size_bytes >= 536870912 THEN 'HIGH_VALUE_REVIEW' ELSE 'LOW_PRIORITY' END AS category FROM p)"""


@query(f"WITH {_PRIORITY} SELECT * FROM prio")
def review_priority(spark: SparkSession, sf: str) -> DataFrame:
    return op.priority(classified(spark, sf), op.preservation(entries(spark, sf)))


_OLD = f"coalesce({NOW} - modified_at, 0) > 63072000"


@query(f"""WITH {_CLASSES} SELECT entry_id, CASE WHEN classification = 'PROTECTED' THEN 'PROTECTED' WHEN classification IN ('ERROR', 'UNKNOWN') THEN 'DEFERRED' WHEN starts_with(classification, 'REVIEW_') THEN 'MANUAL_REVIEW' WHEN {_OLD} THEN 'COLD_ARCHIVE' ELSE 'ARCHIVE' END AS state,
 CASE WHEN classification = 'PROTECTED' THEN 'PROTECT' WHEN classification IN ('ERROR', 'UNKNOWN') THEN 'DEFER' WHEN starts_with(classification, 'REVIEW_') THEN 'MOVE_TO_MANUAL_REVIEW' WHEN {_OLD} THEN 'DEMOTE_TO_COLD_ARCHIVE' ELSE 'CONSOLIDATE_IN_ARCHIVE' END AS recommendation FROM classed""")
def lifecycle_states(spark: SparkSession, sf: str) -> DataFrame:
    return op.lifecycle(classified(spark, sf), NOW)


_SERIES = f"""series AS (SELECT entry_id, CASE WHEN list_has_any(string_split(lower(dir), '/'), [{_in(op.GENERATED)}]) THEN 1 WHEN suffix IN ('.exe', '.msi', '.dmg', '.pkg', '.deb', '.rpm', '.iso', '.appimage') THEN 2
 WHEN regexp_matches(lower(name), 'tax|invoice|receipt|statement|1099|w2') THEN 3 WHEN suffix IN ({_in(op.VIDEO)}) THEN 4 WHEN suffix IN ('.jpg', '.jpeg', '.png', '.gif', '.tiff', '.heic', '.bmp', '.webp') THEN 5 WHEN suffix IN ({_in(op.CODE)}) THEN 6 WHEN suffix IN ({_in(op.DATA)}) THEN 7
 WHEN regexp_matches(lower(relative_path), 'backup|time machine') THEN 8 WHEN regexp_matches(lower(relative_path), '/tmp/|/temp/|export|download') THEN 9 ELSE 10 END AS k FROM entries),
 named AS (SELECT entry_id, ['GENERATED_BUILD_ARTIFACTS', 'SOFTWARE_INSTALLERS', 'FINANCIAL_AND_TAX', 'PERSONAL_VIDEO', 'PERSONAL_PHOTOGRAPHS', 'SOURCE_CODE', 'DATASETS', 'DEVICE_BACKUPS', 'TEMPORARY_EXPORTS', 'UNKNOWN'][k] AS series, ([0.85, 0.9, 0.7, 0.6, 0.6, 0.75, 0.6, 0.6, 0.5, 0.3]::DOUBLE[])[k] AS confidence FROM series)"""


@query(f"WITH {ENTRIES}, {_SERIES} SELECT * FROM named")
def record_series(spark: SparkSession, sf: str) -> DataFrame:
    return op.record_series(entries(spark, sf))


@query(f"WITH {ENTRIES}, {_SERIES} SELECT series, count(*) AS entries, round(avg(confidence), 6) AS confidence FROM named GROUP BY 1")
def record_series_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op.record_series(entries(spark, sf)).groupBy("series").agg(F.count("*").alias("entries"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"WITH {_CLASSES}, {_SERIES} SELECT series, count(*) FILTER (NOT starts_with(classification, 'REVIEW_')) AS preserve, count(*) FILTER (starts_with(classification, 'REVIEW_')) AS review FROM classed JOIN named USING (entry_id) GROUP BY 1")
def retention_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.retention(classified(spark, sf), op.record_series(entries(spark, sf)))


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END::DOUBLE"


_TESTS = ["classification = 'REVIEW_SAFE'", "classification = 'REVIEW_PROBABLE'", "classification = 'PROTECTED'", "classification = 'ERROR'", "canonical_entry_id IS NOT NULL AND classification = 'REVIEW_SAFE'", "classification NOT IN ('KEEP', 'KEEP_CANONICAL')", None, None, f"suffix IN ({_in(op.IMAGE)})", f"suffix IN ({_in(op.DOCUMENT)})", f"suffix IN ({_in(op.ARCHIVE)})"]
_FEATURES = f"""{_CLASSES}, feats AS (SELECT entry_id, {', '.join(f'({_flag(t)}) AS f{i}' if t else ('confidence AS f6' if i == 6 else 'round(log10(size_bytes + 1), 6) AS f7') for i, t in enumerate(_TESTS))} FROM classed)"""
_LEARNED = (1.5, 0.8, -3.0, -2.0, 0.5, 0.2, 0.4, 0.1, -0.3, -0.1, 0.6)


@query(f"WITH {_FEATURES} SELECT * FROM feats")
def learning_features(spark: SparkSession, sf: str) -> DataFrame:
    return op.features(classified(spark, sf))


_Z = " + ".join(f"{w}::DOUBLE * f{i}" for i, w in enumerate(_LEARNED))


@query(f"WITH {_FEATURES}, p AS (SELECT entry_id, round(1 / (1 + exp(-({_Z} - 0.7::DOUBLE))), 6) AS probability FROM feats WHERE entry_id NOT IN (SELECT doc_id FROM labels)) SELECT entry_id, probability, CASE WHEN probability >= 0.5 THEN 'APPROVE_FOR_REVIEW' ELSE 'KEEP' END AS suggestion FROM p ORDER BY entry_id LIMIT 5000")
def learned_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return op.predict(op.features(classified(spark, sf)), _LEARNED, -0.7, table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id")))


@query()
def logistic_training(spark: SparkSession, sf: str) -> DataFrame:
    frame = op.features(classified(spark, sf)).join(table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), F.col("quality").cast("double").alias("label")), "entry_id")
    weights, bias, metrics = op.train(frame.drop("entry_id"), "label")
    return spark.createDataFrame([*[(f"f{i}", float(w)) for i, w in enumerate(weights)], ("bias", bias), *metrics.items()], "name string, value double")


@query(f"WITH {_CLASSES}, d AS (SELECT full_hash, min(entry_id) AS keeper, count(*) AS n FROM entries WHERE full_hash IS NOT NULL GROUP BY 1), e AS (SELECT split_part(e.relative_path, '/', 1) AS node, e.size_bytes, coalesce(n > 1 AND e.entry_id <> keeper, false) AS dup, starts_with(classification, 'REVIEW_') AS rev FROM entries e LEFT JOIN d USING (full_hash) JOIN classed c ON c.entry_id = e.entry_id) SELECT node, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, coalesce(sum(size_bytes) FILTER (dup), 0)::BIGINT AS duplicate_bytes, coalesce(sum(size_bytes) FILTER (rev), 0)::BIGINT AS reviewable_bytes, coalesce(sum(size_bytes) FILTER (dup OR rev), 0)::BIGINT AS reclaimable_bytes FROM e GROUP BY 1")
def treemap_level(spark: SparkSession, sf: str) -> DataFrame:
    return di.treemap(entries(spark, sf), classified(spark, sf))


@query(f"WITH {_CLASSES} SELECT split_part(relative_path, '/', 1) AS top_level, classification, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM classed WHERE starts_with(classification, 'REVIEW_') GROUP BY 1, 2")
def review_by_top_level(spark: SparkSession, sf: str) -> DataFrame:
    return op.top_level_review(classified(spark, sf))


_LOG = "log AS (SELECT l_orderkey AS target, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'REJECT' WHEN 'A' THEN 'APPROVE' ELSE 'DEFER' END AS decision FROM lineitem)"


@query(f"WITH {_LOG} SELECT target, max({{'s': seq, 'd': decision}}).d AS decision, count(*) AS changes FROM log GROUP BY 1")
def current_decisions(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "lineitem").selectExpr("l_orderkey AS target", "l_linenumber AS seq", "CASE l_returnflag WHEN 'R' THEN 'REJECT' WHEN 'A' THEN 'APPROVE' ELSE 'DEFER' END AS decision")
    return log.groupBy("target").agg(F.max(F.struct("seq", "decision"))["decision"].alias("decision"), F.count("*").alias("changes"))


@query(f"""WITH {_CLASSES}, d AS (SELECT doc_id AS entry_id, CASE WHEN toxic = 1 THEN 'REJECT' ELSE 'APPROVE' END AS decision FROM labels) SELECT c.entry_id, relative_path, classification, size_bytes, d.entry_id IS NOT NULL AS decided, canonical_entry_id IS NOT NULL AS duplicate
FROM classed c LEFT JOIN d USING (entry_id) WHERE starts_with(classification, 'REVIEW_') AND size_bytes >= 200 AND c.entry_id > 50 ORDER BY c.entry_id LIMIT 100""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """One page of the review queue: facets as predicates, flags by joins, keyset after an id."""
    c = classified(spark, sf).where(F.col("classification").startswith("REVIEW_") & (F.col("size_bytes") >= 200) & (F.col("entry_id") > 50))
    decided = table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), F.lit(True).alias("decided"))
    j = c.join(decided, "entry_id", "left")
    return j.select("entry_id", "relative_path", "classification", "size_bytes", F.coalesce("decided", F.lit(False)).alias("decided"), F.col("canonical_entry_id").isNotNull().alias("duplicate")).orderBy("entry_id").limit(100)


@query(f"""WITH {ENTRIES}, m AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE NULL END AS bad, quality FROM labels), x AS (SELECT m.entry_id, CASE WHEN e.entry_id IS NULL THEN 'MISSING' WHEN e.full_hash IS NULL THEN 'UNVERIFIED' WHEN bad IS NOT NULL THEN 'DRIFT' ELSE 'OK' END AS status FROM m LEFT JOIN entries e ON e.entry_id = m.entry_id AND e.entry_id % 11 <> 0) SELECT * FROM x""")
def manifest_validation(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), (F.col("doc_id") % 5 == 0).alias("bad"))
    e = entries(spark, sf).where("entry_id % 11 <> 0").select("entry_id", "full_hash", F.lit(True).alias("found"))
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("full_hash").isNull(), "UNVERIFIED").when(F.col("bad"), "DRIFT").otherwise("OK")
    return m.join(e, "entry_id", "left").select("entry_id", status.alias("status"))


@query(f"WITH {_CLASSES} SELECT entry_id, relative_path, size_bytes, classification, reason FROM classed WHERE starts_with(classification, 'REVIEW_') ORDER BY size_bytes DESC, entry_id")
def review_export(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the CSV and JSON lines exports."""
    return classified(spark, sf).where(F.col("classification").startswith("REVIEW_")).select("entry_id", "relative_path", "size_bytes", "classification", "reason").orderBy(F.desc("size_bytes"), "entry_id")


@query(f"WITH {ENTRIES}, a AS (SELECT 'b3/' AS pattern, NULL::BIGINT AS id, 'photos' AS label UNION ALL SELECT NULL, 42, 'answer' UNION ALL SELECT 'invoice', NULL, 'tax') SELECT e.entry_id, a.label FROM entries e JOIN a ON contains(e.relative_path, a.pattern) OR e.entry_id = a.id")
def known_content_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Assertions are written by a user, so there are few: they become one array of conditions, not a join."""
    rules = [("photos", F.col("relative_path").contains("b3/")), ("answer", F.col("entry_id") == 42), ("tax", F.col("relative_path").contains("invoice"))]
    return entries(spark, sf).select("entry_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).alias("label"))
