"""Rule-based classification and the scores built on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.paths import ancestors, parent, segments, top_level
from inventra.operators.directories import DEPENDENCY_SPECS, LOCKFILES
from inventra.operators.duplicates import groups

#: Classes from most to least protective, suffixes of kinds of files, and weights.
PRIORITY = ("ERROR", "PROTECTED", "UNKNOWN", "KEEP", "KEEP_CANONICAL", "REVIEW_VERSION_FAMILY", "REVIEW_BACKUP", "REVIEW_LARGE", "REVIEW_PROBABLE", "REVIEW_SAFE")
INSTALLERS = (".exe", ".msi", ".dmg", ".pkg", ".deb", ".rpm", ".iso", ".img", ".appimage")
OFFICE = (".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
LEGACY_OFFICE = (".doc", ".xls", ".ppt", ".wpd", ".wks")
ENCRYPTED = (".gpg", ".kdbx", ".axx", ".enc")
DISK_IMAGE = (".dmg", ".iso", ".vmdk", ".vdi", ".img", ".qcow2")
DATABASE = (".sqlite", ".db", ".mdb", ".accdb")
EMAIL = (".pst", ".ost", ".mbox", ".eml")
IMAGE = (".jpg", ".jpeg", ".png", ".gif", ".tiff", ".bmp", ".webp")
DOCUMENT = (".txt", ".md", ".csv", ".pdf", ".docx", ".xlsx", ".pptx")
ARCHIVE = (".zip", ".tar", ".gz", ".exe", ".msi", ".dmg", ".iso")
VIDEO = (".mp4", ".mov", ".mkv", ".avi", ".m4v")
CODE = (".py", ".js", ".ts", ".c", ".cpp", ".h", ".rs", ".go", ".java", ".rb", ".sh")
DATA = (".csv", ".tsv", ".parquet", ".jsonl", ".sqlite", ".db", ".hdf5", ".npz")
GENERATED = ("__pycache__", "dist", "build", "target", "node_modules", ".venv", "venv")
REGENERABLE = ("PYTHON_BYTECODE_CACHE", "VIRTUAL_ENVIRONMENT", "NODE_MODULES")
YEAR = 365 * 24 * 3600.0
WEIGHTS = {"recoverable_bytes": 1.0, "redundancy_confidence": 2.0, "regeneration_confidence": 1.5, "loss_risk": -2.0, "preservation_risk": -3.0, "review_effort": -1.0}
PROTECTED_SUFFIXES = (".kdbx", ".gpg", ".pem", ".key")
PROTECTED_NAMES = ("id_rsa", "wallet.dat")
PROTECTED_DIRS = (".ssh", ".gnupg")


class Rule(NamedTuple):
    id: str
    condition: str
    classification: str
    confidence: float
    reason: str


RULES: tuple[Rule, ...] = (
    Rule("parser-or-filesystem-error", "failed", "ERROR", 1.0, "PARSER_OR_FILESYSTEM_ERROR"),
    Rule("protected-signal", "protected", "PROTECTED", 0.95, "PROTECTED_SIGNAL"),
    Rule("exact-duplicate-noncanonical", "duplicate", "REVIEW_SAFE", 1.0, "EXACT_SHA256_DUPLICATE"),
    Rule("office-temporary-lock", "office_lock", "REVIEW_SAFE", 0.9, "OFFICE_TEMPORARY_LOCK_FILE"),
    Rule("python-bytecode-cache", "bytecode", "REVIEW_SAFE", 0.9, "PYTHON_BYTECODE_CACHE"),
    Rule("virtualenv-regenerable", "environment", "REVIEW_PROBABLE", 0.75, "VIRTUAL_ENVIRONMENT"),
    Rule("node-modules-regenerable", "node_modules", "REVIEW_PROBABLE", 0.75, "NODE_MODULES"),
    Rule("old-duplicate-installer", "old_installer", "REVIEW_PROBABLE", 0.6, "INSTALLER_OR_IMAGE"),
)


def _root_before(segment: str) -> Column:
    """Path before the first /segment/, or null."""
    at = F.instr(F.concat(F.lit("/"), "relative_path"), f"/{segment}/")
    return F.when(at > 0, F.expr(f"substring(concat('/', relative_path), 2, greatest(instr(concat('/', relative_path), '/{segment}/') - 2, 0))"))


def facts(entries: DataFrame) -> DataFrame:
    """Everything the rules look at. Marker directories are joined by their path, never matched by prefix."""
    dup = groups(entries).select("full_hash", "size_bytes", F.col("members").alias("group_size"), "canonical_entry_id")
    e = entries.join(dup, ["full_hash", "size_bytes"], "left")
    marked = entries.select("source_root", parent("relative_path").alias("marker_dir"), F.col("name").isin(*DEPENDENCY_SPECS).alias("spec"), F.col("name").isin(*LOCKFILES).alias("lock")).where("spec OR lock")
    marked = marked.groupBy("source_root", "marker_dir").agg(F.bool_or("spec").alias("spec"), F.bool_or("lock").alias("lock"))
    specs = marked.where("spec").select("source_root", "marker_dir")
    e = e.withColumn("_venv", F.coalesce(*[_root_before(s) for s in (".venv", "venv", "env")])).withColumn("_node", _root_before("node_modules"))

    def has(df: DataFrame, key: str, dirs: DataFrame, name: str) -> DataFrame:
        own = dirs.select(F.col("source_root").alias("_s"), F.col("marker_dir").alias("_d"), F.lit(True).alias(name))
        return df.join(own, (F.col("source_root") == F.col("_s")) & (F.col(key) == F.col("_d")), "left").drop("_s", "_d")

    e = has(e, "_venv", specs, "venv_spec")
    e = has(e, "_node", marked.where("lock").select("source_root", "marker_dir"), "node_lock")
    inside = entries.select("entry_id", "source_root", F.explode(F.concat(F.array(F.lit("")), ancestors("relative_path"))).alias("marker_dir")).join(specs, ["source_root", "marker_dir"], "left_semi").select("entry_id").distinct().withColumn("in_project", F.lit(True))
    sibling = entries.select(F.col("source_root").alias("_s"), F.col("dir").alias("_p"), F.concat(F.lit("~$"), "name").alias("_n")).distinct().withColumn("has_sibling", F.lit(True))
    e = e.join(inside, "entry_id", "left").join(sibling, (F.col("source_root") == F.col("_s")) & (F.col("dir") == F.col("_p")) & (F.col("name") == F.col("_n")), "left").drop("_s", "_p", "_n")
    return e.fillna(False, ["venv_spec", "node_lock", "in_project", "has_sibling"])


def conditions(now: float) -> dict[str, Column]:
    duplicate = F.coalesce(F.col("group_size") >= 2, F.lit(False))
    return {
        "failed": (F.col("scan_status") == "ERROR") | F.col("analysis_failed"),
        "protected": F.col("suffix").isin(*PROTECTED_SUFFIXES) | F.col("name").isin(*PROTECTED_NAMES) | F.arrays_overlap(segments("relative_path"), F.array(*[F.lit(x) for x in PROTECTED_DIRS])),
        "duplicate": duplicate & (F.col("canonical_entry_id") != F.col("entry_id")),
        "office_lock": F.col("name").startswith("~$") & (F.col("size_bytes") <= 65536) & F.col("suffix").isin(*OFFICE) & F.col("has_sibling"),
        "bytecode": F.concat(F.lit("/"), "relative_path").contains("/__pycache__/") & (F.col("suffix") == ".pyc") & F.col("in_project"),
        "environment": F.col("venv_spec"),
        "node_modules": F.col("node_lock"),
        "old_installer": F.col("suffix").isin(*INSTALLERS) & duplicate & F.coalesce(F.lit(now) - F.col("modified_at") > YEAR, F.lit(False)),
    }


def classify(entries: DataFrame, now: float, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(entry_id, classification, confidence, reason, rules, ...): of all rules that match, the most protective class wins, then the higher confidence, then rule order.
    All rules are one array expression, so the whole engine is a projection over facts()."""
    test = conditions(now)
    hits = [F.when(F.coalesce(test[r.condition], F.lit(False)), F.struct(F.lit(PRIORITY.index(r.classification)).alias("rank"), F.lit(-r.confidence).alias("less"), F.lit(i).alias("i"), F.lit(r.id).alias("id"), F.lit(r.classification).alias("classification"), F.lit(r.reason).alias("reason"))) for i, r in enumerate(rules)]
    e = facts(entries).withColumn("_m", F.array_sort(F.array_compact(F.array(*hits)))).withColumn("_w", F.get("_m", F.lit(0)))
    return e.select(
        "entry_id", F.coalesce("_w.classification", F.lit("KEEP")).alias("classification"), F.coalesce(-F.col("_w.less"), F.lit(0.5)).alias("confidence"), F.coalesce("_w.reason", F.lit("NO_REMOVAL_SIGNAL")).alias("reason"),
        F.array_join(F.transform("_m", lambda m: m["id"]), ",").alias("rules"), "canonical_entry_id", "source_root", "relative_path", "name", "suffix", "size_bytes", "modified_at", "scan_status", "analysis_failed",
    )


def preservation(entries: DataFrame) -> DataFrame:
    """Preservation risks; later rules override the action; entries without a risk are left out."""
    s = F.col("suffix")
    broken = (F.col("scan_status") == "ERROR") | F.col("analysis_failed")
    flag = lambda c, level: F.when(c, level)
    action = F.when(s.isin(*EMAIL, *DATABASE), "KEEP_WITH_APPLICATION_CONTEXT").when(s.isin(*DISK_IMAGE), "NEEDS_FORMAT_IDENTIFICATION").when(s.isin(*ENCRYPTED), "NEEDS_KEY_DOCUMENTATION").when(s.isin(*LEGACY_OFFICE), "KEEP_AND_MIGRATE").when(broken, "NEEDS_INTEGRITY_REVIEW")
    none = F.lit("none")
    df = entries.select(
        "entry_id", F.coalesce(flag(s.isin(*LEGACY_OFFICE), "medium"), none).alias("format_risk"), F.coalesce(flag(broken, "high"), none).alias("integrity_risk"), F.coalesce(flag(s.isin(*DISK_IMAGE), "medium"), none).alias("context_loss_risk"),
        F.coalesce(flag(s.isin(*DISK_IMAGE), "medium"), none).alias("accessibility_risk"), F.coalesce(flag(s.isin(*ENCRYPTED), "high"), none).alias("encryption_risk"),
        F.coalesce(flag(s.isin(*EMAIL), "high"), flag(s.isin(*DATABASE, *LEGACY_OFFICE), "medium"), none).alias("application_dependency_risk"), action.alias("recommended_action"),
    )
    return df.where(F.col("recommended_action").isNotNull())


def priority(classified: DataFrame, risks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(entry_id, score, category): weighted components of a review's value."""
    w = weights or WEIGHTS
    df = classified.join(risks.select("entry_id", F.lit(True).alias("_risk")), "entry_id", "left")
    risk = F.coalesce("_risk", F.lit(False))
    exact = (F.col("classification") == "REVIEW_SAFE") & F.col("reason").startswith("EXACT")
    regenerable = F.col("reason").isin(*REGENERABLE)
    low = exact | regenerable
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = {"recoverable_bytes": F.log10(F.col("size_bytes") + 1), "redundancy_confidence": one(exact), "regeneration_confidence": one(regenerable), "loss_risk": F.when(low, 0.0).otherwise(0.6), "preservation_risk": one(risk), "review_effort": F.when(low, 0.2).otherwise(0.7)}
    total = sum((F.lit(w.get(k, 0.0)) * v for k, v in parts.items()), F.lit(0.0))
    category = F.when(risk, "PRESERVATION_FIRST").when(low, "QUICK_SAFE_WIN").when(F.col("classification").isin("REVIEW_BACKUP", "REVIEW_VERSION_FAMILY"), "CONTEXT_REQUIRED").when(F.col("size_bytes") >= 512 * 1024 * 1024, "HIGH_VALUE_REVIEW").otherwise("LOW_PRIORITY")
    return df.select("entry_id", F.round(total, 6).alias("score"), category.alias("category"))


def lifecycle(classified: DataFrame, now: float) -> DataFrame:
    c = F.col("classification")
    old = F.coalesce(F.lit(now) - F.col("modified_at"), F.lit(0.0)) > 2 * YEAR
    state = F.when(c == "PROTECTED", "PROTECTED").when(c.isin("ERROR", "UNKNOWN"), "DEFERRED").when(c.startswith("REVIEW_"), "MANUAL_REVIEW").when(old, "COLD_ARCHIVE").otherwise("ARCHIVE")
    advice = F.when(c == "PROTECTED", "PROTECT").when(c.isin("ERROR", "UNKNOWN"), "DEFER").when(c.startswith("REVIEW_"), "MOVE_TO_MANUAL_REVIEW").when(old, "DEMOTE_TO_COLD_ARCHIVE").otherwise("CONSOLIDATE_IN_ARCHIVE")
    return classified.select("entry_id", state.alias("state"), advice.alias("recommendation"))


def record_series(entries: DataFrame) -> DataFrame:
    """(entry_id, series, confidence): first rule that matches."""
    s, name, path = F.col("suffix"), F.lower("name"), F.lower("relative_path")
    any_of = lambda c, words: reduce(or_, (c.contains(w) for w in words))
    rules = (
        (F.arrays_overlap(segments("lower(relative_path)"), F.array(*[F.lit(g) for g in GENERATED])), "GENERATED_BUILD_ARTIFACTS", 0.85),
        (s.isin(".exe", ".msi", ".dmg", ".pkg", ".deb", ".rpm", ".iso", ".appimage"), "SOFTWARE_INSTALLERS", 0.9),
        (any_of(name, ("tax", "invoice", "receipt", "statement", "1099", "w2")), "FINANCIAL_AND_TAX", 0.7),
        (s.isin(*VIDEO), "PERSONAL_VIDEO", 0.6),
        (s.isin(".jpg", ".jpeg", ".png", ".gif", ".tiff", ".heic", ".bmp", ".webp"), "PERSONAL_PHOTOGRAPHS", 0.6),
        (s.isin(*CODE), "SOURCE_CODE", 0.75),
        (s.isin(*DATA), "DATASETS", 0.6),
        (any_of(path, ("backup", "time machine", "device backup")), "DEVICE_BACKUPS", 0.6),
        (any_of(path, ("/tmp/", "/temp/", "export", "download")), "TEMPORARY_EXPORTS", 0.5),
    )
    series, conf = None, None
    for test, n, c in rules:
        series = F.when(test, n) if series is None else series.when(test, n)
        conf = F.when(test, c) if conf is None else conf.when(test, c)
    return entries.select("entry_id", series.otherwise("UNKNOWN").alias("series"), conf.otherwise(0.3).alias("confidence"))


def retention(classified: DataFrame, series: DataFrame) -> DataFrame:
    """Per series: entries to preserve and to review; protected and failed entries are always preserved."""
    df = classified.join(series.select("entry_id", "series"), "entry_id")
    review = F.col("classification").startswith("REVIEW_")
    return df.groupBy("series").agg(F.count_if(~review).alias("preserve"), F.count_if(review).alias("review"))


def features(classified: DataFrame) -> DataFrame:
    """Eleven numeric features of each entry."""
    c, s = F.col("classification"), F.col("suffix")
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    approval = ~c.isin("KEEP", "KEEP_CANONICAL")
    cols = [flag(c == "REVIEW_SAFE"), flag(c == "REVIEW_PROBABLE"), flag(c == "PROTECTED"), flag(c == "ERROR"), flag(F.col("canonical_entry_id").isNotNull() & (c == "REVIEW_SAFE")), flag(approval), F.col("confidence"), F.round(F.log10(F.col("size_bytes") + 1), 6), flag(s.isin(*IMAGE)), flag(s.isin(*DOCUMENT)), flag(s.isin(*ARCHIVE))]
    return classified.select("entry_id", *[x.cast("double").alias(f"f{i}") for i, x in enumerate(cols)])


def predict(frame: DataFrame, weights: Sequence[float], bias: float, decided: DataFrame, limit: int = 5000) -> DataFrame:
    """Predictions of undecided entries with given weights; approval from 0.5 on."""
    z = sum((F.lit(float(w)) * F.col(f"f{i}") for i, w in enumerate(weights)), F.lit(float(bias)))
    p = F.round(1 / (1 + F.exp(-z)), 6)
    return frame.join(decided, "entry_id", "left_anti").select("entry_id", p.alias("probability"), F.when(p >= 0.5, "APPROVE_FOR_REVIEW").otherwise("KEEP").alias("suggestion")).orderBy("entry_id").limit(limit)


def train(frame: DataFrame, label: str, steps: int = 800, rate: float = 0.1, ridge: float = 0.01, most: int = 200_000) -> tuple[list[float], float, dict[str, float]]:
    """Logistic regression by gradient descent on standardised features (population deviation, 0 taken as 1), ridge on weights only.

    Examples are aggregated by their distinct feature vectors. Of more than `most` vectors, those of the smallest hashes are learned from, with all their examples,
    so what is gathered is bounded."""
    import numpy as np

    names = [c for c in frame.columns if c.startswith("f")]
    rows = frame.groupBy(*names, label).count().orderBy(F.xxhash64(*names, label), *names, label).limit(most).collect()
    x = np.array([[r[n] for n in names] for r in rows], float)
    y = np.array([r[label] for r in rows], float)
    n = np.array([r["count"] for r in rows], float)
    mean = (n[:, None] * x).sum(0) / n.sum()
    std = np.sqrt((n[:, None] * (x - mean) ** 2).sum(0) / n.sum())
    std[std == 0] = 1.0
    s = (x - mean) / std
    w, b = np.zeros(len(names)), 0.0
    for _ in range(steps):
        e = n * (1 / (1 + np.exp(-(s @ w + b))) - y) / n.sum()
        w, b = w - rate * (s.T @ e + ridge * w), b - rate * e.sum()
    raw = w / std
    predicted = (1 / (1 + np.exp(-(s @ w + b))) >= 0.5).astype(float)
    return raw.tolist(), float(b - (raw * mean).sum()), {"accuracy": float((n * (predicted == y)).sum() / n.sum()), "examples": float(n.sum())}


def top_level_review(classified: DataFrame) -> DataFrame:
    """Review queue by top-level directory and class."""
    return classified.where(F.col("classification").startswith("REVIEW_")).groupBy(top_level("relative_path").alias("top_level"), "classification").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
