"""Inventory algebra: scopes, searches, facets, summaries and reports."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.paths import top_level, under


@dataclass(frozen=True)
class Scope:
    """A conjunction of facets; every field left empty is no condition. Predicates on plain columns reach the scan."""

    sources: tuple[str, ...] = ()
    subtree: str = ""
    suffixes: tuple[str, ...] = ()
    min_size: int | None = None
    max_size: int | None = None
    newer_than: float | None = None
    older_than: float | None = None
    hashes: tuple[str, ...] = ()
    only_unique: bool = False
    only_duplicates: bool = False

    def predicate(self) -> Column:
        out: Column = F.lit(True)
        for given, test in (
            (self.sources, lambda: F.col("source_root").isin(*self.sources)),
            (self.subtree, lambda: under("relative_path", self.subtree)),
            (self.suffixes, lambda: F.col("suffix").isin(*self.suffixes)),
            (self.min_size is not None, lambda: F.col("size_bytes") >= self.min_size),
            (self.max_size is not None, lambda: F.col("size_bytes") <= self.max_size),
            (self.newer_than is not None, lambda: F.col("modified_at") > self.newer_than),
            (self.older_than is not None, lambda: F.col("modified_at") < self.older_than),
            (self.hashes, lambda: F.col("full_hash").isin(*self.hashes)),
        ):
            if given:
                out = out & test()
        return out

    def apply(self, entries: DataFrame) -> DataFrame:
        kept = entries.where(self.predicate())
        if self.only_unique or self.only_duplicates:
            n = entries.where(F.col("full_hash").isNotNull()).groupBy("full_hash").agg(F.count("*").alias("_n"))
            n = n.where("_n = 1" if self.only_unique else "_n > 1").select("full_hash")
            kept = kept.join(n, "full_hash", "left_semi")
        return kept


#: Media types by suffix.
MIME = {".pdf": "application/pdf", ".zip": "application/zip", ".jpg": "image/jpeg", ".png": "image/png", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".py": "text/x-python", ".mp3": "audio/mpeg"}


def mime(suffix: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return table[F.col(suffix)]


def high_level_type(mime_: str, suffix: str) -> Column:
    m, t = F.coalesce(F.col(mime_), F.lit("")), F.ltrim(F.col(suffix), F.lit("."))
    return F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("text/") | t.isin("pdf", "docx", "xlsx", "pptx", "md", "csv"), "document").when(t.isin("zip", "tar", "gz", "bz2", "xz"), "archive").otherwise("other")


def sniff(content: str) -> Column:
    """Media type by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "application/pdf").when(head == "504B0304", "application/zip").when(head == "89504E47", "image/png").when(head.startswith("FFD8FF"), "image/jpeg")


def search(entries: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Case-insensitive prefix of path or name; wildcards in the prefix stand for themselves."""
    p = prefix.lower()
    return entries.where(F.lower("relative_path").startswith(p) | F.lower("name").startswith(p)).select("entry_id", "relative_path", "name").orderBy("relative_path", "entry_id").limit(limit)


def top(entries: DataFrame, by: Iterable[Column], limit: int) -> DataFrame:
    """Files and bytes by the given keys, most bytes first."""
    keys = list(by)
    g = entries.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    names = [c for c in g.columns if c not in ("files", "bytes")]
    return g.orderBy(F.desc("bytes"), *names).limit(limit)


def large_files(entries: DataFrame, threshold: int, limit: int = 500) -> DataFrame:
    return entries.where(F.col("size_bytes") >= threshold).select("entry_id", "relative_path", "size_bytes").orderBy(F.desc("size_bytes"), "entry_id").limit(limit)


def overview(entries: DataFrame) -> DataFrame:
    """One row of totals. Distinct contents are reduced to one row each before they are summed."""
    content = entries.where(F.col("full_hash").isNotNull()).groupBy("full_hash", "size_bytes").agg(F.count("*").alias("n"))
    c = content.agg(F.count("*").alias("contents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("unique_bytes"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    e = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("scan_status") == "ERROR").alias("errors"))
    return e.crossJoin(c)  # one row each


def errors(entries: DataFrame) -> DataFrame:
    kind = F.when(F.col("scan_status") == "ERROR", "SCAN").otherwise("ANALYSIS")
    return entries.where((F.col("scan_status") == "ERROR") | F.col("analysis_failed")).groupBy(kind.alias("stage"), "suffix").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "stage", "suffix")


def normalised(docs: DataFrame, most: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """(doc_id, text, characters, words, digest): white space collapsed, cut to so many characters."""
    t = F.substring(F.trim(F.regexp_replace(F.col(text_col), "[ \\t\\n\\r\\f\\x0B]+", " ")), 1, most)
    df = docs.select("doc_id", t.alias("text"))
    return df.select("doc_id", F.length("text").alias("characters"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).alias("words"), F.sha2("text", 256).alias("digest"))


def compare(current: DataFrame, baseline: DataFrame, tolerance: float = 0.5, floor: float = 1.0) -> DataFrame:
    """Benchmark verdicts: counts must be equal, times above the floor may grow by the tolerance."""
    c, b = current.select("suite", F.col("count").alias("c_count"), F.col("seconds").alias("c_seconds")), baseline.select("suite", F.col("count").alias("b_count"), F.col("seconds").alias("b_seconds"))
    verdict = F.when(F.col("b_count").isNull(), "NEW").when(F.col("c_count") != F.col("b_count"), "COUNT_DRIFT").when((F.col("b_seconds") >= floor) & (F.col("c_seconds") > F.col("b_seconds") * (1 + tolerance)), "SLOWER").otherwise("OK")
    return c.join(b, "suite", "left").select("suite", "c_count", "b_count", verdict.alias("verdict"))


def by_top_level(entries: DataFrame, limit: int = 200) -> DataFrame:
    return top(entries, [F.col("source_root"), top_level("relative_path").alias("top_level")], limit)
