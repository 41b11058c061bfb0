"""Version families by file name, derived formats, and equivalence of normalised content."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that mark a version, and suffixes of editable files and of exports.
_TOKEN = "(?:final|draft|revised|copy|backup|v\\d+|\\(\\d+\\))"
EDITABLE = (".docx", ".pptx", ".xlsx", ".md", ".odt", ".ipynb", ".tex")
EXPORT = (".pdf", ".html", ".htm")


def tokens(name: str) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit(f"({_TOKEN})"), F.lit(1))


def stem(name: str) -> Column:
    """Name without suffix and version words."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, "[.][^.]*$", "")), f"(?:[_ -]*{_TOKEN})+", "")
    return F.regexp_replace(bare, "^[ ._-]+|[ ._-]+$", "")


def _named(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("full_hash").isNotNull()).withColumn("stem", stem("name"))


def families(entries: DataFrame) -> DataFrame:
    """(stem, suffix, contents, files, first_id) of stems with several contents."""
    g = _named(entries).groupBy("stem", "suffix").agg(F.count_distinct("full_hash").alias("contents"), F.count("*").alias("files"), F.min("entry_id").alias("first_id"))
    return g.where("contents > 1")


def pairs(entries: DataFrame, pairwise: int = 16) -> DataFrame:
    """Different contents of one stem, each content once: all pairs of up to `pairwise` contents, else each with the first, so links grow with contents."""
    f = _named(entries).groupBy("stem", "full_hash").agg(F.min("entry_id").alias("id"))
    linked = equivalences(f.select(F.col("stem").alias("h"), "id"), pairwise, keep=True)
    return linked.select(F.col("h").alias("stem"), "a", "b", F.lit("LIKELY_VERSION_OF").alias("type"), F.lit(1.0).alias("confidence"))


def name_similarity(entries: DataFrame, pairwise: int = 16) -> DataFrame:
    """(a, b, ratio) of different names of one stem, each name once under its smallest id; pairs as in pairs()."""
    f = entries.groupBy(stem("name").alias("h"), "name").agg(F.min("entry_id").alias("id"))
    linked = equivalences(f.select("h", "id"), pairwise, keep=True)
    names = f.select("id", "name")
    both = linked.join(names.select(F.col("id").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    return both.select("a", "b", ratio("na", "nb").alias("ratio"))


def derivations(entries: DataFrame, close_seconds: float = 3600.0) -> DataFrame:
    """An editable file and an export of the same folder and stem."""
    e = _named(entries)
    key = ["source_root", "dir", "stem"]
    side = lambda s, p: e.where(F.col("suffix").isin(*s)).select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("entry_id", "full_hash", "modified_at")])
    j = side(EDITABLE, "a").join(side(EXPORT, "b"), key).where("a_full_hash <> b_full_hash")
    near = F.abs(F.col("a_modified_at") - F.col("b_modified_at")) <= close_seconds
    return j.select(F.col("a_entry_id").alias("source"), F.col("b_entry_id").alias("target"), F.when(near, 0.85).otherwise(0.75).alias("confidence"), F.lit("LIKELY_EXPORT").alias("type"))


def equivalences(hashes: DataFrame, pairwise: int = 16, keep: bool = False) -> DataFrame:
    """(a, b) of members (h, id) with one value: all pairs of small groups, a star of large ones, so links grow with members. keep: with h."""
    g = hashes.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    small = hashes.join(g.where(F.col("n") <= pairwise).select("h"), "h")
    near = small.select("h", F.col("id").alias("a")).join(small.select("h", F.col("id").alias("b")), "h").where("a < b").select("h", "a", "b")
    star = hashes.join(g.where(F.col("n") > pairwise).select("h", F.col("first").alias("a")), "h").where("id <> a").select("h", "a", F.col("id").alias("b"))
    both = near.unionByName(star)
    return both if keep else both.drop("h")


def ratio(a: str, b: str) -> Column:
    """Similarity of two names without their version words; matching blocks have no built-in form."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, T.DoubleType())(stem(a), stem(b))
