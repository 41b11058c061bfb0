"""Directory trees: recursive summaries, containment, backup lineage, projects.

Prefix joins are avoided throughout: a path is exploded into its ancestors, and everything else is joins and aggregates on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inventra.functions.paths import ancestors, parent, segments
from inventra.operators.graph import staged

#: Files that mark a project, by kind; and directories that hold generated files or environments.
DEPENDENCY_SPECS = ("pyproject.toml", "requirements.txt", "requirements-dev.txt", "environment.yml", "environment.yaml", "Pipfile", "package.json", "Cargo.toml", "go.mod")
LOCKFILES = ("Pipfile.lock", "poetry.lock", "uv.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum")
OTHER_MARKERS = (".git", "pom.xml", "build.gradle", "Makefile", "CMakeLists.txt", "Dockerfile", "README", "README.md")
MARKERS = DEPENDENCY_SPECS + LOCKFILES + OTHER_MARKERS
ENVIRONMENT_DIRS = ("node_modules", ".venv", "venv", "env")
GENERATED_DIRS = ("__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".ipynb_checkpoints", "dist", "build", "target", "coverage", "htmlcov")


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def summaries(entries: DataFrame) -> DataFrame:
    """Of every directory of a source, recursively: files, bytes, distinct contents, duplicates, newest and oldest, and a digest of its contents: the
    exclusive or of the first two times 60 bits of its distinct hashes, which has no order and combines on the map side."""
    e = entries.select("source_root", F.explode(ancestors("relative_path")).alias("dir"), "size_bytes", "modified_at", "full_hash")
    each = e.groupBy("source_root", "dir", "full_hash").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.min("modified_at").alias("oldest"), F.max("modified_at").alias("newest"))
    bits = lambda at: F.bit_xor(F.conv(F.substring("full_hash", at, 15), 16, 10).cast("long"))
    out = each.groupBy("source_root", "dir").agg(
        F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.count("full_hash").alias("unique_hashes"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        F.coalesce(bits(1), F.lit(0)).alias("digest_1"), F.coalesce(bits(16), F.lit(0)).alias("digest_2"),
    )
    return out.withColumn("duplicates", F.col("files") - F.col("unique_hashes"))


def extension_map(entries: DataFrame) -> DataFrame:
    """(source_root, dir, suffix, files): the extension distribution of each directory as rows."""
    e = entries.select("source_root", F.explode(ancestors("relative_path")).alias("dir"), "suffix")
    return e.groupBy("source_root", "dir", "suffix").agg(F.count("*").alias("files"))


def equal_sets(sets: DataFrame) -> DataFrame:
    """(g, size, rep) of distinct (g, i): rep is the smallest group with the same items, known by their number and two order-free digests, which
    combine on the map side however large a set is."""
    own = sets.groupBy("g").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("i")).alias("_x"), F.bit_xor(F.xxhash64(F.lit("second"), "i")).alias("_y"))
    reps = own.groupBy("size", "_x", "_y").agg(F.min("g").alias("rep"))
    return own.join(reps, ["size", "_x", "_y"]).select("g", "size", "rep")


def set_overlap(members: DataFrame, group: str, item: str, least_items: int = 1, containment: float = 0.9) -> DataFrame:
    """(a, b, shared, size_a, size_b, containment, jaccard) of all groups that reach the containment of the smaller in the larger; exact, without a
    cap on how many groups hold an item.

    Items are ordered by the number of their holders. A set that has the share t of its n items in another one has one of them among its
    n - ceil(t n) + 1 rarest; those alone are met with the items of larger sets. The bound is taken from a histogram of holders for each
    group, so no group is sorted. Equal sets are compared as one; a copy is linked to the first of them only."""
    sets = staged(members.select(F.col(group).alias("g"), F.col(item).alias("i")).where(F.col("i").isNotNull()).distinct())
    sizes = staged(equal_sets(sets).where(F.col("size") >= least_items))
    reps = sizes.where("g = rep").select("g", "size")
    own = staged(sets.join(reps, "g"))
    holders = own.groupBy("i").agg(F.count("*").alias("holders")).where("holders > 1")
    own = staged(own.join(holders, "i"))
    so_far = W.partitionBy("g").orderBy("holders").rowsBetween(W.unboundedPreceding, -1)
    alone = own.groupBy("g").agg(F.count("*").alias("_met"))
    hist = own.groupBy("g", "size", "holders").agg(F.count("*").alias("_n")).join(alone, "g")
    # items that no other group holds come first in the order
    hist = hist.withColumn("_before", F.col("size") - F.col("_met") + F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
    cut = hist.where(F.col("_before") < F.col("size") - F.ceil(F.col("size") * containment - 1e-9) + 1).groupBy("g").agg(F.max("holders").alias("_most"))
    small = own.join(cut, "g").where("holders <= _most").select("i", F.col("g").alias("s"), F.col("size").alias("_ns"))
    large = own.select("i", F.col("g").alias("l"), F.col("size").alias("_nl"))
    pairs = small.join(large, "i").where((F.col("_ns") < F.col("_nl")) | (F.col("_ns") == F.col("_nl")) & (F.col("s") != F.col("l")))
    pairs = pairs.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()
    shared = pairs.join(own.select(F.col("g").alias("a"), "i"), "a").join(own.select(F.col("g").alias("b"), "i"), ["b", "i"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(reps.select(F.col("g").alias("a"), F.col("size").alias("size_a")), "a").join(reps.select(F.col("g").alias("b"), F.col("size").alias("size_b")), "b").select("a", "b", "shared", "size_a", "size_b")
    copies = sizes.where("g <> rep").select(F.col("rep").alias("a"), F.col("g").alias("b"), F.col("size").alias("shared"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    out = out.unionByName(copies).withColumn("containment", F.col("shared") / F.least("size_a", "size_b")).withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    return out.where(F.col("containment") >= containment)


def overlap_edges(members: DataFrame, group: str = "dir", item: str = "hash", **kw) -> DataFrame:
    """Containment edges: the smaller set is the source."""
    df = set_overlap(members, group, item, **kw)
    first = F.col("size_a") <= F.col("size_b")
    return df.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"), F.lit("MOSTLY_CONTAINED_IN").alias("type"), "shared", F.round("containment", 6).alias("confidence"))


def archive_matches(members: DataFrame, directories: DataFrame, containment: float = 0.9) -> DataFrame:
    """(archive, dir, containment, type): members of an archive (archive, hash) held by a directory (dir, hash)."""
    inside = members.distinct()
    sizes = inside.groupBy("archive").agg(F.count("*").alias("size"))
    shared = inside.join(directories.distinct(), "hash").groupBy("archive", "dir").agg(F.count("*").alias("shared"))
    df = shared.join(sizes, "archive").withColumn("containment", F.col("shared") / F.col("size")).where(F.col("containment") >= containment)
    kind = F.when(F.col("containment") == 1.0, "ARCHIVE_OF_DIRECTORY").otherwise("ARCHIVE_PARTIAL_SNAPSHOT_OF")
    return df.select("archive", "dir", "shared", F.round("containment", 6).alias("containment"), kind.alias("type"), F.when(F.col("containment") == 1.0, 2).otherwise(4).alias("tier"))


def projects(entries: DataFrame) -> DataFrame:
    """Directories with project markers (a lone README is none): markers, kind, and what makes them reproducible."""
    own = entries.where(F.col("name").isin(*MARKERS)).select("source_root", parent("relative_path").alias("dir"), "name")
    g = own.groupBy("source_root", "dir").agg(F.array_sort(F.collect_set("name")).alias("markers"))
    g = g.where(F.size(F.array_except("markers", _names(("README", "README.md")))) > 0)
    has = lambda *names: F.arrays_overlap("markers", _names(names))
    kind = F.when(has("pyproject.toml", "requirements.txt", "Pipfile", "environment.yml"), "python").when(has("package.json"), "javascript").when(has("Cargo.toml"), "rust").when(has("go.mod"), "go").when(has("pom.xml", "build.gradle"), "java").otherwise("source")
    return g.select("source_root", "dir", F.array_join("markers", ",").alias("markers"), kind.alias("kind"), has(*DEPENDENCY_SPECS).alias("has_dependency_spec"), has(*LOCKFILES).alias("has_lockfile"), has(".git").alias("has_git"), has("Dockerfile").alias("has_dockerfile"))


def storage_breakdown(entries: DataFrame) -> DataFrame:
    """Bytes of each source by use: environment before generated before source."""
    s = segments("relative_path")
    use = F.when(F.arrays_overlap(s, _names(ENVIRONMENT_DIRS)), "environment").when(F.arrays_overlap(s, _names(GENERATED_DIRS)), "generated").otherwise("source")
    return entries.groupBy("source_root", use.alias("use")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def treemap(entries: DataFrame, classes: DataFrame, prefix_depth: int = 1) -> DataFrame:
    """Of each directory of the depth: recursive bytes, duplicate bytes, reviewable bytes, and bytes that are either, counted once."""
    dup = entries.where(F.col("full_hash").isNotNull()).groupBy("full_hash").agg(F.count("*").alias("n"), F.min("entry_id").alias("keeper"))
    e = entries.join(dup, "full_hash", "left").join(classes.select("entry_id", "classification"), "entry_id", "left")
    redundant = F.coalesce((F.col("n") > 1) & (F.col("entry_id") != F.col("keeper")), F.lit(False))
    review = F.coalesce(F.col("classification").startswith("REVIEW_"), F.lit(False))
    node = F.element_at(ancestors("relative_path"), prefix_depth)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("size_bytes"))), F.lit(0))
    return e.groupBy(node.alias("node")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), part(redundant).alias("duplicate_bytes"), part(review).alias("reviewable_bytes"), part(redundant | review).alias("reclaimable_bytes"))


def children(entries: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """One level below a directory: sub-directories with their file counts first, then files by size; limit + 1 rows tell of truncation."""
    depth = len([x for x in node.split("/") if x])
    below = entries.where(F.col("relative_path").startswith(node.rstrip("/") + "/")) if node else entries
    parts = F.split("relative_path", "/")
    is_dir = F.size(parts) > depth + 1
    child = F.element_at(parts, depth + 1)
    g = below.groupBy(child.alias("child"), is_dir.alias("is_dir")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return g.orderBy(F.desc("is_dir"), F.desc("bytes"), "child").limit(limit + 1)


def parents(entries: DataFrame) -> DataFrame:
    """(entry_id, parent_dir, siblings): each entry with the number of entries that share its parent."""
    e = entries.select("entry_id", "source_root", parent("relative_path").alias("parent_dir"))
    n = e.groupBy("source_root", "parent_dir").agg(F.count("*").alias("siblings"))
    return e.join(n, ["source_root", "parent_dir"]).select("entry_id", "parent_dir", "siblings")
