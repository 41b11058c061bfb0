"""Edges, components, neighbourhoods and bounded projections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application that driver and executors share, below spark.checkpoint.dir. Only a session in one process may leave that unset;
    elsewhere a temporary folder would be another one on each machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inventra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inventra/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str = "step") -> DataFrame:
    """df written once as Parquet to the shared folder and read again: lineage ends here, a lost executor costs no
    recomputation, and every later use sees the same rows."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write go as soon as it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_staged(spark: SparkSession) -> None:
    """Removes every staged table of this application; call it when no result that reads them is still needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of undirected edges (a, b); the root is the smallest node of the component.

    Contraction: every node hooks to the smallest of itself and its neighbours, hooks are followed to their end by doubling, the ends
    of the edges are renamed, and what still joins different roots goes into the next round. Minima and equal-key joins only."""
    edges = staged(edges.select("a", "b").where("a <> b"))
    named: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
        moved = True
        while moved:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = staged(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            hook, moved = step.select("node", "root"), not step.where("moved").isEmpty()
        if named is None:
            named = hook
        else:
            above = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            named = staged(named.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        ra, rb = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = staged(edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return named if named is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Which typed edges each kind of projection shows, and the kinds that show active content relationships only.
PROJECTIONS = {
    "universe": "true",
    "duplicate": "relationship_type IN ('EXACT_DUPLICATE_MEMBER', 'DUPLICATE_CONTENT')",
    "content": "source_type = 'CONTENT_OBJECT' OR target_type = 'CONTENT_OBJECT'",
    "backup-lineage": "relationship_type LIKE '%BACKUP%'",
    "project": "relationship_type LIKE '%PROJECT%'",
    "document-family": "relationship_type LIKE '%DOCUMENT%'",
    "image-cluster": "relationship_type LIKE '%IMAGE%'",
    "selected-directory": "true",
    "content-equivalence": "evidence_tier IN ('TIER_1_EXACT', 'TIER_2_NORMALIZED_EXACT', 'TIER_3_STRONG_EQUIVALENCE')",
    "partial-overlap": "evidence_tier = 'TIER_4_PARTIAL_OVERLAP'",
    "derivation-family": "relationship_type IN ('LIKELY_EXPORT', 'LIKELY_RENDERING', 'LIKELY_DERIVED', 'LIKELY_VERSION', 'LIKELY_COPY')",
}
ACTIVE_ONLY = ("content-equivalence", "partial-overlap", "derivation-family")


def typed_projections(edges: DataFrame, kinds: tuple[str, ...] = tuple(PROJECTIONS), floor: float = 0.0, max_edges: int = 1000) -> DataFrame:
    """(kind, rank, and the edge) of the most confident typed edges of each kind, ties by id and ends. All kinds come from one pass; every task keeps max_edges of a kind at most."""
    from pyspark.sql import Window as W

    shown = [F.when(F.expr(f"({PROJECTIONS[k]})" + (" AND status = 'ACTIVE'" if k in ACTIVE_ONLY else "")), F.lit(k)) for k in kinds]
    each = edges.where(F.col("confidence") >= floor).select(F.explode(F.array_compact(F.array(*shown))).alias("kind"), "*")
    return each.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("confidence"), "id", "source_id", "target_id"))).where(F.col("rank") <= max_edges)


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed edges whose two ends are among the nodes (type, id); an edge to a retired end is history."""
    known = nodes.select("type", "id").distinct()
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id")), [f"{end}_type", f"{end}_id"], "left_semi")
    return edges


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Typed edges after new ones are put in: of equal ends, type and version the new one's confidence counts and the old id stays. Of several new ones
    with one key the greatest id counts, then the greatest confidence. Confidences outside 0 to 1 are an error."""
    key = ["source_type", "source_id", "target_type", "target_id", "relationship_type", "version"]
    valid = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.raise_error(F.lit("confidence must be between 0 and 1")))
    both = edges.select(*key, "id", "confidence", F.lit(0).alias("_new")).unionByName(new.select(*key, "id", valid.alias("confidence"), F.lit(1).alias("_new")))
    order = F.struct("_new", "id")
    return both.groupBy(*key).agg(F.min_by("id", order).alias("id"), F.max_by("confidence", F.struct("_new", "id", "confidence")).alias("confidence"))


def labels(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(type, id, label) of nodes (type, id): the name, or type and id where there is none."""
    return nodes.select("type", "id").distinct().join(names.select("type", "id", "name"), ["type", "id"], "left").select("type", "id", F.coalesce("name", F.concat_ws(" ", "type", "id")).alias("label"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, type, confidence) once each, smaller end first, with the best confidence."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "type", "confidence")
    return e.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbour, type, confidence) of the given nodes, in both directions."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "type", "confidence").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "type", "confidence"))
    return both.join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 2, floor: float = 0.0) -> DataFrame:
    """(node, depth): breadth first from the seeds over edges of at least the confidence; depth is bounded, so the plan is."""
    strong = edges.where(F.col("confidence") >= floor)
    both = strong.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(strong.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        new = both.join(frontier.select(F.col("node").alias("x")), "x", "left_semi").select(F.col("y").alias("node")).distinct()
        frontier = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def projection(edges: DataFrame, types: tuple[str, ...] = (), floor: float = 0.0, max_edges: int = 1000) -> DataFrame:
    """The most confident edges of the types, ties by their ends."""
    e = edges.where(F.col("confidence") >= floor)
    if types:
        e = e.where(F.col("type").isin(*types))
    return e.orderBy(F.desc("confidence"), "src", "dst", "type").limit(max_edges)


def capped_nodes(edges: DataFrame, max_edges: int = 1000, max_nodes: int = 200) -> DataFrame:
    """(node, admitted_at): nodes in the order in which edges by confidence bring them in, up to max_nodes. Admission depends on all
    earlier edges, so it runs over at most max_edges rows on the driver."""
    spark = edges.sparkSession
    admitted: dict[int, int] = {}
    for r in projection(edges, max_edges=max_edges).collect():
        new = [n for n in (r["src"], r["dst"]) if n not in admitted]
        if len(admitted) + len(new) > max_nodes:
            continue
        for n in new:
            admitted[n] = len(admitted)
    return spark.createDataFrame(list(admitted.items()), "node long, admitted_at long")


def circle(nodes: DataFrame, width: float = 800.0, height: float = 600.0) -> DataFrame:
    """(node, x, y): nodes on a circle in order; of at most as many nodes as a projection holds."""
    from pyspark.sql import Window as W

    n = nodes.select("node").distinct().withColumn("i", F.row_number().over(W.orderBy("node")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    angle = F.lit(2.0) * F.pi() * F.col("i") / F.col("n")
    radius = min(width, height) * 0.4
    return n.select("node", F.round(F.lit(width / 2) + F.lit(radius) * F.cos(angle), 3).alias("x"), F.round(F.lit(height / 2) + F.lit(radius) * F.sin(angle), 3).alias("y"))


def lineage(parents: DataFrame, most: int = 16) -> DataFrame:
    """(node, ancestor, depth) of a tree of (node, parent), at most so many levels up.

    Only nodes that have children are walked, level by level until none is left; then all nodes meet what lies above their parents in
    one join. Each path to an ancestor is a row, and no count of rows ends the walk."""
    links = parents.where("parent IS NOT NULL").select("node", "parent")
    level = staged(links.select("parent", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    inner = staged(links.join(level.select(F.col("parent").alias("node")), "node", "left_semi").select(F.col("node").alias("ancestor"), F.col("parent").alias("next")))
    above = level
    for depth in range(2, most + 1):
        level = staged(level.join(inner, "ancestor").select("parent", F.col("next").alias("ancestor"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        above = above.unionByName(level)
    return links.join(above, "parent").select("node", "ancestor", "depth")
