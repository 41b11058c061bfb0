"""Queries over the inventory: scopes, searches, charts, reports, texts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventra.functions import formats, paths
from inventra.operators import inventory as op
from inventra.plans.registry import query
from inventra.sources.bindings import ENTRIES, NOW, entries, table
from inventra.sources.files import folded
from inventra.streaming.sessions import session_counts


def _sql(rest: str) -> str:
    """The entries as a WITH clause before the rest, which may go on with further ones after a comma."""
    return f"WITH {ENTRIES}{rest if rest.startswith(',') else ' ' + rest}"


@query(_sql("SELECT * FROM entries"))
def inventory_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf)


@query(_sql("SELECT entry_id, relative_path FROM entries WHERE source_root IN ('src1', 'src2', 'src3') AND starts_with(relative_path, 'en/') AND suffix IN ('.docx', '.md', '.pdf') AND size_bytes BETWEEN 300 AND 50000 AND modified_at > 1410000000"))
def scoped_entries(spark: SparkSession, sf: str) -> DataFrame:
    scope = op.Scope(sources=("src1", "src2", "src3"), subtree="en", suffixes=(".docx", ".md", ".pdf"), min_size=300, max_size=50000, newer_than=1410000000.0)
    return scope.apply(entries(spark, sf)).select("entry_id", "relative_path")


@query(_sql("SELECT entry_id, full_hash FROM entries WHERE full_hash IN (SELECT full_hash FROM entries GROUP BY 1 HAVING count(*) > 1)"))
def scope_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return op.Scope(only_duplicates=True).apply(entries(spark, sf)).select("entry_id", "full_hash")


@query(_sql("SELECT entry_id, full_hash FROM entries WHERE size_bytes > 1000 AND full_hash IN (SELECT full_hash FROM entries GROUP BY 1 HAVING count(*) = 1)"))
def scope_unique(spark: SparkSession, sf: str) -> DataFrame:
    return op.Scope(only_unique=True, min_size=1001).apply(entries(spark, sf)).select("entry_id", "full_hash")


@query(_sql("SELECT entry_id, relative_path, size_bytes FROM entries WHERE starts_with(relative_path, 'de/b4/')"))
def subtree_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).where(paths.under("relative_path", "de/b4")).select("entry_id", "relative_path", "size_bytes")


@query(_sql("SELECT entry_id, relative_path, name FROM entries WHERE starts_with(lower(relative_path), 'doc_1') OR starts_with(lower(name), 'doc_1') ORDER BY relative_path, entry_id LIMIT 50"))
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return op.search(entries(spark, sf), "DOC_1")


@query(_sql("SELECT entry_id, split_part(relative_path, '/', 1) AS top_level, dir AS parent_dir, len(string_split(relative_path, '/'))::INT AS depth FROM entries"))
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", paths.top_level("relative_path").alias("top_level"), paths.parent("relative_path").alias("parent_dir"), F.size(F.split("relative_path", "/")).alias("depth"))


@query(_sql("SELECT entry_id, CASE WHEN relative_path <> '' THEN '<source>/' || relative_path ELSE '<source>' END AS redacted, '/mnt/' || relative_path AS shown FROM entries"))
def redacted_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).withColumn("absolute", F.concat(F.lit("/mnt/"), "relative_path"))
    return e.select("entry_id", paths.shown("absolute", "relative_path", True).alias("redacted"), paths.shown("absolute", "relative_path", False).alias("shown"))


@query(_sql("SELECT entry_id, relative_path, size_bytes FROM entries WHERE size_bytes >= 4000 ORDER BY size_bytes DESC, entry_id LIMIT 500"))
def large_files(spark: SparkSession, sf: str) -> DataFrame:
    return op.large_files(entries(spark, sf), 4000)


@query(_sql("SELECT e.entry_id, relative_path, full_hash, quality, toxic FROM entries e LEFT JOIN labels ON doc_id = entry_id WHERE entry_id IN (3, 77, 512)"))
def entry_detail(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), "quality", "toxic")
    return entries(spark, sf).where(F.col("entry_id").isin(3, 77, 512)).join(labels, "entry_id", "left").select("entry_id", "relative_path", "full_hash", "quality", "toxic")


@query(_sql("SELECT DISTINCT source_root, split_part(relative_path, '/', 1) AS top_level FROM entries ORDER BY 1, 2 LIMIT 500"))
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("source_root", paths.top_level("relative_path").alias("top_level")).distinct().orderBy("source_root", "top_level").limit(500)


@query("SELECT doc_id, text[1:500] AS text FROM documents")
def text_previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INT AS keys FROM events")
def json_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Columns out of JSON payloads."""
    keys = F.json_object_keys("props")
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", m[keys[0]].alias("first_value"), F.size(keys).alias("keys"))


@query(_sql("SELECT suffix, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries GROUP BY 1 ORDER BY bytes DESC, suffix LIMIT 20"))
def file_types_chart(spark: SparkSession, sf: str) -> DataFrame:
    return op.top(entries(spark, sf), [F.col("suffix")], 20)


@query(_sql("SELECT split_part(relative_path, '/', 1) AS top_level, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries GROUP BY 1 ORDER BY bytes DESC, 1 LIMIT 20"))
def top_level_chart(spark: SparkSession, sf: str) -> DataFrame:
    return op.top(entries(spark, sf), [paths.top_level("relative_path").alias("top_level")], 20)


@query(_sql("SELECT source_root, split_part(relative_path, '/', 1) AS top_level, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM entries GROUP BY 1, 2 ORDER BY bytes DESC, 1, 2 LIMIT 200"))
def inventory_report(spark: SparkSession, sf: str) -> DataFrame:
    return op.by_top_level(entries(spark, sf))


@query(_sql(", c AS (SELECT full_hash, size_bytes, count(*) AS n FROM entries WHERE full_hash IS NOT NULL GROUP BY 1, 2) SELECT (SELECT count(*) FROM entries) AS entries, (SELECT sum(size_bytes)::BIGINT FROM entries) AS bytes, (SELECT count(*) FROM entries WHERE scan_status = 'ERROR') AS errors, count(*) AS contents, sum(size_bytes)::BIGINT AS unique_bytes, count(*) FILTER (n > 1) AS duplicate_groups FROM c"))
def overview_totals(spark: SparkSession, sf: str) -> DataFrame:
    return op.overview(entries(spark, sf))


@query(_sql("SELECT CASE WHEN scan_status = 'ERROR' THEN 'SCAN' ELSE 'ANALYSIS' END AS stage, suffix, count(*) AS errors FROM entries WHERE scan_status = 'ERROR' OR analysis_failed GROUP BY 1, 2 ORDER BY errors DESC, 1, 2"))
def errors_report(spark: SparkSession, sf: str) -> DataFrame:
    return op.errors(entries(spark, sf))


@query("SELECT o_orderpriority AS job_type, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY 1")
def stage_medians(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("job_type")).agg(F.percentile("o_totalprice", 0.5).alias("median"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS runs, max(o_orderdate) AS latest FROM orders GROUP BY 1, 2")
def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("runs"), F.max("o_orderdate").alias("latest"))


_MIME = "CASE suffix " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.MIME.items()) + " END"


@query(_sql(f", m AS (SELECT entry_id, suffix, {_MIME} AS mime FROM entries) SELECT entry_id, mime, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'text/%' OR suffix IN ('.pdf', '.docx', '.xlsx', '.pptx', '.md', '.csv') THEN 'document' WHEN suffix IN ('.zip', '.tar', '.gz', '.bz2', '.xz') THEN 'archive' ELSE 'other' END AS kind FROM m"))
def file_type_detection(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).withColumn("mime", op.mime("suffix")).select("entry_id", "mime", op.high_level_type("mime", "suffix").alias("kind"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))[1:2000000] AS t FROM documents) SELECT doc_id, length(t)::INT AS characters, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS words, sha256(t) AS digest FROM n""")
def normalised_texts(spark: SparkSession, sf: str) -> DataFrame:
    return op.normalised(table(spark, sf, "documents"))


@query()
def folded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Digest and length of the whole text after NFKC and case folding by a vectorised function; SQL has neither."""
    fold = F.pandas_udf(folded, T.StringType())
    t = table(spark, sf, "documents").select("doc_id", fold("text").alias("t"))
    return t.select("doc_id", F.length("t").alias("characters"), F.sha2("t", 256).alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """What an analysis still has to do."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query(_sql("SELECT split_part(relative_path, '/', 1) AS top_level, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, max(modified_at) AS newest FROM entries GROUP BY 1"))
def aggregate_directories(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).groupBy(paths.top_level("relative_path").alias("top_level")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("modified_at").alias("newest"))


@query("""WITH b AS (SELECT p_brand AS suite, count(*) AS n, round(sum(p_retailprice) / 1000, 4) AS s FROM part GROUP BY 1), c AS (SELECT p_brand AS suite, count(*) - max(CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END) AS n, round(sum(p_retailprice) / 1000 * (1 + max(p_size) % 3), 4) AS s FROM part GROUP BY 1)
SELECT suite, c.n AS c_count, b.n AS b_count, CASE WHEN c.n <> b.n THEN 'COUNT_DRIFT' WHEN b.s >= 1 AND c.s > b.s * 1.5 THEN 'SLOWER' ELSE 'OK' END AS verdict FROM c LEFT JOIN b USING (suite)""")
def benchmark_comparison(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    base = p.groupBy(F.col("p_brand").alias("suite")).agg(F.count("*").alias("count"), F.round(F.sum("p_retailprice") / 1000, 4).alias("seconds"))
    drift = F.max(F.when(F.col("p_brand") == "Brand#11", 1).otherwise(0))
    now = p.groupBy(F.col("p_brand").alias("suite")).agg((F.count("*") - drift).alias("count"), F.round(F.sum("p_retailprice") / 1000 * (1 + F.max("p_size") % 3), 4).alias("seconds"))
    return op.compare(now, base)


@query("""SELECT o_orderkey, o_totalprice / 60 AS rate, CASE WHEN o_totalprice > 0 THEN greatest(500000 - o_totalprice, 0) / (o_totalprice / 60) END AS eta,
 CASE WHEN o_custkey * 37 >= 3600 THEN (o_custkey * 37 // 3600) || ':' || lpad((o_custkey * 37 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((o_custkey * 37 % 60)::VARCHAR, 2, '0') ELSE lpad((o_custkey * 37 // 60)::VARCHAR, 2, '0') || ':' || lpad((o_custkey * 37 % 60)::VARCHAR, 2, '0') END AS took FROM orders""")
def progress_scalars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("seconds", F.col("o_custkey") * 37)
    rate = F.col("o_totalprice") / 60
    return o.select("o_orderkey", rate.alias("rate"), F.when(F.col("o_totalprice") > 0, F.greatest(F.lit(500000) - F.col("o_totalprice"), F.lit(0)) / rate).alias("eta"), formats.duration("seconds").alias("took"))


@query(_sql("""SELECT entry_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f', size_bytes / 1024.0::DOUBLE) || ' KiB' ELSE printf('%.1f', size_bytes / 1048576.0::DOUBLE) || ' MiB' END AS size, printf('%.1f', 100.0::DOUBLE * entry_id / (SELECT count(*) FROM entries)) || '%' AS share FROM entries"""))
def formatted_sizes(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    n = e.agg(F.count("*").alias("n"))
    return e.crossJoin(F.broadcast(n)).select("entry_id", formats.binary_size("size_bytes").alias("size"), formats.percent("entry_id", "n").alias("share"))  # n is one row


@query("""WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS events, round(sum(value), 4) AS value FROM c GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming sessions."""
    return session_counts(table(spark, sf, "events"), "2 hours")


@query(_sql(f"SELECT CASE WHEN {NOW} - modified_at < 86400 * 365 THEN 'year' WHEN {NOW} - modified_at < 86400 * 365 * 5 THEN 'five' ELSE 'older' END AS age, count(*) AS files FROM entries GROUP BY 1"))
def age_buckets(spark: SparkSession, sf: str) -> DataFrame:
    age = F.lit(NOW) - F.col("modified_at")
    return entries(spark, sf).groupBy(F.when(age < 86400 * 365, "year").when(age < 86400 * 365 * 5, "five").otherwise("older").alias("age")).agg(F.count("*").alias("files"))
