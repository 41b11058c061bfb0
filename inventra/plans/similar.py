"""Queries over similarity: text, chunks, descriptors, versions, normalised content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.operators import chunks as ch
from inventra.operators import descriptors as de
from inventra.operators import similarity as sm
from inventra.operators import versions as ve
from inventra.plans.registry import query
from inventra.sources import files
from inventra.sources.bindings import CHUNKS, ENTRIES, chunks, descriptors, entries, spread, table

_TOK = r"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)"
_SH = rf"""{_TOK}, sh AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM tok WHERE len(t) >= 20))"""
_PAIRS = f"""{_SH}, z AS (SELECT doc_id, count(*) AS n, sha256(array_to_string(list_sort(list(s)), '|')) AS k FROM sh GROUP BY 1), g AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS rep FROM z),
 n AS (SELECT doc_id, n FROM g WHERE doc_id = rep), r AS (SELECT sh.* FROM sh JOIN n USING (doc_id)), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM r x JOIN r y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
 j AS (SELECT a, b, shared, na.n AS size_a, nb.n AS size_b, shared / (na.n + nb.n - shared)::DOUBLE AS jaccard FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b UNION ALL SELECT rep, doc_id, n, n, n, 1.0 FROM g WHERE doc_id <> rep)"""


@query(f"WITH {_TOK} SELECT doc_id, len(t)::INT AS tokens, len(list_distinct(t))::INT AS distinct_tokens FROM tok")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", sm.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


@query(f"WITH {_SH} SELECT doc_id, count(*) AS shingles FROM sh GROUP BY 1")
def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sm.shingles(spread(table(spark, sf, "documents"))).groupBy("doc_id").agg(F.count("*").alias("shingles"))


@query(f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS confidence, CASE WHEN jaccard >= 0.95 THEN 'NEAR_DUPLICATE_DOCUMENT' ELSE 'TEXTUALLY_SIMILAR' END AS type, 5 AS tier FROM j WHERE jaccard >= 0.8")
def near_duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of exact Jaccard similarity 0.8 or more, a superset of what sketches find; texts of equal shingles are linked to the first of them."""
    return sm.near_duplicates(spread(table(spark, sf, "documents")))


@query(f"WITH {_PAIRS} SELECT a, b, shared, size_a, size_b, jaccard FROM j WHERE jaccard >= 0.5")
def exact_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    p = sm.jaccard_pairs(sm.shingles(spread(table(spark, sf, "documents"))), 0.5)
    return p.select("a", "b", F.col("shared").cast("long").alias("shared"), F.col("size_a").cast("long").alias("size_a"), F.col("size_b").cast("long").alias("size_b"), "jaccard")


@query()
def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return sm.minhash(spread(table(spark, sf, "documents")))


@query()
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return sm.lsh_pairs(sm.minhash(spread(table(spark, sf, "documents"))))


@query(f"WITH {CHUNKS} SELECT chunk_hash, size_bytes, count(*) AS occurrences, count(DISTINCT doc_id) AS objects FROM chunks GROUP BY 1, 2")
def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    return ch.index(chunks(spark, sf))


_CLASSES = f"""WITH {CHUNKS}, s0 AS (SELECT DISTINCT doc_id, chunk_hash, size_bytes FROM chunks), k AS (SELECT doc_id, sum(size_bytes)::BIGINT AS total, sha256(array_to_string(list_sort(list(chunk_hash)), '|')) AS k FROM s0 GROUP BY 1),
 m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep, total FROM k)"""


@query(_CLASSES + " SELECT * FROM m")
def chunk_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Which object stands for each in chunk_overlap."""
    return ch.classes(chunks(spark, sf))


@query(_CLASSES + """, t AS (SELECT doc_id, total FROM m WHERE doc_id = rep), s AS (SELECT s0.* FROM s0 JOIN t USING (doc_id)),
 o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared_chunks, sum(x.size_bytes)::BIGINT AS shared_bytes FROM s x JOIN s y USING (chunk_hash) WHERE x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, shared_chunks, shared_bytes, round(shared_bytes / ta.total::DOUBLE, 6) AS a_in_b, round(shared_bytes / tb.total::DOUBLE, 6) AS b_in_a, round(shared_bytes / (ta.total + tb.total - shared_bytes)::DOUBLE, 6) AS jaccard,
 CASE WHEN greatest(shared_bytes / ta.total::DOUBLE, shared_bytes / tb.total::DOUBLE) >= 0.9 THEN 'NEAR_SUBSET_CONTENT' ELSE 'PARTIAL_CONTENT_OVERLAP' END AS type FROM o JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE shared_bytes >= 256""")
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return ch.overlaps(chunks(spark, sf), minimum_bytes=256)


@query()
def content_defined_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ch.content_chunks(spread(table(spark, sf, "documents")))


@query(f"WITH {ENTRIES}, o AS (SELECT DISTINCT full_hash, size_bytes FROM entries WHERE full_hash IS NOT NULL), c AS (SELECT count(*) AS objects, sum(size_bytes)::BIGINT AS bytes FROM o) SELECT objects, bytes, bytes // 65536 + objects AS expected_chunks, (bytes // 65536 + objects) * 64 AS index_bytes FROM c")
def chunk_cost(spark: SparkSession, sf: str) -> DataFrame:
    return ch.cost(entries(spark, sf))


_BITS = """m AS (SELECT vec_id, embedding, list_sort([x::DOUBLE FOR x IN embedding[2:64]])[32] AS m FROM embeddings),
 own AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > m THEN 1 ELSE 0 END) AS v FROM m),
 d AS (SELECT * FROM own UNION ALL SELECT vec_id + 10000000, list_transform(range(1, 65), lambda i: CASE WHEN i > vec_id % 50 AND i <= vec_id % 50 + vec_id % 11 THEN 1 - v[i] ELSE v[i] END) FROM own)"""
_DIST = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x.v[i] <> y.v[i] THEN 1 ELSE 0 END))::INT"


@query(f"WITH {_BITS} SELECT vec_id, list_sum(v)::INT AS ones, array_to_string(v, '') AS bits FROM d")
def descriptor_bits(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("array_join(transform(sequence(0, 63), i -> cast(shiftright(bits, i) & 1 as string)), '')")
    return descriptors(spark, sf).select("vec_id", F.bit_count("bits").alias("ones"), text.alias("bits"))


@query(f"WITH {_BITS} SELECT vec_id, b::INT AS band, list_sum(list_transform(range(0, 64 * (b + 1) // 9 - 64 * b // 9), lambda k: v[64 * b // 9 + k + 1] * (1 << k)))::BIGINT AS value FROM d, range(9) t(b)")
def descriptor_bands(spark: SparkSession, sf: str) -> DataFrame:
    return de.band_index(descriptors(spark, sf), 8)


@query(f"WITH {_BITS} SELECT x.vec_id AS a, y.vec_id AS b, {_DIST} AS distance, 1 - {_DIST} / 64::DOUBLE AS confidence FROM d x JOIN d y ON x.vec_id < y.vec_id WHERE {_DIST} <= 8")
def descriptor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return de.pairs(descriptors(spark, sf), 8)


_CLUSTERS = f"""WITH RECURSIVE {_BITS}, p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM d x JOIN d y ON x.vec_id < y.vec_id WHERE {_DIST} <= 8), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node AS vec_id, min(root) AS cluster FROM r GROUP BY 1),
 k AS (SELECT vec_id, cluster, count(*) OVER (PARTITION BY cluster) AS members FROM c)"""


@query(_CLUSTERS + " SELECT * FROM k")
def descriptor_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return de.clusters(descriptors(spark, sf), 8)


@query(_CLUSTERS + " SELECT cluster, vec_id, (row_number() OVER (PARTITION BY cluster ORDER BY vec_id) - 1)::INT AS cell, members > 9 AS truncated FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY vec_id) <= 9")
def contact_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return de.contact_sheets(de.clusters(descriptors(spark, sf), 8), 9)


_VP = r"(?:[_ -]*(?:final|draft|revised|copy|backup|v\d+|\(\d+\)))+"
_STEM = rf"trim(regexp_replace(lower(regexp_replace(name, '[.][^.]*$', '')), '{_VP}', '', 'g'), ' ._-')"


@query(rf"WITH {ENTRIES} SELECT entry_id, {_STEM} AS stem, array_to_string(regexp_extract_all(lower(name), '(?:final|draft|revised|copy|backup|v\d+|\(\d+\))'), ',') AS tokens FROM entries")
def version_stems(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", ve.stem("name").alias("stem"), F.array_join(ve.tokens("name"), ",").alias("tokens"))


_FAMILY = f"v AS (SELECT source_root, dir, {_STEM} AS stem, suffix, full_hash, entry_id, modified_at FROM entries WHERE full_hash IS NOT NULL)"


@query(f"WITH {ENTRIES}, {_FAMILY} SELECT stem, suffix, count(DISTINCT full_hash) AS contents, count(*) AS files, min(entry_id) AS first_id FROM v GROUP BY 1, 2 HAVING count(DISTINCT full_hash) > 1")
def version_families(spark: SparkSession, sf: str) -> DataFrame:
    return ve.families(entries(spark, sf))


@query(f"""WITH {ENTRIES}, {_FAMILY}, f AS (SELECT stem, full_hash, min(entry_id) AS id FROM v GROUP BY 1, 2), g AS (SELECT stem, count(*) AS n, min(id) AS first_id FROM f GROUP BY 1)
SELECT x.stem, x.id AS a, y.id AS b, 'LIKELY_VERSION_OF' AS type, 1.0::DOUBLE AS confidence FROM f x JOIN f y ON x.stem = y.stem AND x.id < y.id JOIN g ON g.stem = x.stem WHERE n <= 16 OR x.id = first_id""")
def version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of one stem: all pairs of up to 16, else each with the first."""
    return ve.pairs(entries(spark, sf))


@query(f"""WITH {ENTRIES}, {_FAMILY}, a AS (SELECT * FROM v WHERE suffix IN ('.docx', '.pptx', '.xlsx', '.md', '.odt', '.ipynb', '.tex')), b AS (SELECT * FROM v WHERE suffix IN ('.pdf', '.html', '.htm'))
SELECT a.entry_id AS source, b.entry_id AS target, CASE WHEN abs(a.modified_at - b.modified_at) <= 3600 THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence, 'LIKELY_EXPORT' AS type FROM a JOIN b USING (dir, stem) WHERE a.full_hash <> b.full_hash""")
def cross_format_derivations(spark: SparkSession, sf: str) -> DataFrame:
    """All sources are taken as one here, as neighbouring documents are of different ones."""
    return ve.derivations(entries(spark, sf).withColumn("source_root", F.lit("all")))


_NORM = "n AS (SELECT sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS h, doc_id AS id FROM documents)"


@query(f"""WITH {_NORM}, g AS (SELECT h, count(*) AS n, min(id) AS first_id FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM g JOIN n x USING (h) JOIN n y USING (h) WHERE x.id < y.id AND (g.n <= 3 OR x.id = g.first_id)""")
def normalized_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of up to three members are linked pairwise, larger ones as a star."""
    return ve.equivalences(table(spark, sf, "documents").selectExpr("doc_id AS id", "sha2(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), 256) AS h"), pairwise=3)


@query("SELECT l_orderkey AS archive, sha256(array_to_string(list_sort(list(l_partkey || ':' || sha256(l_quantity::BIGINT::VARCHAR))), chr(10))) AS digest, sha256(array_to_string(list_sort(list(l_partkey || ':' || l_quantity::BIGINT)), chr(10))) AS structural FROM lineitem GROUP BY 1")
def archive_manifest_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of an archive's members as a multiset of path and content; the structural one has sizes instead."""
    member = lambda v: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l_partkey", v))), "\n"), 256)
    q = F.col("l_quantity").cast("long").cast("string")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("archive")).agg(member(F.sha2(q, 256)).alias("digest"), member(q).alias("structural"))


@query("SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1 HAVING sum(length(text)) >= 32")
def page_text_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of ordered pages of text; too little text has none."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.sha2("text", 256).alias("h")))).alias("p"), F.sum(F.length("text")).alias("n"))
    return g.where("n >= 32").select("conv_id", F.sha2(F.array_join(F.col("p.h"), "\n"), 256).alias("digest"))


@query("SELECT CASE WHEN props LIKE '%a%' THEN 'x' ELSE 'y' END AS kind, floor(log2(strlen(props)))::BIGINT AS band, count(*) AS objects FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def fuzzy_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets in which binary similarity is worth computing: kind and power of two of the size."""
    e = table(spark, sf, "events")
    return e.groupBy(F.when(F.col("props").contains("a"), "x").otherwise("y").alias("kind"), F.floor(F.log2(F.octet_length("props"))).alias("band")).agg(F.count("*").alias("objects")).where("objects > 1")


@query()
def filename_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Names that share a stem, each name once; pairs as in version_pairs."""
    return ve.name_similarity(entries(spark, sf))


@query("SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS digest, CASE WHEN text <> '' THEN strlen(text) END AS payload FROM documents")
def audio_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the payload of an audio file, with tags before and after it or not."""
    tagged = "concat(IF(doc_id % 3 = 0, X'', concat(X'4944330400000000022C', cast(repeat('x', 300) AS BINARY))), cast(text AS BINARY), IF(doc_id % 2 = 0, cast(concat('TAG', repeat('y', 125)) AS BINARY), X''))"
    d = table(spark, sf, "documents").select("doc_id", F.expr(tagged).alias("content")).select("doc_id", files.audio_payload("content").alias("p"))
    return d.select("doc_id", F.sha2("p", 256).alias("digest"), F.length("p").alias("payload"))


@query("SELECT p_partkey, sha256(p_partkey || chr(31) || p_brand || chr(30) || p_size || chr(31) || 'a,b' || chr(30)) AS digest FROM part")
def tabular_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows for each part, as comma- or tab-separated text."""
    t = table(spark, sf, "part").selectExpr("p_partkey", "IF(p_partkey % 2 = 0, concat('\"', p_partkey, '\", ', p_brand, ' \r\n', p_size, ',\"a,b\"\n'), concat(p_partkey, '\t', p_brand, '\n', p_size, '\t a,b')) AS t", "IF(p_partkey % 2 = 0, '.csv', '.TSV') AS suffix")
    digest = F.pandas_udf(files.tabular_digest, "string")
    return t.select("p_partkey", digest("t", "suffix").alias("digest"))
