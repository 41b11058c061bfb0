"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         3.0::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('inventra:' || coalesce(s.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (least(floor((rank + 1) * rate + u) - floor(rank * rate + u), 3) * size)::BIGINT AS taken FROM ranked
"""

OP3 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (h.k IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h USING (k) GROUP BY doc_id
"""

OP2 = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
windows AS (
  SELECT doc_id, i, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4], w[i+5], w[i+6], w[i+7]) AS a, array_to_string(w[i:i+7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) > 8)
), dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(8, i - coalesce(prev, i - 8)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM dup) GROUP BY doc_id
), lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
         len(list_filter(w, lambda x: list_contains([{stop}], x))) AS n_stop
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars / n_words::DOUBLE BETWEEN 2 AND 15
         AND n_symbols / n_words::DOUBLE <= 0.25 AND n_stop / n_words::DOUBLE >= 0.01 AND n_dup_lines / n_lines::DOUBLE <= 0.60 AS kept
FROM m
"""


#: All windows that hold a shingle of the item (others have similarity 0), scored exactly; without fingerprints. Pairs with fewer such positions than
#: 0.8 of the item's shingles are left out, as the similarity takes as many.
OP5 = f"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS v FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
vs AS (SELECT item_id, q, array_to_string(v[q:q + 4], ' ') AS k FROM (SELECT item_id, v, unnest(range(1, greatest(len(v) - 4, 1) + 1)) AS q FROM items WHERE len(v) > 0)),
ws AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
hits AS (SELECT DISTINCT doc_id, item_id, p FROM ws JOIN vs USING (k)),
pairs AS (SELECT doc_id, item_id, list(p) AS ps FROM hits JOIN items USING (item_id) GROUP BY ALL HAVING count(*) >= 0.8 * greatest(len(any_value(v)) - 4, 1)),
win AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(p - 1 - back, len(w) - len(v)))::INT AS start FROM (
  SELECT doc_id, item_id, w, v, unnest(ps) AS p FROM pairs JOIN docs USING (doc_id) JOIN items USING (item_id)) x, unnest(range(0, greatest(len(v) - 5, 0) + 1)) AS t(back)),
xs AS (SELECT doc_id, item_id, start, array_to_string(x[i:i + 4], ' ') AS k, count(*) AS n FROM (
  SELECT doc_id, item_id, start, x, unnest(range(1, greatest(len(x) - 4, 1) + 1)) AS i FROM (
    SELECT doc_id, item_id, start, w[start + 1:start + len(v)] AS x FROM win JOIN docs USING (doc_id) JOIN items USING (item_id))) GROUP BY ALL),
vn AS (SELECT item_id, k, count(*) AS n FROM vs GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, sum(least(xs.n, coalesce(vn.n, 0))) AS c, sum(xs.n) AS nx FROM xs LEFT JOIN vn USING (item_id, k) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, c / (nx + (SELECT sum(n) FROM vn WHERE vn.item_id = scored.item_id) - c)::DOUBLE AS s FROM scored)
SELECT doc_id, item_id, start, round(s, 6) AS similarity FROM sim WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, start) = 1
"""


def op2() -> str:
    from .quality_rules import STOP_WORDS

    return OP2.replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS))


ORACLES = {"op1_mixing": OP1, "op2_quality_rules": op2(), "op3_line_dedup": OP3, "op5_decontamination": OP5}
