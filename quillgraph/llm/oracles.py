"""The operators that SQL can state, for DuckDB, over whole tables and by plain comparison."""

from __future__ import annotations

#: Words as the contracts have them.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Reachability over links in both directions, without an end to the number of steps.
REACH = """
reach(a, b) AS (
    SELECT rn, rn FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)"""

OP1 = f"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS rn, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
    SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM rows
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT x.rn AS a, y.rn AS b FROM good x JOIN good y ON x.label = y.label AND x.rn <> y.rn AND len(x.e) = len(y.e)
    WHERE CASE WHEN len(x.e) = len(y.e) THEN list_dot_product(x.e, y.e) END / (x.norm * y.norm) >= 0.93
), {REACH}, found AS (
    SELECT reach.a, min(o.vec_id) AS component_id FROM reach JOIN rows o ON o.rn = reach.b GROUP BY reach.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(r.vec_id = component_id, false) AS kept
FROM rows r JOIN found f ON f.a = r.rn LEFT JOIN counted c ON c.a = r.rn
"""

OP7 = """
WITH texts AS (
    SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
    SELECT rn, doc_id, p, substr(h, 2 * p + 1, 100) AS s
    FROM (SELECT rn, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM texts WHERE doc_id IS NOT NULL)
), least AS (
    SELECT s, min(doc_id) AS first, max(doc_id) AS last FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), hits AS (
    SELECT rn, p FROM strings JOIN least USING (s) WHERE doc_id > first
), runs AS (
    SELECT rn, min(p) AS a, max(p) + 50 AS z FROM (
        SELECT rn, p, sum(fresh) OVER (PARTITION BY rn ORDER BY p) AS run
        FROM (SELECT rn, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rn ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)
    ) GROUP BY rn, run
), gaps AS (
    SELECT rn, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM runs WINDOW w AS (PARTITION BY rn ORDER BY a)
    UNION ALL SELECT rn, max(z), NULL FROM runs GROUP BY rn
), kept AS (
    SELECT g.rn, string_agg(CASE WHEN g.z IS NULL THEN substr(h, 2 * g.a + 1) ELSE substr(h, 2 * g.a + 1, 2 * (g.z - g.a)) END, '' ORDER BY g.a) AS k
    FROM gaps g JOIN texts USING (rn) GROUP BY g.rn
), totals AS (SELECT rn, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY rn)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN totals USING (rn) LEFT JOIN kept USING (rn)
"""

OP8 = f"""
WITH RECURSIVE rows AS MATERIALIZED (
    SELECT row_number() OVER () AS rn, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingled AS MATERIALIZED (
    SELECT rn, doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM rows
), sets AS MATERIALIZED (
    SELECT min(rn) AS rn, s, len(s) AS n FROM shingled WHERE doc_id IS NOT NULL AND len(s) > 0 GROUP BY s
), each_one AS MATERIALIZED (SELECT rn, n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT x.rn AS a, y.rn AS b, x.n AS n, y.n AS m, count(*) AS k FROM each_one x JOIN each_one y ON x.g = y.g AND x.rn < y.rn AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY ALL HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), links AS MATERIALIZED (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
    UNION ALL SELECT r.rn, t.rn FROM shingled r JOIN sets t USING (s) WHERE r.doc_id IS NOT NULL AND r.rn <> t.rn
    UNION ALL SELECT t.rn, r.rn FROM shingled r JOIN sets t USING (s) WHERE r.doc_id IS NOT NULL AND r.rn <> t.rn
), {REACH}, found AS (
    SELECT reach.a, min(o.doc_id) AS component_id FROM reach JOIN rows o ON o.rn = reach.b GROUP BY reach.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN doc_id IS NULL OR len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id, component_id, coalesce(doc_id = component_id, false) AS kept
FROM shingled JOIN found ON found.a = rn
"""

OP9 = f"""
WITH sized AS (
    SELECT row_number() OVER () AS rn, doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5(concat_ws('|', 'mix', doc_id::VARCHAR, coalesce(text, ''))) AS h FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM sources
), levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, source IS NULL, source)
), settled AS (
    SELECT *, first_value(level) OVER (ORDER BY level * weight >= cap, cap / weight, source IS NULL, source) AS common FROM levels
), targets AS (
    SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap ELSE common * weight END AS target FROM settled
), wanted AS (
    SELECT *, CASE WHEN target > 0 AND source_size > 0 THEN ceil(target - 1e-6)::BIGINT ELSE 0 END AS wanted FROM targets
), placed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, rn ROWS UNBOUNDED PRECEDING) - size AS first FROM sized
)
SELECT doc_id, p.source, size, source_size, target,
    (CASE WHEN source_size > 0 THEN wanted // source_size * size + greatest(0, least(size, wanted % source_size - first)) ELSE 0 END)::BIGINT AS taken
FROM placed p JOIN wanted w ON w.source IS NOT DISTINCT FROM p.source
"""

OP11 = """
WITH cut AS (
    SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS d FROM documents
), drawn AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || d[17:24])::BIGINT % 100 AS c, ('0x' || d[25:32])::BIGINT % 100 AS f FROM cut
), parts AS (
    SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN f < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH held AS MATERIALIZED (
    SELECT row_number() OVER () AS rn, doc_id, {TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL
), occurrences AS MATERIALIZED (
    SELECT rn, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM held
), entries AS MATERIALIZED (
    SELECT rn, doc_id, n, term, count(*)::BIGINT AS tf FROM occurrences GROUP BY ALL
), totals AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM held WHERE len(w) > 0),
weights AS (
    SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM entries, totals GROUP BY term, nn
), items AS (SELECT DISTINCT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
scores AS (
    SELECT item_id, rn, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN entries USING (term), totals GROUP BY item_id, rn, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""
