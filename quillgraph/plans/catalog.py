"""One query an operator over the provided tables, with its DuckDB counterpart where SQL states it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import rounded
from ..operators import bm25, build, calls, chunking, containment, extract, grounding, metrics, overlap, profile, questions, repertory, resolve, sessions
from ..operators import vectors as vec
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..session import shared_dir
from ..sources import contracts, frontier, growing, links, markup, stores
from ..sources.versions import Versions, merge_collection
from ..streaming import drain, latency, live_sessions, sketches
from . import leaflets, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 7
REMEDY, BRAND = "Supplier#000000002", "Brand#2"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the views of views.py in SQL
RUB = "rub AS (SELECT p_partkey AS id, p_brand AS chapter, p_name AS rubric FROM part)"
ENT = """ent AS (SELECT l_partkey AS rubric_id, s_name AS remedy_raw, CASE WHEN l_suppkey % 5 >= 2 THEN s_name END AS remedy_canonical,
  CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS grade
  FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) l JOIN supplier ON l_suppkey = s_suppkey)"""
MET = """met AS (SELECT ts, event_type AS task, CASE WHEN k % 10 <> 0 THEN 'deterministic' END AS path, value AS latency_ms, k * 40 + 100 AS input_tokens,
  CASE WHEN k % 3 <> 0 THEN k * 10 END AS output_tokens FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
STA = """sta AS (SELECT s_name AS remedy, p_size AS section_no, p_name || ' ' || p_partkey AS text, bool_or(l_returnflag = 'R') AS important,
  max(CASE WHEN l_linestatus = 'F' AND p_size <= 5 THEN p_type END) AS clinical
  FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
ANS = """ans AS (SELECT conv_id AS session, turn, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS topic, length(text) % 3 <> 0 AS correct FROM conversations WHERE role = 'user')"""


def flat(c: Column | str, field: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: (x[field] if field else x).cast("string")), ",")


# relational store


@query(f"""WITH {RUB}, {ENT}, hit AS (SELECT DISTINCT id, chapter, rubric FROM rub JOIN ent ON id = rubric_id WHERE remedy_canonical = '{REMEDY}' AND grade = 3 ORDER BY chapter, rubric, id LIMIT 50)
SELECT id, chapter, rubric, string_agg(remedy_raw || ':' || grade, ',' ORDER BY grade DESC, remedy_raw, remedy_canonical) AS remedies FROM hit JOIN ent ON id = rubric_id GROUP BY ALL""")
def grade3_rubrics_for_remedy(spark: SparkSession, d: str) -> DataFrame:
    e = views.entries(spark, d)
    hits = repertory.graded_rubrics(views.rubrics(spark, d), e, REMEDY, k=50)
    full = repertory.with_members(hits, e.join(hits.select("id"), F.col("rubric_id") == F.col("id"), "left_semi"))
    return full.select("id", "chapter", "rubric", F.array_join(F.transform("remedies", lambda r: F.concat(r["remedy_raw"], F.lit(":"), r["grade"])), ",").alias("remedies"))


@query(f"""WITH {RUB}, {ENT} SELECT id, chapter, rubric, string_agg(CASE WHEN grade = 3 THEN remedy_raw END, ',' ORDER BY remedy_raw) AS grade3, count(*) AS n FROM rub JOIN ent ON id = rubric_id WHERE id = 42 GROUP BY ALL""")
def rubric_by_id(spark: SparkSession, d: str) -> DataFrame:
    r = repertory.rubric(views.rubrics(spark, d), views.entries(spark, d), 42)
    return r.select("id", "chapter", "rubric", F.array_join(F.array_sort(F.transform(repertory.grade3(F.col("remedies")), lambda x: x["remedy_raw"])), ",").alias("grade3"), F.size("remedies").cast("bigint").alias("n"))


@query(f"WITH {ENT} SELECT remedy_raw, remedy_canonical, grade FROM ent WHERE rubric_id = 17")
def entries_of_rubric(spark: SparkSession, d: str) -> DataFrame:
    return repertory.entries_of(views.entries(spark, d), 17)


@query("SELECT DISTINCT p_brand AS chapter FROM part ORDER BY 1")
def chapters(spark: SparkSession, d: str) -> DataFrame:
    return repertory.chapters(views.rubrics(spark, d))


@query(f"""WITH {RUB}, {ENT} SELECT id, chapter, rubric FROM rub WHERE id IN (SELECT rubric_id FROM ent WHERE grade = 3) ORDER BY md5(concat_ws('|', id::VARCHAR, '{SEED}')), id LIMIT 20""")
def random_rubrics_with_grade3(spark: SparkSession, d: str) -> DataFrame:
    return repertory.random_graded(views.rubrics(spark, d), views.entries(spark, d), 20, SEED).select("id", "chapter", "rubric")


@query(f"WITH {ENT} SELECT DISTINCT remedy_canonical FROM ent WHERE grade = 3 AND remedy_canonical IS NOT NULL")
def remedies_with_grade3(spark: SparkSession, d: str) -> DataFrame:
    return repertory.graded_remedies(views.entries(spark, d))


@query(f"""WITH {ENT}, n AS (SELECT DISTINCT remedy_canonical FROM ent WHERE grade = 3 AND remedy_canonical IS NOT NULL) SELECT * FROM n ORDER BY md5(concat_ws('|', remedy_canonical, '{SEED}')), 1 LIMIT 10""")
def remedies_with_grade3_sampled(spark: SparkSession, d: str) -> DataFrame:
    return repertory.graded_remedies(views.entries(spark, d), 10, SEED)


@query(f"""WITH {RUB} SELECT id, rubric FROM rub WHERE chapter = '{BRAND}' AND id NOT IN (SELECT id FROM rub WHERE id % 3 = 0) ORDER BY md5(concat_ws('|', id::VARCHAR, '{SEED}')), id LIMIT 20""")
def sample_rubrics(spark: SparkSession, d: str) -> DataFrame:
    r = views.rubrics(spark, d)
    return repertory.sample_rubrics(r, BRAND, r.where("id % 3 = 0"), 20, SEED).select("id", "rubric")


@query(f"""WITH {RUB}, {ENT} SELECT id, chapter, rubric, n_grade3, n_grade1 FROM rub JOIN (SELECT rubric_id, count(*) FILTER (grade = 3) AS n_grade3, count(*) FILTER (grade = 1) AS n_grade1 FROM ent GROUP BY 1 HAVING count(*) FILTER (grade = 3) >= 8 AND count(*) FILTER (grade = 1) >= 15) ON id = rubric_id""")
def eligible_rubrics(spark: SparkSession, d: str) -> DataFrame:
    return repertory.eligible(views.rubrics(spark, d), views.entries(spark, d), 8, 15).select("id", "chapter", "rubric", "n_grade3", "n_grade1")


_STRAT = f"""pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY md5(concat_ws('|', id::VARCHAR, '{SEED}')), id) AS turn FROM elig) WHERE turn <= 3
  ORDER BY turn, md5(concat_ws('|', chapter, '{SEED}')), chapter LIMIT 60)"""
_ELIG = "elig AS (SELECT id, chapter, rubric FROM rub JOIN (SELECT rubric_id FROM ent GROUP BY 1 HAVING count(*) FILTER (grade = 3) >= 1 AND count(*) FILTER (grade = 1) >= 3) ON id = rubric_id)"


@query(f"WITH {RUB}, {ENT}, elig AS (SELECT * FROM rub), {_STRAT} SELECT id, chapter, rubric, turn FROM pick")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return repertory.stratified(views.rubrics(spark, d), "chapter", "id", 60, 3, SEED).select("id", "chapter", "rubric", F.col("turn").cast("bigint").alias("turn"))


@query(f"""WITH {RUB}, {ENT}, {_ELIG}, {_STRAT} SELECT 'fwd-' || id AS id, id AS rubric_id, chapter, rubric,
  arg_min(remedy_raw, md5(concat_ws('|', id::VARCHAR, remedy_raw, '{SEED}'))) FILTER (grade = 3) AS correct_remedy,
  string_agg(CASE WHEN grade = 3 THEN remedy_raw END, ',' ORDER BY remedy_raw) AS grade3_all, string_agg(CASE WHEN grade = 1 THEN remedy_raw END, ',' ORDER BY remedy_raw) AS distractor_pool
  FROM pick JOIN ent ON id = rubric_id GROUP BY ALL""")
def goldset_forward(spark: SparkSession, d: str) -> DataFrame:
    g = repertory.gold_forward(views.rubrics(spark, d), views.entries(spark, d), 60, 3, SEED)
    return g.select("id", "rubric_id", "chapter", "rubric", "correct_remedy", flat("grade3_all").alias("grade3_all"), flat("distractor_pool").alias("distractor_pool"))


@query(f"""WITH {RUB}, {ENT}, n AS (SELECT * FROM (SELECT DISTINCT remedy_canonical FROM ent WHERE grade = 3 AND remedy_canonical IS NOT NULL) ORDER BY md5(concat_ws('|', remedy_canonical, '{SEED}')), 1 LIMIT 10),
  h AS (SELECT remedy_canonical, rubric, row_number() OVER (PARTITION BY remedy_canonical ORDER BY chapter, rubric, id) AS r FROM (SELECT DISTINCT remedy_canonical, rubric_id FROM ent JOIN n USING (remedy_canonical) WHERE grade = 3) JOIN rub ON id = rubric_id)
SELECT 'rev-' || remedy_canonical AS id, remedy_canonical AS remedy, string_agg(DISTINCT rubric, ',' ORDER BY rubric) AS expect_rubrics FROM h WHERE r <= 5000 GROUP BY ALL""")
def goldset_reverse(spark: SparkSession, d: str) -> DataFrame:
    return repertory.gold_reverse(views.rubrics(spark, d), views.entries(spark, d), 10, SEED).select("id", "remedy", flat("expect_rubrics").alias("expect_rubrics"))


@query(f"""WITH {RUB}, {ENT} SELECT *, CAST(floor(100 * n_resolved / greatest(n_entries, 1)) AS BIGINT) AS resolved_percent FROM (SELECT count(*) AS n_rubrics, count(DISTINCT chapter) AS n_chapters FROM rub),
  (SELECT count(*) AS n_entries, count(*) FILTER (grade = 3) AS n_grade3, count(remedy_canonical) AS n_resolved FROM ent)""")
def rubric_summary(spark: SparkSession, d: str) -> DataFrame:
    return repertory.summary(views.rubrics(spark, d), views.entries(spark, d))


@query(f"""WITH {RUB}, {ENT}, names AS (SELECT DISTINCT remedy_raw AS name, remedy_canonical AS canonical FROM ent)
SELECT e.rubric_id, e.remedy_raw, n.canonical AS remedy_canonical, e.grade FROM ent e LEFT JOIN names n ON n.name = e.remedy_raw""")
def load_and_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Nested records made from the tables, split into rubrics and entries again with names resolved."""
    e = views.entries(spark, d)
    full = repertory.with_members(views.rubrics(spark, d), e).where(F.size("remedies") > 0)
    nested = full.select("id", "chapter", "rubric", F.transform("remedies", lambda r: F.struct(r["remedy_raw"].alias("name"), r["grade"].alias("grade"))).alias("remedies"), F.transform(repertory.grade3(F.col("remedies")), lambda r: r["remedy_raw"]).alias("grade3"), "page", "url")
    names = e.select(F.col("remedy_raw").alias("name"), F.col("remedy_canonical").alias("canonical")).distinct()
    # ids of parts begin at 0 and may have gaps, so positions are mapped back
    r, out = repertory.normalized(nested.withColumn("url", F.col("id").cast("string")), ["id"], names)
    return out.join(r.select(F.col("id").alias("rubric_id"), F.col("url").cast("bigint").alias("part")), "rubric_id").select(F.col("part").alias("rubric_id"), "remedy_raw", "remedy_canonical", "grade")


# keyword search


def _bm25_sql(source: str, id_: str, columns: list[str], terms: list[str], k: int, where: str = "TRUE") -> str:
    toks = " || ' ' || ".join(f"coalesce({c}, '')" for c in columns)
    asked = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH d AS (SELECT *, {id_} AS id, regexp_extract_all(strip_accents(lower({toks})), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
  s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), q AS (SELECT * FROM (VALUES {asked}) v(term)),
  m AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM d, q), h AS (SELECT * FROM m WHERE f > 0),
  df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
  p AS (SELECT id, term, f, dl, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf, avgdl FROM h JOIN df USING (term), s),
  sc AS (SELECT id, -sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score, count(*) AS c FROM p GROUP BY 1)
SELECT sc.id, round(score, 6) AS score FROM sc JOIN d ON d.id = sc.id WHERE c = {len(terms)} AND {where} ORDER BY round(score, 9), sc.id LIMIT {k}"""


@query(_bm25_sql("part", "p_partkey", ["p_brand", "p_name"], ["red", "widget"], 10))
def bm25_search_labels(spark: SparkSession, d: str) -> DataFrame:
    r = views.rubrics(spark, d)
    return bm25.search(bm25.postings(r, "id", "chapter", "rubric"), bm25.corpus_statistics(r, "id", "chapter", "rubric"), "red widget", 10).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql("part", "p_partkey", ["p_brand", "p_name"], ["red"], 10, f"p_brand = '{BRAND}'"))
def bm25_search_chapter(spark: SparkSession, d: str) -> DataFrame:
    r = views.rubrics(spark, d)
    found = bm25.search(bm25.postings(r, "id", "chapter", "rubric"), bm25.corpus_statistics(r, "id", "chapter", "rubric"), "red", 10, r.where(F.col("chapter") == BRAND))
    return found.select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql("documents", "doc_id", ["text"], ["the", "hation"], 10))
def bm25_search_documents(spark: SparkSession, d: str) -> DataFrame:
    """By the index on disk: only the first search of a folder of tables reads a text."""
    return _index(spark, d).search("the (hation)", 10).select("id", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, d: str) -> TextIndex:
    """The index of the documents of ``d``, built if it is not there yet."""
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{hashlib.md5(d.encode()).hexdigest()}")
    if not index.versions.newest():
        index.append(views.documents(spark, d), "doc_id", "text")
    return index


@query(_bm25_sql("documents", "doc_id", ["text"], ["the", "hation"], 10))
def bm25_search_without_index(spark: SparkSession, d: str) -> DataFrame:
    """The same over postings made for one search."""
    t = views.documents(spark, d)
    return bm25.search(bm25.postings(t, "doc_id", "text"), bm25.corpus_statistics(t, "doc_id", "text"), "the (hation)", 10).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql("documents", "doc_id", ["text"], ["the", "and"], 25))
def bm25_search_appended(spark: SparkSession, d: str) -> DataFrame:
    """An index that grew by thirds of the documents and was then merged, as if it had been built at once."""
    index, t = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"), views.documents(spark, d)
    for i in range(3):
        index.append(t.where(F.col("doc_id") % 3 == i), "doc_id", "text")
    index.merge()
    return index.search("the and", 25).select("id", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
  h AS (SELECT id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS f FROM d), df AS (SELECT count(*) AS df FROM h WHERE f > 0)
SELECT id, round(-(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM h, s, df WHERE f > 0 ORDER BY round(score, 9), id LIMIT 10""")
def bm25_search_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A quoted token with inner punctuation is a phrase of consecutive words."""
    return _index(spark, d).search("of,the", 10).select("id", F.round("score", 6).alias("score"))


# metrics


@query(f"""WITH {MET} SELECT CASE grouping_id(task, path) WHEN 3 THEN 'overall' WHEN 1 THEN 'task' ELSE 'path' END AS scope, coalesce(task, path) AS name,
  round(quantile_cont(latency_ms, 0.5), 1) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 1) AS p95_ms, count(*) AS n
  FROM (SELECT task, coalesce(path, 'generative') AS path, latency_ms FROM met WHERE latency_ms IS NOT NULL) GROUP BY GROUPING SETS ((), (task), (path))""")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_report(views.metrics(spark, d))


_Z = "1.96::DOUBLE"
@query(f"""SELECT lang, round(p, 4) AS rate, n, count, round(greatest(0.0::DOUBLE, ((p + {_Z} * {_Z} / (2 * n)) - {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n)) / (1 + {_Z} * {_Z} / n)), 4) AS ci_lo,
  round(least(1.0::DOUBLE, ((p + {_Z} * {_Z} / (2 * n)) + {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n)) / (1 + {_Z} * {_Z} / n)), 4) AS ci_hi
  FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS count, count(*) FILTER (quality = 1) / count(*)::DOUBLE AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)""")
def wilson_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rates(views.load(spark, d, "labels").join(views.documents(spark, d).select("doc_id", "lang"), "doc_id"), "quality", "lang")


_TOK = """tok AS (SELECT CAST(floor(0.4::DOUBLE * coalesce(avg(i) FILTER (path = 'deterministic'), 0) + 0.6::DOUBLE * 3 * coalesce(avg(i) FILTER (path = 'generative'), avg(i))) AS BIGINT) AS tokens_in,
  CAST(floor(0.4::DOUBLE * coalesce(avg(o) FILTER (path = 'deterministic'), 0) + 0.6::DOUBLE * 3 * coalesce(avg(o) FILTER (path = 'generative'), avg(o))) AS BIGINT) AS tokens_out
  FROM (SELECT coalesce(path, 'generative') AS path, input_tokens::DOUBLE AS i, coalesce(output_tokens, 0)::DOUBLE AS o FROM met WHERE input_tokens > 0))"""


@query(f"WITH {MET}, {_TOK} SELECT * FROM tok")
def observed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return metrics.observed_tokens(views.metrics(spark, d))


_PRICES = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in metrics.PRICES)


@query(f"""WITH {MET}, {_TOK}, c AS (SELECT model, 50000.0::DOUBLE * tokens_in / 1e6 * pin + 50000.0::DOUBLE * tokens_out / 1e6 * pout AS cost FROM tok, (VALUES {_PRICES}) v(model, pin, pout))
SELECT model, round(cost, 2) AS cost, CASE WHEN cost < base THEN round(100 * (1 - cost / base), 0) END AS saved_percent FROM c, (SELECT cost AS base FROM c WHERE model = 'gpt-5.5') ORDER BY cost, model""")
def cost_model(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cost_ranking(metrics.observed_tokens(views.metrics(spark, d)))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as case runs: what is served, supported and found follows from the id."""
    t = views.documents(spark, d).select((F.col("doc_id") % 7 == 0).alias("r"), (F.col("doc_id") % 5 != 0).alias("a"), "doc_id", "n_chars")
    served = F.when(F.col("r"), F.col("doc_id") % 21 == 0).otherwise(F.col("a"))
    return t.select(F.when(F.col("r"), "refuse").otherwise("answerable").alias("expect"), served.alias("served"), (F.col("doc_id") % 11 != 0).alias("supported"), (F.col("doc_id") % 13 != 0).alias("quote_found"), (F.col("n_chars") % 1000 / 1000.0).alias("similarity"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("located"))


_OUT = """o AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'refuse' ELSE 'answerable' END AS expect, CASE WHEN doc_id % 7 = 0 THEN doc_id % 21 = 0 ELSE doc_id % 5 <> 0 END AS served, doc_id % 11 <> 0 AS supported, doc_id % 13 <> 0 AS quote_found,
  n_chars % 1000 / 1000.0::DOUBLE AS similarity, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS located FROM documents)"""


@query(f"""WITH {_OUT} SELECT count(*) FILTER (served) AS served, round(count(*) FILTER (served AND NOT supported) / count(*) FILTER (served)::DOUBLE, 4) AS hallucination_rate, round(count(*) FILTER (served AND quote_found) / count(*) FILTER (served)::DOUBLE, 4) AS quote_validity,
  round(count(*) FILTER (expect = 'refuse' AND NOT served) / count(*) FILTER (expect = 'refuse')::DOUBLE, 4) AS refusal_accuracy, round(count(*) FILTER (expect <> 'refuse' AND NOT served) / count(*) FILTER (expect <> 'refuse')::DOUBLE, 4) AS false_refusal_rate,
  round(quantile_cont(similarity, 0.5), 4) AS similarity_median, round(min(similarity), 4) AS similarity_min, round(count(*) FILTER (located) / count(located)::DOUBLE, 4) AS hit_rate FROM o""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.main_report(_outcomes(spark, d)).withColumn("refusal_accuracy", F.col("refusal_accuracy.rate")).withColumn("false_refusal_rate", F.col("false_refusal_rate.rate"))


@query("""SELECT expect, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'refuse' ELSE 'answerable' END AS expect, unnest(range(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 3 END)) FROM documents) GROUP BY 1""")
def evaluation_cases(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluation_cases(_outcomes(spark, d).select("expect"), 3).groupBy("expect").agg(F.count("*").alias("n"))


@query(f"""WITH {_OUT} SELECT tag, topic, left(reason, 200) AS reason FROM (SELECT 'false_refusal' AS tag, doc_id::VARCHAR AS topic, text AS reason FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0 UNION ALL SELECT 'unsupported', doc_id::VARCHAR, text FROM documents WHERE doc_id % 11 = 0)""")
def failure_list(spark: SparkSession, d: str) -> DataFrame:
    t = views.documents(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("topic"), F.col("text").alias("reason"))
    return metrics.failures(("false_refusal", t.where("doc_id % 7 <> 0 and doc_id % 5 = 0")), ("unsupported", t.where("doc_id % 11 = 0")))


@query(f"""WITH {RUB}, {ENT}, f AS (SELECT id, bool_or(grade = 3 AND remedy_raw = a) AS ok, NOT bool_or(grade = 3 AND remedy_raw = w) AS valid, id % 10 = 0 AS error FROM rub JOIN ent ON id = rubric_id
  JOIN (SELECT rubric_id AS i, min(remedy_raw) AS a, max(remedy_raw) AS w FROM ent GROUP BY 1) ON i = id GROUP BY id),
  v AS (SELECT rc, bool_or(grade = 3 AND rubric_id = a) AS ok, rc LIKE '%7' AS error FROM ent JOIN (SELECT remedy_canonical AS rc, min(rubric_id) AS a FROM ent WHERE remedy_canonical IS NOT NULL GROUP BY 1) ON rc = remedy_canonical GROUP BY rc),
  n AS (SELECT (SELECT count(*) FILTER (NOT error) FROM f) AS nf, (SELECT count(*) FILTER (NOT error) FROM v) AS nv, (SELECT count(*) FILTER (error) FROM f) + (SELECT count(*) FILTER (error) FROM v) AS ne,
    (SELECT count(*) FILTER (NOT error AND ok) FROM f) + (SELECT count(*) FILTER (NOT error AND ok) FROM v) AS ok, (SELECT count(*) FILTER (NOT error AND valid) FROM f) AS valid)
SELECT nf AS n_forward, nv AS n_reverse, ne AS n_errors, round(ok / (nf + nv)::DOUBLE, 4) AS answer_correctness, round(valid / nf::DOUBLE, 4) AS distractor_validity FROM n""")
def repertory_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Forward: is the name that a rubric is answered with one of its grade 3. Reverse: is the rubric that a name is answered with one where it has grade 3."""
    e = views.entries(spark, d)
    g = e.groupBy("rubric_id").agg(F.collect_set(F.when(F.col("grade") == 3, F.col("remedy_raw"))).alias("grade3_all"), F.min("remedy_raw").alias("answer"), F.array(F.max("remedy_raw")).alias("distractors"))
    forward = g.withColumn("error", F.when(F.col("rubric_id") % 10 == 0, "none made"))
    r = e.where("remedy_canonical is not null").groupBy("remedy_canonical").agg(F.collect_set(F.when(F.col("grade") == 3, F.col("rubric_id").cast("string"))).alias("expect_rubrics"), F.min("rubric_id").cast("string").alias("answer"))
    return metrics.repertory_report(forward, r.withColumn("error", F.when(F.col("remedy_canonical").endswith("7"), "none made")))


# passages


@query("""SELECT substr(sha1(concat_ws('|', source, source || ' § ' || doc_id, trim(text))), 1, 16) AS id, doc_id FROM documents""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = views.chunk_rows(spark, d)
    return c.select(text.content_id(F.col("source"), F.col("locator"), text.strip(F.col("text"))).alias("id"), "doc_id")


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\S+')) < 15 OR lower(source) IN ('dose', 'relations') AS sparse FROM documents""")
def sparse_flags(spark: SparkSession, d: str) -> DataFrame:
    return views.chunk_rows(spark, d).select("doc_id", text.is_sparse(F.col("text"), F.col("source")).alias("sparse"))


@query("""WITH c AS (SELECT DISTINCT source, substr(sha1(concat_ws('|', source, source || ' § ' || doc_id, trim(text))), 1, 16) AS id FROM documents WHERE trim(text) <> '') SELECT source, count(*) AS n FROM c GROUP BY ROLLUP (source)""")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.counts(chunking.passages(views.chunk_rows(spark, d)))


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
  g AS (SELECT doc_id, ps, 0 AS i, '' AS buf, NULL::VARCHAR AS done FROM p
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(buf) + length(ps[i + 1]) > 2200 AND buf <> '' THEN right(buf, 180) || ' ' ELSE buf END || ps[i + 1] || chr(10) || chr(10),
    CASE WHEN length(buf) + length(ps[i + 1]) > 2200 AND buf <> '' THEN regexp_replace(buf, '^\\s+|\\s+$', '', 'g') END FROM g WHERE i < len(ps)),
  o AS (SELECT doc_id, i, done AS t FROM g WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, regexp_replace(buf, '^\\s+|\\s+$', '', 'g') FROM g WHERE i = len(ps) AND buf <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part, md5(t) AS text_md5, length(t) AS n_chars FROM o""")
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines count as paragraphs: the texts have no blank lines."""
    parts = chunking.packed_parts(chunking.paragraphs(F.col("text"), "\n"))
    p = views.documents(spark, d).select("doc_id", F.posexplode(parts).alias("at", "t"))
    return p.select("doc_id", (F.col("at") + 1).cast("bigint").alias("part"), F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


# vectors

ASKED = "id % 20 = 0"  #: the fixed set of queries, asked of all rows
_QV = "q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0)"
_SIM = "list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[])"
_HITS = f"""hits AS (SELECT * FROM (SELECT query_id, vec_id AS id, vec_id % 2 = 1 AS sparse, {_SIM} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round({_SIM}, 12) DESC, vec_id) AS rank
  FROM q, embeddings WHERE vec_id <> query_id) WHERE rank <= 32)"""
_TOPS = """tops AS (SELECT query_id, n_hits, top_id, top_rank, top_similarity, margin FROM (SELECT query_id, count(*) AS n_hits FROM hits GROUP BY 1) LEFT JOIN
  (SELECT query_id, id AS top_id, rank AS top_rank, similarity AS top_similarity, similarity - nxt AS margin FROM (SELECT *, lead(similarity) OVER w AS nxt, row_number() OVER w AS n FROM hits WHERE NOT sparse WINDOW w AS (PARTITION BY query_id ORDER BY rank)) WHERE n = 1) USING (query_id))"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    v = views.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 2 == 1).alias("sparse"))
    q = v.where(ASKED).select(F.col("id").alias("query_id"), "embedding")
    return vec.batch_search(v, q, exclude_self=True).withColumn("sparse", F.col("id") % 2 == 1)


@query(f"WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 3) SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM q, embeddings WHERE label = 5 ORDER BY {_SIM} DESC, vec_id LIMIT 8")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = views.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("subject"))
    one = v.where("id = 3").select("embedding").first()
    return vec.search(v, list(one.embedding), subject=5, k=8).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_QV}, {_HITS} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM hits")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _vector_index(spark: SparkSession, d: str) -> tuple[VectorIndex, DataFrame]:
    v = views.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.built(v, f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}")
    return index, v.where(ASKED).select(F.col("id").alias("query_id"), "embedding")


@query()
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest by the inverted file, a row a query, with the part of the exact eight among them."""
    index, q = _vector_index(spark, d)
    found = index.calibrated(0.95).search(q, 8, exclude_self=True)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    got, right = found.groupBy("query_id").agg(ids.alias("got")), index.search(q, 8, exact=True, exclude_self=True).groupBy("query_id").agg(ids.alias("right"))
    recall = F.size(F.filter("right", lambda x: F.array_contains("got", x))) / F.size("right")
    return got.join(right, "query_id").select("query_id", flat("got").alias("ids"), recall.alias("recall"))


@query(f"WITH {_QV}, {_HITS} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM hits WHERE rank <= 8")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same index with every list searched by full vectors."""
    index, q = _vector_index(spark, d)
    return index.search(q, 8, exact=True, exclude_self=True).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_QV}, {_HITS}, {_TOPS} SELECT query_id, n_hits, top_id, top_rank, round(top_similarity, 6) AS top_similarity FROM tops")
def effective_top(spark: SparkSession, d: str) -> DataFrame:
    return vec.tops(_hits(spark, d)).select("query_id", "n_hits", "top_id", F.col("top_rank").cast("bigint").alias("top_rank"), F.round("top_similarity", 6).alias("top_similarity"))


@query(f"WITH {_QV}, {_HITS}, {_TOPS} SELECT query_id, round(margin, 6) AS margin FROM tops")
def vector_margin(spark: SparkSession, d: str) -> DataFrame:
    return vec.tops(_hits(spark, d)).select("query_id", F.round("margin", 6).alias("margin"))


@query(f"""WITH {_QV}, {_HITS}, {_TOPS} SELECT query_id, r AS reason, r IN ('hard', 'soft') AS accepted FROM (SELECT query_id, CASE WHEN query_id % 100 = 0 THEN 'out_of_domain' WHEN top_id IS NULL THEN 'only_sparse' WHEN top_similarity >= 0.40 THEN 'hard' WHEN top_similarity >= 0.35 AND margin >= 0.02 THEN 'soft' ELSE 'below_floor' END AS r FROM tops)""")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    q = views.load(spark, d, "embeddings").withColumnRenamed("vec_id", "id").where(ASKED).select(F.col("id").alias("query_id"), F.when(F.expr("id % 100 = 0"), "Bitcoin at night").otherwise("a topic").alias("text"))
    return vec.gated(q, vec.tops(_hits(spark, d)), hard=0.40, soft=0.35, margin=0.02).select("query_id", "reason", "accepted")


@query(f"""WITH {_QV}, {_HITS}, {_TOPS} SELECT query_id, id, place FROM (SELECT h.query_id, h.id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) - 1 AS place FROM hits h JOIN tops t ON h.query_id = t.query_id WHERE h.rank <= 8 AND (top_id IS NULL OR h.id <> top_id)) WHERE place BETWEEN 1 AND 4""")
def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return vec.neighbours(h, vec.tops(h)).select("query_id", "id", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {_QV}, {_HITS} SELECT query_id, coalesce(bool_or(contains(lower('Vec ' || id || '.'), lower('VEC ' || e || '.'))), FALSE) AS located FROM (SELECT query_id, query_id * 3 + 1 AS e FROM q) x LEFT JOIN (SELECT query_id, id FROM hits WHERE rank <= 8) h USING (query_id) GROUP BY 1""")
def vector_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).withColumn("locator", F.concat(F.lit("Vec "), "id", F.lit(".")))
    e = views.load(spark, d, "embeddings").withColumnRenamed("vec_id", "id").where(ASKED).select(F.col("id").alias("query_id"), F.concat(F.lit("VEC "), F.col("id") * 3 + 1, F.lit(".")).alias("expect_locator"))
    return vec.hit_rate(h, e)


@query("""SELECT p_partkey AS id, nullif(regexp_extract(' ' || q || ' ', '(?i)[^a-z0-9_](bitcoin|ct scan|ecg)[^a-z0-9_]', 1), '') AS term FROM (SELECT p_partkey, p_name || CASE p_partkey % 7 WHEN 0 THEN ' and Bitcoin' WHEN 1 THEN ' CT scan, ECG' WHEN 2 THEN ' ecgs' ELSE '' END AS q FROM part)""")
def out_of_domain_veto(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    q = F.concat("p_name", F.when(k == 0, " and Bitcoin").when(k == 1, " CT scan, ECG").when(k == 2, " ecgs").otherwise(""))
    return views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.foreign_term(q).alias("term"))


# overlap

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _toks(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_SCORED = f"""l AS (SELECT doc_id * 100000 + pos AS id, doc_id AS entity, t AS text, {_toks('t')} AS k FROM lines), r AS (SELECT doc_id - 1 AS entity, pos, t AS r_text, {_toks('t')} AS u FROM lines),
  pr AS (SELECT id, pos, r_text, len(list_intersect(k, u)) AS shared, len(k) AS nk, len(u) AS nu FROM l JOIN r USING (entity) WHERE len(k) >= 3),
  best AS (SELECT * FROM (SELECT *, shared / least(nk, nu)::DOUBLE AS s, shared / (nk + nu - shared)::DOUBLE AS j, row_number() OVER (PARTITION BY id ORDER BY shared / least(nk, nu)::DOUBLE DESC, pos) AS n FROM pr WHERE shared > 0) WHERE n = 1),
  w AS (SELECT entity, list_distinct(flatten(list(u))) AS a FROM r GROUP BY 1),
  sc AS (SELECT l.id, l.entity, l.text, len(k) >= 3 AND coalesce(s, 0) >= 0.7 AS duplicate, round(coalesce(s, 0.0::DOUBLE), 2) AS score, CASE WHEN len(k) >= 3 THEN round(coalesce(j, 0.0::DOUBLE), 2) END AS jaccard,
    CASE WHEN len(k) >= 3 THEN round(coalesce(len(list_intersect(k, a)) / nullif(least(len(k), len(a)), 0)::DOUBLE, 0.0::DOUBLE), 2) END AS in_all, CASE WHEN len(k) < 3 THEN 'too_short' END AS note,
    CASE WHEN len(k) >= 3 AND coalesce(s, 0) >= 0.7 THEN r_text END AS match_text FROM l LEFT JOIN best ON best.id = l.id LEFT JOIN w ON w.entity = l.entity)"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document against those of the next one."""
    lines = views.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    left = lines.select((F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.col("doc_id").alias("entity"), "text")
    right = lines.select((F.col("doc_id") - 1).alias("entity"), "pos", "text", F.lit("").alias("section"))
    return overlap.scored(left, right)


@query(f"WITH {_LINES}, {_SCORED} SELECT id, duplicate, score, jaccard, in_all, note, match_text FROM sc")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("id", "duplicate", "score", "jaccard", "in_all", "note", "match_text")


@query(f"WITH {_LINES}, {_SCORED} SELECT entity, count(*) AS n, count(*) FILTER (duplicate) AS n_duplicates, round(count(*) FILTER (duplicate) / count(*)::DOUBLE, 2) AS duplicate_ratio FROM sc GROUP BY 1")
def duplicate_ratios(spark: SparkSession, d: str) -> DataFrame:
    return overlap.duplicate_ratio(_flagged(spark, d))


@query(f"""WITH {_LINES}, {_SCORED}, gone AS (SELECT DISTINCT entity + 1 AS doc_id, lower(trim(regexp_replace(match_text, '\\s+', ' ', 'g'))) AS key FROM sc WHERE duplicate)
SELECT lines.doc_id, pos::INT AS pos, md5(t) AS text_md5 FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.key = lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) WHERE gone.key IS NULL""")
def dedup_suppression(spark: SparkSession, d: str) -> DataFrame:
    lines = views.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumnRenamed("doc_id", "entity")
    kept = overlap.suppressed(lines, overlap.suppressions(_flagged(spark, d).withColumn("entity", F.col("entity") + 1)))
    return kept.select(F.col("entity").alias("doc_id"), "pos", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""SELECT a.doc_id, round(CASE WHEN len({_toks('a.text')}) = 0 OR len({_toks('b.text')}) = 0 THEN 0 ELSE len(list_intersect({_toks('a.text')}, {_toks('b.text')})) / (len({_toks('a.text')}) + len({_toks('b.text')}) - len(list_intersect({_toks('a.text')}, {_toks('b.text')})))::DOUBLE END, 6) AS jaccard,
  round(CASE WHEN len({_toks('a.text')}) = 0 OR len({_toks('b.text')}) = 0 THEN 0 ELSE len(list_intersect({_toks('a.text')}, {_toks('b.text')})) / least(len({_toks('a.text')}), len({_toks('b.text')}))::DOUBLE END, 6) AS containment FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def token_similarity(spark: SparkSession, d: str) -> DataFrame:
    t = views.documents(spark, d)
    pairs = t.select("doc_id", F.col("text").alias("a")).join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")
    return overlap.similarity(pairs, "a", "b").select("doc_id", rounded(F.col("jaccard"), 6).alias("jaccard"), rounded(F.col("containment"), 6).alias("containment"))


_KEY = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"


@query(f"""WITH lft AS (SELECT c_custkey AS id, {_KEY.format('c_mktsegment')} AS k, {_KEY.format("split_part(c_mktsegment, ' ', 1)")} AS f FROM customer),
  r AS (SELECT p_partkey AS pos, {_KEY.format('p_type')} AS k, {_KEY.format("split_part(p_type, ' ', 1)")} AS f, {_KEY.format('left(p_name, 3)')} AS a FROM part)
SELECT id, coalesce((SELECT min(pos) FROM r WHERE r.k = lft.k), (SELECT min(pos) FROM r WHERE r.f = lft.f), (SELECT min(pos) FROM r WHERE a <> '' AND starts_with(lft.f, a))) AS match_pos FROM lft""")
def entity_match(spark: SparkSession, d: str) -> DataFrame:
    left = views.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    right = views.load(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("name"), F.left("p_name", F.lit(3)).alias("abbrev"))
    return overlap.matched_entities(left, right)


_SETS = """st AS MATERIALIZED (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains({stop}, x)))) AS s FROM documents),
  cl AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, s FROM st WHERE len(s) >= 10), each_one AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS w FROM cl WHERE id = class_id),
  ln AS MATERIALIZED (SELECT a.id AS small, b.id AS large, count(*) AS shared, count(*) / any_value(a.n)::DOUBLE AS containment FROM each_one a JOIN each_one b ON a.w = b.w AND (a.n < b.n OR (a.n = b.n AND a.id < b.id)) GROUP BY 1, 2 HAVING count(*) * 100 >= any_value(a.n) * 80)""".format(stop="[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]")


def _contained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members = containment.classes(views.documents(spark, d), "doc_id", "text")
    return members, containment.linked(containment.representatives(members))


@query(f"WITH {_SETS} SELECT small, large, shared, round(containment, 6) AS containment FROM ln")
def containment_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose words lie in another's to four fifths, over the whole table; equal sets are one class."""
    return _contained(spark, d)[1].select("small", "large", F.col("shared").cast("bigint").alias("shared"), rounded(F.col("containment"), 6).alias("containment"))


@query(f"WITH {_SETS} SELECT id, class_id, (SELECT count(*) FROM ln WHERE small = class_id OR large = class_id) AS n_links FROM cl")
def containment_classes(spark: SparkSession, d: str) -> DataFrame:
    return containment.overview(*_contained(spark, d))


# names


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Part names as entities; their capitals, beginnings and parenthesised forms as names."""
    p = views.load(spark, d, "part").groupBy(F.col("p_name").alias("remedy")).agg(F.min("p_partkey").alias("seq"))
    seed = p.select("seq", "remedy", F.concat(F.substring_index("remedy", " ", 1), F.lit("-"), F.left(F.substring_index("remedy", " ", -1), F.lit(3))).alias("abbrev"))
    form = F.explode(F.array(F.concat(F.upper("remedy"), F.lit(".")), F.concat("remedy", F.lit(" (old form)")), F.concat(F.substring_index("remedy", " ", 1), F.lit(" "), F.left(F.substring_index("remedy", " ", -1), F.lit(2))), F.concat(F.left("remedy", F.lit(2)), F.lit("x"), F.substring(F.col("remedy"), F.lit(4), F.length("remedy")))))
    return seed, p.select(form.alias("name")).distinct()


_NAMES = """p AS (SELECT p_name AS remedy, min(p_partkey) AS seq FROM part GROUP BY 1), idx AS (SELECT seq, remedy AS canonical, unnest([remedy, split_part(remedy, ' ', 1) || '-' || left(split_part(remedy, ' ', -1), 3)]) AS alias FROM p),
  ix AS (SELECT *, regexp_extract_all(lower(alias), '[a-z]+') AS toks, array_to_string(regexp_extract_all(lower(alias), '[a-z]+'), ' ') AS key FROM idx),
  nm AS (SELECT DISTINCT unnest([upper(remedy) || '.', remedy || ' (old form)', split_part(remedy, ' ', 1) || ' ' || left(split_part(remedy, ' ', -1), 2), left(remedy, 2) || 'x' || substr(remedy, 4)]) AS name FROM p)"""


@query(f"""WITH {_NAMES}, kx AS (SELECT key, arg_max(canonical, seq) AS canonical FROM ix WHERE key <> '' GROUP BY 1),
  v AS (SELECT name, 0 AS nth, array_to_string(regexp_extract_all(lower(regexp_replace(name, '\\s*\\([^)]*\\)\\s*', ' ', 'g')), '[a-z]+'), ' ') AS key FROM nm UNION ALL SELECT name, 1, array_to_string(regexp_extract_all(lower(regexp_extract(name, '\\(([^)]*)\\)', 1)), '[a-z]+'), ' ') FROM nm WHERE name LIKE '%(%')
SELECT name, arg_min(canonical, nth) AS canonical FROM v JOIN kx USING (key) GROUP BY 1""")
def alias_exact(spark: SparkSession, d: str) -> DataFrame:
    seed, names = _names(spark, d)
    return resolve.exact(names, resolve.seeded(seed))


@query(f"""WITH {_NAMES}, n AS (SELECT name, regexp_extract_all(lower(name), '[a-z]+') AS t FROM nm)
SELECT name, min(canonical) AS canonical FROM n JOIN (SELECT DISTINCT seq, canonical, toks FROM ix) i ON t[1] = toks[1] WHERE length(t[1]) >= 3 AND len(t) <= len(toks) AND len(list_filter(range(1, len(t) + 1), lambda k: NOT starts_with(toks[k], t[k]))) = 0 GROUP BY 1 HAVING count(DISTINCT seq) = 1""")
def alias_prefix(spark: SparkSession, d: str) -> DataFrame:
    seed, names = _names(spark, d)
    return resolve.by_prefix(names, resolve.seeded(seed))


@query()
def alias_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    seed, names = _names(spark, d)
    return resolve.fuzzy(names, resolve.seeded(seed)).select("name", "canonical", F.round("score", 6).alias("score"))


@query()
def alias_cascade(spark: SparkSession, d: str) -> DataFrame:
    seed, names = _names(spark, d)
    return resolve.cascade(names, resolve.seeded(seed))


@query()
def alias_feedback(spark: SparkSession, d: str) -> DataFrame:
    seed, names = _names(spark, d)
    return resolve.extended(resolve.seeded(seed), names.select(F.lit(0).alias("batch"), F.lit("names").alias("source"), "name"))


@query(f"WITH {_NAMES} SELECT canonical, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases, 'seed' AS sources FROM ix GROUP BY 1")
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    seed, _ = _names(spark, d)
    return resolve.table(resolve.seeded(seed)).select("canonical", flat("aliases").alias("aliases"), flat("sources").alias("sources"))


@query(f"""WITH {_NAMES}, keys AS (SELECT key AS k, arg_max(canonical, seq) AS canonical FROM ix WHERE key <> '' GROUP BY 1),
  asked AS (SELECT DISTINCT p_name || '.' AS name, p_brand AS source FROM part UNION SELECT DISTINCT 'no ' || p_name, p_brand FROM part)
SELECT source, count(*) AS n_names, count(canonical) AS n_resolved, string_agg(CASE WHEN canonical IS NULL THEN name END, ',' ORDER BY name) AS unresolved
FROM asked LEFT JOIN keys ON k = array_to_string(regexp_extract_all(lower(name), '[a-z]+'), ' ') GROUP BY 1""")
def alias_report(spark: SparkSession, d: str) -> DataFrame:
    """What each source's names come to."""
    seed, _ = _names(spark, d)
    p = views.load(spark, d, "part")
    asked = p.select(F.concat("p_name", F.lit(".")).alias("name"), F.col("p_brand").alias("source")).unionByName(p.select(F.concat(F.lit("no "), "p_name").alias("name"), F.col("p_brand").alias("source"))).distinct()
    found = asked.join(resolve.exact(asked.select("name").distinct(), resolve.seeded(seed), variants=False), "name", "left")
    return resolve.report(found).select("source", "n_names", "n_resolved", flat("unresolved").alias("unresolved"))


@query()
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up at run time: aliases as they are, then beginnings, then likeness."""
    seed, names = _names(spark, d)
    return resolve.canonical(names, resolve.seeded(seed))


# quotes


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Forty characters of each document, blanks doubled, against it or the next one."""
    t = views.documents(spark, d)
    q = t.select("doc_id", F.replace(F.substring(F.substring_index("text", "\n", 1), 11, 40), F.lit(" "), F.lit("  ")).alias("quote"), (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("of"))
    return q.join(t.select(F.col("doc_id").alias("of"), F.col("text").alias("source")), "of")


@query("""SELECT a.doc_id, trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(q), '\\s+', ' ', 'g'))) AS quote_exact
  FROM (SELECT doc_id, replace(substr(split_part(text, chr(10), 1), 11, 40), ' ', '  ') AS q, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS o FROM documents) a JOIN documents b ON b.doc_id = o""")
def quote_exact(spark: SparkSession, d: str) -> DataFrame:
    return grounding.exact(_quotes(spark, d)).select("doc_id", "quote_exact")


@query("""WITH x AS (SELECT a.doc_id, trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(q), '\\s+', ' ', 'g'))) AS found
  FROM (SELECT doc_id, replace(substr(split_part(text, chr(10), 1), 11, 40), ' ', '  ') AS q, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS o FROM documents) a JOIN documents b ON b.doc_id = o)
SELECT doc_id, doc_id % 4 <> 0 AND found AS supported, CASE WHEN doc_id % 2 = 0 AND found THEN 'a claim' WHEN doc_id % 2 = 0 THEN 'a claim,supporting quote not found in source' WHEN found THEN '' ELSE 'supporting quote not found in source' END AS claims FROM x""")
def quote_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A verdict stands only if its quote is in the source; else the claim counts as unsupported and says why."""
    rows = grounding.exact(_quotes(spark, d)).select("doc_id", F.col("quote_exact").alias("quote_found"), (F.col("doc_id") % 4 != 0).alias("supported"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a claim"))).alias("unsupported_claims"))
    return grounding.verdicts(rows).select("doc_id", "supported", flat("unsupported_claims").alias("claims"))


@query()
def quote_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return grounding.present(_quotes(spark, d)).select("doc_id", "quote_found")


# questions

_OPT = "list_transform(list_sort(list_transform({o}, lambda x: {{'h': md5(concat_ws('|', {k}, x, '{s}')), 'o': x}})), lambda y: y.o)"


def _options(o: str, k: str) -> str:
    return _OPT.format(o=o, k=k, s=SEED)


@query(f"""WITH {RUB}, {ENT}, c AS (SELECT rubric_id, arg_min(remedy_raw, md5(concat_ws('|', rubric_id::VARCHAR, remedy_raw, '{SEED}'))) AS correct FROM ent WHERE grade = 3 GROUP BY 1),
  w AS (SELECT rubric_id, correct, list(remedy_raw ORDER BY n) AS wrong FROM (SELECT rubric_id, correct, remedy_raw, row_number() OVER (PARTITION BY rubric_id ORDER BY md5(concat_ws('|', rubric_id::VARCHAR, remedy_raw, '{SEED}')), remedy_raw) AS n FROM (SELECT DISTINCT rubric_id, remedy_raw FROM ent WHERE grade = 1) JOIN c USING (rubric_id) WHERE remedy_raw <> correct) WHERE n <= 3 GROUP BY ALL HAVING count(*) = 3),
  o AS (SELECT rubric_id, correct, {_options("list_prepend(correct, wrong)", "rubric_id::VARCHAR")} AS op FROM w)
SELECT rubric_id, array_to_string(op, ',') AS options, CAST(list_position(op, correct) - 1 AS INT) AS correct_index FROM o""")
def mcq_rubric_to_remedy(spark: SparkSession, d: str) -> DataFrame:
    q = questions.rubric_to_remedy(views.rubrics(spark, d), views.entries(spark, d), SEED)
    return q.select("rubric_id", flat("options").alias("options"), "correct_index")


@query(f"""WITH {RUB}, {ENT}, own AS (SELECT DISTINCT remedy_canonical AS rc, rubric_id FROM ent WHERE grade = 3 AND remedy_canonical IS NOT NULL),
  lb AS (SELECT rc, rubric, min(struct_pack(chapter := chapter, id := id)) AS f FROM own JOIN rub ON id = rubric_id GROUP BY 1, 2),
  c AS (SELECT rc, arg_min(rubric, md5(concat_ws('|', rc, rubric, '{SEED}'))) AS correct, arg_min(f, md5(concat_ws('|', rc, rubric, '{SEED}'))) AS f FROM lb GROUP BY 1),
  pool AS (SELECT rc, correct, rubric, row_number() OVER (PARTITION BY rc ORDER BY md5(concat_ws('|', rc, id::VARCHAR, '{SEED}')), id) AS n FROM c JOIN rub ON chapter = f.chapter AND rubric <> correct WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.rc = c.rc AND own.rubric_id = id)),
  k AS (SELECT rc, correct, rubric, row_number() OVER (PARTITION BY rc ORDER BY n) AS k FROM (SELECT rc, correct, rubric, min(n) AS n FROM pool WHERE n <= 20 GROUP BY ALL)),
  w AS (SELECT rc, correct, list(rubric ORDER BY k) AS wrong FROM k WHERE k <= 3 GROUP BY ALL HAVING count(*) = 3), o AS (SELECT rc, correct, {_options("list_prepend(correct, wrong)", "rc")} AS op FROM w)
SELECT rc AS remedy_canonical, f.id AS rubric_id, array_to_string(op, ',') AS options, CAST(list_position(op, o.correct) - 1 AS INT) AS correct_index FROM o JOIN c USING (rc)""")
def mcq_remedy_to_rubric(spark: SparkSession, d: str) -> DataFrame:
    """All remedies are asked for."""
    asked = views.entries(spark, d).select("remedy_canonical").where("remedy_canonical is not null")
    q = questions.remedy_to_rubric(views.rubrics(spark, d), views.entries(spark, d), asked, SEED)
    return q.select("remedy_canonical", "rubric_id", flat("options").alias("options"), "correct_index")


def _pool_sql(by: str, label: str, where: str) -> str:
    part, key = (f"PARTITION BY {by} ", f"{by}::VARCHAR, {label}") if by else ("", label)
    return f"(SELECT {by + ',' if by else ''} list({label} ORDER BY n) AS pool FROM (SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', {key}, '{SEED}')), {label}) AS n FROM (SELECT DISTINCT {by + ',' if by else ''} {label} FROM sta WHERE {where})) WHERE n <= 4 {'GROUP BY ' + by if by else ''})"


@query(f"""WITH {STA}, w AS (SELECT remedy, section_no, text, list_filter(pool, lambda x: x <> remedy)[1:3] AS wrong FROM sta JOIN {_pool_sql('section_no', 'remedy', 'important')} USING (section_no) WHERE important),
  o AS (SELECT remedy, section_no, text, {_options("list_prepend(remedy, wrong)", "remedy, text")} AS op FROM w WHERE len(wrong) = 3)
SELECT remedy, section_no, text AS supporting_quote, array_to_string(op, ',') AS options, CAST(list_position(op, remedy) - 1 AS INT) AS correct_index FROM o""")
def mcq_keynote(spark: SparkSession, d: str) -> DataFrame:
    return questions.keynote(views.statements(spark, d), SEED).select("remedy", "section_no", "supporting_quote", flat("options").alias("options"), "correct_index")


@query(f"""WITH {STA}, a AS (SELECT pool AS wide FROM {_pool_sql('', 'clinical', 'clinical IS NOT NULL')}), w AS (SELECT remedy, section_no, text, clinical, CASE WHEN len(list_filter(pool, lambda x: x <> clinical)) >= 3 THEN list_filter(pool, lambda x: x <> clinical)[1:3] ELSE list_filter(wide, lambda x: x <> clinical)[1:3] END AS wrong
  FROM sta JOIN {_pool_sql('section_no', 'clinical', 'clinical IS NOT NULL')} USING (section_no), a WHERE clinical IS NOT NULL), o AS (SELECT remedy, section_no, text, clinical, {_options("list_prepend(clinical, wrong)", "remedy, text")} AS op FROM w WHERE len(wrong) = 3)
SELECT remedy, section_no, text AS supporting_quote, array_to_string(op, ',') AS options, CAST(list_position(op, clinical) - 1 AS INT) AS correct_index FROM o""")
def mcq_clinical(spark: SparkSession, d: str) -> DataFrame:
    return questions.clinical(views.statements(spark, d), SEED).select("remedy", "section_no", "supporting_quote", flat("options").alias("options"), "correct_index")


@query()
def mcq_draw(spark: SparkSession, d: str) -> DataFrame:
    s = views.statements(spark, d)
    made = {"rubric_to_remedy": questions.rubric_to_remedy(views.rubrics(spark, d), views.entries(spark, d), SEED), "keynote": questions.keynote(s, SEED)}
    one = questions.packaged(questions.drawn(made, SEED, remedy=REMEDY), "store", "Repertory")
    return one.select("kind", "question", flat("options").alias("options"), "correct_index", F.col("source.chunk_id").alias("chunk_id"), questions.well_formed(F.col("options"), F.col("correct_index")).alias("well_formed"))


@query(f"""SELECT id, subject, CASE WHEN subject = 'Repertory' THEN 'deterministic' WHEN subject = 'Materia Medica' AND ('0x' || substr(md5(concat_ws('|', id::VARCHAR, '{SEED}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.4 THEN 'deterministic' ELSE 'generative' END AS path
  FROM (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Repertory' WHEN 1 THEN 'Materia Medica' ELSE 'Other' END AS subject FROM documents)""")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    r = views.documents(spark, d).select(F.col("doc_id").alias("id"), F.when(k == 0, "Repertory").when(k == 1, "Materia Medica").otherwise("Other").alias("subject"))
    return questions.routed(r, seed=SEED)


# pages


@query("SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return views.html_pages(spark, d).select("page_id", markup.title(F.col("html")).alias("title"))


@query("""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS at, replace(unnest(l), '&amp;', '&') AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    p = markup.pages(views.html_pages(spark, d))
    return p.select("page_id", F.posexplode("page.links").alias("at", "l")).select("page_id", "at", F.col("l.href").alias("href"))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '<script>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10""")
def html_tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.tag_counts(markup.pages(views.html_pages(spark, d)))


@query("SELECT page_id AS id, length(html) AS size FROM pages ORDER BY 2 DESC, url LIMIT 1")
def largest_page(spark: SparkSession, d: str) -> DataFrame:
    p = views.html_pages(spark, d).select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.length("html").cast("bigint").alias("size"))
    return profile.largest(p).select("id", "size")


# text


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'œ', 'oe'), 'æ', 'ae'), '[ \\t]+', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).select("doc_id", F.md5(text.clean(F.col("text")).cast("binary")).alias("text_md5"))


@query("""SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)licensed under|password='))) AS n_kept FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def boiler_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = extract.without_boilerplate(F.col("text"), "(?i)licensed under|password=")
    none = extract.without_boilerplate(F.col("text"), "(?i)licensed under|password=") == ""
    n = F.size(F.split("text", "\n"))
    left = F.size(F.filter(F.split("text", "\n"), lambda x: ~F.rlike(text.strip(x), F.lit("(?i)licensed under|password="))))
    return views.documents(spark, d).withColumn("kept", kept).withColumn("none", none).select("doc_id", n.cast("bigint").alias("n_lines"), left.cast("bigint").alias("n_kept"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM events""")
def forward_fill_context(spark: SparkSession, d: str) -> DataFrame:
    """The last error before each event of a user, as headings carry on over paragraphs."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return views.load(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), True).over(w).alias("context"))


@query("""SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM events) GROUP BY ALL""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Stretches that begin at an error, as texts begin at a heading."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    g = views.load(spark, d, "events").select("user_id", F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("grp"))
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '^[a-d]$') THEN ascii(t) - 97 WHEN regexp_matches(t, '^[1-4]$') THEN t::INT - 1 END AS choice FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'b' WHEN 1 THEN '3' WHEN 2 THEN 'd' WHEN 3 THEN '9' ELSE 'zzz' END AS t FROM documents)""")
def parsed_choices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    t = F.when(k == 0, " B) ").when(k == 1, "3").when(k == 2, "d.").when(k == 3, "9").otherwise("zzz")
    return views.documents(spark, d).select("doc_id", text.parse_choice(t, F.array(F.lit("one"), F.lit("two"), F.lit("three"), F.lit("four"))).cast("int").alias("choice"))


# sessions


@query(f"WITH {ANS} SELECT session, count(*) AS answered, count(*) FILTER (correct) AS correct, CAST(round(100 * count(*) FILTER (correct) / count(*)::DOUBLE, 0) AS INT) AS percent FROM ans GROUP BY 1")
def session_scores(spark: SparkSession, d: str) -> DataFrame:
    return sessions.scores(views.answers(spark, d))


@query(f"""WITH {ANS} SELECT session, topic, misses, place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY misses DESC, first_miss, topic) AS place FROM (SELECT session, topic, count(*) AS misses, min(turn) AS first_miss FROM ans WHERE NOT correct GROUP BY 1, 2)) WHERE place <= 3""")
def weak_topics(spark: SparkSession, d: str) -> DataFrame:
    return sessions.weak_topics(views.answers(spark, d)).select("session", "topic", "misses", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {ANS} SELECT session, turn, count(*) OVER w AS answered_so_far, count(*) FILTER (correct) OVER w AS correct_so_far FROM ans WINDOW w AS (PARTITION BY session ORDER BY turn)""")
def running_scores(spark: SparkSession, d: str) -> DataFrame:
    return sessions.running(views.answers(spark, d)).select("session", "turn", "answered_so_far", "correct_so_far")


@query(f"""WITH {ANS}, weak AS (SELECT session, string_agg(topic, ', ' ORDER BY place) AS weak FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY misses DESC, first_miss, topic) AS place FROM (SELECT session, topic, count(*) AS misses, min(turn) AS first_miss FROM ans WHERE NOT correct GROUP BY 1, 2)) WHERE place <= 3 GROUP BY 1)
SELECT session, 'Score: ' || right_ || '/' || n || ' (' || CAST(round(100 * right_ / n::DOUBLE, 0) AS INT) || '%)' || coalesce(' · Revisiting: ' || weak, '') AS line FROM (SELECT session, count(*) AS n, count(*) FILTER (correct) AS right_ FROM ans GROUP BY 1) LEFT JOIN weak USING (session)""")
def score_lines(spark: SparkSession, d: str) -> DataFrame:
    return sessions.score_lines(views.answers(spark, d))


@query("""SELECT session, turn, coalesce(last_value(CASE kind WHEN 'exam' THEN 'config_mode' WHEN 'mode' THEN 'asking' WHEN 'serve' THEN 'awaiting_answer' WHEN 'answer' THEN 'asking' END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn), 'config_exam') AS after
  FROM (SELECT conv_id AS session, turn, CASE WHEN turn = 0 THEN 'exam' WHEN turn = 1 THEN 'mode' WHEN role = 'user' THEN 'answer' ELSE 'serve' END AS kind FROM conversations)""")
def session_states(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("turn") == 0, "exam").when(F.col("turn") == 1, "mode").when(F.col("role") == "user", "answer").otherwise("serve")
    return sessions.states(views.load(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", kind.alias("kind"))).select("session", "turn", "after")


# profiles


@query("""SELECT lang, count(*) AS n, count(*) FILTER (length(text) < 100) AS n_short, count(*) FILTER (contains(text, chr(10))) AS n_lined, CAST(floor(100 * count(*) FILTER (length(text) < 100) / count(*)) AS BIGINT) AS short_percent, CAST(floor(100 * count(*) FILTER (contains(text, chr(10))) / count(*)) AS BIGINT) AS lined_percent FROM documents GROUP BY 1""")
def stats_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.shares(views.documents(spark, d), ["lang"], short=F.length("text") < 100, lined=F.contains("text", F.lit("\n")))


@query("""WITH n AS (SELECT DISTINCT doc_id AS x FROM labels) SELECT x AS after, nxt - x - 1 AS n_missing FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nxt FROM n) WHERE nxt > x + 1""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return profile.gaps(views.load(spark, d, "labels"), "doc_id")


@query("""SELECT x AS doc_id FROM (SELECT unnest(range((SELECT min(doc_id) FROM labels), (SELECT max(doc_id) FROM labels))) AS x) WHERE x NOT IN (SELECT doc_id FROM labels)""")
def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing(views.load(spark, d, "labels"), "doc_id")


@query(f"WITH {ENT} SELECT grade, count(*) AS n FROM ent GROUP BY 1")
def grade_histogram(spark: SparkSession, d: str) -> DataFrame:
    full = repertory.with_members(views.rubrics(spark, d), views.entries(spark, d))
    return profile.grade_histogram(full.select(F.transform("remedies", lambda r: F.struct(r["grade"].alias("grade"))).alias("remedies")))


@query(f"""WITH {MET} SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, task, coalesce(path, 'generative') AS path, count(*) AS n, round(sum(latency_ms), 2) AS total_ms, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms FROM met GROUP BY 1, 2, 3""")
def latency_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stream's aggregation over the same rows as one batch."""
    return latency.windowed(views.metrics(spark, d)).select("start", "task", "path", "n", F.round("total_ms", 2).alias("total_ms"), "least_ms", "most_ms")




# functions over names and statements


@query("SELECT p_partkey AS id, array_to_string(regexp_extract_all(lower(p_name || '-' || p_type || '.'), '[a-z]+'), ' ') AS key FROM part")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.name_key(F.concat("p_name", F.lit("-"), "p_type", F.lit("."))).alias("key"))


@query(f"SELECT doc_id, array_to_string(list_sort({_toks('text')}), ' ') AS tokens FROM documents")
def content_token_sets(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).select("doc_id", F.array_join(F.array_sort(text.content_tokens(F.col("text"))), " ").alias("tokens"))


@query("SELECT p_partkey AS id, upper(left(p_name, 1)) || substr(p_name, 2) || ',' || p_type AS variants FROM part")
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring(F.col("p_name"), F.lit(2), F.length("p_name")), F.lit(". ("), "p_type", F.lit(".)"))
    return views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.name_variants(n), ",").alias("variants"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE p_type || ' ' || p_name END AS rest FROM part")
def marker_stripped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit(". ] "), "p_type")).otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    return views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.strip_marker(t, text.markers(F.col("p_name"), F.concat(F.lit("q"), F.left("p_name", F.lit(2))))).alias("rest"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN ', from ' || p_type || ';' END AS better, ' in ' || p_name AS worse FROM part""")
def modalities(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Better, from "), "p_type", F.lit("; "))).otherwise(""), F.lit("Worse in "), "p_name")
    m = text.split_modalities(t)
    return views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), m["better"].alias("better"), F.concat(F.lit(" "), m["worse"]).alias("worse"))


@query("""SELECT lang, doc_id // 8 AS part, string_agg('[' || source || ' § ' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS block FROM documents GROUP BY ALL""")
def formatted_sources(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their whole texts, a block for the language's among eight ids, as many as a search gives."""
    h = F.array_sort(F.collect_list(F.struct("doc_id", F.concat("source", F.lit(" § "), "doc_id").alias("locator"), "text")))
    t = views.documents(spark, d).groupBy("lang", F.floor(F.col("doc_id") / 8).alias("part")).agg(h.alias("h"))
    return t.select("lang", "part", text.format_sources(F.col("h")).alias("block"))


# configuration and topics of sessions


@query("""SELECT conv_id AS session, CASE conv_id % 4 WHEN 0 THEN 'First' WHEN 1 THEN 'Other' WHEN 2 THEN 'Other' END AS exam, conv_id % 3 = 0 AS general, CASE WHEN conv_id % 3 = 1 THEN 'Repertory' END AS subject, CASE WHEN conv_id % 3 = 2 THEN 'Sulphur' END AS topic FROM (SELECT DISTINCT conv_id FROM conversations)""")
def session_configuration(spark: SparkSession, d: str) -> DataFrame:
    c = views.load(spark, d, "conversations").select(F.col("conv_id").alias("session")).distinct()
    k, m = F.col("session") % 4, F.col("session") % 3
    exam = sessions.exam_of(F.when(k == 0, " 1 ").when(k == 1, "some OTHER one").when(k == 2, "2").otherwise("?"), (("First", ("first",)), ("Other", ("other", "general"))))
    mode = sessions.mode_of(F.when(m == 0, "Mixed").when(m == 1, "the repertory please").otherwise(" Sulphur "), ("Organon of Medicine", "Repertory"))
    return c.select("session", exam.alias("exam"), mode["general"].alias("general"), mode["subject"].alias("subject"), mode["topic"].alias("topic"))


_UNIFORM = "('0x' || substr(md5(concat_ws('|', {k}, '{s}')), 1, 8))::BIGINT"


@query(f"""WITH {ANS}, weak AS (SELECT session, arg_min(topic, (r, topic)) AS weak FROM (SELECT session, topic, -ln(greatest({_UNIFORM.format(k="session::VARCHAR, topic", s=SEED)} / 4294967296.0::DOUBLE, 1e-12::DOUBLE)) / count(*) AS r FROM ans WHERE NOT correct GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT session, weak, weak IS NOT NULL AND {_UNIFORM.format(k="session::VARCHAR, 'revisit'", s=SEED)} / 4294967296.0::DOUBLE < 0.3 AS again FROM (SELECT DISTINCT session FROM ans) LEFT JOIN weak USING (session))
SELECT session, CASE WHEN again THEN weak WHEN session % 2 = 0 THEN 'explicit' ELSE 'topic ' || {_UNIFORM.format(k="session::VARCHAR, 'general'", s=SEED)} % 5 END AS next_topic, CASE WHEN NOT again AND session % 2 = 1 THEN 'S' END AS next_subject FROM s""")
def next_topics(spark: SparkSession, d: str) -> DataFrame:
    a = views.answers(spark, d)
    misses = a.where("not correct").groupBy("session", "topic").agg(F.count("*").alias("misses"))
    s = a.select("session").distinct().select("session", F.lit(None).cast("string").alias("subject"), F.when(F.col("session") % 2 == 0, "explicit").alias("topic"), (F.col("session") % 2 == 1).alias("general"))
    general = spark.createDataFrame([("S", f"topic {i}") for i in range(5)], "subject string, topic string")
    return sessions.next_topics(s, misses, general, SEED)


@query(f"WITH {ANS} SELECT session, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS n FROM ans) WHERE n <= 8 GROUP BY 1")
def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recent(views.answers(spark, d).withColumn("question", F.col("turn").cast("string"))).select("session", flat("recent").alias("recent"))


@query(f"""WITH q AS ({SQL["mcq_keynote"]}), o AS (SELECT *, string_split(options, ',') AS op, substr('ABCD', correct_index + 1, 1) || ') ' || string_split(options, ',')[correct_index + 1] || '. moderate' AS answer FROM q)
SELECT remedy, supporting_quote, 'Which remedy is characterized by this keynote symptom: "' || supporting_quote || '"?' || chr(10) || 'A) ' || op[1] || chr(10) || 'B) ' || op[2] || chr(10) || 'C) ' || op[3] || chr(10) || 'D) ' || op[4] AS question,
  CASE WHEN section_no = 1 THEN 'Correct: ' ELSE 'Not understood. The answer is ' END || answer AS reveal FROM o""")
def rendered_questions(spark: SparkSession, d: str) -> DataFrame:
    q = questions.keynote(views.statements(spark, d), SEED)
    choice = F.when(F.col("section_no") == 1, F.col("correct_index"))
    return q.select("remedy", "supporting_quote", sessions.rendered(F.col("question"), F.col("options")).alias("question"), sessions.reveal(F.col("question"), F.col("options"), F.col("correct_index"), choice, F.col("difficulty")).alias("reveal"))


@query(f"""WITH q AS ({SQL["mcq_rubric_to_remedy"]}), x AS (SELECT rubric_id, string_split(options, ',')[correct_index + 1] AS answer, CAST(('0x' || substr(md5('Which remedy is graded 3 under the rubric "' || p_name || '" (' || p_brand || ')?|0'), 1, 8))::BIGINT % 4 AS INT) AS slot FROM q JOIN part ON p_partkey = rubric_id)
SELECT rubric_id, array_to_string(list_concat(['new 0', 'new 1', 'new 2'][1:slot], [answer], ['new 0', 'new 1', 'new 2'][slot + 1:3]), ',') AS options, slot AS correct_index FROM x""")
def distractor_insertion(spark: SparkSession, d: str) -> DataFrame:
    q = questions.rubric_to_remedy(views.rubrics(spark, d), views.entries(spark, d), SEED)
    new = questions.with_distractors(q.withColumn("distractors", F.array(*(F.lit(f"new {i}") for i in range(3)))))
    return new.select("rubric_id", flat("options").alias("options"), "correct_index")


# discovery and parsers


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1) AS host, CAST(generate_subscripts(l, 1) - 1 AS INT) AS "at", replace(unnest(l), '&amp;', '&') AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS l FROM pages))
SELECT "position", "at", url FROM (SELECT page_id AS "position", "at", host || split_part(href, '#', 1) AS url, row_number() OVER (PARTITION BY host || split_part(href, '#', 1) ORDER BY page_id, "at") AS n FROM l WHERE regexp_matches(split_part(href, '#', 1), '^/[A-Za-z]+$')) WHERE n = 1""")
def discovered_links(spark: SparkSession, d: str) -> DataFrame:
    index = markup.pages(views.html_pages(spark, d)).withColumnRenamed("page_id", "position")
    return links.discovered(index, "^/[A-Za-z]+$").select("position", "at", "url")


_LEAF = """p AS (SELECT p_partkey AS id, 'http://leaflets.example.com/' || p_partkey AS url, upper(left(p_name, 1)) || substr(p_name, 2) AS n, p_name AS low, lower(p_type) AS kind, p_brand AS brand,
  split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', -1) AS last, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) AS capital, p_partkey % 290 + 1 AS no, p_partkey % 290 + 2 AS more, chr(10) AS nl FROM part)"""


def _entries(m: str) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def _leaflets(spark: SparkSession, d: str, form: str) -> DataFrame:
    return leaflets.pages(spark, d, form).drop("id")


@query(f"""WITH {_LEAF} SELECT url, n AS remedy, 'Leaflet ' || id || '.' || nl || low || ' of ' || kind || nl || ' and ' || nl || n AS intro, low || ' of ' || kind || ',' || n AS keynotes,
  'Mind=Calm as ' || brand || '.|Modalities=Better, from ' || low || '; Worse, at ' || id || '.|Relationship=Compare: ' || n || ', Rhus.' AS fields, ', from ' || low || ';' AS better, ', at ' || id || '.' AS worse, capital || ',Rhus' AS related,
  'Leaflet ' || id || '.' || nl || low || ' of ' || kind || nl || ' and ' || nl || n || nl || 'Mind.--' || nl || 'Calm as ' || brand || '.' || nl || 'Modalities.--' || nl || 'Better, from ' || low || '; Worse, at ' || id || '.' || nl || 'Relationship.--' || nl || 'Compare: ' || n || ', Rhus.' AS raw_text FROM p""")
def extract_field_monographs(spark: SparkSession, d: str) -> DataFrame:
    r = extract.field_monographs(_leaflets(spark, d, "field_monographs"), "pages")
    return r.select("url", "remedy", "intro", flat("keynotes").alias("keynotes"), _entries("fields").alias("fields"), F.col("modalities")["better"].alias("better"), F.col("modalities")["worse"].alias("worse"), flat("relations.remedies").alias("related"), "raw_text")


@query(f"""WITH {_LEAF} SELECT url, n AS remedy, low || ' ' || kind AS clinical, 'Aggravation=At ' || id || '.|Amelioration=In rest.|Clinical=Used for ' || kind || '.|Mind=Calm as ' || brand || '. Again ' || id || '.|Relations=Compare ' || n || '.' AS fields, 'In rest.' AS better, 'At ' || id || '.' AS worse, capital AS related,
  low || ' ' || kind || ' -- Clinical.— Used for ' || kind || '. SYMPTOMS. Mind.— Calm as ' || brand || '. Aggravation.– At ' || id || '. Amelioration.— In rest. Relations.— Compare ' || n || '. Mind.— Again ' || id || '.' AS raw_text FROM p""")
def extract_dictionary_records(spark: SparkSession, d: str) -> DataFrame:
    r = extract.dictionary_records(_leaflets(spark, d, "dictionary_records"), "pages")
    return r.select("url", "remedy", flat("clinical").alias("clinical"), _entries("fields").alias("fields"), F.col("modalities")["better"].alias("better"), F.col("modalities")["worse"].alias("worse"), flat("relations.remedies").alias("related"), "raw_text")


@query(f"""WITH {_LEAF} SELECT url, n[1] || first[2:] || ' ' || upper(last[1]) || last[2:] AS remedy, n || ',Rhus tox' AS mentions, 'Compare ' || n || '.' AS relations, capital AS related, 'A leaflet of ten words or more about the ' || low || ' of part number ' || id || '. Compare ' || n || '.' AS raw_text FROM p""")
def extract_prose_records(spark: SparkSession, d: str) -> DataFrame:
    r = extract.prose_records(_leaflets(spark, d, "prose_records"), "pages")
    return r.select("url", "remedy", flat("remedy_mentions").alias("mentions"), F.col("relations.raw").alias("relations"), flat("relations.remedies").alias("related"), "raw_text")


@query(f"""WITH {_LEAF} SELECT url, n AS remedy, n || '. The leaflet' AS name_full, 'First of the ' || kind || ';,second of part ' || id || '.' AS keynotes, 'First of the ' || kind || '; second of part ' || id || '. Third.' AS keynotes_text, 'at ' || id || '.' AS worse, capital || ',Rhus' AS related FROM p
UNION ALL SELECT url, 'Other thing', 'Other thing. Of ' || brand, 'Nothing else is known here.', 'Nothing else is known here.', NULL, '' FROM p""")
def extract_keynote_records(spark: SparkSession, d: str) -> DataFrame:
    r = extract.keynote_records(_leaflets(spark, d, "keynote_records"), "pages")
    return r.select("url", "remedy", "name_full", flat("keynotes").alias("keynotes"), "keynotes_text", F.col("modalities")["worse"].alias("worse"), flat("relations.remedies").alias("related"))


@query(f"""WITH {_LEAF} SELECT url, n AS remedy, 7 AS n_symptoms, '1:Mind,2:Head: Hair,48:Relations' AS sections, 'Second thing of part ' || id || '.' AS important, 'fever ' || id AS clinical, capital || ',Rhus' AS related,
  n || '. Calm as ' || brand || '. Fears the ' || low || ' Second thing of part ' || id || '. Pain of ' || kind || '; At night ' || id || '. Compare ' || n || ', Rhus.' AS raw_text FROM p""")
def extract_sectioned_records(spark: SparkSession, d: str) -> DataFrame:
    r = extract.sectioned_records(_leaflets(spark, d, "sectioned_records"), "pages")
    each = F.flatten(F.transform("sections", lambda x: x["symptoms"]))
    titles = F.array_join(F.transform("sections", lambda x: F.concat(x["no"].cast("string"), F.lit(":"), x["name"])), ",")
    return r.select("url", "remedy", "n_symptoms", titles.alias("sections"), flat(F.filter(each, lambda x: x["important"]), "text").alias("important"), flat(F.filter(each, lambda x: x["clinical"].isNotNull()), "clinical").alias("clinical"), flat("relations.remedies").alias("related"), "raw_text")


@query(f"""WITH {_LEAF} SELECT url, 'Mind' AS chapter, 'Anger' AS rubric, id::VARCHAR AS page, first || ':3,' || last || ':2,' || kind || ':1' AS remedies, first AS grade3 FROM p UNION ALL SELECT url, 'Mind', 'Anger > evening ' || id, id::VARCHAR, first || ':2', '' FROM p
UNION ALL SELECT url, 'Head', 'Anger > Pain', id::VARCHAR, last || ':1', '' FROM p UNION ALL SELECT url, 'Head', 'Vertigo > rising', id::VARCHAR, first || ':3', first FROM p""")
def extract_rubric_records(spark: SparkSession, d: str) -> DataFrame:
    r = extract.rubric_records(_leaflets(spark, d, "rubric_records"), "pages", chapter_link="^/[a-z]+$")
    return r.select("url", "chapter", "rubric", "page", flat(F.transform("remedies", lambda x: F.concat(x["name"], F.lit(":"), x["grade"].cast("string")))).alias("remedies"), flat("grade3").alias("grade3"))


@query(f"""WITH {_LEAF} SELECT url || '#P' || no AS url, no::INT AS aphorism_no, 'The ' || low || ' of part ' || id || '.' AS text, '1:A note on ' || kind || '.' AS footnotes FROM p UNION ALL SELECT url || '#P' || more || 'E6', more::INT, 'The ' || kind || '.', '*:starred ' || id FROM p""")
def extract_aphorisms(spark: SparkSession, d: str) -> DataFrame:
    r = extract.aphorisms(_leaflets(spark, d, "aphorisms"), "pages")
    return r.select("url", "aphorism_no", "text", flat(F.transform("footnotes", lambda x: F.concat(x["marker"], F.lit(":"), x["text"]))).alias("footnotes"))


@query(f"""WITH {_LEAF} SELECT url, no::INT AS lecture_no, n || 's and their use' AS title, no || ' and ' || more AS reference, no || ',' || more AS aphorisms, array_to_string(list_sort(list_distinct([no, more, 7, 8, 9])), ',') AS mentions,
  n || 's and their use. The ' || low || ' of part ' || id || ' is named in § ' || more || ' and paragraph 7-9.' AS text, 19 AS n_words FROM p""")
def extract_lectures(spark: SparkSession, d: str) -> DataFrame:
    r = extract.lectures(_leaflets(spark, d, "lectures"), "pages")
    return r.select("url", "lecture_no", "title", "reference", flat("aphorisms").alias("aphorisms"), flat("mentions").alias("mentions"), "text", "n_words")


@query(f"""WITH {_LEAF}, r AS (
  SELECT 'sectioned_records' AS source, n || ' § Mind' AS locator, 'Calm as ' || brand || '. Fears the ' || low || ' Second thing of part ' || id || '.' AS text, true AS sparse, 'Materia Medica' AS subject, 1 AS section_no, true AS has_important FROM p
  UNION ALL SELECT 'sectioned_records', n || ' § Head: Hair', 'Pain of ' || kind || '; At night ' || id || '.', true, 'Materia Medica', 2, false FROM p
  UNION ALL SELECT 'sectioned_records', n || ' § Relations', 'Compare ' || n || ', Rhus.', true, 'Materia Medica', 48, false FROM p
  UNION ALL SELECT 'aphorisms', '§ ' || no, 'The ' || low || ' of part ' || id || '.', true, 'Organon of Medicine', NULL, NULL FROM p
  UNION ALL SELECT 'aphorisms', '§ ' || no || ', footnote 1', 'A note on ' || kind || '.', true, 'Organon of Medicine', NULL, NULL FROM p
  UNION ALL SELECT 'aphorisms', '§ ' || more, 'The ' || kind || '.', true, 'Organon of Medicine', NULL, NULL FROM p
  UNION ALL SELECT 'aphorisms', '§ ' || more || ', footnote *', 'starred ' || id, true, 'Organon of Medicine', NULL, NULL FROM p
  UNION ALL SELECT 'field_monographs', n || ' § ' || f.k, n || ' — ' || f.k || '. ' || f.v, len(string_split(f.v, ' ')) < 15 OR f.k = 'Relationship', 'Materia Medica', NULL, NULL
    FROM (SELECT n, unnest([{{'k': 'Mind', 'v': 'Calm as ' || brand || '.'}}, {{'k': 'Modalities', 'v': 'Better, from ' || low || '; Worse, at ' || id || '.'}}, {{'k': 'Relationship', 'v': 'Compare: ' || n || ', Rhus.'}}]) AS f FROM p)
  UNION ALL SELECT 'prose_records', n[1] || first[2:] || ' ' || upper(last[1]) || last[2:], 'A leaflet of ten words or more about the ' || low || ' of part number ' || id || '. Compare ' || n || '.', false, 'Materia Medica', NULL, NULL FROM p)
SELECT DISTINCT substr(sha1(source || '|' || locator || '|' || text), 1, 16) AS id, source, locator, text, sparse, subject, section_no, has_important FROM r""")
def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Leaflets of five forms parsed and flattened into passages with their subject."""
    forms = ("sectioned_records", "aphorisms", "field_monographs", "prose_records")
    records = {f: getattr(extract, f)(_leaflets(spark, d, f), "pages") for f in forms}
    return chunking.build(records).select("id", "source", "locator", "text", "sparse", "subject", "section_no", "has_important")


@query(f"""WITH {_LEAF} SELECT page.k AS page, page.t AS text FROM (SELECT id, unnest([{{'k': url || '/text', 't': 'The ' || low || ' of part ' || id || '.'}}]) AS page FROM p)""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Scripts, styles, comments and titles leave nothing of a page; entities and blanks are what they stand for."""
    f = leaflets.filled("<title>{n}</title><style>p{{margin:0}}</style><script>var t = '</p>';</script><!-- {id} --><p>The&nbsp;  {low}<br> of <b>part</b>\n{id} .</p>")
    return leaflets.walked(spark, d, f).select(F.concat("url", F.lit("/text")).alias("page"), text.collapse(text.clean(markup.plain(F.col("page.text")))).alias("text"))


@query(f"""WITH {_LEAF}, b AS (SELECT url, unnest([{{'a': 0, 'b': false, 't': 'The ' || low || ' of'}}, {{'a': 1, 'b': true, 't': 'Part ' || id || '.'}}, {{'a': 2, 'b': false, 't': 'Not ' || kind || '.'}}]) AS x FROM p) SELECT url, x.a AS at, x.b AS bold, x.t AS text FROM b""")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with their text, and whether most of it is bold."""
    f = leaflets.filled("<p>The <i>{low}</i> of</p><div><a name='x'></a><b>Part</b> <b>{id}.</b></div><p> </p><table><tr><td>Not <b>{kind}.</b> </td></tr></table>".replace("<b>{kind}.</b>", "{kind}."))
    b = leaflets.walked(spark, d, f).select("url", F.posexplode(extract.blocks(F.col("page.text"))).alias("at", "b"))
    return b.select("url", "at", F.col("b.bold").alias("bold"), F.col("b.text").alias("text"))


@query("SELECT unnest(['bold', 'italic']) AS kind, unnest([count(*), 0]) AS noise, unnest([0, count(*)]) AS short, unnest([2 * count(*), count(*)]) AS substantive FROM part")
def html_runs(spark: SparkSession, d: str) -> DataFrame:
    f = leaflets.filled("<p><b>--</b><strong>Number</strong> <i>ab</i></p><p><b>{low} {id}</b><em>{kind}</em></p>")
    return profile.run_sizes(leaflets.walked(spark, d, f))


@query(f"""WITH {_LEAF}, h AS (SELECT 'Aggravation:' AS h FROM p UNION ALL SELECT 'Relations.' FROM p UNION ALL SELECT n || '. The leaflet' FROM p UNION ALL SELECT 'Other thing. Of ' || brand FROM p) SELECT h AS heading, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def repeated_headings(spark: SparkSession, d: str) -> DataFrame:
    return profile.repeated_headings(_leaflets(spark, d, "keynote_records"))


# a build from index pages to records, and their files

_RECORDS = {"field_monographs": 1, "dictionary_records": 1, "prose_records": 1, "keynote_records": 2, "sectioned_records": 1, "rubric_records": 4, "aphorisms": 2, "lectures": 0}


# links as written that are rooted or go up and down again do not fit a pattern anchored at its beginning
_LINKED = {k: "count(*) FILTER (p_partkey % 10 NOT IN (4, 5))" if k in ("field_monographs", "dictionary_records") else "count(*)" for k in _RECORDS}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS n_pages, {n} * {c} AS n_accepted, {0 if n else 1} * {c} AS n_rejected FROM part WHERE p_partkey % 10 <> 3" for (k, n), c in zip(_RECORDS.items(), _LINKED.values())))
def registry_build(spark: SparkSession, d: str) -> DataFrame:
    """All collections of the registry: linked leaflets parsed, thin lectures set aside."""
    out, indexes = None, {}
    for kind in stores.REGISTRY:
        name = "p{id}x.htm" if kind == "keynote_records" else "lect{id}.htm"
        if name not in indexes:  # an index names the pages of several collections
            indexes[name] = build.written(leaflets.indexes(spark, d, name), "index")
        bits = name.split("{id}")
        pages = leaflets.pages(spark, d, kind).withColumn("url", F.concat(F.lit("http://leaflets.example.com/a/" + bits[0]), F.col("id").cast("string"), F.lit(bits[1]))).drop("id")
        more = {"chapter_link": "^/[a-z]+$"} if kind == "rubric_records" else {}
        one = build.summary(kind, *build.parsed(kind, indexes[name], pages, **more))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_LEAF} SELECT 'http://leaflets.example.com/a/lect' || id || '.htm' AS url, n || ' ' || id AS name, 'leaflet' AS abbrev FROM p WHERE id % 10 <> 3""")
def named_pages(spark: SparkSession, d: str) -> DataFrame:
    return links.named_pages(leaflets.indexes(spark, d), r"lect\d+\.htm$", r"main\.htm")


@query(f"""WITH {_LEAF} SELECT 'http://leaflets.example.com/a/lect' || id || '.htm' AS url FROM p WHERE id % 10 <> 3 ORDER BY 1""")
def two_level_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that an index names, and the pages that those link to; front matter is left out."""
    fields = "<a href='x/0.htm'>Title</a><a href='x/1.htm'>One</a>"
    top = markup.pages(spark.createDataFrame([("http://leaflets.example.com/top.htm", 0, fields)], "url string, position int, html string"))
    chapters = leaflets.indexes(spark, d).withColumn("url", F.lit("http://leaflets.example.com/x/1.htm")).withColumn("page", F.col("page"))
    base = links.two_level(top, r"x/\d+\.htm", r"x/0\.htm", chapters, r"lect\d+\.htm$")
    return base.select(F.regexp_replace("url", "/x/a/", "/a/").alias("url")).distinct()


@query("SELECT page_id, CASE WHEN contains(url, '://www.') THEN replace(url, '://www.', '://') ELSE replace(url, '://', '://www.') END AS url FROM pages")
def other_hosts(spark: SparkSession, d: str) -> DataFrame:
    return views.load(spark, d, "pages").select("page_id", links.other_host(F.col("url")).alias("url"))


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def json_array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records as one JSON array in one file, read back by its schema."""
    df = views.load(spark, d, "supplier").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")))
    at = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    stores.write_json_array(df, at, "s_suppkey")
    return stores.records(spark, at, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


@query("SELECT n_name, n_nationkey, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'late', 99, 1")
def json_lines_log(spark: SparkSession, d: str) -> DataFrame:
    """Records as lines, a log that grows, and lines without the required field left out."""
    df = views.load(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("n_name"), "n_nationkey", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    at, schema = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    stores.write_json_lines(df, at)
    stores.append_log(spark.createDataFrame([("late", 99, 1)], schema), at)
    return stores.json_lines(spark, at, schema, required="n_name")


@query("SELECT r_regionkey, r_name FROM region")
def table_if_missing(spark: SparkSession, d: str) -> DataFrame:
    """A table is built where it is missing and left as it is where it is there."""
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    make = lambda more: lambda: views.load(spark, d, "region").select(F.col("r_regionkey") + more, "r_name").toDF("r_regionkey", "r_name")
    stores.ensure(spark, at, make(0))
    return stores.ensure(spark, at, make(1000))


@query("SELECT p_partkey AS id, p_name AS text FROM part")
def rule_stripped(spark: SparkSession, d: str) -> DataFrame:
    """A box-drawing dash before a text goes, one inside stays away from it."""
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("─ "), "p_name")).otherwise(F.col("p_name"))
    return views.load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.strip_rule(t).alias("text"))


@query(f"""WITH t AS (SELECT DISTINCT conv_id AS session, 'topic ' || conv_id % 5 AS topic FROM conversations), c AS (SELECT DISTINCT 'topic ' || p_partkey % 6 AS topic, p_name || ' ' || p_partkey AS question FROM part),
  ring AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(concat_ws('|', topic, question, '{SEED}')), question) - 1 AS place, count(*) OVER (PARTITION BY topic) AS n FROM c),
  had AS (SELECT conv_id AS session, p_name || ' ' || p_partkey AS question FROM (SELECT DISTINCT conv_id, turn FROM conversations) JOIN part ON p_partkey = conv_id % 5 + 6 * turn),
  s AS (SELECT t.session, t.topic, ('0x' || substr(md5(concat_ws('|', t.session::VARCHAR, t.topic, '{SEED}')), 1, 8))::BIGINT AS h FROM t),
  f AS (SELECT s.session, s.topic, arg_min(question, (place - h % n + n) % n) AS question FROM s JOIN ring USING (topic) WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.session = s.session AND had.question = ring.question) GROUP BY 1, 2)
SELECT t.session, t.topic, question FROM t LEFT JOIN f USING (session, topic)""")
def next_questions(spark: SparkSession, d: str) -> DataFrame:
    """What each session is asked next, of what it has not had."""
    c, p = views.load(spark, d, "conversations"), views.load(spark, d, "part")
    question = F.concat("p_name", F.lit(" "), "p_partkey")
    topics = c.select(F.col("conv_id").alias("session"), F.concat(F.lit("topic "), F.col("conv_id") % 5).alias("topic")).distinct()
    had = c.select(F.col("conv_id").alias("session"), (F.col("conv_id") % 5 + 6 * F.col("turn")).alias("p_partkey")).distinct().join(p, "p_partkey").select("session", question.alias("question"))
    return sessions.next_questions(topics, p.select(F.concat(F.lit("topic "), F.col("p_partkey") % 6).alias("topic"), question.alias("question")), had, SEED)


@query("SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '') AS answer, 'coaching' AS task, 'stand-in' AS model, NULL::VARCHAR AS error FROM documents")
def logged_calls(spark: SparkSession, d: str) -> DataFrame:
    """The plug point for model calls with a stand-in for the model."""
    rows = views.documents(spark, d).select("doc_id", F.col("text").alias("prompt"))
    return calls.called(rows, lambda r: {"answer": r["prompt"][::-1]}, "answer string", 60_000, "coaching", "stand-in").select("doc_id", "answer", "task", "model", "error")


@query(f"""WITH {ANS}, t AS (SELECT *, make_timestamp((1704067200 + session * 600 + turn * 60) * 1000000) AS ts FROM ans), mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM t),
  m AS (SELECT session, topic, count(*) AS misses, min(turn) AS first FROM t WHERE NOT correct GROUP BY 1, 2),
  w AS (SELECT session, string_agg(topic, ', ' ORDER BY misses DESC, first, topic) AS weak FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY misses DESC, first, topic) AS place FROM m) WHERE place <= 3 GROUP BY 1)
SELECT t.session, count(*) AS answered, count(*) FILTER (correct) AS correct, CAST(round(100 * count(*) FILTER (correct) / count(*)::DOUBLE, 0) AS INT) AS percent, coalesce(any_value(weak), '') AS weak
FROM t LEFT JOIN w ON w.session = t.session, mark GROUP BY t.session HAVING max(ts) + INTERVAL 1801 SECOND <= any_value(mark.w)""")
def closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as keyed state of a stream, closed by a timer once they are quiet; those still open at the end send nothing."""
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]").where("role = 'user'")
    answers = turns.select(F.col("conv_id").alias("session"), "turn", F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("topic"), (F.length("text") % 3 != 0).alias("correct"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 60).alias("ts"))
    with live_sessions.with_rocksdb(spark):
        return drain.drained(live_sessions.closed_sessions(answers, "1801 seconds"), "sessions")


@query(f"""WITH {MET}, l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM met WHERE latency_ms IS NOT NULL),
  c AS (SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d') AS day, task, coalesce(path, 'generative') AS path FROM met, l WHERE latency_ms IS NOT NULL AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark)
SELECT level, label, count(*) AS n, true AS p50_near, true AS p95_near FROM (SELECT 'day' AS level, day AS label FROM c UNION ALL SELECT 'task', task FROM c UNION ALL SELECT 'path', path FROM c) GROUP BY ALL""")
def latency_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the event stream kept as sketches and merged to day, task and path; each estimate's exact rank is near the asked one."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema

    def calls_of(e: DataFrame) -> DataFrame:
        return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("task"), F.when(F.get_json_object("props", "$.k").cast("int") % 10 != 0, "deterministic").alias("path"), F.col("value").alias("latency_ms"))

    windows = drain.drained(sketches.sketched(calls_of(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))), "sketches")
    told = sketches.merged(windows).select("level", "label", "n", sketches.quantile(F.col("sketch"), 0.5).alias("p50"), sketches.quantile(F.col("sketch"), 0.95).alias("p95"))
    closed = windows.select(F.col("start").alias("hour")).distinct()
    exact = calls_of(views.load(spark, d, "events")).where("latency_ms is not null").withColumn("hour", F.date_trunc("hour", "ts")).join(closed, "hour", "left_semi")
    exact = exact.select("latency_ms", sketches.levels(F.col("ts"), F.col("task"), F.coalesce("path", F.lit("generative"))).alias("g")).select("latency_ms", "g.*")
    ranked = exact.join(told, ["level", "label"]).groupBy("level", "label", "n")

    def near(p: str, at: float) -> Column:
        return ((F.count_if(F.col("latency_ms") < F.col(p)) / F.count("*") <= at + sketches.RANK_ERROR) & (F.count_if(F.col("latency_ms") <= F.col(p)) / F.count("*") >= at - sketches.RANK_ERROR)).alias(f"{p}_near")

    return ranked.agg(near("p50", 0.5), near("p95", 0.95))


# discovery and contracts


@query("""WITH RECURSIVE l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS h FROM pages), e AS (SELECT 'page ' || page_id AS src, 'to ' || replace(h, '&amp;', '&') AS dst FROM l UNION SELECT 'to ' || replace(h, '&amp;', '&'), 'page ' || page_id FROM l),
  r(node, depth) AS (SELECT 'page 0', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 7)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def frontier_depths(spark: SparkSession, d: str) -> DataFrame:
    """What the first page reaches over its links and the pages that share them, with the fewest steps."""
    l = markup.pages(views.html_pages(spark, d)).select(F.concat(F.lit("page "), "page_id").alias("page"), F.explode("page.links").alias("l")).select("page", F.concat(F.lit("to "), "l.href").alias("to")).distinct()
    edges = l.select(F.col("page").alias("src"), F.col("to").alias("dst")).unionByName(l.select(F.col("to").alias("src"), F.col("page").alias("dst")))
    return frontier.reached(edges, spark.createDataFrame([("page 0",)], "node string"), 7)


_PROPS = """CASE event_id % 10 WHEN 1 THEN left(props, length(props) - 1) WHEN 2 THEN replace(replace(props, ': ', ': "'), '}', '"}') WHEN 3 THEN '{}' WHEN 4 THEN replace(props, ': ', ': -1') WHEN 5 THEN NULL WHEN 6 THEN '[1]' WHEN 7 THEN replace(props, '}', ', "kind": "odd"}') ELSE props END"""


def _contract(spark: SparkSession, d: str) -> DataFrame:
    rows = views.load(spark, d, "events").select("event_id", F.expr(_PROPS).alias("p"))
    return contracts.checked(rows, "p", [contracts.Field("k", "$.k", "bigint", least=0, most=99), contracts.Field("kind", "$.kind", "string", required=False, among=("plain",))])


@query(f"""SELECT event_id, (p->>'$.k')::BIGINT AS k FROM (SELECT event_id, {_PROPS} AS p FROM events) WHERE event_id % 10 IN (0, 8, 9)""")
def contract_good(spark: SparkSession, d: str) -> DataFrame:
    """Events whose properties keep their contract, typed."""
    return contracts.good(_contract(spark, d)).select("event_id", "k")


@query("""SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'p: not JSON' WHEN 2 THEN 'k: not bigint' WHEN 3 THEN 'k: missing' WHEN 4 THEN 'k: below 0' WHEN 5 THEN 'p: null' WHEN 6 THEN 'p: not an object' ELSE 'kind: not listed' END AS reason FROM events WHERE event_id % 10 BETWEEN 1 AND 7""")
def contract_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Events that break it, a row a reason."""
    return contracts.quarantined(_contract(spark, d), "event_id")


# versions of a collection


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, vec_id % 7 = 3 AND label = 4 AS changed FROM embeddings")
def merged_collection(spark: SparkSession, d: str) -> DataFrame:
    """A collection built twice: the second time one label's rows have changed, and only they are written again."""
    v = Versions(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}")
    rows = views.load(spark, d, "embeddings").select("vec_id", "label", "embedding", F.lit(False).alias("changed"))
    merge_collection(v, rows, "label")
    merge_collection(v, rows.withColumn("changed", (F.col("vec_id") % 7 == 3) & (F.col("label") == 4)), "label")
    now = v.read(v.parts(), rows.schema)
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return now.select("vec_id", "label", F.round(total, 4).alias("total"), "changed")


# streams


@query(f"""WITH {MET}, l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM met WHERE latency_ms IS NOT NULL)
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, task, coalesce(path, 'generative') AS path, count(*) AS n, round(sum(latency_ms), 2) AS total_ms FROM met, l WHERE latency_ms IS NOT NULL AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def latency_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latency windows of events read as a stream; the last windows stay open behind the watermark."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("int")
    m = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("task"), F.when(k % 10 != 0, "deterministic").alias("path"), F.col("value").alias("latency_ms"))
    return drain.drained(latency.windowed(m), "latency").select("start", "task", "path", "n", F.round("total_ms", 2).alias("total_ms"))


# logs and archives that grow


@query("SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, props FROM events")
def followed_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of events followed as a stream: drained, appended to, and drained again from the checkpoint."""
    at, schema = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", "event_id bigint, us bigint, user_id bigint, event_type string, value double, props string"
    rows = views.load(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", "props")
    late = F.col("event_id") % 3 == 0
    stores.append_log(rows.where(~late), f"{at}/log")
    drain.drained_at(growing.follow(spark, f"{at}/log", schema), at)
    stores.append_log(rows.where(late), f"{at}/log")
    return drain.drained_at(growing.follow(spark, f"{at}/log", schema), at)


@query("SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def page_archive(spark: SparkSession, d: str) -> DataFrame:
    """Pages kept as lines of an archive, read back by ranges of bytes."""
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    stores.append_log(views.load(spark, d, "pages").select("page_id", "url", "html"), at)
    return growing.read(spark, at, "page_id bigint, url string, html string", 1 << 20).select("page_id", "url", F.md5("html").alias("html_md5"))
