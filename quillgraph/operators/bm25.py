"""Keyword search with BM25 over a postings table.

Postings (term, id, positions, length) are made once. A query is a list of quoted phrases,
all of which must occur; a phrase of several tokens must occur as consecutive tokens. Lower
scores are better. Columns of text are searched as one text without phrases across columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_tokens, query_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_column: str, *text: str) -> DataFrame:
    """term, id, positions (ascending), length (tokens of all columns), a row for each term of a document."""
    tokens = [index_tokens(F.coalesce(F.col(c), F.lit(""))) for c in text]
    columns = docs.select(F.col(id_column).alias("id"), F.array(*tokens).alias("columns"))
    sized = columns.withColumn("length", F.aggregate("columns", F.lit(0).cast("bigint"), lambda n, t: n + F.size(t)))
    places = sized.select("id", "length", F.posexplode("columns").alias("c", "tokens")).select("id", "length", "c", F.posexplode("tokens").alias("at", "term"))
    at = F.col("at").cast("bigint") + F.col("c").cast("bigint") * F.lit(1 << 40)  # no phrase goes over columns
    return places.groupBy("term", "id", "length").agg(F.array_sort(F.collect_list(at)).alias("positions")).select("term", "id", "positions", "length")


def corpus_statistics(docs: DataFrame, id_column: str, *text: str) -> DataFrame:
    """n (all rows) and avgdl (mean tokens of all columns), in one row."""
    tokens = sum((F.size(index_tokens(F.coalesce(F.col(c), F.lit("")))) for c in text), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(tokens).alias("avgdl"))


def phrases(spark: SparkSession, query: str) -> list[list[str]]:
    """Tokens of each phrase of a query; phrases without a word character are left out."""
    row = spark.range(1).select(F.transform(query_tokens(F.lit(query)), index_tokens).alias("p")).first()
    return [p for p in row.p if p]


def search(index: DataFrame, statistics: DataFrame, query: str, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """id and score of the k best, by score and id. ``among`` (column id) filters after scoring: it changes no weight."""
    spark = index.sparkSession
    asked = phrases(spark, query)
    if not asked:
        return spark.createDataFrame([], f"id {index.schema['id'].dataType.simpleString()}, score double")
    terms = spark.createDataFrame([Row(p=p, i=i, term=t) for p, toks in enumerate(asked) for i, t in enumerate(toks)], "p int, i int, term string")
    # as many rows as the query has words; the semi-join goes below the grouping of the postings
    hit = index.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").join(F.broadcast(terms), "term")
    # a phrase starts where each of its tokens stands at its own offset
    starts = hit.select("p", "id", "length", "i", F.transform("positions", lambda x: x - F.col("i")).alias("s"))
    sizes = F.element_at(F.array(*(F.lit(len(t)) for t in asked)), F.col("p") + 1)
    grouped = starts.groupBy("p", "id", "length").agg(F.collect_list("s").alias("lists")).where(F.size("lists") == sizes)
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1), lambda acc, x: F.array_intersect(acc, x))
    matched = grouped.select("p", "id", "length", F.size(both).alias("f")).where("f > 0")
    df = matched.groupBy("p").agg(F.count("*").alias("df"))
    scored = matched.join(F.broadcast(df), "p").crossJoin(F.broadcast(statistics))  # a row a phrase, and one row
    idf = F.ln((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    f = F.col("f").cast("double")
    part = idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("avgdl")))
    out = scored.groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("m")).where(F.col("m") == len(asked)).select("id", "score")
    if among is not None:
        out = out.join(among.select("id"), "id", "left_semi")
    return out.orderBy(F.round("score", 9), "id").limit(k)
