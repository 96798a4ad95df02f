"""The provided tables seen as the data the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = 500_000  #: order lines that a task puts together, about


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a file of one row group is one split, and work on texts is worth a small shuffle.

    Tables of more splits than cores stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def rubrics(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chapter"), F.col("p_name").alias("rubric"), F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("url"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part, supplier and flag of order lines: grade by flag, canonical for three suppliers in five."""
    e = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    grade = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return e.join(s, e["l_suppkey"] == s["s_suppkey"]).select(F.col("l_partkey").alias("rubric_id"), F.col("s_name").alias("remedy_raw"), F.when(F.col("l_suppkey") % 5 >= 2, F.col("s_name")).alias("remedy_canonical"), grade.alias("grade"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents"))


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as passages before ids: source is the book, language the subject."""
    t = documents(spark, d)
    return t.select("doc_id", "text", "source", F.lit("").alias("layer"), F.concat("source", F.lit(" § "), "doc_id").alias("locator"), F.lit(None).cast("string").alias("url"), F.col("lang").alias("subject"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with the text of the document of the same id, where there is one; odd ids are sparse."""
    e = load(spark, d, "embeddings")
    t = documents(spark, d).select(F.col("doc_id").alias("id"), "text", F.concat("source", F.lit(" § "), "doc_id").alias("locator"))
    v = e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("subject"), (F.col("vec_id") % 2 == 1).alias("sparse"))
    return v.join(t, "id", "left")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events as model calls; a path is missing where k is divisible by ten."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select("ts", F.col("event_type").alias("task"), F.when(k % 10 != 0, "deterministic").alias("path"), F.col("value").alias("latency_ms"), (k * 40 + 100).alias("input_tokens"), F.when(k % 3 != 0, k * 10).alias("output_tokens"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as statements of suppliers: section by part size, important when returned, a condition for finished lines of small parts.

    Lines are dealt by their text over as many tasks as LINES a task need, and put together there,
    so what a task holds does not follow the input.
    """
    l = load(spark, d, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-l.count() // LINES))
    l = l.select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "F").alias("finished"))
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type")
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    x = l.join(p, l["l_partkey"] == p["p_partkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    condition = F.when(F.col("finished") & (F.col("p_size") <= 5), F.col("p_type")).alias("condition")
    x = x.select(F.col("s_name").alias("remedy"), F.col("p_size").alias("section_no"), F.concat("p_name", F.lit(" "), "p_partkey").alias("text"), "returned", condition).repartition(tasks, "text")
    return x.groupBy("remedy", "section_no", "text").agg(F.bool_or("returned").alias("important"), F.max("condition").alias("clinical")).withColumn("section_name", F.concat(F.lit("Section "), "section_no"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """User turns as answers: the topic is the first word, right unless the length is divisible by three."""
    c = load(spark, d, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("session"), "turn", F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("topic"), (F.length("text") % 3 != 0).alias("correct"))


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "pages"))
