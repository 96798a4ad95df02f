"""Profiles of record sets and raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import share_floor
from ..functions.text import collapse, strip
from ..sources.markup import BOLD, BOLD_END, ITALIC, ITALIC_END, plain

BUCKET = 1 << 16


def gaps(numbers: DataFrame, column: str) -> DataFrame:
    """Missing numbers between the least and the greatest: a row a gap (after, n_missing), so a wide gap is one row."""
    n = numbers.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("n")).distinct().withColumn("bucket", F.floor(F.col("n") / BUCKET))
    inside = n.select("n", F.lead("n").over(Window.partitionBy("bucket").orderBy("n")).alias("next"))
    # the last number of a bucket is followed by the first of the next bucket that has any: a row a bucket
    edges = n.groupBy("bucket").agg(F.max("n").alias("n"), F.min("n").alias("first"))
    across = edges.select("n", F.lead("first").over(Window.orderBy("bucket")).alias("next"))
    return inside.unionByName(across).where("next > n + 1").select(F.col("n").alias("after"), (F.col("next") - F.col("n") - 1).alias("n_missing"))


def missing(numbers: DataFrame, column: str) -> DataFrame:
    """Each missing number between the least and the greatest."""
    g = gaps(numbers, column)
    return g.select(F.explode(F.sequence(F.col("after") + 1, F.col("after") + F.col("n_missing"))).alias(column))


def shares(records: DataFrame, by: list[str], **conditions) -> DataFrame:
    """n and, for each named condition, how many rows meet it and the whole percent, rounded down."""
    g = records.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{k}") for k, c in conditions.items()))
    return g.select(*by, "n", *(F.col(f"n_{k}") for k in conditions), *(share_floor(F.col(f"n_{k}"), F.col("n")).alias(f"{k}_percent") for k in conditions))


def grade_histogram(records: DataFrame) -> DataFrame:
    """Entries of nested rubric records by grade; a missing grade counts as 1."""
    return records.select(F.explode("remedies").alias("r")).groupBy(F.coalesce("r.grade", F.lit(1)).alias("grade")).agg(F.count("*").alias("n"))


def largest(pages: DataFrame, size: str = "size") -> DataFrame:
    """The largest page; of equals the first path."""
    return pages.orderBy(F.desc(size), "path").limit(1)


def tag_counts(pages: DataFrame, top: int = 10) -> DataFrame:
    return pages.select(F.explode("page.tags").alias("tag", "n")).groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def run_sizes(pages: DataFrame) -> DataFrame:
    """Bold and italic runs: noise (symbols only), short (under four characters) and substantive."""
    found = None
    for kind, a, z in (("bold", BOLD, BOLD_END), ("italic", ITALIC, ITALIC_END)):
        one = pages.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("page.text", F.lit(f"{a}([^{z}]*){z}"), F.lit(1))).alias("t"))
        found = one if found is None else found.unionByName(one)
    t = collapse(plain(F.col("t")))
    noise = (t == "") | t.rlike(r"^[\s<>_.,;:*+=|/\\\-]{1,3}$")
    return found.groupBy("kind").agg(F.count_if(noise).alias("noise"), F.count_if(~noise & (F.length(t) < 4)).alias("short"), F.count_if(~noise & (F.length(t) >= 4)).alias("substantive"))


def repeated_headings(pages: DataFrame, top: int = 20) -> DataFrame:
    """Bold texts of 4 to 44 characters that begin with a capital, most frequent first."""
    t = strip(collapse(plain(F.col("t"))))
    h = pages.select(F.explode(F.regexp_extract_all("page.text", F.lit(f"{BOLD}([^{BOLD_END}]*){BOLD_END}"), F.lit(1))).alias("t")).select(t.alias("heading"))
    return h.where("length(heading) between 4 and 44").where(F.col("heading").rlike(r"^\p{Lu}")).groupBy("heading").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "heading").limit(top)
