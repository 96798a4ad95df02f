"""Graded membership: rubrics (id, chapter, rubric, page, url) and their entries (rubric_id, remedy_raw, remedy_canonical, grade).

Entries have no key: the same name may stand twice under a rubric, at equal or different
grades. Every limit has a total order, and every draw an explicit seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import draw_key, share_floor
from .order import numbered


def members(entries: DataFrame) -> DataFrame:
    """rubric_id and its entries as an ordered array: grade falling, then name."""
    item = F.struct((-F.col("grade")).alias("down"), "remedy_raw", "remedy_canonical", "grade")
    listed = entries.groupBy("rubric_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    return listed.select("rubric_id", F.transform("m", lambda x: F.struct(x["remedy_raw"].alias("remedy_raw"), x["remedy_canonical"].alias("remedy_canonical"), x["grade"].alias("grade"))).alias("remedies"))


def with_members(rubrics: DataFrame, entries: DataFrame) -> DataFrame:
    """Rubrics with their entries (an empty array without any); one join instead of a load per rubric."""
    m = members(entries)
    return rubrics.join(m, rubrics["id"] == m["rubric_id"], "left").drop("rubric_id").withColumn("remedies", F.coalesce("remedies", F.array().cast(m.schema["remedies"].dataType)))


def grade3(remedies: Column) -> Column:
    return F.filter(remedies, lambda r: r["grade"] == 3)


def rubric(rubrics: DataFrame, entries: DataFrame, rubric_id: int) -> DataFrame:
    """One rubric with its entries, or no row."""
    return with_members(rubrics.where(F.col("id") == rubric_id), entries.where(F.col("rubric_id") == rubric_id))


def entries_of(entries: DataFrame, rubric_id: int) -> DataFrame:
    return entries.where(F.col("rubric_id") == rubric_id).select("remedy_raw", "remedy_canonical", "grade")


def graded_rubrics(rubrics: DataFrame, entries: DataFrame, remedy: str, chapter: str | None = None, k: int = 50, grade: int = 3) -> DataFrame:
    """Distinct rubrics where a remedy has the grade, by chapter, rubric and id; the first k."""
    hit = entries.where((F.col("remedy_canonical") == remedy) & (F.col("grade") == grade)).select("rubric_id").distinct()
    out = rubrics if chapter is None else rubrics.where(F.col("chapter") == chapter)
    return out.join(hit, out["id"] == hit["rubric_id"], "left_semi").orderBy("chapter", "rubric", "id").limit(k)


def chapters(rubrics: DataFrame) -> DataFrame:
    return rubrics.select("chapter").distinct().orderBy("chapter")


def random_graded(rubrics: DataFrame, entries: DataFrame, k: int, seed: int | str, grade: int = 3) -> DataFrame:
    """k seeded rubrics among those with an entry of the grade."""
    hit = entries.where(F.col("grade") == grade).select("rubric_id")
    return rubrics.join(hit, rubrics["id"] == hit["rubric_id"], "left_semi").orderBy(draw_key("id", seed=seed), "id").limit(k)


def graded_remedies(entries: DataFrame, k: int | None = None, seed: int | str = 0, grade: int = 3) -> DataFrame:
    """Distinct canonical names with an entry of the grade; all, or k seeded ones."""
    out = entries.where((F.col("grade") == grade) & F.col("remedy_canonical").isNotNull()).select("remedy_canonical").distinct()
    return out if k is None else out.orderBy(draw_key("remedy_canonical", seed=seed), "remedy_canonical").limit(k)


def sample_rubrics(rubrics: DataFrame, chapter: str, exclude: DataFrame, k: int, seed: int | str) -> DataFrame:
    """k seeded rubrics of a chapter outside ``exclude`` (column id); null ids exclude nothing."""
    out = rubrics.where(F.col("chapter") == chapter).join(exclude.select("id"), "id", "left_anti")
    return out.orderBy(draw_key("id", seed=seed), "id").limit(k)


def eligible(rubrics: DataFrame, entries: DataFrame, grade3_least: int = 1, grade1_least: int = 3) -> DataFrame:
    """Rubrics with enough entries of grades 3 and 1, and both counts."""
    counts = entries.groupBy("rubric_id").agg(F.count_if(F.col("grade") == 3).alias("n_grade3"), F.count_if(F.col("grade") == 1).alias("n_grade1"))
    counts = counts.where((F.col("n_grade3") >= grade3_least) & (F.col("n_grade1") >= grade1_least))
    return rubrics.join(counts, rubrics["id"] == counts["rubric_id"]).drop("rubric_id")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, cap: int, seed: int | str) -> DataFrame:
    """n rows taken in turns from shuffled strata, at most ``cap`` of each.

    The round is a row's rank in its stratum; ranks above the cap are dropped while ranking.
    """
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(draw_key(key, seed=seed), key))
    ranked = rows.withColumn("turn", turn).where(F.col("turn") <= cap)
    return ranked.orderBy("turn", draw_key(stratum, seed=seed), stratum).limit(n)


def gold_forward(rubrics: DataFrame, entries: DataFrame, n: int, cap: int, seed: int | str) -> DataFrame:
    """Cases that ask for a grade-3 name of a rubric: the answer, all right names and the pool of wrong ones."""
    picked = stratified(eligible(rubrics, entries), "chapter", "id", n, cap, seed).select("id", "chapter", "rubric", "page")
    e = picked.join(entries, picked["id"] == entries["rubric_id"])
    right, wrong = F.when(F.col("grade") == 3, F.col("remedy_raw")), F.when(F.col("grade") == 1, F.col("remedy_raw"))
    answer = F.min(F.when(F.col("grade") == 3, F.struct(draw_key("id", "remedy_raw", seed=seed).alias("o"), "remedy_raw")))["remedy_raw"]
    cases = e.groupBy("id", "chapter", "rubric", "page").agg(answer.alias("correct_remedy"), F.array_sort(F.collect_list(right)).alias("grade3_all"), F.array_sort(F.collect_list(wrong)).alias("distractor_pool"))
    return cases.select(F.concat(F.lit("fwd-"), F.col("id")).alias("id"), F.col("id").alias("rubric_id"), "chapter", "rubric", "correct_remedy", "grade3_all", "distractor_pool", "page", F.lit("answerable").alias("expect"), F.lit("rubric_to_remedy").alias("qtype"), F.lit("deterministic").alias("path"))


def gold_reverse(rubrics: DataFrame, entries: DataFrame, n: int, seed: int | str, most: int = 5000) -> DataFrame:
    """Cases that ask for a rubric of a remedy: all labels where it has grade 3, the first ``most``."""
    names = graded_remedies(entries, n, seed)
    e = entries.where("grade = 3").join(F.broadcast(names), "remedy_canonical").select("remedy_canonical", "rubric_id").distinct()
    hits = e.join(rubrics, e["rubric_id"] == rubrics["id"]).select("remedy_canonical", "chapter", "rubric", "id")
    rank = F.row_number().over(Window.partitionBy("remedy_canonical").orderBy("chapter", "rubric", "id"))
    kept = hits.withColumn("at", rank).where(F.col("at") <= most)
    listed = kept.groupBy("remedy_canonical").agg(F.array_sort(F.collect_set("rubric")).alias("expect_rubrics"))
    return listed.select(F.concat(F.lit("rev-"), F.col("remedy_canonical")).alias("id"), F.col("remedy_canonical").alias("remedy"), F.lit("remedy_to_rubric").alias("qtype"), "expect_rubrics", F.lit("deterministic").alias("path"))


def normalized(records: DataFrame, order: list[str], aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rubrics and entries of nested records; ids follow ``order``, names resolve by ``aliases`` (name, canonical).

    Records whose grade-3 entries are not all in their list ``grade3`` stop the load.
    """
    rows = numbered(records.drop("id"), order, "id") if "id" not in order else numbered(records.withColumnRenamed("id", "_id"), ["_id" if c == "id" else c for c in order], "id").drop("_id")
    listed = F.forall("remedies", lambda r: (r["grade"] != 3) | F.array_contains(F.coalesce(F.col("grade3"), F.array().cast("array<string>")), r["name"]))
    checked = rows.withColumn("rubric", F.when(F.coalesce(listed, F.lit(True)), F.col("rubric")).otherwise(F.raise_error(F.concat(F.lit("grade 3 entries of rubric "), F.col("id"), F.lit(" are not listed")))))
    rubrics = checked.select("id", "chapter", "rubric", "page", "url")
    entries = checked.select(F.col("id").alias("rubric_id"), F.explode("remedies").alias("r")).select("rubric_id", F.col("r.name").alias("remedy_raw"), F.col("r.grade").alias("grade"))
    if aliases is None:
        return rubrics, entries.select("rubric_id", "remedy_raw", F.lit(None).cast("string").alias("remedy_canonical"), "grade")
    names = aliases.select(F.col("name").alias("remedy_raw"), F.col("canonical").alias("remedy_canonical"))
    return rubrics, entries.join(names, "remedy_raw", "left").select("rubric_id", "remedy_raw", "remedy_canonical", "grade")


def summary(rubrics: DataFrame, entries: DataFrame) -> DataFrame:
    """Rubrics, chapters, entries, those of grade 3 and the whole percent resolved, in one row."""
    r = rubrics.agg(F.count("*").alias("n_rubrics"), F.count_distinct("chapter").alias("n_chapters"))
    e = entries.agg(F.count("*").alias("n_entries"), F.count_if(F.col("grade") == 3).alias("n_grade3"), F.count("remedy_canonical").alias("n_resolved"))
    return r.crossJoin(e).withColumn("resolved_percent", share_floor(F.col("n_resolved"), F.col("n_entries")))  # one row each
