"""Multiple-choice questions from graded membership and statements: seeded, set-based, one row a question.

Options are in the order of a hash, so a question is the same wherever it is made. Names of
collections that appear in wording are parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import digest
from ..functions.stats import draw_key, uniform
from ..session import shared_dir

DISTRACTORS, SAMPLED = 3, 20
LIKELY, TILE = 100, 4096  #: rows of a pool expected below the bound of its draw; names, and rubrics, of a tile about
RATE, ELIGIBLE = 0.40, ("Repertory", "Materia Medica")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from files in the shared folder, made once however often they are read."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _assembled(rows: DataFrame, key: list[str], correct: str, wrong: str, seed: int | str) -> DataFrame:
    """options (in hash order), correct_index of rows with a right answer and an array of wrong ones; four options exactly."""
    options = F.concat(F.array(F.col(correct)), F.col(wrong))
    ordered = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(draw_key(*key, o, seed=seed).alias("h"), o.alias("o")))), lambda x: x["o"])
    r = rows.where(F.size(wrong) == DISTRACTORS).withColumn("options", ordered)
    return r.withColumn("correct_index", (F.array_position("options", F.col(correct)) - 1).cast("int"))


def rubric_to_remedy(rubrics: DataFrame, entries: DataFrame, seed: int | str, wording: str = 'Which remedy is graded 3 under the rubric "%s" (%s)?') -> DataFrame:
    """For each rubric with a grade-3 entry and three other distinct grade-1 names: one right name, three wrong ones."""
    right = entries.where("grade = 3").groupBy("rubric_id").agg(F.min(F.struct(draw_key("rubric_id", "remedy_raw", seed=seed).alias("h"), F.col("remedy_raw").alias("r")))["r"].alias("correct"))
    pool = entries.where("grade = 1").select("rubric_id", "remedy_raw").distinct().join(right, "rubric_id").where("remedy_raw <> correct")
    order = Window.partitionBy("rubric_id").orderBy(draw_key("rubric_id", "remedy_raw", seed=seed), "remedy_raw")
    few = pool.withColumn("n", F.row_number().over(order)).where(F.col("n") <= DISTRACTORS)
    made = few.groupBy("rubric_id", "correct").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "remedy_raw"))), lambda x: x["remedy_raw"]).alias("wrong"))
    q = _assembled(made, ["rubric_id"], "correct", "wrong", seed).join(rubrics, F.col("rubric_id") == rubrics["id"])
    place = F.concat("chapter", F.lit(' — "'), "rubric", F.lit('"'), F.when(F.coalesce("page", F.lit("")) != "", F.concat(F.lit(", p."), "page")).otherwise(""))
    why = F.concat(F.lit('"'), "rubric", F.lit('" lists '), "correct", F.lit(" at grade 3; "), F.array_join("wrong", ", "), F.lit(" are listed at grade 1 under the same rubric."))
    return q.select("rubric_id", F.format_string(wording, "rubric", "chapter").alias("question"), "options", "correct_index", why.alias("explanation"), F.col("rubric").alias("supporting_quote"), F.lit("moderate").alias("difficulty"), place.alias("locator"), "url")


def remedy_to_rubric(rubrics: DataFrame, entries: DataFrame, remedies: DataFrame, seed: int | str, wording: str = "Under which rubric is %s graded 3?") -> DataFrame:
    """For each given canonical name: one label where it has grade 3, three of the same chapter where it has not.

    Labels repeat under different parents, so of equal ones the first by chapter, rubric and
    id stands. All of the name's grade-3 rubrics are left out of the wrong ones, however many.
    ``remedies`` is the stated set of questions.
    """
    asked = remedies.select("remedy_canonical").distinct()
    own = entries.where("grade = 3").join(asked, "remedy_canonical", "left_semi").select("remedy_canonical", "rubric_id").distinct()
    hits = own.join(rubrics.select("id", "chapter", "rubric"), own["rubric_id"] == F.col("id")).select("remedy_canonical", "id", "chapter", "rubric")
    hits = _written(hits, "hits")  # read for the right answers, the pool's sizes and what the pool leaves out, before and after the first draw
    labels = hits.groupBy("remedy_canonical", "rubric").agg(F.min(F.struct("chapter", "id")).alias("f"))
    correct = labels.groupBy("remedy_canonical").agg(F.min(F.struct(draw_key("remedy_canonical", "rubric", seed=seed).alias("h"), "rubric", F.col("f.chapter").alias("chapter"), F.col("f.id").alias("id"))).alias("c"))
    correct = correct.select("remedy_canonical", F.col("c.rubric").alias("correct"), F.col("c.chapter").alias("chapter"), F.col("c.id").alias("rubric_id"))
    correct = _written(correct, "correct")
    pool = _pool(correct, hits, rubrics.select("chapter", F.col("id").alias("other"), "rubric"), seed)
    drawn = pool.withColumn("n", F.row_number().over(Window.partitionBy("remedy_canonical").orderBy(draw_key("remedy_canonical", "other", seed=seed), "other"))).where(F.col("n") <= SAMPLED)
    distinct = drawn.groupBy("remedy_canonical", "correct", "chapter", "rubric_id", "rubric").agg(F.min("n").alias("n"))
    ranked = distinct.withColumn("k", F.row_number().over(Window.partitionBy("remedy_canonical").orderBy("n"))).where(F.col("k") <= DISTRACTORS)
    made = ranked.groupBy("remedy_canonical", "correct", "chapter", "rubric_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rubric"))), lambda x: x["rubric"]).alias("wrong"))
    q = _assembled(made, ["remedy_canonical"], "correct", "wrong", seed)
    why = F.concat("remedy_canonical", F.lit(' has grade 3 under "'), "correct", F.lit('" ('), "chapter", F.lit("); the others are rubrics of the chapter where it has not."))
    return q.select("remedy_canonical", "rubric_id", F.format_string(wording, "remedy_canonical").alias("question"), "options", "correct_index", why.alias("explanation"), F.col("correct").alias("supporting_quote"), F.lit("hard").alias("difficulty"), F.concat("chapter", F.lit(' — "'), "correct", F.lit('"')).alias("locator"))


def _pool(correct: DataFrame, hits: DataFrame, rubrics: DataFrame, seed: int | str) -> DataFrame:
    """Of the rubrics (chapter, other, rubric) that each question may draw from, those that can be among its first SAMPLED.

    The pool's size follows from counts: all of the chapter but equal labels and the name's own
    rubrics. The draw is by a hash, so nearly all questions find their first ones below the
    limit under which LIKELY of the pool are expected; hashes are compared while tiles of
    names and rubrics meet, many at once, and what lies above is no row. A question that finds
    too few is asked again without a limit.
    """
    sizes = rubrics.groupBy("chapter").agg(F.count("rubric").alias("n_all"))
    alike = rubrics.groupBy("chapter", F.col("rubric").alias("correct")).agg(F.count("rubric").alias("n_alike"))
    mine = hits.alias("h").join(correct.alias("c"), (F.col("h.remedy_canonical") == F.col("c.remedy_canonical")) & (F.col("h.chapter") == F.col("c.chapter")) & (F.col("h.rubric") != F.col("c.correct")))
    mine = mine.groupBy("h.remedy_canonical").agg(F.count("*").alias("n_mine"))
    names = correct.groupBy("chapter").agg(F.count("*").alias("n_names"))
    tiles = sizes.join(names, "chapter").select("chapter", "n_all", F.ceil(F.col("n_all") / TILE).alias("blocks"), F.ceil(F.col("n_names") / TILE).alias("groups"))
    asked = correct.join(tiles, "chapter").join(alike, ["chapter", "correct"], "left").join(mine, "remedy_canonical", "left")
    size = F.col("n_all") - F.coalesce("n_alike", F.lit(0)) - F.coalesce("n_mine", F.lit(0))
    limit = F.when(size <= LIKELY, F.lit(1 << 32)).otherwise(F.floor(F.lit(LIKELY << 32) / size).cast("bigint"))  # of the first four bytes of a hash
    asked = asked.select("remedy_canonical", "correct", "chapter", "rubric_id", "blocks", "groups", size.alias("size"), limit.alias("limit"))
    own = hits.select("remedy_canonical", F.col("id").alias("other")).distinct()
    dealt = rubrics.join(tiles.select("chapter", "blocks", "groups"), "chapter").withColumn("block", F.pmod(F.xxhash64("other"), "blocks"))
    dealt = dealt.select("chapter", "other", "rubric", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("group"))

    def sides(some: DataFrame) -> DataFrame:
        return some.withColumn("group", F.pmod(F.xxhash64("remedy_canonical"), "groups")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks", "groups")

    def kept(both: DataFrame) -> DataFrame:
        return both.where(F.col("rubric") != F.col("correct")).select("remedy_canonical", "other", "correct", "chapter", "rubric_id", "rubric").join(own, ["remedy_canonical", "other"], "left_anti")

    key, mine, theirs = ["chapter", "group", "block"], ["remedy_canonical", "correct", "chapter", "rubric_id"], ["other", "rubric"]
    tails = dealt.withColumn("tail", F.concat_ws("|", F.col("other").cast("string"), F.lit(str(seed))))  # what draw_key hashes behind the name and a bar

    def meet(names: pa.Table, rest: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 2]
        if len(names) and len(rest):
            found += digest.below(*([x.encode() for x in t[c].to_pylist()] for t, c in ((names, "remedy_canonical"), (rest, "tail"))), names["limit"].to_numpy())
        i, j = (np.concatenate(x) for x in zip(*found))
        left, right = names.select(mine).take(i), rest.select(theirs).take(j)
        return pa.table({c: t[c] for t in (left, right) for c in t.column_names})

    types = {f.name: f for f in (*asked.schema, *dealt.schema)}
    schema = StructType([types[c] for c in (*mine, *theirs)])
    first = _written(kept(sides(asked).groupBy(*key).cogroup(tails.groupBy(*key)).applyInArrow(meet, schema)), "pool")
    found = first.groupBy("remedy_canonical").agg(F.count("*").alias("n_found"))
    short = asked.join(found, "remedy_canonical", "left").where(F.coalesce("n_found", F.lit(0)) < F.least(F.col("size"), F.lit(SAMPLED))).drop("n_found")
    again = kept(sides(short).join(dealt, key))
    return first.join(short.select("remedy_canonical"), "remedy_canonical", "left_anti").unionByName(again)


def _first_labels(rows: DataFrame, label: str, by: list[str], seed: int | str) -> DataFrame:
    """For each group the first labels of the seeded order, one more than a question needs."""
    distinct = rows.select(*by, label).distinct()
    if by:
        order = Window.partitionBy(*by).orderBy(draw_key(*by, label, seed=seed), label)
        few = distinct.withColumn("n", F.row_number().over(order)).where(F.col("n") <= DISTRACTORS + 1)
    else:
        few = distinct.orderBy(draw_key(label, seed=seed), label).limit(DISTRACTORS + 1).withColumn("n", F.row_number().over(Window.orderBy(draw_key(label, seed=seed), label)))
    return few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", label))), lambda x: x[label]).alias("pool"))


def _others(pool: Column, own: str) -> Column:
    return F.slice(F.filter(pool, lambda x: x != F.col(own)), 1, DISTRACTORS)


def keynote(statements: DataFrame, seed: int | str) -> DataFrame:
    """For each important statement: its name among three others that have an important one in the same section."""
    important = statements.where("important")
    q = important.join(_first_labels(important, "remedy", ["section_no"], seed), "section_no").withColumn("wrong", _others(F.col("pool"), "remedy"))
    q = _assembled(q, ["remedy", "text"], "remedy", "wrong", seed)
    return q.select("remedy", "section_no", F.concat(F.lit('Which remedy is characterized by this keynote symptom: "'), "text", F.lit('"?')).alias("question"), "options", "correct_index", F.col("text").alias("supporting_quote"), F.lit("moderate").alias("difficulty"), F.concat("remedy", F.lit(" § "), "section_name").alias("locator"))


def clinical(statements: DataFrame, seed: int | str) -> DataFrame:
    """For each statement with a condition: the condition among three others of the section, or of all where it has too few."""
    marked = statements.where("clinical is not null and clinical <> ''")
    q = marked.join(_first_labels(marked, "clinical", ["section_no"], seed), "section_no").crossJoin(F.broadcast(_first_labels(marked, "clinical", [], seed).withColumnRenamed("pool", "all")))  # one row of four labels
    own, wide = _others(F.col("pool"), "clinical"), _others(F.col("all"), "clinical")
    q = q.withColumn("wrong", F.when(F.size(own) == DISTRACTORS, own).otherwise(wide))
    q = _assembled(q, ["remedy", "text"], "clinical", "wrong", seed)
    return q.select("remedy", "section_no", F.concat(F.lit("In which condition is this symptom of "), "remedy", F.lit(' clinically indicated: "'), "text", F.lit('"?')).alias("question"), "options", "correct_index", F.col("text").alias("supporting_quote"), F.lit("hard").alias("difficulty"), F.concat("remedy", F.lit(" § "), "section_name").alias("locator"))


KINDS = ("rubric_to_remedy", "remedy_to_rubric", "keynote", "clinical")


def drawn(candidates: dict[str, DataFrame], seed: int | str, kinds: Sequence[str] | None = None, remedy: str | None = None, rubric_id: int | None = None) -> DataFrame:
    """One question: of the fixed rubric; else of the kinds that know the remedy; else any. Unknown kinds are an error."""
    unknown = set(kinds or ()) - set(KINDS)
    if unknown or kinds == []:
        raise ValueError(f"unknown kinds {sorted(unknown)}; known: {KINDS}")
    pools, targeted = [], {"remedy_to_rubric": "remedy_canonical", "keynote": "remedy"}
    for kind, df in candidates.items():
        if rubric_id is not None:
            if kind == "rubric_to_remedy":
                pools.append(df.where(F.col("rubric_id") == rubric_id).withColumn("priority", F.lit(0)).withColumn("kind", F.lit(kind)))
        elif not kinds or kind in kinds:
            hit = F.col(targeted[kind]) == remedy if remedy is not None and kind in targeted else F.lit(False)
            pools.append(df.withColumn("priority", F.when(F.coalesce(hit, F.lit(False)), 0).otherwise(1)).withColumn("kind", F.lit(kind)))
    columns = ["kind", "question", "options", "correct_index", "supporting_quote", "difficulty", "locator", "priority"]
    out = pools[0].select(columns)
    for p in pools[1:]:
        out = out.unionByName(p.select(columns))
    return out.orderBy("priority", draw_key("kind", "question", seed=seed), "question").limit(1)


def packaged(questions: DataFrame, collection: str, subject: str) -> DataFrame:
    """Questions with the source passage and verdict that fit an answer from a stored row."""
    source = F.struct(F.concat(F.lit(f"deterministic:{collection}:"), "locator").alias("chunk_id"), F.col("supporting_quote").alias("text"), F.lit(collection).alias("book"), F.lit(subject).alias("subject"), "locator", F.lit(1.0).alias("similarity"), F.lit(False).alias("sparse"))
    verdict = F.struct(F.lit(True).alias("supported"), F.array().cast("array<string>").alias("unsupported_claims"), F.lit(True).alias("quote_found_in_source"), F.lit("question, options and answer come from a stored row").alias("reason"))
    return questions.withColumn("source", source).withColumn("verdict", verdict)


def routed(requests: DataFrame, rate: float = RATE, seed: int | str = 0) -> DataFrame:
    """path of requests (id, subject): stored rows for the repertory always, for eligible subjects at the rate, else generative."""
    chance = uniform("id", seed=seed) < rate
    return requests.withColumn("path", F.when(F.col("subject") == "Repertory", "deterministic").when(F.col("subject").isin(*ELIGIBLE) & chance, "deterministic").otherwise("generative"))


def well_formed(options: Column, index: Column) -> Column:
    """Four options that differ without case and blanks, and an index among them."""
    plain = F.transform(options, lambda o: F.lower(F.trim(o)))
    return F.coalesce((F.size(options) == 4) & index.between(0, 3) & (F.size(F.array_distinct(plain)) == 4), F.lit(False))


def with_distractors(rows: DataFrame) -> DataFrame:
    """New wrong options (distractors) in place of the old, only if there are three; the right one goes to a slot by the question's hash."""
    answer = F.element_at("options", F.col("correct_index") + 1)
    slot = F.pmod(F.conv(F.substring(draw_key("question"), 1, 8), 16, 10).cast("bigint"), F.lit(4)).cast("int")
    fits = F.coalesce(F.size("distractors") == DISTRACTORS, F.lit(False))
    return rows.select(*(c for c in rows.columns if c not in ("options", "correct_index", "distractors")), F.when(fits, F.array_insert("distractors", slot + 1, answer)).otherwise(F.col("options")).alias("options"), F.when(fits, slot).otherwise(F.col("correct_index")).alias("correct_index"))
