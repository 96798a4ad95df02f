"""Quiz sessions as data: configuration by text, topics by misses, running scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import draw_key, uniform

CONFIG_EXAM, CONFIG_MODE, ASKING, AWAITING = "config_exam", "config_mode", "asking", "awaiting_answer"
REVISIT = 0.30


def exam_of(text: Column, exams: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The exam whose number the text is, or one of whose keywords it holds; null if none."""
    t = F.lower(F.trim(text))
    out = F
    for i, (name, keys) in enumerate(exams, 1):
        hit = t == str(i)
        for k in keys:
            hit = hit | F.contains(t, F.lit(k))
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def mode_of(text: Column, subjects: Sequence[str]) -> Column:
    """general, subject and topic: general words, else the first subject named, else the whole text is the topic."""
    t = F.trim(text)
    low = F.lower(t)
    general = low.isin("general", "2", "practice", "mixed")
    subject = F.coalesce(*(F.when(F.contains(low, F.lit(s.lower())), F.lit(s)) for s in subjects), F.lit(None).cast("string"))
    return F.struct(general.alias("general"), F.when(~general, subject).alias("subject"), F.when(~general & subject.isNull(), t).alias("topic"))


def states(events: DataFrame) -> DataFrame:
    """Events (session, turn, kind) with the state before and after: exam, mode, serve and answer lead on; others change nothing."""
    after = F.when(F.col("kind") == "exam", CONFIG_MODE).when(F.col("kind") == "mode", ASKING).when(F.col("kind") == "serve", AWAITING).when(F.col("kind") == "answer", ASKING)
    w = Window.partitionBy("session").orderBy("turn")
    filled = events.withColumn("after", F.coalesce(F.last(after, True).over(w), F.lit(CONFIG_EXAM)))
    return filled.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(CONFIG_EXAM)))


def running(answers: DataFrame) -> DataFrame:
    """Answers (session, turn, topic, correct) with answered, correct and misses of the topic so far; a null choice is wrong."""
    w = Window.partitionBy("session").orderBy("turn")
    t = Window.partitionBy("session", "topic").orderBy("turn")
    right = F.coalesce(F.col("correct").cast("boolean"), F.lit(False))
    return answers.withColumn("answered_so_far", F.count("*").over(w)).withColumn("correct_so_far", F.count_if(right).over(w)).withColumn("topic_misses", F.count_if(~right).over(t))


def scores(answers: DataFrame) -> DataFrame:
    """session, answered, correct, percent."""
    right = F.coalesce(F.col("correct").cast("boolean"), F.lit(False))
    g = answers.groupBy("session").agg(F.count("*").alias("answered"), F.count_if(right).alias("correct"))
    return g.withColumn("percent", F.round(100 * F.col("correct") / F.col("answered"), 0).cast("int"))


def weak_topics(answers: DataFrame, top: int = 3) -> DataFrame:
    """The topics of a session missed most; of equals the one missed first."""
    missed = answers.where(~F.coalesce(F.col("correct").cast("boolean"), F.lit(False))).groupBy("session", "topic").agg(F.count("*").alias("misses"), F.min("turn").alias("first_miss"))
    order = Window.partitionBy("session").orderBy(F.desc("misses"), "first_miss", "topic")
    return missed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def score_lines(answers: DataFrame) -> DataFrame:
    """session and its line of score, with up to three topics to revisit."""
    weak = weak_topics(answers).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "topic"))), lambda x: x["topic"]), ", ").alias("weak"))
    line = F.concat(F.lit("Score: "), "correct", F.lit("/"), "answered", F.lit(" ("), "percent", F.lit("%)"), F.when(F.col("weak").isNotNull(), F.concat(F.lit(" · Revisiting: "), "weak")).otherwise(""))
    return scores(answers).join(weak, "session", "left").select("session", line.alias("line"))


def next_topics(sessions: DataFrame, misses: DataFrame, general: DataFrame, seed: int | str, revisit: float = REVISIT) -> DataFrame:
    """Topic and subject to ask for: at the rate a missed topic weighted by misses, else the explicit one, else a seeded general one.

    sessions: session, subject, topic, general; misses: session, topic, misses; general: subject, topic.
    """
    # exponential race: the smallest -ln(u) / weight wins in proportion to the weight
    race = -F.ln(F.greatest(uniform("session", "topic", seed=seed), F.lit(1e-12))) / F.col("misses")
    weak = misses.where("misses > 0").groupBy("session").agg(F.min_by("topic", F.struct(race.alias("r"), F.col("topic").alias("t"))).alias("weak"))
    listed = general.groupBy().agg(F.array_sort(F.collect_list(F.struct("subject", "topic"))).alias("all"))  # the seed list, a few dozen rows
    s = sessions.join(weak, "session", "left").crossJoin(F.broadcast(listed))
    pool = F.filter("all", lambda g: F.col("subject").isNull() | (g["subject"] == F.col("subject")))
    pick = F.get(pool, F.pmod(F.conv(F.substring(draw_key("session", F.lit("general"), seed=seed), 1, 8), 16, 10).cast("bigint"), F.greatest(F.size(pool), F.lit(1))).cast("int"))
    again = F.col("weak").isNotNull() & (uniform("session", F.lit("revisit"), seed=seed) < revisit)
    explicit = ~F.col("general") & F.col("topic").isNotNull()
    return s.select("session", F.when(again, F.col("weak")).when(explicit, F.col("topic")).otherwise(pick["topic"]).alias("next_topic"), F.when(again | explicit, F.col("subject")).otherwise(pick["subject"]).alias("next_subject"))


def recent(asked: DataFrame, n: int = 8) -> DataFrame:
    """session and its last questions in order."""
    order = Window.partitionBy("session").orderBy(F.desc("turn"))
    few = asked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    return few.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "question"))), lambda x: x["question"]).alias("recent"))


def next_questions(topics: DataFrame, candidates: DataFrame, asked: DataFrame, seed: int | str) -> DataFrame:
    """session, topic, question: the first one of its topic that the session has not had, null if it had all.

    topics: session, topic; candidates: topic, question; asked: session, question. Each topic's
    questions stand in a ring in seeded order; a session starts at a place of its own and looks
    at one more than it has had, so the work grows with what was asked, not with all pairs.
    """
    order = Window.partitionBy("topic").orderBy(draw_key("topic", "question", seed=seed), "question")
    ring = candidates.select("topic", "question").distinct().withColumn("place", F.row_number().over(order) - 1)
    sizes = ring.groupBy("topic").agg(F.count("*").cast("int").alias("n"))
    had = asked.select("session", "question").distinct()
    t = topics.join(had.groupBy("session").agg(F.count("*").cast("int").alias("had")), "session", "left").join(sizes, "topic", "left")
    start = F.pmod(F.conv(F.substring(draw_key("session", "topic", seed=seed), 1, 8), 16, 10).cast("bigint"), F.col("n"))
    looks = t.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.coalesce("had", F.lit(0)), F.col("n") - 1)))).select("session", "topic", "k", F.pmod(start + F.col("k"), F.col("n")).cast("int").alias("place"))
    fresh = looks.join(ring, ["topic", "place"]).join(had, ["session", "question"], "left_anti")
    chosen = fresh.groupBy("session", "topic").agg(F.min_by("question", "k").alias("question"))
    return topics.select("session", "topic").join(chosen, ["session", "topic"], "left")


def reveal(question: Column, options: Column, correct: Column, choice: Column, explanation: Column) -> Column:
    """What a player sees after an answer: right, wrong, or not understood."""
    letter = F.substring(F.lit("ABCD"), correct + 1, F.lit(1))
    answer = F.concat(letter, F.lit(") "), F.element_at(options, correct + 1))
    return F.when(choice.isNull(), F.concat(F.lit("Not understood. The answer is "), answer, F.lit(". "), explanation)).when(choice == correct, F.concat(F.lit("Correct: "), answer, F.lit(". "), explanation)).otherwise(F.concat(F.lit("Not quite. The answer is "), answer, F.lit(". "), explanation))


def rendered(question: Column, options: Column) -> Column:
    """A question and its lettered options, a line each."""
    return F.concat(question, F.lit("\n"), F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(") "), o)), "\n"))
