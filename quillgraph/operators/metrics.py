"""Evaluation: latencies, rates, gold-set outcomes and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentile, rate_report

GENERATIVE, DETERMINISTIC = "generative", "deterministic"
CALLS = {DETERMINISTIC: 1, GENERATIVE: 3}
DEFAULT_TOKENS = (3000, 700)
DETERMINISTIC_RATE = 0.40

# Prices in dollars of a million tokens in and out.
PRICES = (
    ("gemini-2.5-flash-lite", 0.10, 0.40), ("gemini-2.5-flash", 0.30, 2.50), ("gpt-4.1-nano", 0.10, 0.40), ("gpt-5.4-nano", 0.20, 1.25),
    ("gpt-5-mini", 0.25, 2.00), ("gpt-5.4-mini", 0.75, 4.50), ("gpt-5.5", 5.00, 30.00),
)


def latency_report(metrics: DataFrame) -> DataFrame:
    """p50_ms, p95_ms and n overall, by task and by path in one pass; a missing path is the generative one."""
    rows = metrics.where("latency_ms is not null").select("task", F.coalesce("path", F.lit(GENERATIVE)).alias("path"), "latency_ms")
    by = rows.groupingSets([[], ["task"], ["path"]], "task", "path").agg(F.round(percentile(F.col("latency_ms"), 0.5), 1).alias("p50_ms"), F.round(percentile(F.col("latency_ms"), 0.95), 1).alias("p95_ms"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "task").otherwise("path")
    return by.select(scope.alias("scope"), F.coalesce("task", "path").alias("name"), "p50_ms", "p95_ms", "n").where("n > 0")


def rates(rows: DataFrame, flag: str, *by: str) -> DataFrame:
    """rate, n, count and the 95% interval of a 0/1 column, in groups; nulls do not count."""
    g = rows.where(F.col(flag).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(flag).cast("int") == 1).alias("count"))
    r = rate_report(F.col("count"), F.col("n"))
    return g.select(*by, r["rate"].alias("rate"), "n", "count", r["ci95"]["lo"].alias("ci_lo"), r["ci95"]["hi"].alias("ci_hi"))


def evaluation_cases(gold: DataFrame, repeats: int) -> DataFrame:
    """A row for each run of a case: answerable ones ``repeats`` times, those to refuse once."""
    times = F.when(F.col("expect") == "refuse", F.lit(1)).otherwise(F.lit(repeats))
    return gold.withColumn("repeat", F.explode(F.sequence(F.lit(1), times)))


def main_report(outcomes: DataFrame) -> DataFrame:
    """One row over case runs (expect, served, supported, quote_found, similarity, located).

    located is null where no locator is expected, similarity where nothing was found.
    """
    refuse, answer = F.col("expect") == "refuse", F.col("expect") != "refuse"
    served = F.col("served")
    g = outcomes.agg(
        F.count_if(served).alias("served"),
        F.count_if(served & ~F.col("supported")).alias("unsupported"),
        F.count_if(served & F.col("quote_found")).alias("quotes"),
        F.count_if(refuse).alias("n_refuse"), F.count_if(refuse & ~served).alias("refused"),
        F.count_if(answer).alias("n_answer"), F.count_if(answer & ~served).alias("falsely_refused"),
        F.percentile("similarity", F.lit(0.5)).alias("similarity_median"), F.min("similarity").alias("similarity_min"),
        F.count("located").alias("n_located"), F.count_if("located").alias("located"),
    )

    def ratio(a: str, b: str):
        return F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)

    return g.select("served", ratio("unsupported", "served").alias("hallucination_rate"), ratio("quotes", "served").alias("quote_validity"), rate_report(F.col("refused"), F.col("n_refuse")).alias("refusal_accuracy"), rate_report(F.col("falsely_refused"), F.col("n_answer")).alias("false_refusal_rate"), F.round("similarity_median", 4).alias("similarity_median"), F.round("similarity_min", 4).alias("similarity_min"), ratio("located", "n_located").alias("hit_rate"))


def repertory_report(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """One row. forward: answer, distractors, grade3_all, error; reverse: answer, expect_rubrics, error. Errors stay out of the denominators."""
    f = forward.agg(
        F.count_if(F.col("error").isNotNull()).alias("forward_errors"),
        F.count_if(F.col("error").isNull()).alias("n_forward"),
        F.count_if(F.col("error").isNull() & F.array_contains("grade3_all", F.col("answer"))).alias("forward_right"),
        F.count_if(F.col("error").isNull() & ~F.arrays_overlap("grade3_all", "distractors")).alias("distractors_valid"),
    )
    r = reverse.agg(F.count_if(F.col("error").isNotNull()).alias("reverse_errors"), F.count_if(F.col("error").isNull()).alias("n_reverse"), F.count_if(F.col("error").isNull() & F.array_contains("expect_rubrics", F.col("answer"))).alias("reverse_right"))
    both = f.crossJoin(r)  # one row each
    right, n = F.col("forward_right") + F.col("reverse_right"), F.col("n_forward") + F.col("n_reverse")
    return both.select("n_forward", "n_reverse", (F.col("forward_errors") + F.col("reverse_errors")).alias("n_errors"), F.round(F.try_divide(right.cast("double"), n), 4).alias("answer_correctness"), F.round(F.try_divide(F.col("distractors_valid").cast("double"), F.col("n_forward")), 4).alias("distractor_validity"))


def failures(*tagged: tuple[str, DataFrame]) -> DataFrame:
    """Rows (topic, reason) of several frames under their tags, reasons cut to 200 characters."""
    out = None
    for tag, df in tagged:
        one = df.select(F.lit(tag).alias("tag"), "topic", F.left("reason", F.lit(200)).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def observed_tokens(metrics: DataFrame, rate: float = DETERMINISTIC_RATE) -> DataFrame:
    """Tokens in and out of one question, truncated, in one row.

    Means by path times the calls of a question on it, blended by the share of deterministic
    questions. Calls without input tokens do not count; without any, defaults stand.
    """
    rows = metrics.where("input_tokens > 0").select(F.coalesce("path", F.lit(GENERATIVE)).alias("path"), F.col("input_tokens").cast("double").alias("i"), F.coalesce("output_tokens", F.lit(0)).cast("double").alias("o"))

    def mean(path: str, c: str):
        own = F.avg(F.when(F.col("path") == path, F.col(c)))
        return F.coalesce(own, F.lit(0.0)) if path == DETERMINISTIC else F.coalesce(own, F.avg(c))

    blended = [(F.lit(rate) * mean(DETERMINISTIC, c) * CALLS[DETERMINISTIC] + F.lit(1 - rate) * mean(GENERATIVE, c) * CALLS[GENERATIVE]).alias(n) for c, n in (("i", "tokens_in"), ("o", "tokens_out"))]
    g = rows.agg(F.count("*").alias("n"), *blended)
    return g.select(*(F.when(F.col("n") > 0, F.floor(c).cast("bigint")).otherwise(F.lit(d)).alias(c) for c, d in zip(("tokens_in", "tokens_out"), DEFAULT_TOKENS)))


def cost_ranking(tokens: DataFrame, questions: int = 50_000, prices: Sequence[tuple[str, float, float]] = PRICES, baseline: str = "gpt-5.5") -> DataFrame:
    """Monthly cost of each model, and the percent saved against the baseline."""
    p = tokens.sparkSession.createDataFrame(list(prices), "model string, price_in double, price_out double")
    cost = tokens.crossJoin(p).select("model", (F.lit(float(questions)) * F.col("tokens_in") / 1e6 * F.col("price_in") + F.lit(float(questions)) * F.col("tokens_out") / 1e6 * F.col("price_out")).alias("cost"))  # one row times the price list
    base = F.max(F.when(F.col("model") == baseline, F.col("cost"))).over(Window.partitionBy())  # over the price list
    cost = cost.withColumn("base", base).where("base is not null")
    saved = F.when(F.col("cost") < F.col("base"), F.round(100 * (1 - F.try_divide("cost", "base")), 0))
    return cost.select("model", F.round("cost", 2).alias("cost"), saved.alias("saved_percent")).orderBy("cost", "model")
