"""Entity names of several sources resolved to canonical ones: exact, by token prefixes, fuzzy.

The index has a row for each alias: entry (its number), canonical, alias, source, name_key,
tokens. Names resolve in sets: each step takes what the steps before left over. The build
with feedback, where each resolved name becomes an alias at once, depends on order and is a
separate operator over groups of names that can influence one another (``extended``).
"""

from __future__ import annotations

import math
import uuid
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, name_tokens, name_variants
from ..session import shared_dir

FUZZY, MARGIN, SHORTEST = 0.90, 0.05, 5


def seeded(records: DataFrame, source: str = "seed") -> DataFrame:
    """Index of records (seq, remedy, abbrev): the first variant is canonical, all variants and the abbreviation are aliases."""
    r = records.select(F.col("seq").alias("entry"), name_variants(F.col("remedy")).alias("v"), "abbrev")
    a = r.select("entry", F.element_at("v", 1).alias("canonical"), F.explode(F.array_distinct(F.concat("v", F.when(F.coalesce("abbrev", F.lit("")) != "", F.array("abbrev")).otherwise(F.array().cast("array<string>"))))).alias("alias"))
    return indexed(a.withColumn("source", F.lit(source)))


def indexed(aliases: DataFrame) -> DataFrame:
    return aliases.select("entry", "canonical", "alias", "source", name_key(F.col("alias")).alias("name_key"), name_tokens(F.col("alias")).alias("tokens"))


def exact(names: DataFrame, index: DataFrame, variants: bool = True) -> DataFrame:
    """name, canonical of the first variant whose key is known; of entries with one key the last stands."""
    keys = index.where("name_key <> ''").groupBy("name_key").agg(F.max_by("canonical", "entry").alias("canonical"))
    each = name_variants(F.col("name")) if variants else F.array("name")
    v = names.select("name", F.posexplode(each).alias("at", "v")).select("name", "at", name_key(F.col("v")).alias("name_key"))
    return v.join(keys, "name_key").groupBy("name").agg(F.min_by("canonical", "at").alias("canonical"))


def by_prefix(names: DataFrame, index: DataFrame) -> DataFrame:
    """name, canonical where each token begins the entry's token at its place, the first being equal, and one entry only fits."""
    n = names.select("name", name_tokens(F.col("name")).alias("t")).where(F.length(F.get("t", F.lit(0))) >= 3)
    i = index.where(F.size("tokens") > 0).select("entry", "canonical", "tokens").distinct()
    fits = (F.size("t") <= F.size("tokens")) & F.forall(F.sequence(F.lit(0), F.size("t") - 1), lambda k: F.startswith(F.get("tokens", k), F.get("t", k)))
    hit = n.join(i, F.get(n["t"], F.lit(0)) == F.get(i["tokens"], F.lit(0))).where(fits)
    return hit.groupBy("name").agg(F.count_distinct("entry").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").select("name", "canonical")


def ratio(a: str, b: str, least: float = FUZZY - MARGIN) -> Column:
    """Similarity of two string columns by matching blocks; 0 where it cannot reach ``least``."""
    def one(x: str, y: str) -> float:
        m = SequenceMatcher(None, x, y)
        return m.ratio() if m.real_quick_ratio() >= least - 1e-9 and m.quick_ratio() >= least - 1e-9 else 0.0

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(each, "double")(a, b)


def near_keys(left: DataFrame, right: DataFrame, least: float = FUZZY - MARGIN) -> DataFrame:
    """Pairs of keys (a of ``left``, b of ``right``; columns k) whose ratio can reach ``least``: an equi-join on pairs of letters.

    A ratio r of keys with S letters together leaves at most (1 - r) S unmatched; these part
    the matched r S / 2 of each key into one block more than they are, and a block holds one
    pair of letters less than letters. So at least (1.5 r - 1) S - 1 pairs of letters, counted
    as often as they occur, are in both.
    """
    shortest = SHORTEST + math.ceil(SHORTEST * least / (2 - least))
    if (1.5 * least - 1) * shortest - 1 <= 0:
        raise ValueError(f"pairs of letters don't tell keys apart at a ratio of {least}")

    def grams(df: DataFrame, name: str) -> DataFrame:
        k = F.col("k")
        pairs = F.transform(F.sequence(F.lit(1), F.length(k) - 1), lambda i: F.substring(k, i, F.lit(2)))
        numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))
        return df.where(F.length("k") >= 2).select(k.alias(name), F.length(k).alias(f"l{name}"), F.explode(numbered).alias("gram"))

    la, lb = F.col("la").cast("double"), F.col("lb").cast("double")
    met = grams(left.select("k").distinct(), "a").join(grams(right.select("k").distinct(), "b"), "gram").where(F.least(la, lb) * 2 >= least * (la + lb) - 1e-9)
    return met.groupBy("a", "b", "la", "lb").agg(F.count("*").alias("both")).where(F.col("both") >= (1.5 * least - 1) * (la + lb) - 1 - 1e-9).select("a", "b")


def fuzzy(names: DataFrame, index: DataFrame, threshold: float = FUZZY, margin: float = MARGIN) -> DataFrame:
    """name, canonical, score of the entry whose best key is similar enough and leads the next entry by the margin.

    Pairs below the threshold less the margin change nothing, so only keys that share enough
    pairs of letters to reach that are compared (``near_keys``).
    """
    least = max(threshold - margin, 0.01)
    n = names.select("name", name_key(F.col("name")).alias("k")).where(F.length("k") >= SHORTEST)
    i = index.where("name_key <> ''").select("entry", "canonical", F.col("name_key").alias("k")).distinct()
    near = near_keys(n, i, least).withColumn("score", ratio("a", "b", least))
    best = n.withColumnRenamed("k", "a").join(near, "a").join(i.withColumnRenamed("k", "b"), "b").groupBy("name", "entry", "canonical").agg(F.max("score").alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "entry")
    top = best.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("at = 1")
    return top.where((F.col("score") >= threshold) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))).select("name", "canonical", "score")


def cascade(names: DataFrame, index: DataFrame, variants: bool = True) -> DataFrame:
    """Every distinct name with canonical (null if unresolved) and the step that found it."""
    names = names.select("name").where("name is not null").distinct()
    one = exact(names, index, variants).withColumn("step", F.lit("exact"))
    left = names.join(one, "name", "left_anti")
    two = by_prefix(left, index).withColumn("step", F.lit("prefix"))
    left = left.join(two, "name", "left_anti")
    three = fuzzy(left, index).select("name", "canonical", F.lit("fuzzy").alias("step"))
    return names.join(one.unionByName(two).unionByName(three), "name", "left")


def canonical(names: DataFrame, index: DataFrame) -> DataFrame:
    """Lookup at run time: exact on persisted aliases as they are, then prefix, then fuzzy."""
    return cascade(names, index, variants=False)


def aliases_of(index: DataFrame, name: str) -> DataFrame:
    return index.where(F.col("canonical") == name).select("alias").distinct().orderBy("alias")


def table(index: DataFrame) -> DataFrame:
    """canonical, aliases and sources, both sorted."""
    return index.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("source")).alias("sources"))


def report(resolved: DataFrame, by: str = "source") -> DataFrame:
    """Names of each source: total, resolved, and the sorted unresolved ones."""
    return resolved.groupBy(by).agg(F.count("*").alias("n_names"), F.count("canonical").alias("n_resolved"), F.array_sort(F.collect_list(F.when(F.col("canonical").isNull(), F.col("name")))).alias("unresolved"))


def identifiers(records: DataFrame, kind: str) -> DataFrame:
    """Distinct names that records of a kind use: rubric, prose or other."""
    if kind == "rubric":
        return records.select(F.explode(F.col("remedies")["name"]).alias("name")).distinct()
    own = records.select(F.col("remedy").alias("name"))
    if kind == "prose":
        own = own.unionByName(records.select(F.explode("remedy_mentions").alias("name")))
    return own.distinct()


def influence(members: DataFrame) -> DataFrame:
    """node, grp: nodes (node, word) that share a word, or words through other nodes, are in one group.

    Groups take the least label of their words, round by round, until none changes; rounds are
    written, so plans stay short.
    """
    spark = members.sparkSession
    at = f"{shared_dir(spark)}/influence-{uuid.uuid4().hex}"
    members.distinct().write.parquet(f"{at}/members")
    m = spark.read.schema(members.schema).parquet(f"{at}/members")
    labels, n = m.select("node", F.col("node").alias("grp")).distinct(), 0
    while True:
        by_word = m.join(labels, "node").groupBy("word").agg(F.min("grp").alias("grp"))
        new = m.join(by_word, "word").groupBy("node").agg(F.min("grp").alias("grp"))
        new.join(labels.withColumnRenamed("grp", "before"), "node").write.parquet(f"{at}/{n}")
        rows = spark.read.schema("node string, grp string, before string").parquet(f"{at}/{n}")
        labels, n = rows.select("node", "grp"), n + 1
        if not rows.where("grp <> before").limit(1).count():
            return labels


def extended(index: DataFrame, names: DataFrame) -> DataFrame:
    """name, source, canonical with feedback: sources in order of ``batch``, names sorted, each resolved name an alias at once.

    names: batch, source, name. What a name resolves to depends on names before it, but only on
    those that it can meet: with an equal key, an equal first word or a key similar enough, or
    through others. Names and entries that can influence one another are a group; each is
    settled in order, in a task of its own.
    """
    asked = names.select("batch", "source", "name").where("name is not null").distinct()
    own = asked.select("batch", "source", "name", name_key(F.col("name")).alias("key"), name_tokens(F.col("name")).alias("tokens"), F.array_distinct(F.filter(F.transform(name_variants(F.col("name")), name_key), lambda k: k != "")).alias("keys"))
    known = index.where("name_key <> ''").select("entry", "canonical", F.col("name_key").alias("key"), "tokens").distinct()
    name_node, entry_node = F.concat(F.lit("name "), "name"), F.concat(F.lit("entry "), "entry")
    keys = own.select(name_node.alias("node"), F.explode(F.array_union("keys", F.array("key"))).alias("k")).unionByName(known.select(entry_node.alias("node"), F.col("key").alias("k"))).where("k <> ''").distinct()
    firsts = own.select(name_node.alias("node"), F.get("tokens", F.lit(0)).alias("t")).unionByName(known.select(entry_node.alias("node"), F.get("tokens", F.lit(0)).alias("t"))).where(F.length("t") >= 3)
    near = near_keys(keys, keys).where("a < b").select(F.explode(F.array("a", "b")).alias("k"), F.concat_ws("|", F.lit("near"), "a", "b").alias("word"))
    words = keys.select("node", F.concat(F.lit("key "), "k").alias("word")).unionByName(firsts.select("node", F.concat(F.lit("first "), "t").alias("word"))).unionByName(keys.join(near, "k").select("node", "word"))
    alone = own.select(name_node.alias("node"), name_node.alias("word")).unionByName(known.select(entry_node.alias("node"), entry_node.alias("word")))
    group = influence(words.unionByName(alone))
    nothing = F.lit(None).cast("string")
    rows = own.withColumn("node", name_node).join(group, "node").select("grp", "batch", "source", "name", "key", "tokens", "keys", F.lit(None).cast("bigint").alias("entry"), nothing.alias("canonical"))
    rows = rows.unionByName(known.withColumn("node", entry_node).join(group, "node").select("grp", F.lit(-1).cast(asked.schema["batch"].dataType).alias("batch"), nothing.alias("source"), nothing.alias("name"), "key", "tokens", F.lit(None).cast("array<string>").alias("keys"), F.col("entry").cast("bigint").alias("entry"), "canonical"))
    return rows.groupBy("grp").applyInPandas(_settled, "name string, source string, canonical string")


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """The names of one group in their order; every name that finds an entry joins its aliases."""
    old, new = rows[rows["batch"] < 0], rows[rows["batch"] >= 0].sort_values(["batch", "name"])
    aliases = pd.DataFrame({"entry": old["entry"].astype("int64"), "key": old["key"], "tokens": old["tokens"].map(tuple)}).sort_values("entry", ignore_index=True)
    canonical = dict(zip(old["entry"].astype("int64"), old["canonical"]))
    latest = {e: n for n, e in enumerate(sorted(canonical))}  # of entries with one key the one last added to stands
    out = []
    for r in new.itertuples():
        entry = next((e for e in (by(aliases, latest, r) for by in (_by_key, _by_beginnings, _by_likeness)) if e is not None), None)
        if entry is not None:
            latest[entry] = len(latest) + len(out)
            if r.key:
                aliases.loc[len(aliases)] = [entry, r.key, tuple(r.tokens)]
        out.append((r.name, r.source, canonical.get(entry)))
    return pd.DataFrame(out, columns=["name", "source", "canonical"])


def _by_key(aliases: pd.DataFrame, latest: dict[int, int], r) -> int | None:
    for key in r.keys:
        hits = aliases.loc[aliases["key"] == key, "entry"]
        if len(hits):
            return max(hits, key=latest.__getitem__)
    return None


def _by_beginnings(aliases: pd.DataFrame, latest: dict[int, int], r) -> int | None:
    if not len(r.tokens) or len(r.tokens[0]) < 3:
        return None
    fit = aliases["tokens"].map(lambda t: len(t) >= len(r.tokens) and t[0] == r.tokens[0] and all(map(str.startswith, t, r.tokens)))
    hits = aliases.loc[fit.astype(bool), "entry"].unique()
    return int(hits[0]) if len(hits) == 1 else None


def _by_likeness(aliases: pd.DataFrame, latest: dict[int, int], r) -> int | None:
    if len(r.key) < SHORTEST or aliases.empty:
        return None
    likeness = aliases["key"].map(lambda k: SequenceMatcher(None, r.key, k).ratio()).groupby(aliases["entry"]).max().nlargest(2)
    best, second = likeness.iloc[0], likeness.iloc[1] if len(likeness) > 1 else -1.0
    return int(likeness.index[0]) if best >= FUZZY and best - second >= MARGIN else None
