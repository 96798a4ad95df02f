"""Overlap of short statements with a fuller source, blocked by entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.stats import containment, jaccard, rounded
from ..functions.text import content_tokens, first_word, letters, statement_key
from .order import slices, spread

LEAST_TOKENS, THRESHOLD = 3, 0.7
MOST, AT_ONCE = 1 << 20, 1 << 20  #: characters of an entity that meets in a task at most; words, or meetings, that a task holds at once


def matched_entities(left: DataFrame, right: DataFrame) -> DataFrame:
    """left names (id, name) with the right entity (pos, name, abbrev) they mean: match_pos, or null.

    Equal letters, else equal first word, else the first word begins with an abbreviation;
    of several the one with the lowest position. The last is an equi-join on prefixes of the
    word: as many rows as it has letters.
    """
    l = left.select("id", letters(F.col("name")).alias("k"), first_word(F.col("name")).alias("f"))
    r = right.select("pos", letters(F.col("name")).alias("k"), first_word(F.col("name")).alias("f"), letters(F.col("abbrev")).alias("a"))
    by_key = r.groupBy("k").agg(F.min("pos").alias("p1"))
    by_first = r.groupBy("f").agg(F.min("pos").alias("p2"))
    by_abbrev = r.where("a <> ''").groupBy("a").agg(F.min("pos").alias("p3"))
    begins = l.where("f <> ''").select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("f")), lambda n: F.substring(F.col("f"), F.lit(1), n))).alias("a"))
    third = begins.join(by_abbrev, "a").groupBy("id").agg(F.min("p3").alias("p3"))
    return l.join(by_key, "k", "left").join(by_first, "f", "left").join(third, "id", "left").select("id", F.coalesce("p1", "p2", "p3").alias("match_pos"))


def scored(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """Every left statement (id, entity, text) with its best right statement (entity, pos, text, section).

    score is the containment of the best (the first of equals), jaccard that pair's; both 0
    where nothing is shared. in_all is the containment in all tokens of the entity. Statements
    under three tokens are not judged: note says so.

    Statements are dealt by entity and meet in tasks, so a text moves once for each side. Entities
    of more than ``most`` characters meet as rows, word by word.
    """
    lengths = left.select("entity", F.length("text").alias("n")).unionByName(right.select("entity", F.length("text").alias("n")))
    large = F.broadcast(lengths.groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("entity"))  # at most a row for each ``most`` characters of all
    out = _by_entity(left.join(large, "entity", "left_anti"), right.join(large, "entity", "left_anti"))
    out = out.unionByName(_by_words(left.join(large, "entity", "left_semi"), right.join(large, "entity", "left_semi")))
    s = F.coalesce(F.col("score"), F.lit(0.0))
    duplicate = (F.col("nt") >= LEAST_TOKENS) & (s >= threshold)
    in_all = F.when(F.col("nt") >= LEAST_TOKENS, F.coalesce(F.try_divide(F.col("n_in").cast("double"), F.least("nt", "n_all")), F.lit(0.0)))
    return out.select(
        "id", "entity", "text", duplicate.alias("duplicate"), rounded(s, 2).alias("score"),
        rounded(F.when(F.col("nt") >= LEAST_TOKENS, F.coalesce("jaccard", F.lit(0.0))), 2).alias("jaccard"), rounded(in_all, 2).alias("in_all"),
        F.when(F.col("nt") < LEAST_TOKENS, "too_short").alias("note"), F.when(duplicate, F.col("r_text")).alias("match_text"), F.when(duplicate, F.col("section")).alias("match_section"),
    )


def _by_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, entity, text, nt (tokens), score and jaccard of the best right statement, n_in (tokens that the entity holds), n_all (its tokens), r_text, section."""
    l = left.select("id", "entity", "text", content_tokens(F.col("text")).alias("t"))
    r = right.select("entity", "pos", F.col("text").alias("r_text"), "section", content_tokens(F.col("text")).alias("u"))
    judged = l.where(F.size("t") >= LEAST_TOKENS)
    # only pairs that share a token can score: joined by token, so long lists don't meet as wholes
    mine = judged.select("id", "entity", F.size("t").alias("nt"), F.explode("t").alias("w"))
    # a row a word of the entity, with all statements that hold it: the words meet once, for pairs and for the entity as a whole
    theirs = r.select("entity", "pos", F.size("u").alias("nu"), F.explode("u").alias("w")).groupBy("entity", "w").agg(F.collect_list(F.struct("pos", "nu")).alias("held"))
    sizes = theirs.groupBy("entity").agg(F.count("*").alias("n_all"))
    met = mine.join(theirs, ["entity", "w"]).select("id", "nt", F.posexplode("held").alias("nth", "h")).select("id", "nt", "nth", "h.*")
    pairs = met.groupBy("id", "pos", "nt", "nu").agg(F.count("*").alias("both"), F.count_if(F.col("nth") == 0).alias("firsts"))
    score = F.col("both").cast("double") / F.least("nt", "nu")
    greatest = F.max_by(F.struct("pos", "score", (F.col("both").cast("double") / (F.col("nt") + F.col("nu") - F.col("both"))).alias("jaccard")), F.struct("score", (-F.col("pos")).alias("p"))).alias("b")
    best = pairs.withColumn("score", score).groupBy("id").agg(greatest, F.sum("firsts").alias("n_in"))
    out = l.join(best, "id", "left").join(sizes, "entity", "left").join(r.select("entity", "pos", "r_text", "section").withColumnRenamed("entity", "e"), (F.col("e") == F.col("entity")) & (F.col("pos") == F.col("b.pos")), "left")
    return out.select("id", "entity", "text", F.size("t").alias("nt"), "b.score", "b.jaccard", "n_in", "n_all", "r_text", "section")


def _by_entity(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same, where the statements of an entity fit a task; ids stand for one statement each."""
    lacks = {f.name: F.lit(None).cast(f.dataType) for f in (*left.schema, *right.schema)}
    columns = ["entity", "id", "pos", "text", "section"]
    sides = [df.select(*(c if c in df.columns else lacks[c].alias(c) for c in columns), F.lit(own).alias("own")) for df, own in ((right.where("entity is not null"), False), (left, True))]
    both = sides[0].unionByName(sides[1])
    # statements of no entity meet nothing, so they are dealt by their text
    dealt = both.repartition(F.col("entity"), F.when(F.col("entity").isNull(), F.xxhash64("text"))).sortWithinPartitions("entity", "own")
    schema = StructType([*(StructField(c, both.schema[c].dataType) for c in ("id", "entity", "text")), StructField("nt", IntegerType()), StructField("score", DoubleType()), StructField("jaccard", DoubleType()), StructField("n_in", LongType()), StructField("n_all", LongType()), StructField("r_text", StringType()), StructField("section", both.schema["section"].dataType)])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column("t").flatten())
            if n < AT_ONCE or not b.num_rows:
                continue
            rows = pa.Table.from_batches(held)
            codes = _codes(rows["entity"])
            whole = rows.num_rows if not rows["entity"][-1].is_valid else int(np.flatnonzero(codes == codes[-1])[0])  # the last entity may go on
            if whole:
                yield from _best(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                n = sum(len(x.column("t").flatten()) for x in held)
        if held:
            yield from _best(pa.Table.from_batches(held))

    return dealt.withColumn("t", content_tokens(F.col("text"))).mapInArrow(met, schema)


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, nulls included."""
    return values.combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)


def _best(rows: pa.Table) -> list[pa.RecordBatch]:
    """Left statements of whole entities with their best right ones."""
    own, entity = rows["own"].to_numpy(), _codes(rows["entity"])
    lists = rows["t"].combine_chunks()
    n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    key = entity[row] * (len(words.dictionary) + 1) + words.indices.to_numpy()
    order = np.flatnonzero(~own[row])
    order = order[np.argsort(key[order], kind="stable")]
    theirs, holder = key[order], row[order]
    n_all = np.bincount(entity[holder[np.flatnonzero(np.diff(theirs, prepend=-1))]], minlength=int(entity.max(initial=0)) + 1)
    asked = np.flatnonzero(own & (n >= LEAST_TOKENS))
    mine = np.flatnonzero((own & (n >= LEAST_TOKENS))[row])
    first = np.searchsorted(theirs, key[mine])
    many = np.searchsorted(theirs, key[mine], side="right") - first
    n_in = np.bincount(row[mine], weights=many > 0, minlength=len(n)).astype(np.int64)
    work = np.bincount(row[mine], weights=many, minlength=len(n)).astype(np.int64)[asked]
    ends = np.cumsum(n[asked])
    pos = rows["pos"].fill_null(0).to_numpy().astype(np.int64)
    best, both = np.full(len(n), -1), np.zeros(len(n), np.int64)
    for part in slices(work, AT_ONCE):
        a, b = ends[part][0] - n[asked[part.start]], ends[part][-1]
        pairs, count = np.unique(np.repeat(row[mine[a:b]], many[a:b]) * len(n) + holder[spread(first[a:b], many[a:b])], return_counts=True)
        l, r = pairs // len(n), pairs % len(n)
        order = np.lexsort((pos[r], -count / np.minimum(n[l], n[r]), l))
        order = order[np.flatnonzero(np.diff(l[order], prepend=-1))]
        best[l[order]], both[l[order]] = r[order], count[order]
    l = np.flatnonzero(own)
    r, shared, found = best[l], both[l], best[l] >= 0
    score, jaccard = (pa.array(np.divide(shared, of, where=found, out=np.zeros(len(l))), mask=~found) for of in (np.minimum(n[l], n[r]), n[l] + n[r] - shared))
    matched = rows.select(["text", "section"]).take(pa.array(r, mask=~found))
    out = rows.select(["id", "entity", "text"]).take(l)
    for name, values in {"nt": pa.array(n[l].astype(np.int32), mask=lists.is_null().to_numpy(zero_copy_only=False)[l]), "score": score, "jaccard": jaccard, "n_in": pa.array(n_in[l], mask=~found), "n_all": pa.array(n_all[entity[l]])}.items():
        out = out.append_column(name, values)
    return out.append_column("r_text", matched["text"]).append_column("section", matched["section"]).combine_chunks().to_batches()


def duplicate_ratio(flagged: DataFrame) -> DataFrame:
    """Part of each entity's statements that are duplicates, to two digits."""
    return flagged.groupBy("entity").agg(F.count("*").alias("n"), F.count_if("duplicate").alias("n_duplicates"), rounded(F.count_if("duplicate") / F.greatest(F.count("*"), F.lit(1)), 2).alias("duplicate_ratio"))


def suppressions(flagged: DataFrame, canonical: Column | str = "entity") -> DataFrame:
    """Distinct (entity, key) of source statements that a duplicate stands for."""
    c = F.col(canonical) if isinstance(canonical, str) else canonical
    return flagged.where("duplicate and match_text is not null").select(c.alias("entity"), statement_key(F.col("match_text")).alias("key")).distinct()


def suppressed(statements: DataFrame, gone: DataFrame) -> DataFrame:
    """Statements (entity, text, ...) whose text is not among those to drop."""
    keyed = statements.withColumn("_key", statement_key(F.col("text")))
    return keyed.join(gone.select(F.col("entity"), F.col("key").alias("_key")), ["entity", "_key"], "left_anti").select(statements.columns)


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with jaccard and containment of two text columns' tokens."""
    x, y = content_tokens(F.col(a)), content_tokens(F.col(b))
    # made once for each row; an expression is made again wherever it stands
    tokens = pairs.withColumn("_x", x).withColumn("_y", y)
    return tokens.withColumn("jaccard", jaccard(F.col("_x"), F.col("_y"))).withColumn("containment", containment(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def first_of(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")
