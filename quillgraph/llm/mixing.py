"""Mixing sources to target weights by a low-discrepancy schedule.

Targets follow from the sources' weights and sizes; a source whose target would exceed its
limit stops there and the excess is shared by weight among the others until none is above.
The mix is a row of slots of up to ``block`` words each. A source has as many slots as its
target needs, counted in words: the last block of a pass is short, and the last slot is cut
to the words that the target still lacks (fractions of a word count as one). Slot i belongs
to the source whose part of the cumulated slots holds the place of the i-th point of the
golden-ratio sequence among all points, so every stretch of the mix is close to the targets.
The slots of a source are ranked in order, and the slot of rank r takes block r of the
source's shuffled documents, laid end to end and cut into equal blocks; after the last
block a further pass begins.

Nothing is ordered within one task: documents are laid out in buckets by the MD5 of the seed,
their id and text, slots in stretches of the schedule and points in cells of their value,
each with the total of those before it (added up in ranges first), so a source may hold any part of the rows. Rows that
agree in all that counts are laid out as one with a number of copies, end to end.

Defined results: a null text has size 0; a null source is a source of its own, behind all
others; an empty source has the target 0 and takes nothing; documents without a word are
never taken; rows with equal or null doc_id are laid out one by one. A word here is a run of
anything but ASCII white space. Further columns are ignored, or kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed_join, materialize

GOLDEN = 0.6180339887498949  #: fixed value: the golden ratio's fraction
STRETCH = 1 << 14
BUCKET_ROWS = 1024
COPIES = 4096  #: copies of one row that are laid out by one task
RANGE = 4096  #: numbers whose totals one task adds up
PARTS = 256  #: parts in which a group's rows are numbered
SPACE = r"[\x20\x09-\x0D]"


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """source, source_size, target for a row a source (source, source_size).

    With caps c and weights w, the shares are min(c, level * w): in order of c / w, the
    sources below the level are capped and the level is what is left over the weights left.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", (total - before) / left).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return w.withColumn("at", level["level"]).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def counted(shares: DataFrame, block: int) -> DataFrame:
    """``shares`` with wanted, the target in whole words, and slots, the blocks that hold them in passes over the source."""
    size = F.col("source_size")
    wanted = F.when((F.col("target") > 0) & (size > 0), F.ceil(F.col("target") - 1e-6).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    s = shares.withColumn("wanted", wanted)
    passes = F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(0)
    return s.withColumn("slots", passes * F.ceil(size / block) + F.ceil((F.col("wanted") - passes * size) / block))


def _before(counts: DataFrame, group: list[str], at: str, n: str, name: str) -> DataFrame:
    """``counts`` (group, at, n; a row a number) with ``name``, the sum of n before each row of its group in the order of ``at``, for n.

    Sums over ranges of RANGE numbers come first, so no task sorts more than one range, or
    the ranges of one group: 1/RANGE of its numbers.
    """
    c = counts.withColumn("range", F.floor(F.col(at) / RANGE))
    upto = Window.partitionBy(*group).orderBy("range")
    wide = c.groupBy(*group, "range").agg(F.sum(n).alias("own"))
    wide = wide.select(*(F.col(g).alias(f"{g}_") for g in group), F.col("range").alias("range_"), (F.sum("own").over(upto) - F.col("own")).alias("wide"))
    local = c.withColumn("local", F.sum(n).over(Window.partitionBy(*group, "range").orderBy(at)) - F.col(n))
    same = F.col("range") == F.col("range_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_"))
    return local.join(wide, same).select(*group, at, (F.col("wide") + F.col("local")).alias(name))


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """slot, source, rank (from 0 within the source) and the further columns, for a row a source (source, target[, slots, ...])."""
    spark = shares.sparkSession
    if "slots" not in shares.columns:
        shares = shares.withColumn("slots", F.ceil(F.col("target") / block))
    slots = int(shares.agg(F.sum("slots")).first()[0] or 0)
    upto = Window.orderBy(F.col("source").isNull(), "source")
    bounds = shares.where("slots > 0").select("source", "slots", F.sum("slots").over(upto).alias("hi")).withColumn("lo", F.col("hi") - F.col("slots"))
    # places of all sources, a stretch of them at a time; a row a slot, so never broadcast
    begin = F.explode(F.sequence(F.floor(F.col("lo") / STRETCH), F.floor((F.col("hi") - 1) / STRETCH)))
    cut = bounds.withColumn("part", begin).select("source", F.greatest("lo", F.col("part") * STRETCH).alias("lo"), F.least("hi", (F.col("part") + 1) * STRETCH).alias("hi"))
    places = cut.repartition(max(1, min(slots // STRETCH, 1 << 12))).select("source", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("place"))
    # the points' places by value: in their cell, and behind the cells before
    cells = max(1, slots // 4096)
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    points = spark.range(slots).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    ahead = _before(points.groupBy("cell").count(), [], "cell", "count", "ahead")
    placed = points.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("point", "id")) - 1).join(ahead, "cell").select("id", (F.col("ahead") + F.col("n")).alias("place"))
    dealt = placed.join(places.hint("merge"), "place").select(F.col("id").alias("slot"), "source", F.floor(F.col("id") / STRETCH).alias("stretch"))
    key = ["source", "stretch"]
    before = _before(dealt.groupBy(*key).count(), ["source"], "stretch", "count", "before")
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy(*key).orderBy("slot")) - 1)
    more = [c for c in shares.columns if c not in ("source", "target", "slots")]
    # a row a source and stretch, with what is known of the source
    known = shares.select(F.col("source").alias("s"), *more)
    before = before.join(known, before["source"].eqNullSafe(known["s"])).drop("s")
    same = local["source"].eqNullSafe(before["source"]) & (local["stretch"] == before["stretch"])
    return local.join(before, same).select("slot", local["source"], (F.col("before") + F.col("local")).alias("rank"), *more)


def laid_out(rows: DataFrame, shares: DataFrame, buckets: int) -> DataFrame:
    """The copies of ``rows`` (row, doc_id, source, size, h, copies), each with ``copy``, source_size, target and ``first``: the words of its source before it, in the order of h."""
    d = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)))
    key, words = ["source", "bucket"], F.col("size") * F.col("copies")
    before = _before(d.groupBy(*key).agg(F.sum(words).alias("n")), ["source"], "bucket", "n", "before")
    known = shares.withColumnRenamed("source", "s")
    before = before.join(known, before["source"].eqNullSafe(known["s"])).drop("s")
    order = Window.partitionBy(*key).orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("local", F.sum(words).over(order) - words)
    same = local["source"].eqNullSafe(before["source"]) & (local["bucket"] == before["bucket"])
    local = local.join(before, same).select("row", "doc_id", local["source"], "size", "copies", "source_size", "target", (F.col("before") + F.col("local")).alias("first"))
    step = F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))
    many = local.where(F.col("copies") > COPIES).withColumn("copy", F.explode(step)).repartition("row", "copy")
    parts = local.where(F.col("copies") <= COPIES).withColumn("copy", F.lit(0).cast("bigint")).unionByName(many)
    upto = F.least(F.col("copies"), F.col("copy") + COPIES) - 1
    parts = parts.withColumn("copy", F.explode(F.sequence("copy", upto)))
    return parts.select("row", "copy", "doc_id", "source", "size", "source_size", "target", (F.col("first") + F.col("copy") * F.col("size")).alias("first"))


def sized(docs: DataFrame, seed: str) -> list[Column]:
    """Of documents: their id, source, size, and the order h."""
    body = F.coalesce(F.col("text"), F.lit(""))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("bigint").cast("string"), body))
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), order.alias("h")]


def apportioned(rows: DataFrame, weights: Sequence[float], share: float, limit: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Of a table (row, doc_id, source, size, h, copies) the copies laid out, and the schedule with rank, block number and room, the words to take.

    ``weights`` repeat over the sources by code point. A block is taken ``limit`` times at most.
    """
    n = rows.count()
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    shares = materialize(targets(sizes, weights, share, limit), "targets")
    placed = laid_out(rows, shares, max(1, -(-n // BUCKET_ROWS)))
    needs = counted(shares, block)
    plan = schedule(needs.select("source", "target", "slots", "source_size", "wanted"), block)
    blocks = F.ceil(F.col("source_size") / block)
    plan = plan.withColumn("block", F.pmod("rank", blocks)).withColumn("pass", F.floor(F.col("rank") / blocks))
    room = F.least(F.lit(block).cast("bigint"), F.col("wanted") - F.col("pass") * F.col("source_size") - F.col("block") * block)
    return placed, plan.select("slot", "source", "rank", "block", "pass", room.alias("room"))


def _grouped(docs: DataFrame, seed: str) -> DataFrame:
    """Rows that agree in id, source, text's digest and size as one, with their number."""
    rows = docs.select(*sized(docs, seed)).groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """A row for each copy and block that overlap: where in the document, and how many words."""
    d = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    lo, hi = F.greatest(F.col("first"), F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return d.select("doc_id", "row", "copy", "source", "size", "block", (lo - F.col("first")).alias("start"), (hi - lo).alias("words"), (lo - F.col("block") * block).alias("offset"))


def _joined(found: DataFrame, plan: DataFrame) -> DataFrame:
    """Pieces with the slots of their block, cut to the room there."""
    right = plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    both = found.join(right, found["source"].eqNullSafe(F.col("s")) & (found["block"] == F.col("b"))).drop("s", "b")
    return both.withColumn("words", F.least("words", F.col("room") - F.col("offset"))).where("words > 0")


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: int = 2, block: int = 128, seed: str = "mix") -> DataFrame:
    """The mix itself: slot, pass, doc_id, source, start and words of each piece, in the order of slot."""
    placed, plan = apportioned(_grouped(docs, seed), weights, share, limit, block)
    return _joined(pieces(placed, block), plan).select("slot", "pass", "doc_id", "source", "start", "words")


def taken_words(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: int = 2, block: int = 128, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken."""
    placed, plan = apportioned(_grouped(docs, seed), weights, share, limit, block)
    placed = materialize(placed, "placed")
    times = plan.groupBy("source", "block", "room").agg(F.count("*").alias("times"))
    taken = _joined(pieces(placed, block), times).groupBy("row", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, ["row", "copy"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def cut(text: Column, start: Column, words: Column) -> Column:
    """The words from number ``start`` on, with the white space before each of them but the first of a text's start.

    The first of each run of white space is marked and found again by its number, so no array of words is made.
    """
    marked = F.regexp_replace(F.regexp_replace(text, f"(?<={SPACE}){SPACE}", "_"), SPACE, " ")
    lead = F.when(text.rlike(f"^{SPACE}"), 1).otherwise(0)

    def end(n: Column) -> Column:
        return F.length(F.call_function("substring_index", marked, F.lit(" "), (n + lead).cast("int")))

    begin = F.when(start > 0, end(start)).otherwise(0)
    return F.substring(text, begin + 1, end(start + words) - begin)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: int = 2, block: int = 128, seed: str = "mix") -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each row of theirs and pass that takes any of it.

    A document that a pass takes in part is cut to the words taken; n_chars, if there, follows
    the text. The rows are written once with a number each; all that is laid out and scheduled
    is numbers, and the texts meet their cuts by that number alone.
    """
    spare = "mix"
    while any(c.startswith(spare) for c in docs.columns):
        spare += "_"
    doc, source, size, h = sized(docs, seed)
    row, start, words, all_ = (f"{spare}{c}" for c in ("row", "start", "words", "size"))
    table = materialize(docs.withColumns({row: F.monotonically_increasing_id(), all_: size, f"{spare}h": h}), "mixed")
    rows = materialize(table.select(doc, source, F.col(all_).alias("size"), F.col(f"{spare}h").alias("h"), F.col(row).alias("row")), "sizes")
    same = ["doc_id", "source", "size", "h"]
    groups = materialize(rows.groupBy(*same).agg(F.min("row").alias("row"), F.count("*").alias("copies")), "groups")
    placed, plan = apportioned(groups, weights, share, limit, block)
    part = _joined(pieces(placed, block), plan.select("source", "block", "pass", "room"))
    part = part.groupBy("row", "copy", "pass").agg(F.min("start").alias(start), F.sum("words").alias(words))
    # which row is which copy, where a group has several
    several = groups.where("copies > 1").select(F.struct(*same).alias("k"), F.col("row").alias("group"), "copies")
    member = keyed_join(rows.select(F.struct(*same).alias("k"), "row"), several, ["k"], "copies").select("group", "row", F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("part"))
    ahead = member.groupBy("group", "part").count()
    ahead = ahead.select("group", "part", (F.sum("count").over(Window.partitionBy("group").orderBy("part")) - F.col("count")).alias("ahead"))
    member = member.withColumn("n", F.row_number().over(Window.partitionBy("group", "part").orderBy("row")) - 1).join(ahead, ["group", "part"])
    member = member.select((F.col("ahead") + F.col("n")).alias("copy"), F.col("row").alias(row), F.col("group").alias("row"))
    single = groups.where("copies = 1").select(F.lit(0).cast("bigint").alias("copy"), F.col("row").alias(row), "row")
    part = part.join(single.unionByName(member), ["row", "copy"]).select(row, start, words)
    out = table.join(part, row).withColumn("text", F.when(F.col(words) == F.col(all_), F.col("text")).otherwise(cut(F.col("text"), F.col(start), F.col(words))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
