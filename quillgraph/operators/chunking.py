"""Nested records flattened into citable passages (columns of schemas.CHUNK)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, content_id, is_sparse, markers, statement_key, strip, strip_marker, strip_rule

MOST_CHARS, OVERLAP = 2200, 180
SUBJECTS = {"aphorisms": "Organon of Medicine", "field_monographs": "Materia Medica", "dictionary_records": "Materia Medica", "keynote_records": "Materia Medica", "sectioned_records": "Materia Medica", "prose_records": "Materia Medica"}


def paragraphs(text: Column, separator: str = rf"\n{SPACE}*\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def packed_parts(parts: Column, most: int = MOST_CHARS, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed greedily; a part begins with the end of the one before.

    The size is taken before a paragraph is added, with the blank lines that the buffer holds
    already, so a paragraph over the limit stays whole.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["buf"]) + F.length(p) > most) & (acc["buf"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(strip(acc["buf"])))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.concat(F.right(acc["buf"], F.lit(overlap)), F.lit(" "))).otherwise(acc["buf"]), p, F.lit("\n\n")).alias("buf"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(strip(acc["buf"]) != "", F.concat(acc["done"], F.array(strip(acc["buf"])))).otherwise(acc["done"]))


def passages(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows (text, source, layer, locator, url and perhaps remedy_raw, field, lead, extras) as passages.

    Blank ones go; sparseness is judged before the lead is put in front; names resolve by
    ``aliases`` (name, canonical); equal ids are kept once.
    """
    have = set(rows.columns)
    r = rows.withColumn("text", strip(F.col("text"))).where("text is not null and text <> ''")
    r = r.withColumn("sparse", is_sparse(F.col("text"), F.col("field") if "field" in have else None))
    if "lead" in have:
        r = r.withColumn("text", F.concat(F.coalesce("lead", F.lit("")), "text"))
    if aliases is not None and "remedy_raw" in have:
        r = r.join(aliases.select(F.col("name").alias("remedy_raw"), F.col("canonical").alias("remedy")), "remedy_raw", "left")
    extras = {"remedy": "string", "parent_locator": "string", "section_no": "int", "has_important": "boolean", "clinical": "array<string>"}
    for c, kind in extras.items():
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(kind))
    r = r.withColumn("id", content_id(F.col("source"), F.col("locator"), F.col("text")))
    return r.select("id", "text", "source", "layer", "locator", "url", "remedy", "sparse", *list(extras)[1:]).dropDuplicates(["id"])


def aphorism_rows(records: DataFrame, source: str, layer: str) -> DataFrame:
    """One passage an aphorism, and one a footnote that names its parent."""
    place = F.concat(F.lit("§ "), F.col("aphorism_no"))
    main = records.select("text", F.lit(source).alias("source"), F.lit(layer).alias("layer"), place.alias("locator"), "url", F.lit(None).cast("string").alias("parent_locator"))
    notes = records.select("aphorism_no", "url", F.explode("footnotes").alias("n")).select(F.col("n.text").alias("text"), F.lit(source).alias("source"), F.lit(layer).alias("layer"), F.concat(place, F.lit(", footnote "), F.col("n.marker")).alias("locator"), "url", place.alias("parent_locator"))
    return main.unionByName(notes)


def field_rows(records: DataFrame, source: str, layer: str = "") -> DataFrame:
    """One passage an entry of the map ``fields``; name and field lead the text."""
    e = records.select("remedy", "url", F.explode(F.map_entries("fields")).alias("e")).select("remedy", "url", F.col("e.key").alias("field"), F.col("e.value").alias("v")).where("v is not null")
    return e.select(strip_rule(F.col("v")).alias("text"), F.lit(source).alias("source"), F.lit(layer).alias("layer"), F.concat("remedy", F.lit(" § "), "field").alias("locator"), "url", F.col("remedy").alias("remedy_raw"), "field", F.concat("remedy", F.lit(" — "), "field", F.lit(". ")).alias("lead"))


def prose_rows(records: DataFrame, source: str, layer: str = "", most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Packed paragraphs of raw_text; parts are numbered where there are several."""
    p = records.withColumn("parts", packed_parts(paragraphs(F.col("raw_text")), most, overlap)).select("remedy", "url", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "text"))
    place = F.when(F.col("n") == 1, F.col("remedy")).otherwise(F.concat("remedy", F.lit(" (part "), F.col("at") + 1, F.lit(")")))
    return p.select("text", F.lit(source).alias("source"), F.lit(layer).alias("layer"), place.alias("locator"), "url", F.col("remedy").alias("remedy_raw"))


def symptoms(records: DataFrame) -> DataFrame:
    """Flat statements of sectioned records: the first of each section without its running header, empty ones dropped."""
    s = records.select("remedy", "abbrev", "url", F.posexplode("sections").alias("section_at", "s")).select("remedy", "abbrev", "url", "section_at", F.col("s.no").alias("section_no"), F.col("s.name").alias("section_name"), F.posexplode("s.symptoms").alias("at", "x"))
    text = F.when(F.col("at") == 0, strip_marker(F.col("x.text"), markers(F.col("remedy"), F.col("abbrev")))).otherwise(F.col("x.text"))
    return s.select("remedy", "url", "section_at", "section_no", "section_name", "at", text.alias("text"), F.coalesce("x.important", F.lit(False)).alias("important"), F.col("x.clinical").alias("clinical")).where("text is not null and text <> ''")


def section_rows(records: DataFrame, source: str, layer: str, gone: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """One passage a section: its statements in order, without those that ``gone`` (entity, key) suppresses for the canonical name."""
    s = symptoms(records)
    if gone is not None:
        named = s.join(aliases.select(F.col("name").alias("remedy"), F.col("canonical").alias("entity")), "remedy", "left") if aliases is not None else s.withColumn("entity", F.col("remedy"))
        s = named.withColumn("key", statement_key(F.col("text"))).join(gone, ["entity", "key"], "left_anti")
    g = s.groupBy("remedy", "url", "section_at", "section_no", "section_name").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"), F.bool_or("important").alias("has_important"), F.array_sort(F.collect_set(F.nullif(F.col("clinical"), F.lit("")))).alias("clinical"))
    return g.select(F.array_join(F.col("x.text"), " ").alias("text"), F.lit(source).alias("source"), F.lit(layer).alias("layer"), F.concat("remedy", F.lit(" § "), "section_name").alias("locator"), "url", F.col("remedy").alias("remedy_raw"), F.col("section_name").alias("field"), "section_no", "has_important", "clinical")


BUILDERS: dict[str, Callable[..., DataFrame]] = {"aphorisms": aphorism_rows, "field_monographs": field_rows, "dictionary_records": field_rows, "keynote_records": prose_rows, "sectioned_records": section_rows, "prose_records": prose_rows}


def build(records: dict[str, DataFrame], aliases: DataFrame | None = None, layers: dict[str, str] | None = None) -> DataFrame:
    """Passages of all given kinds of records with their subject; an unknown kind is an error."""
    unknown = set(records) - set(BUILDERS)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}; known: {sorted(BUILDERS)}")
    out = None
    for kind, df in records.items():
        one = passages(BUILDERS[kind](df, kind, (layers or {}).get(kind, "")), aliases).withColumn("subject", F.lit(SUBJECTS[kind]))
        out = one if out is None else out.unionByName(one)
    return out


def counts(chunks: DataFrame) -> DataFrame:
    """Passages by source and, with a null source, in all; none at all is an error."""
    by = chunks.groupBy("source").agg(F.count("*").alias("n"))
    none = chunks.sparkSession.range(1).select(F.lit(True).alias("all"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("bigint").alias("n"))
    # each source's count also goes to the total, so the passages are counted once
    both = by.select(F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("source"), F.col("n")), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("source"), F.col("n")))).alias("x")).select("x.*").unionByName(none)
    n = both.groupBy("all", "source").agg(F.sum("n").alias("n"))
    return n.select("source", F.when(F.col("all") & (F.col("n") == 0), F.raise_error(F.lit("no passages")).cast("bigint")).otherwise(F.col("n")).alias("n"))
