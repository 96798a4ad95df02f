"""Pages written from the parts table in the forms that the parsers read, so that what they find is known.

A page a part: n is its name with a capital, low its name, kind its type in small letters,
id its key. Each form states its HTML as a template over those.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markup
from .views import load, spread

FORMS = {
    "field_monographs": "<title>{n} - Leaflets</title><p>Leaflet {id}.</p><p><i>{low} of {kind}</i> and <i>{n}</i></p><b>Mind.--</b>Calm  as {brand} .<b>Modalities.--</b>Better, from {low}; Worse, at {id}.<b>Relationship.--</b>Compare: {n}, Rhus.<p>Copyright {id}</p>",
    "dictionary_records": "<title>{n}. Leaflet</title><p><i>{low} {kind}</i><i>--</i></p><p>Clinical.—</p><p>Used for {kind}.</p><p>SYMPTOMS. Mind.—</p><p>Calm as {brand}\n.</p><p>Aggravation.–</p><p>At {id}.</p><p>Amelioration.—</p><p>In rest.</p><p>Relations.—</p><p>Compare {n}.</p><p>Mind.—</p><p>Again {id}.</p>",
    "prose_records": "<title>x</title><p>{up}</p><p>A leaflet of ten words or more about the {low} of part number {id}. Compare {n}.</p><p>{up} AGAIN</p><p>Too short {id}.</p><p><i>{n}, Rhus tox; low</i></p>",
    "keynote_records": "<title>x</title><p><a name=\"a{id}\"></a><b>{n}. The leaflet</b> First of the {kind}; second of part {id}. Third.</p><p><b>Aggravation:</b> at {id}.</p><p><b>Relations.</b> Like {n} and Rhus.</p><p><b>Other thing. Of {brand}</b> Nothing else is known here.</p>",
    "sectioned_records": "<title>{n}. - Leaflets</title><p>MIND. [1] {n}. Calm as {brand}. Fears the {low} θ fever {id}.</p><p><b>Second thing of part {id}.</b></p><p>Head: hair. [2] Pain of {kind}; At night {id}.</p><p>Relations. [48] Compare {n}, Rhus.</p><p>Copyright</p>",
    "rubric_records": "<title>x</title><p><a href=\"/mind\">MIND</a> p. {id}</p><p><b>Anger</b>: <b>{first}</b>, <i>{last}</i>, {kind}, see rage</p><p>evening {id}: <i>{first}</i>, two words</p><p><a href=\"/head\">Head</a></p><p>Pain: {last}</p><p><b>Vertigo</b></p><p>rising: <b>{first}</b></p>",
    "aphorisms": "<title>x</title><a name=\"P{no}\"></a><p>§ {no}</p><p>The {low} of part {id}.</p><p>1</p><p>A note on {kind}.</p><a name=\"P{no}E5\"></a><p>§ {no} Fifth Edition</p><p>An older text of {id}.</p><a name=\"P{more}E6\"></a><p>§ {more} Sixth Edition</p><p>The {kind}.</p><p>* starred {id}</p>",
    "lectures": "<title>Lecture {no} - Leaflets</title><p>Leaflets</p><p>LECTURE {no} : Organon § {no} and {more}</p><p>{n}s and their use.</p><p>\"A caption.\"</p><p>The {low} of part {id} is named in § {more} and paragraph 7-9.</p>",
}
FIELDS = {
    "id": "p_partkey", "n": "upper(left(p_name, 1)) || substr(p_name, 2)", "low": "p_name", "up": "upper(p_name)", "kind": "lower(p_type)", "brand": "p_brand",
    "first": "substring_index(p_name, ' ', 1)", "last": "substring_index(p_name, ' ', -1)", "no": "p_partkey % 290 + 1", "more": "p_partkey % 290 + 2",
}


def filled(template: str) -> Column:
    """The template's HTML; double braces stand for single ones."""
    bits = re.split(r"(?<!\{)\{(\w+)\}(?!\})", template)
    return F.concat(*(F.expr(f"cast({FIELDS[b]} as string)") if k % 2 else F.lit(b.replace("{{", "{").replace("}}", "}")) for k, b in enumerate(bits)))


def walked(spark: SparkSession, d: str, body: Column) -> DataFrame:
    """id, url and the walked page of each part, with name and abbrev as an index would give them."""
    html = F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("http://leaflets.example.com/"), "p_partkey").alias("url"), html.alias("html"), F.expr(FIELDS["n"]).alias("name"), F.lit("").alias("abbrev"))
    return markup.pages(spread(p))


def pages(spark: SparkSession, d: str, form: str) -> DataFrame:
    return walked(spark, d, filled(FORMS[form]))


def indexes(spark: SparkSession, d: str, name: str = "lect{id}.htm") -> DataFrame:
    """url, position and walked page of an index for each brand: its parts' names in bold, each before a link to its leaflet.

    Parts whose key ends in 3 are not linked; those whose key ends in 4 are linked by a rooted
    address, those in 5 by one that goes up and down again.
    """
    bits = name.split("{id}")
    file = F.concat(F.lit(bits[0]), F.col("p_partkey").cast("string"), F.lit(bits[1]))
    last = F.col("p_partkey") % 10
    href = F.when(last == 4, F.concat(F.lit("/a/"), file)).when(last == 5, F.concat(F.lit("a/../a/./"), file, F.lit("#top"))).otherwise(F.concat(F.lit("a/"), file))
    entry = F.concat(F.lit("<p><b>"), F.expr(FIELDS["n"]), F.lit(" "), F.col("p_partkey").cast("string"), F.lit('</b> <a href="'), href, F.lit('">leaflet</a></p>'))
    p = load(spark, d, "part").where("p_partkey % 10 <> 3")
    g = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    number = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    g = g.repartition(spark.sparkContext.defaultParallelism)  # few pages with very many links each: what moved is small, what they hold is long to walk
    return markup.pages(g.select(F.lit("http://leaflets.example.com/index.htm").alias("url"), number.alias("position"), F.concat(F.lit("<html><body><a href='main.htm'>Main</a>"), "body", F.lit("</body></html>")).alias("html")))
