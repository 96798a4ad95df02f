import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stats, text


@pytest.fixture()
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("v")).first().v

    return get


@pytest.mark.parametrize("count, n, want", [(3, 4, (0.3006, 0.9544)), (5, 6, (0.4365, 0.9699)), (4, 4, (None, 1.0)), (0, 4, (0.0, None)), (0, 0, None)])
def test_wilson(value, count, n, want):
    got = value(stats.wilson(F.lit(count), F.lit(n)))
    if want is None:
        assert got is None
    else:
        assert all(w is None or abs(g - w) < 1e-9 for g, w in zip((got.lo, got.hi), want))
        assert 0 <= got.lo <= got.hi <= 1


def test_rate_report(value):
    r = value(stats.rate_report(F.lit(5), F.lit(6)))
    assert (r.rate, r.n, r["count"]) == (0.8333, 6, 5)
    assert value(stats.rate_report(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize("values, p, want", [([1, 2, 3, 4, 5], 0.5, 3), ([1, 2, 3, 4], 0.5, 2.5), ([9], 0.95, 9), ([4, 1, 3, 2], 0.0, 1), ([4, 1, 3, 2], 1.0, 4)])
def test_percentile(spark, values, p, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert df.agg(stats.percentile(F.col("v"), p)).first()[0] == want


def test_similarities(value):
    a, b, e = (F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (["x", "y", "z"], ["x", "y", "q", "r"], []))
    assert value(stats.jaccard(a, b)) == 2 / 5 and value(stats.containment(a, b)) == 2 / 3
    assert value(stats.jaccard(a, e)) == value(stats.containment(e, a)) == 0
    assert abs(value(stats.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) - math.sqrt(0.5)) < 1e-12
    assert value(stats.share_floor(F.lit(2), F.lit(3))) == 66 and value(stats.share_floor(F.lit(0), F.lit(0))) == 0


def test_white_space_is_what_python_splits_at(value):
    odd = "a b c\u0085d\u001ce  f　"
    assert value(text.words(F.lit(odd))) == odd.split()
    assert value(text.collapse(F.lit(f"  {odd}\n"))) == " ".join(odd.split())
    assert value(text.words(F.lit(" \n"))) == []


@pytest.mark.parametrize("given, want", [("Acon .  Bry , x", "Acon. Bry, x"), ("a\n\n\n\nb", "a\n\nb"), ("\u0091q\u0092 \u0096 \u0085", "'q' –..."), ("hœm Æ", "hoem AE"), ("  \t x  ", "x")])
def test_clean(value, given, want):
    assert value(text.clean(F.lit(given))) == want


def test_tokens(value):
    assert value(text.name_tokens(F.lit("Act. R-x é2b"))) == ["act", "r", "x", "b"]
    assert value(text.name_key(F.lit("KALI-bi."))) == "kali bi"
    assert value(text.content_tokens(F.lit("The pain, the PAIN of ox and an eye"))) == ["pain", "eye"]
    assert value(text.letters(F.lit("Nux-Vom. 2"))) == "nuxvom" and value(text.letters(F.lit(None).cast("string"))) == ""
    assert value(text.first_word(F.lit("  Nux. vomica"))) == "nux" and value(text.first_word(F.lit(""))) == ""


@pytest.mark.parametrize("given, want", [
    ("Actea Racemosa. (Cimicifuga.)", ["Actea Racemosa", "Cimicifuga"]), ("ABRUS PRECATORIUS -- JEQUIRITY", ["ABRUS PRECATORIUS", "JEQUIRITY"]),
    ("Cina (Quina) Boliviana", ["Cina Boliviana", "Quina"]), ("Plain", ["Plain"]), ("A — B", ["A", "B"]), ("()", ["()"]),
])
def test_name_variants(value, given, want):
    assert value(text.name_variants(F.lit(given))) == want


def test_markers(value):
    heads = text.markers(F.lit("Abies Nigra (Spruce)."), F.lit("Abies. n."))
    assert value(heads) == ["Abies. n.", "Abies Nigra"]
    for given, want in (("Abies.  n. ] Pain after", "Pain after"), ("abies nigra", None), ("Pain in Abies. n.", "Pain in Abies. n."), ("ABIES NIGRA. Cold", "Cold")):
        assert value(text.strip_marker(F.lit(given), heads)) == want
    assert value(text.strip_marker(F.lit("x"), F.array().cast("array<string>"))) == "x"


def test_sparse(value):
    short, enough = " ".join(["w"] * 14), " ".join(["w"] * 15)
    assert value(text.is_sparse(F.lit(short))) and not value(text.is_sparse(F.lit(enough)))
    assert value(text.is_sparse(F.lit(enough), F.lit(" DOSE "))) and not value(text.is_sparse(F.lit(enough), F.lit("Mind")))
    assert not value(text.is_sparse(F.lit(enough), F.lit(None).cast("string")))


def test_content_id(value):
    import hashlib

    want = hashlib.sha1("Bök|§ 1|tëxt".encode()).hexdigest()[:16]
    assert value(text.content_id(F.lit("Bök"), F.lit("§ 1"), F.lit("tëxt"))) == want


def test_query_tokens(value):
    assert value(text.query_tokens(F.lit('wax,black "pain" (it\'s) -> x:y ^*'))) == ["wax,black", "pain", "it's", ">", "x", "y"]
    assert value(text.query_tokens(F.lit(""))) == []
    assert value(text.index_tokens(F.lit("Évil, the 2nd's"))) == ["evil", "the", "2nd", "s"]


@pytest.mark.parametrize("given, want", [("about Bitcoin now", "Bitcoin"), ("bitcoins", None), ("a CT  scan", None), ("ct scan!", "ct scan"), ("préecg", None), ("", None)])
def test_foreign_term(value, given, want):
    assert value(text.foreign_term(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("B", 1), (" b). ", 1), ("2", 1), ("5", None), ("phos", 2), ("", None), ("zz", None), ("d:", 3)])
def test_parse_choice(value, given, want):
    options = F.array(*map(F.lit, ["Sulphur", "Bryonia", "Phosphorus", "Sepia"]))
    assert value(text.parse_choice(F.lit(given), options)) == want


def test_modalities_and_names(value):
    got = value(text.split_modalities(F.lit("Better, from heat; Worse, cold air;\n at night.")))
    assert got == {"better": ", from heat;", "worse": ", cold air; at night."}
    assert value(text.split_modalities(F.lit("nothing"))) == {}
    assert value(text.title_names(F.lit("Compare: Bry. Nux, bry; Sulphur. The Éa Ox Lyc"))) == ["Bry", "Nux", "Sulphur", "Lyc"]
    assert value(text.title_case(F.lit("o'neil (ABC) d"))) == "O'Neil (Abc) D"


def test_format_sources(value):
    hits = F.array(F.struct(F.lit("L1").alias("locator"), F.lit("t1").alias("text")), F.struct(F.lit("L2").alias("locator"), F.lit("t2").alias("text")))
    assert value(text.format_sources(hits)) == "[L1]\nt1\n\n[L2]\nt2"


def test_draw_key_is_md5(value):
    import hashlib

    assert value(stats.draw_key(F.lit(5), F.lit("x"), seed=7)) == hashlib.md5(b"5|x|7").hexdigest()
    assert 0 <= value(stats.uniform(F.lit(5), seed=7)) < 1
