"""Scalar functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that Python's str.split takes for white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DASHES = r"\u2010-\u2015\u0096\u0097\u2212\-"

# What C1 control characters and ligatures stand for.
SINGLE = {"\u0091": "'", "\u0092": "'", "\u0093": '"', "\u0094": '"', "\u0095": "*", "\u0096": "–", "\u0097": "—", "\u0082": ",", "\u0084": '"', "\u008b": "<", "\u009b": ">", "\u0086": "+", "\u0087": "+"}
MULTIPLE = {"\u0085": "...", "\u0099": "(TM)", "œ": "oe", "æ": "ae", "Œ": "OE", "Æ": "AE"}

# Words that say nothing about a statement.
STOP_WORDS = tuple("the a an of in on to and or with is are was were be been it its his her as at by for from that this these those not no all any".split())
SPARSE_FIELDS = ("dose", "relationship", "relations", "causation", "non-homeopathic uses")
SPARSE_WORDS = 15

# Phrases that name another domain.
FOREIGN_TERMS = (
    "acupuncture", "meridian theory", "meridian point", "unani", "tibb", "naturopathic", "naturopathy", "ayurvedic", "ayurveda", "dosha", "chiropractic",
    "traditional chinese medicine", "monoclonal antibody", "crispr", "mrna vaccine", "lipid nanoparticle", "pcr-based", "polymerase chain reaction", "statin",
    "chemotherapy", "mri scan", "ct scan", "ecg", "ekg", "laparoscopic", "histopathology", "brachial plexus", "conduction system", "pharmacokinetics",
    "antibiotic resistance", "gdpr", "bitcoin", "gradient descent",
)

# Words that open a sentence about relations and are no names.
NOT_NAMES = ("compare", "complementary", "not", "after", "before", "similar", "compatible", "incompatible", "like", "followed", "follows", "antidotes", "affects", "inimical", "complements", "the", "similarto")

ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def strip(c: Column, what: str = SPACE) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(c, f"^{what}+|{what}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    """White-space words; none for a blank text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def clean(c: Column) -> Column:
    """Undo control characters and ligatures, squeeze blanks, pull punctuation to its word, cap blank lines."""
    out = F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))
    for a, b in MULTIPLE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, f"{SPACE}+([.,;:!?])", "$1")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def folded(c: Column) -> Column:
    """Lower case with single blanks, for comparing quotes."""
    return collapse(F.lower(c))


def statement_key(c: Column) -> Column:
    return F.lower(collapse(c))


def name_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def name_key(c: Column) -> Column:
    return F.array_join(name_tokens(c), " ")


def content_tokens(c: Column) -> Column:
    """Distinct words of over two letters that are no stop words."""
    return F.array_distinct(F.filter(name_tokens(c), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def first_word(c: Column) -> Column:
    return F.coalesce(letters(F.get(words(c), F.lit(0))), F.lit(""))


def _bare(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"\.+$", ""))


def name_variants(c: Column) -> Column:
    """Ways to write a name: without its parentheses, what is in them, and the sides of a dash; never empty."""
    s = strip(c)
    main = _bare(collapse(F.regexp_replace(s, rf"{SPACE}*\([^)]*\){SPACE}*", " ")))
    inner = F.transform(F.regexp_extract_all(s, F.lit(r"\(([^)]*)\)"), F.lit(1)), _bare)
    bases = F.array_distinct(F.filter(F.concat(F.array(main), inner), lambda b: b != ""))
    parts = F.flatten(F.transform(bases, lambda b: F.split(b, f"{SPACE}*--{SPACE}*|{SPACE}+—{SPACE}+")))
    out = F.transform(F.filter(parts, lambda p: strip(p) != ""), _bare)
    return F.when(F.size(out) > 0, out).otherwise(F.array(s))


def markers(name: Column, abbreviation: Column) -> Column:
    """Running headers that may open a section: the abbreviation and the name without parentheses."""
    main = _bare(F.regexp_replace(name, rf"{SPACE}*\([^)]*\){SPACE}*", " "))
    return F.filter(F.array(abbreviation, main), lambda m: m.isNotNull() & (m != ""))


def strip_marker(text: Column, heads: Column) -> Column:
    """``text`` without a leading marker; null if nothing else is there; unchanged if none leads it."""
    def quoted(m: Column) -> Column:
        return F.concat(F.lit(r"\Q"), F.array_join(words(m), r"\E" + f"{SPACE}+" + r"\Q"), F.lit(r"\E"))

    usable = F.filter(heads, lambda m: n_words(m) > 0)
    pattern = F.concat(F.lit(f"(?i)^{SPACE}*(?:"), F.array_join(F.transform(usable, quoted), "|"), F.lit(rf")\.?{SPACE}*\]?{SPACE}*"))
    rest = F.regexp_replace(text, pattern, "")
    return F.when(F.size(usable) == 0, text).when(F.rlike(text, pattern), F.nullif(strip(rest), F.lit(""))).otherwise(text)


def strip_rule(c: Column) -> Column:
    """Drop one leading box-drawing dash and the blanks behind it."""
    return F.regexp_replace(c, f"^─{SPACE}*", "")


def is_sparse(text: Column, field: Column | None = None) -> Column:
    """Too thin to ask about: a field of cross-references, or under fifteen words."""
    short = n_words(text) < SPARSE_WORDS
    return short if field is None else short | F.coalesce(F.lower(strip(field)).isin(*SPARSE_FIELDS), F.lit(False))


def content_id(source: Column, locator: Column, text: Column) -> Column:
    """Sixteen hexadecimal digits that name a passage."""
    return F.substring(F.sha1(F.concat_ws("|", source, locator, text).cast("binary")), 1, 16)


def query_tokens(c: Column) -> Column:
    """The quoted phrases of a keyword query: unsafe punctuation apart, split at white space."""
    return words(F.regexp_replace(c, r'["*^:()\-]', " "))


def index_tokens(c: Column) -> Column:
    """Letters and digits, lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def foreign_term(c: Column, terms: tuple[str, ...] = FOREIGN_TERMS) -> Column:
    """The first whole phrase of another domain, as written, or null."""
    pattern = r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?![\p{L}\p{N}_])"
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def parse_choice(text: Column, options: Column) -> Column:
    """Index of the option meant by a letter, a number or part of its text; null if none."""
    t = F.regexp_replace(F.lower(strip(text)), r"[).:]+$", "")
    at = F.filter(F.transform(options, lambda o, i: F.when(F.contains(F.lower(strip(o)), t), i)), lambda i: i.isNotNull())
    return F.when(t.rlike("^[a-d]$"), F.ascii(t) - 97).when(t.rlike("^[1-4]$"), t.try_cast("int") - 1).when(t != "", F.get(at, F.lit(0)))


def split_modalities(c: Column) -> Column:
    """What is better and worse, as a map without empty values."""
    t = F.regexp_replace(c, f"{SPACE}+", " ")
    found = F.create_map(F.lit("better"), clean(F.regexp_extract(t, r"(?i)better([^.;]*[.;])", 1)), F.lit("worse"), clean(F.regexp_extract(t, r"(?is)worse(.*)$", 1)))
    return F.map_filter(found, lambda _, v: v.isNotNull() & (v != ""))


def first_seen(items: Column, key=lambda x: F.lower(x)) -> Column:
    """Items whose key did not occur before, in order."""
    none = F.array().cast("array<string>")

    # in one pass: items inside a lambda would be made again for each of them
    def step(acc: Column, x: Column) -> Column:
        return F.when(~F.array_contains(acc["keys"], key(x)), F.named_struct(F.lit("keys"), F.array_append(acc["keys"], key(x)), F.lit("items"), F.array_append(acc["items"], x))).otherwise(acc)

    return F.aggregate(items, F.struct(none.alias("keys"), none.alias("items")), step, lambda acc: acc["items"])


def title_names(c: Column) -> Column:
    """Capitalised words of three letters or more, first seen, without those that open phrases."""
    found = F.regexp_extract_all(c, F.lit(r"((?<![\p{L}\p{N}_])[A-Z][a-z]{2,}(?![\p{L}\p{N}_]))"), F.lit(1))
    return first_seen(F.filter(found, lambda w: ~F.lower(w).isin(*NOT_NAMES)))


def format_sources(hits: Column) -> Column:
    """Blocks of locator and text of an array of structs, a blank line between."""
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("["), h["locator"], F.lit("]\n"), h["text"])), "\n\n")


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, also behind apostrophes and parentheses."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")
