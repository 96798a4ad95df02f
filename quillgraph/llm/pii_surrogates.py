"""Personal data replaced by keyed, type-consistent surrogates; DataFrame expressions only.

Mentions are found by patterns: mail and IP addresses, phone, card and social security
numbers, IBANs, secrets (access keys, issued tokens, private keys, what is assigned to a
keyword such as password in any case and quoting, quoted tokens), and names of persons after
titles, after phrases that introduce a name ("my name is") or with a well-known given name,
with particles ("von", "de la") and openings ("O'", "Mc");
further bare mentions of a name in the same text follow it. A mention consists of parts; the distinct parts of
the corpus, each in a canonical form, get surrogates from a keyed SHA-256 stream:

* digits for digits and letters for letters, so length and format stay;
* phone numbers keep the first digit behind a plus, cards the first digit and a right check
  digit, IBANs country and right check digits, access keys their prefix;
* domains end in the reserved ``.example`` (or stay below example.com, .org, .net), IP
  addresses lie in the reserved blocks from 240 on and below 2001:db8;
* given names keep gender, and all names script (Latin or Cyrillic) and case.

One entity gets one surrogate wherever and however it is written. Surrogates are checked
against each other and against the corpus's own entities; those that collide are drawn anew
with the next counter. Every eight draws the form grows: names, mail names, domains, IBANs and
secrets by letters, numbers by digits, IPv4 addresses become IPv6 ones; so there is always a
free one. What repeats is settled once: texts are replaced by distinct text, not by row, and
the patterns go over each text once.

Defined results: null and empty texts stay as they are; all other columns stay, whatever
their names; rows with equal or null ids are replaced alike; the number of rows stays. Texts and
mentions may be of any length: no pattern repeats a group by recursion more than a few times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, materialize

# Titles by gender, and well-known given names by gender.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"), "u": ("Dr", "Prof", "Professor", "Doctor", "Доктор")}
GIVEN = {
    "m": (
        "Ahmed", "Alexander", "Andreas", "Andrew", "Anthony", "Antonio", "Benjamin", "Bob", "Brian", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Eric", "François", "Frank", "George", "Hans", "Henry",
        "Hiroshi", "Jack", "James", "Javier", "Jean", "John", "José", "Joseph", "Juan", "Jürgen", "Kevin", "Klaus", "Luis", "Manuel", "Mark", "Martin", "Matthew", "Michael", "Michel", "Miguel", "Mohammed", "Paul", "Peter",
        "Philippe", "Pierre", "Richard", "Robert", "Samuel", "Stefan", "Stephen", "Steven", "Thomas", "Timothy", "William", "Wolfgang", "Алексей", "Дмитрий", "Иван", "Михаил", "Сергей",
    ),
    "f": (
        "Alice", "Amanda", "Amy", "Ana", "Angela", "Anna", "Barbara", "Carmen", "Carol", "Catherine", "Charlotte", "Christine", "Claudia", "Deborah", "Dorothy", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Helen",
        "Isabel", "Isabelle", "Jennifer", "Jessica", "Julia", "Karen", "Katherine", "Laura", "Linda", "Lisa", "Lucía", "Margaret", "María", "Marie", "Mary", "Monika", "Nancy", "Nathalie", "Nicole", "Olivia", "Patricia",
        "Petra", "Priya", "Rachel", "Rebecca", "Ruth", "Sabine", "Sandra", "Sarah", "Sharon", "Sophie", "Stephanie", "Susan", "Ursula", "Анна", "Екатерина", "Мария", "Наталья", "Ольга",
    ),
}
# Words between given name and surname, and what surnames begin with.
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "ter", "bin", "al")
OPENINGS = ("O'", "O’", "D'", "D’", "Mc", "Mac")

# What introduces a name.
CUES = ("my name is", "My name is", "Name:", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "mon nom est", "Mon nom est", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "меня зовут", "Меня зовут")
_CUE = "(?:" + "|".join(CUES) + ")"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[A-Za-z0-9\-]++"
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in g) + ")"
_NAME = rf"(?!{_TITLE}(?!\p{{L}}))(?:{'|'.join(OPENINGS)})?\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME}"
# keywords of secrets; those that are also common words need an equals sign, a quote, a digit or no blank behind the colon
_PASS = r"(?i:passw(?:or)?d|pwd|passphrase|api[_\-]?key|access[_\-]?key|secret[_\-]?key|client[_\-]?secret|(?:auth|access|refresh)[_\-]?token)"
_WORDY = "(?i:secret|token)"
_KEY_END = r"""["']?[ \t]{0,4}"""
_BEGIN, _END = (f"-----{x} [A-Z ]*PRIVATE KEY-----" for x in ("BEGIN", "END"))
_ISSUED = "(?:gh[pousr]_|github_pat_|sk-|xox[abprs]-|glpat-|AIza|eyJ)"
#: A word that may be a bare mention of a name.
BARE = r"(?<!\p{L})(?:[OD]['’])?\p{Lu}\p{L}+(?:-\p{Lu}\p{Ll}+)?(?!\p{L})"
NO_NAMES = ("the", "he", "she", "it", "we", "you", "they", "and", "but", "this", "that", "in", "on", "der", "die", "das", "er", "sie", "es", "und", "le", "la", "les", "il", "elle", "et", "el", "los", "las", "он", "она")  #: after a title by mistake
_INITIALS = sorted({t[0] for g in GIVEN.values() for t in g})
_KNOWN = "(?:" + "|".join(f"{c}(?:" + "|".join(t[1:] for g in GIVEN.values() for t in g if t[0] == c) + ")" for c in _INITIALS) + ")"
PATTERNS = {
    "pem": rf"{_BEGIN}(?:[^\-]*+(?:-(?!----)[^\-]*+)*+{_END}|(?:\s*+[A-Za-z0-9+/=]{{16,}}+)++)",
    "keyed": rf"""(?:{_PASS}{_KEY_END}[=:]|{_WORDY}{_KEY_END}(?:=|:(?=\S|[ \t]{{1,4}}(?:["']|[^\s"']*[0-9]))))[=:]?>?[ \t]{{0,4}}(?=["']?[^\s"']*[\p{{L}}0-9])(?:"[^"\r\n]+|'[^'\r\n]+|[^\s"']+)""",
    "issued": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|glpat-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})",
    "mail": rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@{_LABEL}(?:\.{_LABEL}(?=(?:\.{_LABEL}){{0,8}}?\.[A-Za-z]{{2}}))*+\.[A-Za-z]{{2,}}+",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:|::(?:{_HEX}:){{0,6}}{_HEX})(?![0-9A-Za-z:]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}|0[1-9](?:[ .\-][0-9]{2}){4}(?![ .\-]?[0-9])|1[3-9][0-9]{9}|(?:\(0[0-9]{1,4}\) ?|0[0-9]{2,4}[ /\-])[0-9]{3,4}[ \-]?[0-9]{3,5}(?![ \-]?[0-9]))(?![0-9])",
    "social": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "access": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"""(?<=")[0-9a-f]{32,64}(?=")""",
    "person": rf"(?<!\p{{L}})(?:(?=\p{{Lu}})(?:(?:{_TITLE}\.? ){{1,3}}{_FAMILY}(?: {_FAMILY})?|{_KNOWN} {_FAMILY})|{_CUE} {_NAME}(?: {_FAMILY})?)(?!\p{{L}})",
}
ANYTHING = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without a match of this have none of the above; it is cheap.
MAYBE = rf"[0-9@]|(?:{_PASS}|{_WORDY}){_KEY_END}[=:]|-----BEGIN|::[A-Fa-f]|(?<![A-Za-z0-9])(?:AKIA|{_ISSUED})|(?<!\p{{L}})(?:(?=\p{{Lu}})(?:{_TITLE}|{_KNOWN})|{_CUE})(?!\p{{L}})"
DIGITS = ("phone", "card", "social")
VOWELS, CONSONANTS = "aeiou", "bdfgklmnprstvz"
VOWELS_2, CONSONANTS_2 = "аеиоу", "бдгклмнпрств"
STREAM, EACH = 64, 8  #: numbers of a stream; draws before a form grows


def kind_of(mention: Column) -> Column:
    out = F
    for k, p in PATTERNS.items():
        if k != "secret":
            out = out.when(mention.rlike(f"^(?:{p})$"), F.lit(k))
    return out.otherwise(F.lit("secret"))


def parts_of(kind: Column, mention: Column) -> Column:
    """Parts (kind, canon, form) that join to the mention; kind ``as is`` is kept."""
    def part(k, canon: Column, form: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), canon.alias("canon"), form.alias("form"))

    digits = F.regexp_replace(mention, "[^0-9]", "")
    at = F.instr(mention, "@")
    mail, domain = F.lower(mention), F.lower(F.substring_index(mention, "@", -1))
    words = F.split(mention, " ")
    n = F.size(words)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"\.$", ""))
    male, female = (F.arrays_overlap(bare, F.array(*(F.lit(t) for t in TITLES[g]))) for g in "mf")

    def named(w: Column, i: Column) -> Column:
        gender = F.when(w.isin(*GIVEN["f"]), "f").when(w.isin(*GIVEN["m"]), "m").when(female, "f").when(male, "m").otherwise("u")
        k = F.when(w.rlike(f"^{_TITLE}\\.?$") | w.isin(*{c for cue in CUES for c in cue.split()}, *PARTICLES), "as is").when(i == n - 1, "surname").otherwise(F.concat(F.lit("given "), gender))
        blank = F.when(i > 0, " ").otherwise("")
        return F.array(part("as is", blank, blank), part(k, F.lower(w), w))

    person = F.flatten(F.transform(words, named))

    def secret(before: Column, after: Column = F.lit("")) -> Column:
        inner = F.substring(mention, F.length(before) + 1, F.length(mention) - F.length(before) - F.length(after))
        return F.array(part("as is", before, before), part("secret", inner, inner), part("as is", after, after))

    halves = F.split(F.lower(mention), "::")
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "") for i in (0, 1))
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))), right)
    out = F.when(kind.isin(*DIGITS), F.array(part(kind, F.concat(F.when(mention.startswith("+"), "+").otherwise(""), digits), mention)))
    out = out.when(kind == "mail", F.array(part("mail", mail, F.substring(mention, F.lit(1), at - 1)), part("as is", F.lit("@"), F.lit("@")), part("domain", domain, F.substring_index(mention, "@", -1))))
    out = out.when(kind == "iban", F.array(part("iban", F.replace(mention, F.lit(" "), F.lit("")), mention)))
    out = out.when(kind == "ip6", F.array(part("ip6", F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), ":"), mention)))
    out = out.when(kind == "pem", secret(F.regexp_extract(mention, f"^{_BEGIN}", 0), F.regexp_extract(mention, f"{_END}$", 0)))
    out = out.when(kind == "keyed", secret(F.regexp_extract(mention, r"""^[A-Za-z_\-]+["']?[ \t]*[=:]{1,2}>?[ \t]*["']?""", 0)))
    out = out.when(kind == "issued", secret(F.regexp_extract(mention, f"^{_ISSUED}", 0)))
    return out.when(kind == "person", person).otherwise(F.array(part(kind, mention, mention)))


def _number(stream: Column, i: Column, below: int) -> Column:
    """The i-th number of the stream, under ``below`` (nearly uniform: from 16 bits)."""
    at = F.pmod(i, F.lit(STREAM)) * 4 + 1
    return F.pmod(F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def _letter(stream: Column, i: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), _number(stream, i, len(letters)) + 1, F.lit(1))


def _mapped(stream: Column, text: Column, hexadecimal: Column | None = None) -> Column:
    """Digits to digits and letters to letters of the same case; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _number(stream, i, 10).cast("string")).when(c.rlike("[a-z]"), _letter(stream, i, "abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), _letter(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{L}"), _letter(stream, i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c)
        return out if hexadecimal is None else F.when(hexadecimal, _letter(stream, i, "0123456789abcdef")).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Of a number without its check digit."""
    def add(acc: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return acc + F.when(x["double"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x["d"])

    marked = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), (F.pmod(i, F.lit(2)) == 0).alias("double")))
    return F.aggregate(marked, F.lit(0), add)


def _mod97(text: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(F.when(value > 9, acc * 100 + value).otherwise(acc * 10 + value), F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def stream_of(key: str) -> Column:
    """The keyed stream of an entity (kind, canon, draw)."""
    seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.col("draw").cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}|"), seed), 256) for i in range(4)))


def payload() -> Column:
    """The surrogate of an entity (kind, canon, draw, stream, hexadecimal: whether canon is), in canonical form."""
    kind, canon, draw, stream = (F.col(c) for c in ("kind", "canon", "draw", "stream"))
    more = F.when(draw >= EACH, F.sequence(F.lit(1), F.floor(draw / EACH).cast("int"))).otherwise(F.array().cast("array<int>"))

    def grown(letters: str, each: int = 3) -> Column:
        return F.array_join(F.transform(more, lambda k: F.concat(*(_letter(stream, k * each + i, letters) for i in range(each)))), "")

    longer, digits = grown("abcdefghijklmnopqrstuvwxyz"), grown("0123456789", 1)
    plus = F.startswith(canon, F.lit("+"))
    bare = F.regexp_replace(canon, r"\+", "")
    fresh = _mapped(stream, bare)
    opening = (_number(stream, F.lit(63), 8) + 2).cast("string")
    phone = F.when(plus, F.concat(F.lit("+"), F.substring(bare, 1, 1), opening, F.substring(fresh, F.lit(3), F.length(bare)))).when(bare.startswith("0"), F.concat(F.lit("0"), opening, F.substring(fresh, F.lit(3), F.length(bare)))).otherwise(F.concat(opening, F.substring(fresh, F.lit(2), F.length(bare))))
    phone = F.concat(phone, digits)
    body = F.concat(F.substring(bare, 1, 1), F.substring(fresh, F.lit(2), F.length(bare) - 2), digits)
    card = F.concat(body, F.pmod(F.lit(10) - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10)).cast("string"))
    valid = F.pmod(_luhn_sum(F.substring(bare, F.lit(1), F.length(bare) - 1)) + F.right(bare, F.lit(1)).try_cast("int"), F.lit(10)) == 0
    card = F.when(valid, card).otherwise(F.concat(F.substring(bare, 1, 1), F.substring(fresh, F.lit(2), F.length(bare)), digits))
    social = F.concat(F.lit("9"), F.substring(fresh, F.lit(2), F.length(bare)), digits)
    ip = F.concat_ws(".", (_number(stream, F.lit(0), 15) + 240).cast("string"), *(_number(stream, F.lit(i), 256).cast("string") for i in (1, 2, 3)))
    ip6 = F.concat_ws(":", F.lit("2001:db8"), *(F.concat(*(_letter(stream, F.lit(4 * g + i), "0123456789abcdef") for i in range(4))) for g in range(6)))
    ip = F.when(draw < EACH, ip).otherwise(ip6)
    local = F.concat(_mapped(stream, F.substring_index(canon, "@", 1)), longer)
    reserved = canon.rlike(r"(^|\.)example\.(com|org|net)$")
    above = F.regexp_replace(canon, r"(^|\.)example\.(com|org|net)$", "")
    domain = F.when(reserved & (above == ""), canon).when(reserved, F.concat(_mapped(stream, above), longer, F.regexp_extract(canon, r"\.example\.(?:com|org|net)$", 0)))
    domain = domain.otherwise(F.concat(_mapped(stream, F.regexp_replace(canon, r"\.[a-z]+$", "")), longer, F.lit(".example")))
    country, account = F.substring(canon, 1, 2), F.concat(_mapped(stream, F.substring(canon, F.lit(5), F.length(canon))), F.upper(longer))
    iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    access = F.concat(F.lit("AKIA"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: _letter(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), ""))
    secret = F.concat(_mapped(stream, canon, F.col("hexadecimal")), longer)

    def syllables(n: int, first: int, vowels: str, consonants: str) -> Column:
        return F.concat(*(x for i in range(n) for x in (_letter(stream, F.lit(first + 2 * i), consonants), _letter(stream, F.lit(first + 2 * i + 1), vowels))))

    def name(vowels: str, consonants: str) -> Column:
        given = syllables(3, 0, vowels, consonants)
        end = F.when(kind == "given f", vowels[0]).when(kind == "given m", _letter(stream, F.lit(20), consonants)).otherwise(vowels[1])
        return F.when(kind == "surname", F.concat(syllables(3, 0, vowels, consonants), _letter(stream, F.lit(20), consonants))).otherwise(F.concat(given, _letter(stream, F.lit(21), consonants), end))

    names = F.concat(F.when(canon.rlike(r"\p{IsCyrillic}"), F.concat(name(VOWELS_2, CONSONANTS_2), grown(VOWELS_2 + CONSONANTS_2))).otherwise(F.concat(name(VOWELS, CONSONANTS), longer)))
    out = F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "social", social).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "mail", local).when(kind == "domain", domain)
    return out.when(kind == "iban", iban).when(kind == "access", access).when(kind == "secret", secret).otherwise(names)


def rendered(kind: Column, form: Column, new: Column) -> Column:
    """The surrogate in the mention's own writing: separators and case stay."""
    def put(member: str, chars: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            return F.when(c.rlike(member), F.struct(F.concat(acc["s"], F.substring(chars, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))

        return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda a: F.concat(a["s"], F.substring(chars, a["i"], F.length(chars))))

    shout = (F.upper(form) == form) & (F.lower(form) != form) & (F.length(form) > 1)
    out = F.when(kind.isin(*DIGITS), put("[0-9]", F.regexp_replace(new, r"\+", ""))).when(kind == "iban", put("[A-Z0-9]", new))
    out = out.when(kind.isin("mail", "domain"), F.when(shout, F.upper(new)).otherwise(new))
    return out.when(kind.startswith("given") | (kind == "surname"), F.when(shout, F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))).otherwise(new)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, new for distinct entities (kind, canon): distinct, and none that the corpus has.

    Only those that collide are drawn again. Of equal draws the first stands; what stands once
    is never given again.
    """
    scope = F.when(F.col("kind") == "mail", F.substring_index("canon", "@", -1)).otherwise("")
    own = entities.select("kind", F.when(F.col("kind") == "mail", F.substring_index("canon", "@", 1)).otherwise(F.col("canon")).alias("new")).distinct()
    live, settled = entities.select("kind", "canon", F.lit(0).alias("draw")).withColumn("scope", scope), None
    while True:
        # the stream is a column of its own, else each of its hundred uses would spell it out
        # and no test of the whole is made for each of its letters
        given = live.withColumns({"stream": stream_of(key), "hexadecimal": F.col("canon").rlike("^[0-9a-f]+$")})
        drawn = given.withColumn("new", payload()).drop("stream", "hexadecimal")
        taken = drawn.join(own.withColumn("had", F.lit(True)), ["kind", "new"], "left")
        # a reserved domain stands for itself
        again = F.col("had").isNotNull() & ~((F.col("kind") == "domain") & (F.col("new") == F.col("canon")))
        if settled is not None:
            taken = taken.join(settled.select("kind", "scope", "new", F.lit(True).alias("given")), ["kind", "scope", "new"], "left")
            again = again | F.col("given").isNotNull()
        rank = F.row_number().over(Window.partitionBy("kind", "scope", "new").orderBy("canon"))
        checked = materialize(taken.select("kind", "canon", "draw", "scope", "new", (again | (rank > 1)).alias("again")), "surrogates")
        done = checked.where("not again")
        settled = done if settled is None else settled.unionByName(done)
        if not checked.where("again").limit(1).count():
            return settled.select("kind", "canon", "new")
        live = checked.where("again").select("kind", "canon", (F.col("draw") + 1).alias("draw"), "scope")


def replaced(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in text, drawn by a secret ``key``; with ``count`` a further column of that name with the number of mentions."""
    spare = "pii"
    while any(c.startswith(spare) for c in docs.columns):
        spare += "_"
    if count in docs.columns:
        raise ValueError(f"the input has a column {count} already")
    if not key:
        raise ValueError("a key is needed")
    m, h, key_of, outs, names, split = (f"{spare}{x}" for x in ("m", "h", "k", "o", "n", "s"))
    found = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ANYTHING), F.lit(0)))
    # written once, as the patterns are dear
    marked = materialize(docs.withColumn(m, found), "marked")
    some = F.coalesce(F.size(m) > 0, F.lit(False))
    hits = materialize(marked.where(some).withColumns({h: F.sha2("text", 256), split: F.split("text", ANYTHING, -1)}).drop("text"), "mentions")
    mentions = hits.select(F.explode(F.array_distinct(m)).alias("mention")).distinct()
    # the kind is a column of its own, else each of its uses would spell out all patterns
    kinds = mentions.withColumn("kind", kind_of(F.col("mention")))
    parts = materialize(kinds.select("mention", F.posexplode(parts_of(F.col("kind"), F.col("mention")))).select("mention", "pos", "col.*"), "parts")
    new = surrogates(parts.where("kind <> 'as is'").select("kind", "canon").distinct(), key)
    made = parts.join(new, ["kind", "canon"], "left").withColumn("out", F.when(F.col("kind") == "as is", F.col("form")).otherwise(rendered(F.col("kind"), F.col("form"), F.col("new"))))
    named = (F.col("kind").startswith("given") | (F.col("kind") == "surname")) & ~F.col("canon").isin(*NO_NAMES)
    made = materialize(made.groupBy("mention").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("out"), F.collect_list(F.when(named, F.struct("canon", "new"))).alias("names")), "rendered")
    once = hits.select(F.col(h).alias(key_of), F.posexplode(m)).distinct()
    once = materialize(once.withColumnRenamed("col", "mention"), "once")
    made = materialize(made.join(once.groupBy("mention").agg(F.count("*").alias("times")), "mention"), "made")
    lists = keyed_join(once, made, ["mention"], "times").groupBy(key_of).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]).alias(outs), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(names))
    def known(word: Column) -> Column:
        return F.get(F.filter(F.col(names), lambda x: x["canon"] == F.lower(word)), F.lit(0))["new"]

    def follow(word: Column) -> Column:
        return F.coalesce(rendered(F.lit("surname"), word, known(word)), word, F.lit(""))

    def renamed(between: Column) -> Column:
        return F.array_join(F.zip_with(F.split(between, BARE, -1), F.regexp_extract_all(between, F.lit(BARE), F.lit(0)), lambda a, w: F.concat(a, follow(w))), "")

    between, some_names = F.col(split), F.size(names) > 0
    rest = F.when(some_names, F.transform(between, renamed)).otherwise(between)
    text = F.array_join(F.zip_with(rest, F.col(outs), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    further = F.transform(between, lambda a: F.size(F.filter(F.regexp_extract_all(a, F.lit(BARE), F.lit(0)), lambda w: known(w).isNotNull())))
    further = F.when(some_names, F.aggregate(further, F.lit(0), lambda acc, x: acc + x)).otherwise(0)
    joined = hits.join(lists, F.col(h) == F.col(key_of))
    if count:
        joined = joined.withColumn(count, F.size(m) + further)
    changed = joined.withColumn("text", text)
    n = [F.col(f"`{count}`")] if count else []
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~some).select(*columns, *([F.lit(0).alias(count)] if count else [])).unionByName(changed.select(*columns, *n))
