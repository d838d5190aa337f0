"""Surrogates for personal data, with DataFrame functions only.

One pattern finds the entities of a text; the gaps between them stay, and each
entity is replaced by a surrogate that depends on a secret key, its type and its
canonical form, so the same entity gets the same surrogate everywhere
(coreference) and nothing travels but the dictionary of distinct entities.
Surrogates keep type and format: letters become letters of the same script and
case, digits digits, separators stay; a payment number keeps its first digit and
whether its check digit is right; an address keeps its top-level domain, and one
domain stays one domain; names are made for the gender of the title and the
script (Latin, Cyrillic, Greek; others become Latin), given and family name
apart, so that "Mrs Anna Berg" and "Mrs Berg" stay one person, and so do "Anna
Berg" and "Berg" without the title wherever the same text has one with it.
Secrets keep a known prefix, telephone numbers their country code.

Collision checks run over the dictionary: a surrogate may be neither that of
another entity nor an entity of the data.  Those that are get the next attempt
until none is left.  Only entities with a later attempt are joined back to the
documents that hold them.

Texts are read twice, to gather the dictionary and to replace; nothing else than the
dictionary is written.  No entity is too long to be found.

Defined cases: a null text stays null with no entities; a text without entities
is returned as it is; documents with the same id share the later attempts, which
belong to the entity and not to the document; columns named like the new ones
are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

_WORD = r"\p{L}\p{N}"
_NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?"
#: Titles of men and women.
TITLES_M = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "Κύριος")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "Κυρία")
_TITLES = "|".join(TITLES_M + TITLES_F)
#: How secrets of known kinds begin, and country codes of telephone numbers.
PREFIXES = "AKIA|ghp_|sk-"
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9a-fA-F]{1,4}"
_IP6 = rf"(?<![{_WORD}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9a-fA-F:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![{_WORD}:])"
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+-])[{_WORD}._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{{2,}}(?![{_WORD}])",
    "secret": rf"(?<![{_WORD}])(?:[0-9a-fA-F]{{32,}}|(?:{PREFIXES})[A-Za-z0-9]{{16,}})(?![{_WORD}])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)|{_IP6}",
    "card": r"(?<![\d.])(?:\d{4}[ -]?){3}\d{1,7}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "person": rf"(?<![{_WORD}])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
TYPES = tuple(PATTERNS)
#: What every entity has, each alternative of ``PATTERNS`` at least one of these: a quick test that spares most texts the pattern.
_HINT = rf"@|\d{{3}}|\d\.\d|\+\d|[0-9a-fA-F]{{16}}|(?:{PREFIXES})[A-Za-z0-9]{{16}}|(?:{_TITLES})\.? \p{{Lu}}|::|(?:{_HEX}:){{7}}"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Letters by script; a letter is replaced by one of its own row.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "άέήίόύώ",
)
#: Syllables of made-up names and their endings, by script.
SYLLABLES = {"latin": "ba be bi da de do ga ka ke la le li lo ma me mi na ne no ra re ri ro sa se ta te ti va vi".split(), "cyrillic": "ба ва га да за ка ла ле ли ма ме ми на но ра ре ро са се та ти".split(), "greek": "βα γα δα ζα κα λα λε λι μα με μι να νο ρα ρε ρο σα σε τα τι".split()}
ENDINGS = {
    ("latin", "given_m"): ("n", "r", "l"), ("latin", "given_f"): ("na", "lia", "ra"), ("latin", "family_m"): ("ner", "son", "mann"), ("latin", "family_f"): ("ner", "son", "mann"),
    ("cyrillic", "given_m"): ("н", "р", "й"), ("cyrillic", "given_f"): ("на", "лия", "ра"), ("cyrillic", "family_m"): ("нов", "рин", "лев"), ("cyrillic", "family_f"): ("нова", "рина", "лева"),
    ("greek", "given_m"): ("νος", "ρης", "λος"), ("greek", "given_f"): ("να", "ρία", "λη"), ("greek", "family_m"): ("νίδης", "ράκης", "λόπουλος"), ("greek", "family_f"): ("νίδου", "ράκη", "λοπούλου"),
}


def _seed(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A keyed digest (nested, so that it can't be extended)."""
    message = F.concat_ws("\n", kind, attempt.cast("string"), canon)
    inner = F.sha2(F.concat(F.lit(key + "\n"), message).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(key + "\r"), inner).cast("binary"), 256)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(seed: Column, n: Column) -> Column:
    """At least ``n`` pseudo-random numbers from 0 to 65535 that follow from a seed."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda i: F.sha2(F.concat(seed, i.cast("string")).cast("binary"), 256))
    return let(F.array_join(blocks, ""), lambda h: F.transform(F.sequence(F.lit(0), n), lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _scrambled(s: Column, seed: Column) -> Column:
    """Each letter or digit by one of its own alphabet."""

    def one(c: Column, b: Column) -> Column:
        out = c
        for a in reversed(ALPHABETS):
            out = F.when(F.instr(F.lit(a), c) > 0, F.substr(F.lit(a), F.pmod(b, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
        return F.when(c == "", c).otherwise(out)

    return let(_numbers(seed, F.length(s)), lambda numbers: F.array_join(F.transform(_chars(s), lambda c, i: one(c, F.get(numbers, i))), ""))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _card(canon: Column, seed: Column) -> Column:
    n = F.length(canon)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _scrambled(F.substr(canon, F.lit(2), n - 2), seed))
    return let(body, lambda made: F.concat(made, F.pmod(_luhn(canon) - _luhn(F.concat(made, F.lit("0"))), F.lit(10)).cast("string")))


def _email(canon: Column, seed: Column, key: str, attempt: Column) -> Column:
    """From the fifth attempt on, where short names run out, digits are added to the name."""
    domain = F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    host = let(_seed(key, F.lit("domain"), domain, F.lit(0)), lambda own: _scrambled(labels, own))
    more = F.when(attempt >= 4, F.conv(F.substr(seed, F.lit(1), F.lit(6)), 16, 10)).otherwise("")
    return F.concat(_scrambled(F.substring_index(canon, "@", 1), seed), more, F.lit("@"), host, F.lit("."), top)


def _name(kind: Column, canon: Column, seed: Column, attempt: Column) -> Column:
    def made(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        ends = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for (s, k), e in ENDINGS.items() if s == script for x in (k, e)))
        ending = lambda numbers: F.get(F.try_element_at(ends, kind), F.pmod(F.get(numbers, F.lit(0)), F.lit(3)))
        stem = lambda numbers: F.array_join(F.transform(F.slice(numbers, 2, 2 + attempt), lambda x: F.get(syllables, F.pmod(x, F.lit(len(SYLLABLES[script]))))), "")
        return let(_numbers(seed, 3 + attempt), lambda numbers: F.concat(stem(numbers), ending(numbers)))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form."""

    def made(seed: Column) -> Column:
        head = lambda pattern: F.regexp_extract(canon, f"^(?:{pattern})", 0)
        after = lambda pattern: let(head(pattern), lambda h: F.concat(h, _scrambled(F.substr(canon, F.length(h) + 1), seed)))
        groups = let(_numbers(seed, F.length(canon)), lambda numbers: F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).when(c == "", c).otherwise(F.lower(F.hex(F.pmod(F.get(numbers, i), F.lit(16)))))), ""))
        octets = let(_numbers(seed, F.lit(4)), lambda numbers: F.array_join(F.transform(F.slice(numbers, 1, 4), lambda x: (F.pmod(x, F.lit(254)) + 1).cast("string")), "."))
        digits = let(_numbers(seed, F.length(canon)), lambda numbers: F.array_join(F.transform(F.slice(numbers, 1, F.length(canon)), lambda x: F.lower(F.hex(F.pmod(x, F.lit(16))))), ""))
        hexed = F.when(canon == F.upper(canon), F.upper(digits)).otherwise(digits)
        return (
            F.when(kind == "email", _email(canon, seed, key, attempt))
            .when((kind == "ip") & canon.contains(":"), groups)
            .when(kind == "ip", octets)
            .when(kind == "card", _card(canon, seed))
            .when((kind == "secret") & canon.rlike("^[0-9a-fA-F]+$"), hexed)
            .when(kind == "secret", after(PREFIXES))
            .when(kind == "phone", after(COUNTRY))
            .otherwise(_name(kind, canon, seed, attempt))
        )

    return let(_seed(key, kind, canon, attempt), made)


def _type(found: Column) -> Column:
    out = F.lit("person")
    for name in reversed([t for t in TYPES if t != "person"]):
        out = F.when(found.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _titled(found: Column) -> Column:
    return F.regexp_extract(found, r"^\p{L}+", 0).isin(*TITLES_M, *TITLES_F)


def _gender(found: Column) -> Column:
    return F.when(F.regexp_extract(found, r"^\p{L}+", 0).isin(*TITLES_F), "f").otherwise("m")


def _names(found: Column) -> Column:
    """The names of a person, without the title."""
    return F.when(_titled(found), F.slice(F.split(found, " "), 2, 2)).otherwise(F.split(found, " "))


def _people(found: Column) -> Column:
    """The persons with a title among entities: an array of ``family``, ``full`` and ``gender``."""
    persons = F.filter(found, lambda x: x.rlike(f"^(?:{PATTERNS['person']})$"))
    one = lambda x: let(_names(x), lambda names: F.struct(F.element_at(names, -1).alias("family"), F.array_join(names, " ").alias("full"), _gender(x).alias("gender")))
    return F.transform(persons, one)


def _tokens(found: Column, kind: Column, people: Column) -> Column:
    """The canonical parts of an entity: an array of kind and canonical form."""
    digits = F.regexp_replace(found, r"\D", "")
    one = (
        F.when((kind == "email") | (kind == "ip"), F.lower(found))
        .when((kind == "phone") & found.startswith("+"), F.concat(F.lit("+"), digits))
        .when(kind.isin("phone", "card"), digits)
        .otherwise(found)
    )

    def named(names: Column) -> Column:
        # a mention without a title has the gender of the one with it
        known = F.get(F.filter(people, lambda p: p["family"] == F.element_at(names, -1)), F.lit(0))["gender"]

        def part(word: Column, i: Column) -> Column:
            place = F.when(i == F.size(names) - 1, "family_").otherwise("given_")
            return F.struct(F.concat(place, F.when(_titled(found), _gender(found)).otherwise(F.coalesce(known, F.lit("m")))).alias("kind"), F.lower(word).alias("canon"))

        return F.transform(names, part)

    return F.when(kind == "person", let(_names(found), named)).otherwise(F.array(F.struct(kind.alias("kind"), one.alias("canon"))))


def _as_written(found: Column, kind: Column, made: Column) -> Column:
    """The surrogate parts in the format of the entity as it is in the text."""
    first = F.get(made, F.lit(0))
    cased = F.array_join(F.zip_with(_chars(found), _chars(first), lambda c, m: F.when(c.isNotNull() & (c != F.lower(c)), F.upper(m)).otherwise(m)), "")
    cased = F.when(F.length(first) == F.length(found), cased).otherwise(first)
    before = lambda i: F.length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), r"\D", ""))
    digits = F.regexp_replace(first, r"\D", "")
    filled = let(digits, lambda d: F.array_join(F.transform(_chars(found), lambda c, i: F.when(c.rlike(r"\d"), F.substr(d, before(i), F.lit(1))).otherwise(c)), ""))
    title = F.when(_titled(found), F.concat(F.substring_index(found, " ", 1), F.lit(" "))).otherwise("")
    names = F.concat(title, F.array_join(F.transform(made, F.initcap), " "))
    return F.when(kind == "person", names).when(kind == "email", cased).when(kind.isin("phone", "card"), filled).otherwise(first)


def _pattern(people: Column) -> Column:
    """What finds the entities of a text: the pattern, and the names of its titled persons where they have no title."""
    quoted = F.transform(people, lambda p: F.concat(F.when(p["full"] != p["family"], F.concat(p["full"], F.lit("|"))).otherwise(""), p["family"]))
    names = F.concat(F.lit(rf"|(?<![{_WORD}])(?:"), F.array_join(F.array_sort(F.array_distinct(quoted), lambda a, b: F.length(b) - F.length(a)), "|"), F.lit(rf")(?![{_WORD}])"))
    return F.concat(F.lit(_ANY), F.when(F.size(people) > 0, names).otherwise(""))


def _with_found(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__people`` and ``__found``, the entities in order."""
    text, none = F.col(text_col), F.array().cast("array<string>")
    every = lambda pattern: F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    first = docs.withColumn("__found", F.when(text.rlike(_HINT), every(F.lit(_ANY))).otherwise(none))
    named = first.withColumn("__people", _people(F.col("__found"))).withColumn("__pattern", _pattern(F.col("__people")))
    return named.withColumn("__found", F.when(F.size("__people") > 0, every(F.col("__pattern"))).otherwise(F.col("__found")))


def later_attempts(dictionary: DataFrame, key: str) -> DataFrame:
    """Entities (``kind``, ``canon``) whose first surrogate collides, and the ``attempt`` that doesn't.

    Each round makes surrogates for those that collided only, and holds them against all that are taken; later
    attempts have more room (longer names, added digits), so that the rounds end.
    """
    space = F.substring_index("kind", "_", 1)
    real = written(dictionary.select(space.alias("space"), F.col("canon").alias("made")).distinct(), "pii-real")
    now = dictionary.withColumn("attempt", F.lit(0))
    taken, settled = real, []
    while True:
        made = now.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).withColumn("space", space)
        place = F.row_number().over(Window.partitionBy("space", "made").orderBy("kind", "canon"))
        held = taken.select("space", "made").distinct().withColumn("held", F.lit(True))
        checked = made.withColumn("place", place).join(held, ["space", "made"], "left")
        checked = written(checked.withColumn("bad", (F.col("place") > 1) | F.col("held").isNotNull()).select("kind", "canon", "attempt", "space", "made", "bad"), "pii-attempts")
        good = checked.where("not bad")
        taken = taken.union(good.select("space", "made"))
        settled.append(good.select("kind", "canon", "attempt"))
        now = checked.where("bad").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if now.isEmpty():
            return reduce(DataFrame.union, settled[1:], settled[0].where("false"))


def pseudonymize(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the entities in the text replaced and ``entities``, the types in order of appearance."""
    with_found = _with_found(docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")), "__text")
    tokens = F.flatten(F.transform("__found", lambda x: let(_type(x), lambda kind: _tokens(x, kind, F.col("__people")))))
    tokens = with_found.select("__doc", F.explode_outer(tokens).alias("t")).where("t is not null").select("__doc", "t.kind", "t.canon").distinct()
    tokens = written(tokens, "pii-entities")
    later = written(later_attempts(tokens.select("kind", "canon").distinct(), key), "pii-later")
    name = lambda t: F.concat_ws("\n", t["kind"], t["canon"])
    own = tokens.join(later, ["kind", "canon"]).groupBy("__doc").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\n", "kind", "canon"), "attempt"))).alias("__later"))
    own = written(own, "pii-own")
    joined = _with_found(docs.join(own, F.col(id_col).eqNullSafe(F.col("__doc")), "left"), text_col)

    def replaced(found: Column) -> Column:
        part = lambda t: surrogate(t["kind"], t["canon"], F.coalesce(F.try_element_at("__later", name(t)), F.lit(0)), key)
        return let(_type(found), lambda kind: let(F.transform(_tokens(found, kind, F.col("__people")), part), lambda made: _as_written(found, kind, made)))

    gaps = F.split(F.col(text_col), F.col("__pattern"), -1)
    made = F.transform("__found", replaced)
    clean = let(made, lambda made: F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(made, i), F.lit("")))), ""))
    clean = F.when(F.size("__found") > 0, clean).otherwise(F.col(text_col))
    kinds = F.transform("__found", _type)
    rest = [c for c in docs.columns if c != "entities"]
    return joined.select(*(clean.alias(c) if c == text_col else F.col(c) for c in rest), F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).otherwise(kinds).alias("entities"))
