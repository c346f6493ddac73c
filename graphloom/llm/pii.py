"""Operator 6, surrogate generation for personal data and secrets.

Native: DataFrame functions only. One pattern finds the entities of a text.
Each is replaced by a surrogate derived from a secret key and the entity's
canonical form (lower-case address, bare digits ...), so that one entity gets
one surrogate everywhere, also where it is written in another format. The
surrogate keeps type and format: letters stay letters of their case and
script, digits digits; the country code of a phone number, the top-level
domain, a secret's prefix and a title stay; octets remain octets, a valid card
number remains valid, and a name after a title gets a given name of that
gender (of either after a title such as Dr) in its own script.

A person is known by gender, given and family name, so "Mrs. Ann Lee", "Ms Ann
Lee" and, later in the same text, "Ann Lee" without a title get one name. A
family name has a surrogate of its own, which "Mrs. Lee" shares; persons of one
family differ by their given names. Names that no title introduces in the text,
and lone given or family names, are left.

Distinctness is checked over the whole corpus: the distinct spellings are
gathered (counted before they are shuffled), and entities with a spelling whose
surrogate equals another entity's surrogate, or any entity, try again with the next attempt
number until none is left. Only the few entities with an attempt above 0 are
joined back to the texts that hold them. Of persons the given names are compared
within a family, and the family names as entities.

Defined results: null texts stay null, empty texts empty; texts without
entities are unchanged; repeated rows are treated alike; extra columns pass
through whatever their names; long texts are searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: A default for tests; deployments pass their own key.
KEY = "surrogate-key"
MAX_ATTEMPTS = 32

# Titles by gender, given names by gender and script, syllables of family names by script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "n": ["Dr", "Dra", "Prof"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Ida", "Julia", "Lena", "Marta", "Nora", "Olga", "Paula", "Rita", "Sofia", "Tessa", "Vera", "Wanda", "Yara"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Peter", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χριστίνα", "Δήμητρα", "Ζωή"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve"],
    "cyrillic": ["ба", "ва", "га", "да", "жа", "за", "ка", "ла", "ма", "на", "па", "ра", "са", "та", "фа", "ша"],
    "greek": ["βα", "γα", "δα", "ζα", "θα", "κα", "λα", "μα", "να", "πα", "ρα", "σα", "τα", "φα", "χα", "ψα"],
}

GIVEN.update({("n", s): GIVEN["f", s] + GIVEN["m", s] for s in SYLLABLES})
_TITLE = "(?:" + "|".join(t for of in TITLES.values() for t in of) + r")\.?"
_NAME = r"\p{Lu}(?:[\p{Ll}\p{Lu}-]|['’](?!s(?!\p{L})))*\p{Ll}"  # a genitive's 's is no part of it
_SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']? {0,3}[=:] {0,3}[\"']?"
#: A calling code by its digits alone (assigned codes of one and two digits, else three), however it is set off.
_SEP = "[^0-9]*"
COUNTRY = rf"^\+{_SEP}(?:[17]|" + "|".join(f"{a}{_SEP}[{b}]" for a, b in ((2, "07"), (3, "0-469"), (4, "013-9"), (5, "1-8"), (6, "0-6"), (8, "1246"), (9, "0-58"))) + f"|[0-9]{_SEP}[0-9]{_SEP}[0-9])"
#: In order of precedence; each matches whole tokens only.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{12,}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|sk_live_|sk_test_|xox[bp]-)[A-Za-z0-9_-]{16,}",
    "secret": rf"{_SECRET}(?=[A-Za-z_/+=.-]*[0-9])[A-Za-z0-9_/+=.-]*[A-Za-z0-9_/+=-]",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])",
    "name": rf"(?<!\p{{L}}){_TITLE} {_NAME}(?: {_NAME})?",
}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def kind(e: Column) -> Column:
    """The type of an entity: the first pattern that takes it whole."""
    out = F.when(F.regexp_like(e, F.lit(f"^{_NAME}$")), "family").otherwise("secret")
    for name in reversed(PATTERNS):
        out = F.when(F.regexp_like(e, F.lit(f"^(?:{PATTERNS[name]})$")), name).otherwise(out)
    return out


def _gender(e: Column) -> Column:
    """f, m or n by the title of a name."""
    title = F.regexp_replace(F.substring_index(e, " ", 1), r"\.", "")
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("n")


def _family_of(e: Column) -> Column:
    return F.substring_index(e, " ", -1)


def canonical(e: Column, k: Column) -> Column:
    """What two spellings of one entity have in common."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(k == "email", F.lower(e))
        .when((k == "phone") & e.startswith("+"), F.concat(F.lit("+"), digits))  # "+1 ..." is no number without a country code
        .when(k.isin("phone", "card", "ssn"), digits)
        .when(k == "iban", F.regexp_replace(e, " ", ""))
        .when(k == "secret", F.regexp_replace(e, rf"^{_SECRET}", ""))
        .when(k == "name", F.concat(_gender(e), F.regexp_replace(e, r"^\S+", "")))
        .otherwise(e)
    )


def _noise(key: str, k: Column, c: Column, attempt: Column) -> Column:
    """Hex digits of HMAC-SHA-512 under the key, two for each character of the canonical form."""
    secret = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in secret.ljust(128, b"\0"))) for pad in (0x36, 0x5C))

    def block(j: Column) -> Column:
        message = F.concat_ws("\x1f", k, c, attempt.cast("string"), j.cast("string"))
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(c) / 64).cast("int")), block), "")


def _at(noise: Column, i: Column) -> Column:
    """A number below 256 for place i (from 1)."""
    return F.conv(F.substring(noise, 2 * i - 1, F.lit(2)), 16, 10).cast("int")


_CASES = {
    "[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{Ll}": "abcdefghijklmnopqrstuvwxyz", r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}


def _like(e: Column, noise: Column, kept: Column, last: Column, hexed: Column) -> Column:
    """e with each letter or digit replaced by one of its class, but for ``kept`` characters ahead and from ``last`` on.

    The place in the noise is the number of letters and digits so far, so that
    spellings with other punctuation agree.
    """

    def one(ch: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(e, kept + 1, i + 1 - kept), r"[^\p{L}\p{N}]", ""))
        pool = F.lit("")
        for name in reversed(_CASES):
            pool = F.when(F.regexp_like(ch, F.lit(f"^{name}$")), _CASES[name]).otherwise(pool)
        pool = F.when((i < kept) | (i >= last), "").when(hexed & F.regexp_like(ch, F.lit("^[0-9a-f]$")), "0123456789abcdef").otherwise(pool)
        return F.struct(ch.alias("ch"), pool.alias("pool"), place.alias("place"))

    def drawn(x: Column) -> Column:
        p = x["pool"]
        return F.when(p == "", x["ch"]).otherwise(F.substring(p, (_at(noise, x["place"]) % F.length(p)) + 1, F.lit(1)))

    chars = F.filter(F.split(e, ""), lambda x: x != "")
    return F.array_join(F.transform(F.transform(chars, one), drawn), "")


def _octets(e: Column, noise: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        n = _at(noise, 2 * i + 1) * 256 + _at(noise, 2 * i + 2)
        return F.when(F.length(x) == 1, n % 9 + 1).when(F.length(x) == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")

    return F.array_join(F.transform(F.split(e, r"\."), one), ".")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    turned = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    each = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(e: Column, made: Column) -> Column:
    """``made`` with its last digit set so that a valid number stays valid."""
    head = F.substring(made, F.lit(1), F.length(made) - 1)
    check = (10 - _luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0"))) % 10) % 10
    valid = _luhn(F.regexp_replace(e, "[^0-9]", "")) % 10 == 0
    return F.when(valid, F.concat(head, check.cast("string"))).otherwise(made)


def _by_script(word: Column, of: Callable[[str], Column]) -> Column:
    return F.when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), of("cyrillic")).when(F.regexp_like(word, F.lit(r"\p{IsGreek}")), of("greek")).otherwise(of("latin"))


def _pick(pool: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), n % len(pool) + 1)


def _family(word: Column, noise: Column) -> Column:
    """A family name of five syllables in the word's script."""
    made = _by_script(word, lambda s: F.array_join(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda k: _pick(SYLLABLES[s], _at(noise, k))), ""))
    return F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made)))


def _given(e: Column, noise: Column, attempt: Column) -> Column:
    """A given name of the title's gender; after every three attempts of a large family one more, joined by a hyphen."""

    def one(s: str) -> Column:
        places = F.sequence(F.lit(1), 1 + (attempt / 3).cast("int"))
        pick = lambda k: F.when(_gender(e) == "f", _pick(GIVEN["f", s], _at(noise, k))).when(_gender(e) == "m", _pick(GIVEN["m", s], _at(noise, k))).otherwise(_pick(GIVEN["n", s], _at(noise, k)))
        return F.array_join(F.transform(places, pick), "-")

    return _by_script(_family_of(e), one)


def _name(e: Column, given: Column, family: Column) -> Column:
    title = F.substring_index(e, " ", 1)
    return F.when(F.size(F.split(e, " ")) > 2, F.concat_ws(" ", title, given, family)).otherwise(F.concat_ws(" ", title, family))


def _steps(key: str, attempt) -> list:
    """The way from an entity to a struct of entity e, kind k, canonical form c and surrogate s, one value at a time.

    Kept apart so that each value is computed once and lambdas nest only where characters are walked.
    """

    def with_kind(e: Column) -> Column:
        return F.struct(e.alias("e"), kind(e).alias("k"))

    def with_canonical(x: Column) -> Column:
        return F.struct(x["e"].alias("e"), x["k"].alias("k"), canonical(x["e"], x["k"]).alias("c"))

    def with_noise(x: Column) -> Column:
        e, k, c = x["e"], x["k"], x["c"]
        ahead = (
            F.when(k == "key", 4).when(k == "iban", 2).when(k == "secret", F.length(F.regexp_extract(e, rf"^{_SECRET}", 0)))
            .when(k == "token", F.length(F.regexp_extract(e, r"^(?:ghp_|gho_|sk-|sk_live_|sk_test_|xox[bp]-)", 0)))
            .when((k == "phone") & e.startswith("+"), F.length(F.regexp_extract(e, COUNTRY, 0)))
            .otherwise(0)
        )
        last = F.when(k == "email", F.length(e) - F.length(F.substring_index(e, ".", -1))).otherwise(F.length(e))
        hexed = k.isin("hex", "secret") & F.regexp_like(c, F.lit("^[0-9a-f]+$"))
        noise = _noise(key, k, F.concat(c, F.lit("0123456789")), attempt(e))
        of = F.when(k == "name", _noise(key, F.lit("family"), F.concat(_family_of(e), F.lit("0123456789")), attempt(_family_of(e))))
        return F.struct(e.alias("e"), k.alias("k"), c.alias("c"), noise.alias("noise"), ahead.alias("ahead"), last.alias("last"), hexed.alias("hexed"), of.alias("of"), attempt(e).alias("attempt"))

    def with_like(x: Column) -> Column:
        made = _like(x["e"], x["noise"], x["ahead"], x["last"], x["hexed"])
        return F.struct(*(x[n].alias(n) for n in ("e", "k", "c", "noise", "of", "attempt")), F.when(~x["k"].isin("ip", "name", "family"), made).alias("like"))

    def with_surrogate(x: Column) -> Column:
        e, k, like = x["e"], x["k"], x["like"]
        made = F.when(k == "ip", _octets(e, x["noise"])).when(k == "name", _name(e, _given(e, x["noise"], x["attempt"]), _family(_family_of(e), x["of"]))).when(k == "family", _family(e, x["noise"])).when(k == "card", _card(e, like)).otherwise(like)
        return F.struct(e.alias("e"), k.alias("k"), x["c"].alias("c"), made.alias("s"))

    return [with_kind, with_canonical, with_noise, with_like, with_surrogate]


def _table(found: DataFrame, steps: list) -> DataFrame:
    """Run ``steps`` over the column entity; x is the last struct.

    In an array of one, because the optimizer would merge plain columns and repeat each value where it is used.
    """
    x = F.array("entity")
    for step in steps:
        x = F.transform(x, step)
    return found.withColumn("x", F.element_at(x, 1))


def _titled(text: Column) -> Column:
    """The entities of a text but for untitled mentions; the costly pattern runs only where a cheap test says it may match."""
    may = F.regexp_like(text, F.lit("[0-9]|@"))
    for title in sorted({t for of in TITLES.values() for t in of}):
        may = may | text.contains(title)
    return F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _full_names(found: Column) -> Column:
    return F.filter(found, lambda e: F.regexp_like(e, F.lit(f"^{_TITLE} {_NAME} {_NAME}$")))


def _bare(e: Column) -> Column:
    return F.regexp_replace(e, r"^\S+ ", "")


def with_matches(docs: DataFrame, pattern: str, raw: str, found: str) -> DataFrame:
    """Add three columns: the pattern that finds the text's untitled mentions too (null if it has no full
    name), the matches in order, and what each stands for, an untitled mention standing for the first titled one."""
    docs = docs.withColumn(raw, _titled(F.col("text")))
    persons = F.array_distinct(F.transform(_full_names(F.col(raw)), _bare))
    ends = r")(?![\p{L}\p{N}]|-\p{L})"
    docs = docs.withColumn(found, F.col(raw)).withColumn(pattern, F.array_join(persons, "|"))
    docs = docs.withColumn(pattern, F.when(F.col(pattern) != "", F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), pattern, F.lit(ends))))
    docs = docs.withColumn(raw, F.when(F.col(pattern).isNull(), F.col(found)).otherwise(F.regexp_extract_all("text", F.col(pattern), F.lit(0))))
    whole = lambda e: F.coalesce(F.when(F.regexp_like(e, F.lit(f"^{_NAME} {_NAME}$")), F.get(F.filter(F.col(found), lambda t: _bare(t) == e), F.lit(0))), e)
    return docs.withColumn(found, F.when(F.col(pattern).isNull(), F.col(found)).otherwise(F.transform(raw, whole)))


def _and_families(found: Column) -> Column:
    """The entities with the family names among them."""
    names = F.filter(found, lambda e: F.regexp_like(e, F.lit(f"^{_TITLE} {_NAME}( {_NAME})?$")))
    return F.concat(found, F.transform(names, _family_of))


def entities(docs: DataFrame) -> DataFrame:
    """The distinct spellings of all texts with their kind and canonical form, and the count of each; family names besides."""
    found = with_matches(docs.select("text"), "pattern", "raw", "found").select(F.explode(_and_families(F.col("found"))).alias("entity"))
    found = found.groupBy("entity").agg(F.count("*").alias("n"))
    found = _table(found, _steps("", lambda e: F.lit(0))[:2])
    return found.select(F.col("x.k").alias("kind"), F.col("x.c").alias("canonical"), "entity", "n")


def _comparable(e: Column, k: Column, made: Column) -> Column:
    """What must differ: the canonical surrogate; of a person the given one within the true family."""
    person = F.concat_ws(" ", _gender(e), F.get(F.split(made, " "), F.lit(1)), _family_of(e))
    return F.when(k == "name", person).otherwise(canonical(made, k))


def attempts(known: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose attempt is above 0 once no two surrogates meet.

    known: a written table of the distinct spellings; each of them is made and compared.
    """
    known = known.where("kind <> 'name' or size(split(entity, ' ')) > 2")  # a name without a given one follows its family's
    state = known.select("kind", "canonical", "entity", F.lit(0).alias("attempt"))
    own = known.select("kind", F.col("canonical").alias("made"))
    for _ in range(MAX_ATTEMPTS):
        made = _table(state, _steps(key, lambda e: F.col("attempt"))).withColumn("made", _comparable(F.col("entity"), F.col("kind"), F.col("x.s"))).drop("x")
        now = shared.written(made, "pii-attempts")
        taken = now.join(own, ["kind", "made"], "left_semi").select("kind", "canonical")
        of_entity = now.select("kind", "made", "canonical", "attempt").distinct()
        again = of_entity.groupBy("kind", "made").agg(F.count("*").alias("n")).where("n > 1").select("kind", "made")
        # of entities with one surrogate the one with the lowest attempt, then the smallest, keeps it
        rank = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "canonical"))
        later = of_entity.join(again, ["kind", "made"]).withColumn("rank", rank).where("rank > 1").select("kind", "canonical")
        bad = shared.written(taken.unionByName(later).distinct(), "pii-collisions")
        if bad.isEmpty():
            return now.where("attempt > 0").select("kind", "canonical", "attempt").distinct()
        bump = bad.withColumn("more", F.lit(1))
        state = now.drop("made").join(bump, ["kind", "canonical"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def _own(columns: list[str], *names: str) -> list[str]:
    """``names`` made longer than any of the caller's."""
    mine = max((len(c) for c in columns), default=0) * "_"
    return [f"{mine}{c}" for c in names]


def replace(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, in the same columns, and their number in ``count`` if one is named."""
    columns = docs.columns
    found_c, raw_c, pattern_c, mark_c, late_c = _own(columns, "found", "raw", "pattern", "mark", "late")
    known = shared.written(entities(docs), "pii-entities")
    late = shared.written(attempts(known, key), "pii-late")
    n = late.count()
    if n:
        # the texts that hold such an entity, by the text's hash: their map of later attempts
        mark = F.xxhash64("text")
        each = with_matches(docs.select("text", mark.alias(mark_c)), pattern_c, raw_c, found_c)
        each = each.select(mark_c, F.explode(_and_families(F.col(found_c))).alias("entity")).distinct()
        each = _table(each, _steps(key, lambda e: F.lit(0))[:2]).select(mark_c, "entity", F.col("x.k").alias("kind"), F.col("x.c").alias("canonical"))
        small = F.broadcast(late) if n * 128 <= shared.BROADCAST_BYTES else late
        held = each.join(small, ["kind", "canonical"]).groupBy(mark_c).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(late_c))
        held = shared.written(held, "pii-held")
        held = F.broadcast(held) if held.count() * 256 <= shared.BROADCAST_BYTES else held
        docs = docs.withColumn(mark_c, mark).join(held, mark_c, "left")
        attempt = lambda e: F.coalesce(F.col(late_c)[e], F.lit(0))
    else:
        attempt = lambda e: F.lit(0)
    docs = with_matches(docs, pattern_c, raw_c, found_c)
    for step in _steps(key, attempt):
        docs = docs.withColumn(found_c, F.transform(found_c, step))
    new = F.zip_with(raw_c, found_c, lambda r, x: F.when(r != x["e"], _bare(x["s"])).otherwise(x["s"]))
    pieces = F.when(F.col(pattern_c).isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col(pattern_c), -1))
    whole = F.array_join(F.zip_with(pieces, new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    text = F.when(F.size(raw_c) > 0, whole).otherwise(F.col("text")).alias("text")
    more = [F.coalesce(F.greatest(F.size(raw_c), F.lit(0)), F.lit(0)).cast("long").alias(count)] if count else []
    return docs.select(*(text if c == "text" else docs[c] for c in columns), *more)


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the new text and how many entities it replaced, of every row."""
    return replace(docs.select("doc_id", "text"), key, count="n_entities")
