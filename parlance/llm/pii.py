"""Personal data: detected entities become surrogates of the same type, gender, script and format.

A surrogate is a keyed hash of the entity's normal form, so one entity has one surrogate everywhere,
however it is written. Names are built from those of their parts: given names and surnames are entities
of their own. Distinct entities whose surrogates meet, or whose surrogate is itself an entity of the
corpus, are hashed again until none do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Given names by gender and script, and syllables for surnames.
FEMALE = "Anna Maria Laura Sarah Julia Emma Sophie Claire Elena Carmen Lucia Petra Ingrid Alice Emily Grace Helen Nina Paula Rosa".split()
MALE = "John James Robert Michael David Thomas Peter Daniel Paul Martin Hans Stefan Pierre Louis Carlos Miguel Antonio Henry George Frank".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split()
MALE_CYRILLIC = "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Павел Борис".split()
SYLLABLES = "ba be bo da de do fa fe ga ka ke ko la le lo ma me mi mo na ne no pa pe ra re ro sa se ta te va".split()
SYLLABLES_CYRILLIC = "ба бе бо да де до фа га ка ке ко ла ле ло ма ме ми мо на не но па пе ра ре ро са се та те ва".split()
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"), "": ("Dr", "Prof")}

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,24}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:token|password|passwd|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?)[A-Za-z0-9_/+.-]{8,}"
_CAPITAL = r"[\p{Lu}][\p{Ll}]+(?:-[\p{Lu}][\p{Ll}]+)?"
_GIVEN = "|".join([*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC])
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
NAME = rf"(?<![\p{{L}}])(?:(?:{_TITLE})\.? (?:{_CAPITAL} )?{_CAPITAL}|(?:{_GIVEN}) {_CAPITAL})(?![\p{{L}}])"
#: In the order of precedence.
PATTERNS = {"email": EMAIL, "secret": SECRET, "ip": IP, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text has that holds an entity other than a name: secrets may be of letters alone.
MARK = r"[0-9@]|AKIA|(?i:token|password|passwd|secret|api[_-]?key)[ ]{0,3}[=:]"

#: After so many attempts an entity's surrogate gets twelve digits of its digest, so that any number of entities part.
ROUNDS = 24

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef"


def entities(text: Column) -> Column:
    """All entities of a text in order. Texts without a mark can hold names only."""
    marked = F.regexp_like(text, F.lit(MARK))
    named = F.regexp_like(text, F.lit(NAME))
    none = F.array().cast("array<string>")
    return F.when(marked, F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).when(named, F.regexp_extract_all(text, F.lit(NAME), F.lit(0))).otherwise(none)


def gaps(text: Column) -> Column:
    """The pieces of a text between its entities: one more than there are entities."""
    marked = F.regexp_like(text, F.lit(MARK))
    named = F.regexp_like(text, F.lit(NAME))
    return F.when(marked, F.split(text, ALL, -1)).when(named, F.split(text, NAME, -1)).otherwise(F.array(text))


def kind(entity: Column) -> Column:
    """The type of an entity; "" for digits in the form of a card whose check digit is wrong, which are none.

    Only secrets depend on what stands before them, so they are what is left.
    """
    out = F.when(F.regexp_like(entity, F.lit(f"^(?:{EMAIL})$")), "email")
    for name in ("ip", "ssn", "card", "phone", "iban", "name"):
        fits = F.regexp_like(entity, F.lit(f"^(?:{PATTERNS[name]})$"))
        out = out.when(fits, F.when(F.call_function("luhn_check", _digits(entity)), "card").otherwise("") if name == "card" else F.lit(name))
    return out.otherwise("secret")


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def normal(entity: Column, of: Column) -> Column:
    """What all ways of writing an entity have in common."""
    return F.when(of.isin("card", "ssn", "phone"), _digits(entity)).when(of == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(F.lower(entity))


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"^((?:{_TITLE})\.? )?", 1)


def _given(name: Column) -> Column:
    """The gender and given name of a name, as in "f:Anna"; null without a given name. The title's gender counts first."""
    title = _title(name)
    word = F.replace(F.rtrim(title), F.lit("."), F.lit(""))
    rest = F.substring(name, F.length(title) + 1, F.lit(1 << 20))
    given = F.substring_index(rest, " ", 1)
    gender = F.when(word.isin(*TITLES["f"]), "f").when(word.isin(*TITLES["m"]), "m").when(given.isin(*FEMALE, *FEMALE_CYRILLIC), "f").when(given.isin(*MALE, *MALE_CYRILLIC), "m").otherwise("")
    return F.when(F.contains(rest, F.lit(" ")), F.concat(gender, F.lit(":"), given))


def _surname(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def parts(entity: Column, of: Column) -> Column:
    """(entity, type) of what has a surrogate of its own: the parts of a name, else the entity itself."""
    part = lambda e, t: F.struct(e.alias("entity"), t.alias("type"))
    names = F.filter(F.array(part(_given(entity), F.lit("given")), part(_surname(entity), F.lit("surname"))), lambda p: p["entity"].isNotNull())
    return F.when(of == "name", names).otherwise(F.array(part(entity, of)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(key: str, of: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), of, norm, attempt.cast("string")).cast("binary"), 256)


def _number(digest: Column, i: Column | int) -> Column:
    """The i-th of 32 numbers from 0 to 255."""
    at = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(digest, (at % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str | list[str], number: Column) -> Column:
    if isinstance(choices, str):
        return F.substring(F.lit(choices), number % len(choices) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, choices)), number % len(choices) + 1)


def _filled(entity: Column, digest: Column, kept: Column) -> Column:
    """The entity with its letters and digits replaced by others of their kind, but for the first ``kept``.

    The n-th letter or digit depends on the digest and n alone, so spacing and case keep their places.
    """
    return _let(F.regexp_like(entity, F.lit("^[0-9a-fA-F]+$")), lambda only_hex: _fill(entity, digest, kept, only_hex))


def _fill(entity: Column, digest: Column, kept: Column, only_hex: Column) -> Column:

    def other(c: Column, n: Column) -> Column:
        return (
            F.when(F.regexp_like(c, F.lit("[0-9]")), _pick(DIGITS, n))
            .when(F.regexp_like(c, F.lit("[a-z]")), F.when(only_hex, _pick(HEX, n)).otherwise(_pick(LOWER, n)))
            .otherwise(F.when(only_hex, F.upper(_pick(HEX, n))).otherwise(_pick(UPPER, n)))
        )

    def add(at: Column, c: Column) -> Column:
        counts = F.regexp_like(c, F.lit("[0-9A-Za-z]"))
        new = F.when(counts & (at["n"] >= kept), _let(_number(digest, at["n"]), lambda n: other(c, n))).otherwise(c)
        return F.struct(F.concat(at["out"], new).alias("out"), (at["n"] + counts.cast("int")).alias("n"))

    return F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), add, lambda at: at["out"])


def _luhn(card: Column) -> Column:
    """The card number with its last digit made to fit the others."""
    digits = F.regexp_replace(card, "[^0-9]", "")
    back = F.slice(F.split(F.reverse(digits), ""), 2, 1 << 10)
    doubled = F.transform(back, lambda c, i: F.when(i % 2 == 0, F.get(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, b: a + b)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), ((10 - total % 10) % 10).cast("string"))


def _check_digits(iban: Column) -> Column:
    """The IBAN with check digits, its third and fourth characters, that fit the others."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, F.lit(5), F.lit(1 << 10)), F.substring(compact, 1, 2), F.lit("00"))
    number = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda at, c: (at * F.when(number(c) < 10, 10).otherwise(100) + number(c)) % 97)
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(iban, F.lit(5), F.lit(1 << 10)))


def _syllables(digest: Column, cyrillic: Column, first: int, last: Column) -> Column:
    choose = lambda i: F.when(cyrillic, _pick(SYLLABLES_CYRILLIC, _number(digest, i))).otherwise(_pick(SYLLABLES, _number(digest, i)))
    return F.array_join(F.transform(F.sequence(F.lit(first), last), choose), "")


def _new_given(given: Column, digest: Column, attempt: Column) -> Column:
    """Another given name of the same gender and script; after three attempts one made of syllables."""
    gender = F.substring_index(given, ":", 1)
    cyrillic = F.regexp_like(given, F.lit(r"\p{IsCyrillic}"))
    # Where the gender isn't known the hash decides.
    female = (gender == "f") | ((gender == "") & (_number(digest, 0) % 2 == 0))
    pick = lambda f, m: F.when(female, _pick(f, _number(digest, 1))).otherwise(_pick(m, _number(digest, 1)))
    listed = F.when(cyrillic, pick(FEMALE_CYRILLIC, MALE_CYRILLIC)).otherwise(pick(FEMALE, MALE))
    ending = F.when(cyrillic, F.when(female, "а").otherwise("ий")).otherwise(F.when(female, "a").otherwise("us"))
    made = F.initcap(F.concat(_syllables(digest, cyrillic, 2, F.least(attempt, F.lit(20))), F.when(cyrillic, "н").otherwise("n"), ending))
    return F.when(attempt < 3, listed).otherwise(made)


def surrogate(entity: Column, of: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity of type ``of``, or of a part of a name."""
    digest = F.when(of == "given", F.lower(entity)).otherwise(normal(entity, of))
    return _let(_digest(key, of, digest, attempt), lambda d: _surrogate(entity, of, attempt, d))


def _surrogate(entity: Column, of: Column, attempt: Column, digest: Column) -> Column:
    # Letters and digits are replaced one by one, of addresses those before the "@".
    country = F.length(F.regexp_extract(entity, r"^\+([0-9]{1,3})(?=[ .(-])", 1))
    kept = F.when(of == "card", 1).when(of == "phone", country).when(of == "iban", 2).when(F.startswith(entity, F.lit("AKIA")), 4).otherwise(0)
    filled = _filled(F.when(of == "email", F.substring_index(entity, "@", 1)).otherwise(entity), digest, kept)
    # Domains are reserved ones; the rest keeps its form.
    ending = F.lower(F.regexp_extract(entity, r"\.([A-Za-z]+)$", 1))
    label = F.array_join(F.transform(F.sequence(F.lit(20), F.lit(25)), lambda i: _pick(LOWER, _number(digest, i))), "")
    domain = F.concat(F.lit("@"), label, F.lit(".example."), ending)
    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i) % 254 + 1).cast("string")), ".")
    # More syllables with each attempt.
    family = F.initcap(_syllables(digest, F.regexp_like(entity, F.lit(r"\p{IsCyrillic}")), 2, F.lit(4) + F.least(attempt, F.lit(20))))
    new = (
        F.when(of == "email", F.concat(filled, F.when(F.regexp_like(entity, F.lit("[a-z]")), domain).otherwise(F.upper(domain))))
        .when(of == "ip", address)
        .when(of == "card", _let(filled, _luhn))
        .when(of == "iban", _let(filled, _check_digits))
        .when(of == "given", _new_given(entity, digest, attempt))
        .when(of == "surname", family)
        .otherwise(filled)
    )
    return F.when(attempt > ROUNDS, F.concat(new, F.lit("-"), F.substring(digest, F.lit(41), F.lit(12)))).otherwise(new)


def _face(norm: Column, of: Column) -> Column:
    """What is compared of a normal form: of given names not the gender."""
    return F.when(of == "given", F.substring_index(norm, ":", -1)).otherwise(norm)


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(type, norm, attempt) of the entities whose first surrogate can't stay; ``found``: type, norm, entity.

    In each round the surrogates are held against each other and against the entities of the corpus, by
    normal form; given names, which are few and common, against each other and themselves. Of those
    that meet the one with the fewest attempts stays, then the smallest. After ROUNDS rounds surrogates
    carry digits of their digest, so the rounds end whatever the corpus holds.
    """
    now = found.groupBy("type", "norm").agg(F.min("entity").alias("entity")).withColumn("attempt", F.lit(0))
    while True:
        # Written once a round: what follows compares narrow rows and doesn't hash again.
        new = surrogate(F.col("entity"), F.col("type"), key, F.col("attempt"))
        placed = now.withColumn("new", F.when(F.col("type") == "given", F.lower(new)).otherwise(normal(new, F.col("type")))).withColumn("face", _face(F.col("norm"), F.col("type")))
        placed = written(placed, "pii-placed")
        # Those that came by with fewer attempts keep their place.
        rank = F.min(F.struct("attempt", "norm")).alias("first")
        best = placed.groupBy("type", "new").agg(rank, F.count("*").alias("n")).filter("n > 1").select("type", "new", "first")
        met = placed.join(best, ["type", "new"]).filter(F.struct("attempt", "norm") != F.col("first")).select("type", "norm")
        others = placed.filter("type <> 'given'").select("type", F.col("face").alias("new")).distinct()
        real = placed.join(others, ["type", "new"], "left_semi").select("type", "norm").union(placed.filter("new = face").select("type", "norm"))
        again = written(met.union(real).distinct().withColumn("again", F.lit(1)), "pii-again")
        if again.isEmpty():
            return placed.filter("attempt > 0").select("type", "norm", "attempt")
        now = placed.join(again, ["type", "norm"], "left").select("type", "norm", "entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def replaced(docs: DataFrame, key: str = "surrogates", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text column, and n_entities and pii_types (distinct, sorted) added.

    All other columns stay, whatever their names; columns of docs called n_entities or pii_types are
    replaced. Null texts stay null with 0 entities. Rows of one id, and repeated rows, get the same
    surrogates, as these depend on the entity and the key alone. An empty table gives an empty one.

    Emails, addresses, numbers and secrets keep their form; cards and IBANs stay valid, and digits that
    only look like a card stay. A surname, a given name of a gender, and anything else has one surrogate
    and shares it with none, so a person named in full and by title keeps one surname. Names are those
    after a title or with one of the given names above; others aren't looked for.

    What the replacement of a text depends on beside it are the entities whose surrogates met others;
    these come by a join on the id, to which Spark sends the side that is small enough, or both sides
    dealt by id.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body, id_ = F.col("row")[text], F.col("row")[doc_id]
    of = F.transform(entities(body), lambda e: F.struct(e.alias("entity"), kind(e).alias("type")))
    norm = lambda p: F.when(p["type"] == "given", F.lower(p["entity"])).otherwise(normal(p["entity"], p["type"]))
    hits = rows.select(id_.alias("id"), F.explode(of).alias("hit")).filter("hit.type <> ''").select("id", F.explode(parts(F.col("hit.entity"), F.col("hit.type"))).alias("part"))
    hits = written(hits.select("id", "part.entity", "part.type", norm(F.col("part")).alias("norm")).distinct(), "pii-hits")
    retried = written(attempts(hits.select("type", "norm", "entity").distinct(), key), "pii-retried")
    name = lambda of, norm: F.concat_ws("\x1f", of, norm)
    listed = hits.join(retried, ["type", "norm"]).select("id", F.struct(name(F.col("type"), F.col("norm")).alias("key"), "attempt").alias("entry")).distinct()
    listed = written(listed.groupBy("id").agg(F.map_from_entries(F.collect_list("entry")).alias("retried")), "pii-listed")
    joined = rows.join(listed, id_.eqNullSafe(F.col("id")), "left").withColumn("found", F.coalesce(of, F.array().cast("array<struct<entity:string,type:string>>")))

    def new(part: Column) -> Column:
        retry = F.coalesce(F.element_at(F.col("retried"), name(part["type"], norm(part))), F.lit(0))
        return _let(retry, lambda r: surrogate(part["entity"], part["type"], key, r))

    def whole(hit: Column) -> Column:
        pieces = F.array_join(F.transform(parts(hit["entity"], hit["type"]), new), " ")
        return F.when(hit["type"] == "", hit["entity"]).when(hit["type"] == "name", F.concat(_title(hit["entity"]), pieces)).otherwise(pieces)

    found = F.col("found")
    text_out = F.when(F.size(found) > 0, F.array_join(F.zip_with(gaps(body), F.concat(F.transform(found, whole), F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")).otherwise(body)
    kept = [text_out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_entities", "pii_types")]
    types = F.filter(F.transform(found, lambda e: e["type"]), lambda t: t != "")
    return joined.select(*kept, F.size(types).alias("n_entities"), F.array_sort(F.array_distinct(types)).alias("pii_types"))
