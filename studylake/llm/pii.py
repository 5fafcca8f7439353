r"""Surrogates for personal data, in DataFrame operations alone.

Detected entities get keyed replacements of their own type: e-mail addresses, telephone numbers, IPv4 addresses, payment
card numbers, IBANs, US social security numbers, and names after a title ("Mr Smith", "Frau Lena Vogel").
A replacement is a function of the key, the type and the normalised entity, so an entity has one surrogate in all texts.
It keeps the entity's format: digits stay digits with their separators, a card's checksum stays right or wrong as it was,
letters keep script and case, a name keeps its title, its number of parts and the gender that the title tells.

A name's parts are entities of their own, by gender, so "Mr Smith" and "Mr John Smith" share a surrogate for "Smith", and
"Mrs Smith" has its stem with another ending; in a text where a surname was found, later mentions of it without a title are replaced too.

Texts are read twice and not moved. The first pass gathers the different entities and checks them: entities that would
share a surrogate, or get one that is itself an entity of the corpus, take the next attempt of their keyed sequence, until
none collide. Where a format is too crowded for that, attempts from ``CROWDED`` on are longer than the entity. Only those exceptions reach the second pass, which rewrites texts in place: as a literal map if they are
few, else by a join on the texts that hold one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, only, shuffle_partitions

_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
#: Titles by the gender that they tell.
MALE = ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "M", "Don", "Г-н", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle", "Doña", "Г-жа", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Professor", "Доктор")
_TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
#: Patterns by type; where two could start at one place, the first wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+[0-9]{7,14}(?![0-9])"
    # After a country code, eight digits or more in groups of any size; after a trunk zero, four pairs or one long group.
    r"|(?<![0-9A-Za-z])(?=\+(?:[\x20.-]?[0-9]){8})\+[0-9]{1,3}(?:[\x20.-][0-9]{1,8}){2,6}(?![0-9])"
    r"|(?<![0-9A-Za-z+.,:/-])0[0-9](?:[\x20.-][0-9]{2}){4}(?![0-9]|[\x20.,:/-][0-9])"
    r"|(?<![0-9A-Za-z+.,:/-])0[0-9]{1,4}[\x20-][0-9]{5,8}(?![0-9]|[\x20.,:/-][0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?\x20{_NAME}(?:\x20{_NAME})?",
}
TYPES = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap sign that a text may hold an entity.
SIGN = rf"@|[0-9][\x20.()-]{{0,2}}[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|(?:{_TITLE})\.?\x20"
#: Telephone country codes are one digit for zones 1 and 7, two for these, three for all others.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SYLLABLES = ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va")
CYRILLIC = ("ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха")
#: Endings that tell gender, where the title does.
ENDING = {"m": "n", "f": "a", "": "s"}
_HEX_DIGITS = 60
#: Attempts that keep an entity's length; a later one adds digits or syllables.
CROWDED = 16
#: Kinds of a name's parts: they share one space of surrogates.
SURNAME, GIVEN = "surname-", "given-"
CAPITALISED = r"(?<![\p{L}\p{N}\p{M}'’-])\p{Lu}[\p{L}\p{M}'’-]+"


def type_of(entity: Column) -> Column:
    whole = [(t, F.rlike(entity, F.lit(f"^(?:{p})$"))) for t, p in PATTERNS.items()]
    return reduce(lambda acc, x: acc.when(x[1], x[0]), whole[1:], F.when(whole[0][1], whole[0][0]))


def _is_part(kind: Column) -> Column:
    return F.startswith(kind, F.lit(SURNAME)) | F.startswith(kind, F.lit(GIVEN))


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?:{_TITLE})\.?\x20", 0)


def name_parts(entity: Column) -> Column:
    """The parts of a titled name as ``(kind, part)``: a given name, if there are two, and the surname, both with the
    title's gender in their kind."""
    title = _title(entity)
    bare = F.regexp_replace(title, r"\.?\x20$", "")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("")
    parts = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), r"\x20")
    return F.transform(parts, lambda p, i: F.struct(F.concat(F.when(i == F.size(parts) - 1, SURNAME).otherwise(GIVEN), gender).alias("kind"), p.alias("part")))


def normal_form(entity: Column, kind: Column) -> Column:
    """What makes two spellings one entity: case of addresses and names' parts, separators of numbers."""
    return (
        F.when((kind == "email") | _is_part(kind), F.lower(entity))
        .when(kind == "ip", entity)
        .otherwise(F.regexp_replace(entity, r"[\x20().-]", ""))
    )


def _digest(key: str, kind: Column, normal: Column, attempt: Column, part: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(key), kind, normal, attempt.cast("string"), F.lit(part)), 256)


def _refill(entity: Column, digits: Column, pattern: str = "[0-9]") -> Column:
    """The entity with its n-th digit replaced by the n-th of ``digits``; all else stays."""
    chars = F.split(entity, "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda acc, c: F.when(
            F.rlike(c, F.lit(pattern)),
            F.struct((acc["i"] + 1).alias("i"), F.concat(acc["out"], F.substring(digits, acc["i"] + 1, F.lit(1))).alias("out")),
        ).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["out"], c).alias("out"))),
    )
    return state["out"]


def _decimal(digest: Column) -> Column:
    """60 decimal digits of a hexadecimal digest."""
    return F.translate(F.substring(digest, 1, _HEX_DIGITS), "abcdef", "036925")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check over a string of digits."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )


def _word(like: Column, digest: Column, more: Column, syllables: tuple[str, ...], ending: Column) -> Column:
    """A made-up name of capital, syllables and ending; all in capitals if ``like`` is."""
    n = F.greatest(F.lit(3), F.least(F.lit(5), F.ceil(F.length(like) / 2).cast("int"))) + more
    made = F.array_join(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.element_at(F.array(*map(F.lit, syllables)), F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("int") + 1),
        ),
        "",
    )
    whole = F.concat(made, ending)
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(whole)).otherwise(F.initcap(whole))


def part_surrogate(part: Column, kind: Column, attempt: Column, key: str) -> Column:
    """Replacement of a name's part, in its script: a stem that gender does not change, and the gender's ending."""
    digest = _digest(key, F.substring_index(kind, "-", 1), normal_form(part, kind), attempt, "a")
    more = F.least(F.greatest(attempt - (CROWDED - 1), F.lit(0)), F.lit(50))
    ending = F.when(F.endswith(kind, F.lit("-m")), ENDING["m"]).when(F.endswith(kind, F.lit("-f")), ENDING["f"]).otherwise(ENDING[""])
    latin = _word(part, digest, more, SYLLABLES, ending)
    return F.when(F.rlike(part, F.lit(r"\p{IsCyrillic}")), _word(part, digest, more, CYRILLIC, F.translate(ending, "nas", "нас"))).otherwise(latin)


def surrogate(entity: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity, or of a name's part, at an attempt of its keyed sequence."""
    normal = normal_form(entity, kind)
    one, two = _digest(key, kind, normal, attempt, "a"), _digest(key, kind, normal, attempt, "b")
    digits = _decimal(one)
    plain = _refill(entity, digits)
    bare, filled = F.regexp_replace(entity, "[^0-9]", ""), F.regexp_replace(plain, "[^0-9]", "")
    # The last digit makes the checksum right if the entity's was, else wrong.
    stem = F.substring(filled, 1, 15)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))
    off = F.when(F.pmod(_luhn(bare), F.lit(10)) == 0, 0).otherwise(F.conv(F.substring(two, 1, 2), 16, 10).cast("int") % 9 + 1)
    card = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.pmod(check + off, F.lit(10)).cast("string"))
    # An IBAN keeps its country and shape, and gets the check digits that its new number needs.
    tail = _refill(F.substring(entity, F.lit(5), F.length(entity)), digits)
    tail = F.translate(tail, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "QWERTYUIOPASDFGHJKLZXCVBNM")
    country = F.substring(entity, 1, 2)
    moved = F.concat(F.regexp_replace(tail, r"\x20", ""), country, F.lit("00"))
    mod = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(F.rlike(c, F.lit("[0-9]")), (acc * 10 + c.cast("int")) % 97)
        .when(c == "", acc)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    iban = F.concat(country, F.lpad((98 - mod).cast("string"), 2, "0"), tail)
    octet = lambda i: (F.conv(F.substring(one, i, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    ip = F.concat_ws(".", octet(1), octet(5), octet(9), octet(13))
    # A telephone number keeps its country code or trunk zero; both follow from its digits, not from how they are grouped.
    code = F.when(F.substring(entity, 1, 1) == "+", F.length(F.regexp_extract(bare, COUNTRY_CODE, 0))).otherwise(F.length(F.regexp_extract(bare, "^0", 0)))
    phone = _refill(entity, F.concat(F.substring(bare, F.lit(1), code), digits))
    at = F.instr(entity, "@")
    local, domain = F.substring(entity, F.lit(1), at - 1), F.substring(entity, at + 1, F.length(entity))
    top = F.regexp_extract(domain, r"\.[A-Za-z0-9-]+$", 0)
    # A new local part of the old one's shape, and a domain that nobody owns.
    shape = F.translate(F.substring(one, 1, 12), "0123456789", "ghijklmnop")
    number = F.when(F.rlike(local, F.lit("[0-9]$")), F.substring(digits, 13, 2)).otherwise("")
    dot = F.when(F.contains(local, F.lit(".")), F.concat(F.substring(shape, 1, 6), F.lit("."), F.substring(shape, 7, 6))).otherwise(shape)
    email = F.concat(dot, number, F.lit("@"), F.substring(two, 1, 6), F.when(top == "", ".org").otherwise(F.concat(F.lit(".example"), top)))
    made = (
        F.when(kind == "email", email)
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .otherwise(plain)
    )
    made = F.when(attempt >= CROWDED, F.concat(made, F.substring(_decimal(two), F.lit(1), F.least(attempt - (CROWDED - 5), F.lit(_HEX_DIGITS))))).otherwise(made)
    return F.when(_is_part(kind), part_surrogate(entity, kind, attempt, key)).otherwise(made)


def _found(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(SIGN)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _key_of(entity: Column, kind: Column) -> Column:
    return F.concat(kind, F.lit("\x00"), normal_form(entity, kind))


def _keys_of(entity: Column) -> Column:
    """Keys of an entity, or of a name's parts."""
    kind = type_of(entity)
    return F.when(kind == "name", F.transform(name_parts(entity), lambda p: _key_of(p["part"], p["kind"]))).otherwise(F.array(_key_of(entity, kind)))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Different entities of the corpus: ``(kind, normal, entity)``, the spelling that sorts first standing for all. Names
    give their parts."""
    found = only(docs, text=text_col).where("text is not null").select(F.explode(F.array_distinct(_found(F.col("text")))).alias("entity"))
    typed = found.distinct().withColumn("kind", type_of(F.col("entity")))
    whole = F.array(F.struct(F.col("kind"), F.col("entity").alias("part")))
    each = typed.select(F.explode(F.when(F.col("kind") == "name", name_parts(F.col("entity"))).otherwise(whole)).alias("p")).select("p.kind", F.col("p.part").alias("entity"))
    each = each.withColumn("normal", normal_form(F.col("entity"), F.col("kind")))
    return each.groupBy("kind", "normal").agg(F.min("entity").alias("entity"))


def exceptions(known: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Entities whose surrogate isn't the first of their sequence: ``(name, attempt)``, with name as in ``_key_of``.

    In each round the entities are given their surrogates; of those that share one all but the first move on, and so do
    those whose surrogate is an entity of the corpus. Rounds go on until there is none, which later attempts' greater length
    brings about in any corpus. Surrogates are costly, so entities are spread over all tasks.
    """
    n = shuffle_partitions(known.sparkSession)
    now = scratch.write(known.withColumn("attempt", F.lit(0)))
    space = F.when(_is_part(F.col("kind")), "part").otherwise(F.col("kind"))
    reals = now.select(space.alias("space"), F.col("normal").alias("taken")).distinct()
    me = F.struct("normal", "kind")
    while True:
        # Dealt after the table is read: its small files would be read by one task.
        spread = now.repartition(n, "kind", "normal")
        made = spread.select("kind", "normal", space.alias("space"), normal_form(surrogate(F.col("entity"), F.col("kind"), F.col("attempt"), key), F.col("kind")).alias("taken"))
        made = scratch.write(made)
        shared = made.groupBy("space", "taken").agg(F.min(me).alias("first"), F.count("*").alias("n")).where("n > 1")
        late = made.join(shared, ["space", "taken"]).where(me != F.col("first")).select("kind", "normal")
        real = made.join(reals, ["space", "taken"], "left_semi").select("kind", "normal")
        again = scratch.write(late.unionByName(real).distinct())
        if again.isEmpty():
            out = now.where("attempt > 0").select(F.concat("kind", F.lit("\x00"), "normal").alias("name"), "attempt")
            return scratch.write(out)
        bumped = now.join(again.withColumn("more", F.lit(1)), ["kind", "normal"], "left")
        bumped = bumped.select("kind", "normal", "entity", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
        then = scratch.write(bumped)
        scratch.drop(made)
        now = then


def replace_pii(docs: DataFrame, text_col: str = "text", *, key: str, count_col: str | None = None, max_literals: int = 500) -> DataFrame:
    """``docs`` with surrogates in place of the entities of ``text_col``; all other columns and rows stay as they are.

    ``count_col`` adds the number of entities detected; mentions of a surname without a title are replaced uncounted. A null text stays null, with 0 entities; so does an empty one.
    Repeated rows are replaced alike. An empty table gives no rows. ``max_literals`` bounds the exceptions that go into
    the plan; above it they are joined to the texts that hold them.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    odd = exceptions(entities(docs, text_col), key, scratch)
    few = odd.limit(max_literals + 1).collect()
    found, tries, new = (fresh(docs, n) for n in ("pii_found", "pii_tries", "pii_new"))
    text = F.col(f"`{text_col}`")
    source = docs.withColumn(found, F.coalesce(_found(text), F.array().cast("array<string>")))
    if not few:
        attempt = lambda name: F.lit(0)
    elif len(few) <= max_literals:
        table = F.create_map(*(F.lit(x) for r in few for x in (r.name, r.attempt)))
        attempt = lambda name: F.coalesce(F.try_element_at(table, name), F.lit(0))
    else:
        # Texts that hold an exception, by their hash and length; each with its own exceptions.
        holder = source.where(F.size(found) > 0).select(F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("s"), F.explode(F.array_distinct(found)).alias("e"))
        named = holder.select("h", "s", F.explode(_keys_of(F.col("e"))).alias("name")).distinct()
        own = named.join(odd, "name").groupBy("h", "s").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias(tries))
        own = scratch.write(own)
        h, s2 = fresh(source, "pii_h"), fresh(source, "pii_s")
        keyed = source.withColumn(h, F.xxhash64(text)).withColumn(s2, F.sha2(text, 256))
        own = own.withColumnRenamed("h", h).withColumnRenamed("s", s2)
        source = keyed.join(own, [h, s2], "left").drop(h, s2)
        attempt = lambda name: F.coalesce(F.try_element_at(F.col(tries), name), F.lit(0))

    part = lambda p, kind: part_surrogate(p, kind, attempt(_key_of(p, kind)), key)

    def replaced(entity: Column) -> Column:
        kind = type_of(entity)
        name = F.concat(_title(entity), F.array_join(F.transform(name_parts(entity), lambda p: part(p["part"], p["kind"])), " "))
        return F.when(kind == "name", name).otherwise(surrogate(entity, kind, attempt(_key_of(entity, kind)), key))

    pieces = F.split(text, ANY, -1)
    mixed = F.zip_with(pieces, F.transform(found, replaced), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    rewritten = source.withColumn(new, F.when(F.size(found) > 0, F.array_join(mixed, "")).otherwise(text))
    # Later mentions of a surname, without its title, in the same text.
    names = F.filter(F.col(found), lambda e: F.rlike(e, F.lit(f"^(?:{PATTERNS['name']})$")))
    surnames = F.array_distinct(F.transform(names, lambda e: F.element_at(name_parts(e), -1)))
    words, between = F.regexp_extract_all(F.col(new), F.lit(CAPITALISED), F.lit(0)), F.split(F.col(new), CAPITALISED, -1)
    meant = lambda w: F.get(F.filter(surnames, lambda s: s["part"] == w), F.lit(0))
    mention = lambda w: F.coalesce(F.when(F.exists(surnames, lambda s: s["part"] == w), part(w, meant(w)["kind"])), w, F.lit(""))
    again = F.array_join(F.zip_with(between, words, lambda b, w: F.concat(b, mention(w))), "")
    titled = F.rlike(F.array_join(found, "\n"), F.lit(f"(?m)^(?:{_TITLE})\\.?\\x20"))
    final = F.when(titled, again).otherwise(F.col(new))
    columns = [final.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    count = [F.size(found).cast("long").alias(count_col)] if count_col else []
    return rewritten.select(*columns, *count)
