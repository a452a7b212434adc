"""Surrogates for personal data and secrets.

Detected entities get replacements that depend on a key, the entity's type and
its normal form only, so an entity has the same surrogate everywhere, whatever
its spelling. A surrogate matches its entity: digits for digits, letters of the
same script and case for letters, valid check digits and address parts, given
names of the same gender. All surrogates are checked against each other and
against the real entities; those that collide are drawn again, and longer after some draws, so
that distinct entities stay distinct. Names are replaced word by word, so that a
name and its parts are one person's; where a text has named someone after a
title, mentions without one are replaced too. DataFrame functions only.
"""

from __future__ import annotations

import os
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_or_not, written

#: Key where none is given, for tests: see secret_key.
KEY = "change-this-key"
#: Draws after which a surrogate gets a character more with each, so that there
#: is always room.
DRAWS = 3

#: Titles by gender, and given names by gender and script.
TITLES_F = ("Mrs", "Ms", "Miss", "Madame", "Mme", "Mademoiselle", "Frau", "Señora", "Sra", "Señorita", "Госпожа")
TITLES_M = ("Mr", "Sir", "Monsieur", "Herr", "Herrn", "Señor", "Sr", "Господин")
TITLES_N = ("Dr", "Doctor", "Prof", "Professor", "Docteur", "Professeur", "Доктор", "Профессор")
NAMES = {
    ("", "latin"): ("Alex", "Andrea", "Camille", "Charlie", "Dominique", "Kim", "Noa", "Robin", "Sam", "Sascha"),
    ("", "cyrillic"): ("Валя", "Женя", "Саша", "Слава"),
    ("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Eva", "Irene", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Teresa", "Vera", "Victoria"),
    ("m", "latin"): ("Adam", "Adrian", "Albert", "Bruno", "Daniel", "David", "Felix", "Gabriel", "Hugo", "Leo", "Lucas", "Martin", "Max", "Oliver", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Сергей"),
}

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\w:])(?=[A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=(?:(?:{_GROUP})?:){{3}})(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![\w:])"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
# runs of groups that may hold accounts and cards; what is valid in them is found by check digits
_IBAN_RUN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}(?:[ -]?[A-Z0-9]{4})*(?: ?[A-Z0-9]{1,3}(?!\.\d{1,3}\.\d|-\d{2}-\d{4}|-\d{3}-\d{4}))?(?:[ -]\d{6}[ -]\d{5})?\b"
_PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.,+-])0(?:\d{4} \d{6}|\d{3} \d{3} ?\d{4}|\d{2} \d{4} \d{4}|\d(?:[ .]\d{2}){4})(?![\d-]|[.,]\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d.,])(?:\d{4}[ -]){3}\d{1,7}(?![\d])|(?<![\d.,])\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<![\d.,])\d{13,19}(?!\d)"
_CARD_RUN = r"(?<![\d.,])\d{4}(?:[ -]\d{4}){2,}[ -]\d{1,7}(?!\d)|" + _CARD
_KEY = r"\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bsk-[A-Za-z0-9_-]{20,}|\b(?=[0-9a-f]*\d)[0-9a-f]{32,128}\b|\b(?=[0-9A-F]*\d)[0-9A-F]{32,128}\b"
_LABEL = r"\b(?:password|passwd|secret|api_key)[=:]"
_LABELLED = rf"(?<=[=:])(?<={_LABEL})[^\s\"',;&|]{{4,}}"
_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join((*TITLES_F, *TITLES_M, *TITLES_N))
# the cheap looks come first: most places fail them
_NAME = rf"(?<= )(?=\p{{Lu}})(?<=\b(?:{_TITLE})\.? ){_WORD}(?: {_WORD}){{0,2}}"
#: All entities; of two that begin at one place the first kind wins.
PATTERN = "|".join(f"(?:{p})" for p in (_LABELLED, _EMAIL, _KEY, _IBAN_RUN, _IP, _IP6, _SSN, _PHONE, _CARD_RUN, _NAME))
#: Characters of an account by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Longest written account or card that is looked for in a run.
PART_CHARS = 44
#: Mark of a labelled secret where a name has its gender.
IS_SECRET = "s"

#: What a text must hold one of to be searched at all, beside @ and digits.
#: Each alternative of PATTERN implies one of these, a digit or @.
HINTS = (*TITLES_F, *TITLES_M, *(f"{t}{end}" for t in TITLES_N for end in (" ", ". ")), "password", "passwd", "secret", "api_key", "AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity; false for null. Plain searches for
    fixed strings cost far less than the patterns they spare."""
    found = reduce(lambda a, b: a | b, [text.contains(h) for h in HINTS], text.rlike(r"[@\d]"))
    return F.coalesce(found, F.lit(False))


def _letters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits; 0 for a valid number."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10


def mod97(account: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters last
    and letters as 10 to 35; 1 for a valid one."""
    turned = _chars(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)))
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike(r"\d"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def kind_of(entity: Column) -> Column:
    """Type of an entity that PATTERN matched without a label; `number` is none
    as a whole: its check digits are wrong, and only what parts_of finds in it
    is replaced."""
    return (
        F.when(entity.rlike(f"^(?:{_EMAIL})$"), "email")
        .when(entity.rlike(f"^(?:{_KEY})$"), "secret")
        .when(entity.rlike(f"^(?:{_IP})$"), "ip")
        .when(entity.rlike(f"^(?:{_IP6})$"), "ip6")
        .when(entity.rlike(f"^(?:{_SSN})$"), "ssn")
        .when(entity.rlike(f"^(?:{_PHONE})$"), "phone")
        .when(entity.rlike(f"^(?:{_CARD})$"), F.when(luhn(_letters(entity)) == 0, "card").otherwise("number"))
        .when(entity.rlike(rf"^(?:{_IBAN})$"), F.when(mod97(_letters(entity)) == 1, "iban").otherwise("number"))
        .when(entity.rlike(f"^(?:{_IBAN_RUN}|{_CARD_RUN})$"), "number")
        .when(entity.rlike(rf"^(?:{_WORD})(?: {_WORD}){{0,2}}$") & ~entity.rlike(r"\d"), "name")
        .otherwise("secret")
    )


def parts_of(run: Column) -> Column:
    """Valid cards and accounts in a run that is none as a whole, as structs
    of place `at` (from 1), size and part: from the left, the longest first. An
    account has its country's size, or any if the country is not known."""
    free = lambda i: (i < 1) | (i > F.length(run)) | ~F.substring(run, i, F.lit(1)).rlike("[A-Z0-9]")
    places = F.sequence(F.lit(1), F.length(run))
    starts = F.filter(places, lambda i: free(i - 1) & ~free(i))
    ends = F.filter(places, lambda i: free(i + 1) & ~free(i))
    made = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: (j - i >= 12) & (j - i < PART_CHARS)), lambda j: F.struct(i.alias("at"), (j - i + 1).alias("size"), F.substring(run, i, j - i + 1).alias("part")))))
    sizes = F.create_map(*[F.lit(x) for item in IBAN_SIZES.items() for x in item])

    def valid(x: Column) -> Column:
        part = x["part"]
        plain = _letters(part)
        account = part.rlike(f"^(?:{_IBAN})$") & (F.coalesce(sizes[F.substring(part, 1, 2)], F.length(plain)) == F.length(plain))
        return F.when(part.rlike(f"^(?:{_CARD})$"), luhn(plain) == 0).when(account, mod97(plain) == 1).otherwise(False)

    found = F.array_sort(F.filter(made, valid), lambda x, y: F.when(x["at"] != y["at"], x["at"] - y["at"]).otherwise(y["size"] - x["size"]))
    none = F.array().cast("array<struct<at:int,size:int,part:string>>")
    end = lambda kept: F.when(F.size(kept) > 0, F.element_at(kept, -1)["at"] + F.element_at(kept, -1)["size"]).otherwise(0)
    return F.aggregate(found, none, lambda kept, x: F.when(x["at"] >= end(kept), F.concat(kept, F.array(x))).otherwise(kept))


def normal(kind: Column, entity: Column) -> Column:
    """One form for all spellings of an entity."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind.isin("phone", "ssn", "card", "iban"), _letters(entity))
        .otherwise(entity)
    )


def _byte(code: Column, i: Column) -> Column:
    """The i-th byte, counted around, of a 64-byte hexadecimal code."""
    return F.conv(F.substring(code, (i % 64) * 2 + 1, F.lit(2)), 16, 10).try_cast("int")


def _code(kind: Column, of: Column, draw: Column, key: str) -> Column:
    """512 keyed bits of an entity and a draw, in hexadecimal."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, draw.cast("string"), of, F.lit(key)), 512)


def _pick(choices: str, at: Column) -> Column:
    return F.substring(F.lit(choices), at % len(choices) + 1, F.lit(1))


def like(text: Column, code: Column) -> Column:
    """Letters and digits drawn anew, each of its own script and case; digits
    that begin a number are not 0. Other characters stay."""
    hexadecimal = text.rlike(r"^(?=.*[a-f])(?=.*\d)[0-9a-f]{8,}$")
    upper_hex = text.rlike(r"^(?=.*[A-F])(?=.*\d)[0-9A-F]{8,}$")

    def drawn(c: Column, i: Column) -> Column:
        b = _byte(code, i)
        return (
            F.when(hexadecimal, _pick("0123456789abcdef", b))
            .when(upper_hex, _pick("0123456789ABCDEF", b))
            .when(c.rlike(r"\d"), F.when(i == 0, _pick("123456789", b)).otherwise(_pick("0123456789", b)))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), _pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", b))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), _pick("абвгдежзиклмнопрстуфхцчшэюя", b))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), _pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", b))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), _pick("αβγδεζηθικλμνξοπρστυφχψω", b))
            .when(c.rlike(r"\p{Lu}"), _pick("ÀÁÂÃÄÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", b))
            .when(c.rlike(r"\p{Ll}"), _pick("àáâãäèéêëìíîïòóôõöùúûü", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), drawn), "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _word(kind: Column, of: Column, code: Column, gender: Column, draw: Column) -> Column:
    """A word of a name: a given name of the gender and script from the list,
    from the second draw on one of syllables with the gender's ending; a surname
    of syllables. Later draws have more of them."""
    script = F.when(of.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    latin = script == "latin"
    listed = reduce(
        lambda rest, item: F.when((gender == item[0][0]) & (script == item[0][1]), F.element_at(F.array(*map(F.lit, item[1])), _byte(code, F.lit(0)) % len(item[1]) + 1)).otherwise(rest),
        NAMES.items(), F.lit("Alex"))
    syllable = lambda i: F.when(latin, F.concat(_pick("bdfglmnprstv", _byte(code, i)), _pick("aeiou", _byte(code, i + 1)))).otherwise(
        F.concat(_pick("бвгдклмнпрст", _byte(code, i)), _pick("аеиоу", _byte(code, i + 1))))
    built = lambda n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: syllable(j * 2)), ""))
    longer = F.greatest(draw - DRAWS, F.lit(0))
    ending = F.when(gender == "f", F.when(latin, "lia").otherwise("ля")).when(gender == "m", F.when(latin, "ron").otherwise("рон")).otherwise(F.when(latin, "ri").otherwise("ри"))
    given = F.when(draw == 0, listed).otherwise(F.concat(built(F.lit(2) + longer), ending))
    return F.when(kind == "given", given).otherwise(F.concat(built(F.lit(4) + longer), F.when(latin, "n").otherwise("н")))


def surrogate(kind: Column, of: Column, gender: Column, draw: Column, code: Column) -> Column:
    """The surrogate of an entity's normal form by the code of its draw; from
    the draw DRAWS on it has a character more with each, and an address of four
    parts becomes one of eight."""
    octets = [_byte(code, F.lit(i)) for i in range(4)]
    ip = F.concat_ws(".", (octets[0] % 99 + 11).cast("string"), *[(o % 254 + 1).cast("string") for o in octets[1:]])
    ip = F.when(draw < 2 * DRAWS, ip).otherwise(F.concat(F.lit("fd00"), *[F.concat(F.lit(":"), F.substring(code, 1 + 4 * i, 4)) for i in range(7)]))
    ip6 = F.array_join(F.transform(_chars(of), lambda c, i: F.when(c == ":", c).when(i == 0, _pick("abcdef", _byte(code, i))).otherwise(_pick("0123456789abcdef", _byte(code, i)))), "")
    # a short one becomes a whole one when draws run out
    ip6 = F.when(draw < 2 * DRAWS, ip6).otherwise(F.concat(F.lit("fd00"), *[F.concat(F.lit(":"), F.substring(code, 1 + 4 * i, 4)) for i in range(7)]))
    longer = F.greatest(draw - DRAWS, F.lit(0))
    stretched = lambda x: F.concat(x, F.repeat(F.substring(x, -1, 1), longer))
    local = like(stretched(F.regexp_extract(of, r"^([^@]*)@", 1)), code)
    domain = like(F.regexp_extract(of, r"@(.*)\.[^.]*$", 1), F.sha2(code, 512))
    email = F.concat(local, F.lit("@"), domain, F.lit("."), F.regexp_extract(of, r"\.([^.]*)$", 1))
    whole = stretched(of)
    digits = like(whole, code)
    phone = F.concat(F.substring(of, 1, 1), F.substring(digits, F.lit(2), F.length(whole)))
    body = F.substring(digits, F.lit(1), F.length(whole) - 1)
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    card = F.concat(body, check.cast("string"))
    account = F.substring(digits, F.lit(5), F.length(whole))
    iban = F.concat(F.substring(of, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(of, 1, 2), F.lit("00"), account))).cast("string"), 2, "0"), account)
    secret = F.when(of.startswith("AKIA"), F.concat(F.lit("AKIA"), like(F.substring(whole, F.lit(5), F.length(whole)), code))).otherwise(digits)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind.isin("given", "surname"), _word(kind, of, code, gender, draw)).when(kind == "phone", phone).when(kind == "ssn", digits).otherwise(secret)
    )


def dressed(kind: Column, entity: Column, plain: Column) -> Column:
    """A surrogate of the normal form in the entity's own format: separators at
    their places, and its capitals."""
    chars = _chars(entity)
    signs = F.transform(chars, lambda c: c.rlike(r"[\p{L}\p{N}]").cast("int"))
    placed = F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(plain, F.aggregate(F.slice(signs, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x), F.lit(1))).otherwise(c))
    signed = F.aggregate(signs, F.lit(0), lambda a, x: a + x)
    # what is longer than the entity comes after it
    placed = F.concat(F.array_join(placed, ""), F.substring(plain, signed + 1, F.greatest(F.length(plain) - signed, F.lit(0))))
    capital = F.transform(_chars(plain), lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    return F.when(kind.isin("phone", "ssn", "card", "iban"), placed).when(kind == "email", F.when(entity == F.lower(entity), plain).otherwise(F.array_join(capital, ""))).otherwise(plain)


def found_in(text: Column) -> Column:
    """Entities of a text in their order; none for null."""
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def genders_in(text: Column, entities: Column) -> Column:
    """For each entity its gender by the title before it, IS_SECRET if a label
    is before it, else empty; one more for what follows the last."""
    women = rf"\b(?:{'|'.join(TITLES_F)})\.? $"
    men = rf"\b(?:{'|'.join(TITLES_M)})\.? $"
    # a label may end the entity before
    before = F.zip_with(F.split(text, PATTERN, -1), F.concat(F.array(F.lit("")), entities), lambda p, e: F.struct(p.alias("p"), e.alias("e")))
    return F.transform(before, lambda x: F.when(x["p"].rlike(women), "f").when(x["p"].rlike(men), "m").when(x["p"].rlike(r"[=:]\z"), F.when(F.concat(x["e"], x["p"]).rlike(rf"{_LABEL}\z"), IS_SECRET).otherwise("")).otherwise(""))


def occurrences(docs: DataFrame) -> DataFrame:
    """Each text's hash h with each entity and gender in it once, written."""
    texts = docs.select(docs["text"].alias("text")).withColumn("e", found_in(F.col("text"))).filter(F.size("e") > 0)
    each = texts.select(F.xxhash64("text").alias("h"), F.explode(F.arrays_zip("e", F.slice(genders_in(F.col("text"), F.col("e")), F.lit(1), F.size("e")).alias("g"))).alias("x"))
    return written(each.select("h", F.col("x.e").alias("entity"), F.col("x.g").alias("g")).distinct(), "pii-occurrences")


def _words(name: Column) -> Column:
    """Words of a name as structs of place `at` (from 1), size, part and kind:
    the first of several is a given name."""
    words = F.split(name, " ")
    return F.transform(words, lambda w, i: F.struct(
        (F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1) + 1).alias("at"), F.length(w).alias("size"), w.alias("part"),
        F.when((i == 0) & (F.size(words) > 1), "given").otherwise("surname").alias("kind")))


def family(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other and from the real."""
    return F.when(kind.isin("given", "surname"), "word").otherwise(kind)


def surrogates(found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Replacements of distinct spellings, entity, g, new and the entities n
    that are in it, and words of names, entity, g, word and new, both written.

    Rounds draw surrogates for the normal forms, until none is another's or a
    real entity; of equal ones that of the smallest entity stays. Each round has
    more room than the last, so they end."""
    kind = F.when(F.col("g") == IS_SECRET, "secret").otherwise(kind_of(F.col("entity")))
    spellings = written(found.select("entity", "g").distinct().withColumn("kind", kind), "pii-spellings")
    # runs that are nothing as a whole, with the entities in them, and names with their words
    runs = spellings.filter("kind = 'number'").select("entity", "g", F.explode(parts_of(F.col("entity"))).alias("x"))
    runs = runs.select("entity", "g", "x.at", "x.size", "x.part", kind_of(F.col("x.part")).alias("kind"), F.lit("").alias("gender"))
    names = spellings.filter("kind = 'name'").select("entity", "g", F.explode(_words(F.col("entity"))).alias("x"))
    names = names.select("entity", "g", "x.at", "x.size", "x.part", "x.kind", F.when(F.col("x.kind") == "given", F.col("g")).otherwise("").alias("gender"))
    parts = written(runs.unionByName(names), "pii-parts")
    whole = spellings.filter("kind <> 'number' and kind <> 'name'").select("entity", "kind", F.lit("").alias("gender"))
    forms = whole.unionByName(parts.select(F.col("part").alias("entity"), "kind", "gender")).distinct()
    forms = written(forms.withColumn("of", normal(F.col("kind"), F.col("entity"))), "pii-forms")
    drawn = forms.select("kind", "of", "gender").distinct().withColumn("draw", F.lit(0))
    real = forms.select(family(F.col("kind")).alias("rkind"), F.col("of").alias("rof")).distinct()
    for _ in count():
        coded = written(drawn.withColumn("code", _code(F.col("kind"), F.col("of"), F.col("draw"), key)), "pii-codes")
        plain = coded.withColumn("plain", surrogate(F.col("kind"), F.col("of"), F.col("gender"), F.col("draw"), F.col("code"))).drop("code")
        plain = written(plain.withColumn("family", family(F.col("kind"))), "pii-plain")
        least = plain.groupBy(F.col("family").alias("lkind"), F.col("plain").alias("lplain")).agg(F.min(F.struct("draw", "of", "gender", "kind")).alias("least"))
        marked = plain.join(least, (F.col("family") == F.col("lkind")) & (F.col("plain") == F.col("lplain")))
        marked = marked.join(real, (F.col("family") == F.col("rkind")) & (normal(F.col("kind"), F.col("plain")) == F.col("rof")), "left")
        again = (F.struct("draw", "of", "gender", "kind") != F.col("least")) | F.col("rof").isNotNull()
        drawn = written(marked.select("kind", "of", "gender", (F.col("draw") + again.cast("int")).alias("draw"), again.alias("again"), "plain"), "pii-drawn")
        if not drawn.filter("again").head(1):
            break
        drawn = drawn.drop("again", "plain")
    final = drawn.select(F.col("kind").alias("fkind"), F.col("of").alias("fof"), F.col("gender").alias("fgender"), "plain")
    joined = forms.join(final, (F.col("kind") == F.col("fkind")) & (F.col("of") == F.col("fof")) & (F.col("gender") == F.col("fgender")))
    made = written(joined.select("entity", "kind", "gender", dressed(F.col("kind"), F.col("entity"), F.col("plain")).alias("new")), "pii-surrogates")
    news = made.select(F.col("entity").alias("mentity"), F.col("kind").alias("mkind"), F.col("gender").alias("mgender"), "new")
    plain = spellings.filter("kind <> 'number' and kind <> 'name'")
    plain = plain.join(news, (F.col("entity") == F.col("mentity")) & (F.col("kind") == F.col("mkind"))).select("entity", "g", "new", F.lit(1).alias("n"))
    each = parts.join(news, (F.col("part") == F.col("mentity")) & (F.col("kind") == F.col("mkind")) & (F.col("gender") == F.col("mgender")))
    each = written(each.select("entity", "g", "at", "size", "part", "kind", "new"), "pii-part-surrogates")
    listed = each.groupBy("entity", "g").agg(F.array_sort(F.collect_list(F.struct("at", "size", "new"))).alias("news"), F.first("kind").alias("kind"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    run = F.col("entity")
    put = F.aggregate("news", start, lambda a, x: F.struct(F.concat(a["out"], F.substring(run, a["at"], x["at"] - a["at"]), x["new"]).alias("out"), (x["at"] + x["size"]).alias("at")), lambda a: F.concat(a["out"], F.substring(run, a["at"], F.length(run))))
    n = F.when(F.col("kind").isin("given", "surname"), 1).otherwise(F.size("news"))
    table = written(plain.unionByName(listed.select("entity", "g", put.alias("new"), n.alias("n"))), "pii-replacements")
    return table, each.filter("kind in ('given', 'surname')").select("entity", "g", F.col("part").alias("word"), "new")


def mention(word: Column) -> Column:
    """The pattern of a word of a name that stands alone."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])\Q"), word, F.lit(r"\E(?!-?[\p{L}\p{N}])"))


def secret_key(spark: SparkSession) -> str:
    """The key of surrogates: the session's spark.tidemark.surrogateKey, else
    the environment's TIDEMARK_SURROGATE_KEY, else that of tests."""
    return spark.conf.get("spark.tidemark.surrogateKey", None) or os.environ.get("TIDEMARK_SURROGATE_KEY") or KEY


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the entities of text replaced, and n_entities added. The key
    is that of secret_key if none is given.

    A null text stays null with no entities; texts without entities stay byte
    for byte; repeated texts are replaced alike, wherever they are. An own
    column n_entities is replaced, others stay; an empty table gives no rows. A
    text meets the replacements of its own entities as one map, found by the
    text's hash; maps are broadcast if they are few, else only texts that may
    hold an entity are shuffled."""
    names = [c for c in docs.columns if c != "n_entities"]
    found = occurrences(docs)
    table, words = surrogates(found, key or secret_key(docs.sparkSession))
    spelled = written(table.select(F.col("entity").alias("sentity"), F.col("g").alias("sg"), "new", "n"), "pii-spelled")
    hit = found.join(small_or_not(spelled), (F.col("entity") == F.col("sentity")) & (F.col("g") == F.col("sg")))
    maps = hit.groupBy(F.col("h").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "entity", "g"), F.struct("new", "n")))).alias("_map"))
    # words of the names that a text holds, each once
    named = found.join(words.select(F.col("entity").alias("wentity"), F.col("g").alias("wg"), "word", "new"), (F.col("entity") == F.col("wentity")) & (F.col("g") == F.col("wg")))
    named = named.groupBy("h", "word").agg(F.min("new").alias("new")).groupBy(F.col("h").alias("_nh")).agg(F.array_sort(F.collect_list(F.struct("word", "new"))).alias("_names"))
    maps = written(maps.join(named, F.col("_h") == F.col("_nh"), "left").drop("_nh"), "pii-maps")
    # the row goes along as one value, so that no column of its own can clash
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("text"))
    text = F.col("text")

    def unpacked(df: DataFrame, new: Column, n: Column) -> DataFrame:
        made = df.select("row", new.alias("_new"), n.cast("long").alias("_n"))
        return made.select(*[(made["_new"] if c == "text" else made["row"].getField(c)).alias(c) for c in names], made["_n"].alias("n_entities"))

    plain = unpacked(rows.filter(~hinted(text)), text, F.lit(0))
    some = rows.filter(hinted(text)).join(small_or_not(maps), F.xxhash64("text") == F.col("_h"), "left")
    entities = F.when(F.col("_map").isNotNull(), found_in(text)).otherwise(F.array().cast("array<string>"))
    some = some.withColumn("_e", entities)
    pieces = F.split(text, PATTERN, -1)
    people = F.coalesce(F.col("_names"), F.array().cast("array<struct<word:string,new:string>>"))
    # what is between the entities, with the mentions of those named in the text
    told = F.when(F.size(people) > 0, F.transform(pieces, lambda p: F.aggregate(people, p, lambda a, w: F.regexp_replace(a, mention(w["word"]), w["new"])))).otherwise(pieces)
    genders = F.slice(genders_in(text, F.col("_e")), F.lit(1), F.size("_e")).alias("g")
    zipped = F.arrays_zip("_e", genders, F.slice(told, F.lit(2), F.size("_e")).alias("p"))
    swapped = F.transform(zipped, lambda x: F.concat(F.coalesce(F.col("_map")[F.concat_ws("\x1f", x["_e"], x["g"])]["new"], x["_e"]), x["p"]))
    new = F.when(F.size("_e") > 0, F.concat(told[0], F.array_join(swapped, ""))).otherwise(text)
    keys = F.transform(F.arrays_zip("_e", genders), lambda x: F.concat_ws("\x1f", x["_e"], x["g"]))
    mentions = F.aggregate(people, F.lit(0), lambda a, w: a + F.regexp_count(F.array_join(pieces, "\x1f"), mention(w["word"])))
    n = F.when(F.size("_e") > 0, mentions + F.aggregate(keys, F.lit(0), lambda a, k: a + F.coalesce(F.col("_map")[k]["n"], F.lit(0)))).otherwise(0)
    return plain.unionByName(unpacked(some, new, n))
