"""Fake values that stay the same for a value within a context.

Strategies whose values come from a seeded generator need Python's own generator to give the same values; they run in one
Arrow function, over distinct values only. Names, towns and the like come from small tables by hash.
"""

from __future__ import annotations

import calendar
import hashlib
import random
import string
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import bound
from ..functions.text import digit_sum_luhn, decoded_tax_code, locale_of, lookup, name_key, salary_amount, seed, shifted_date, strip, tax_code, token_key, value_hash
from ..sources import seeds
from ..sources.locales import LOCALES

FIRST_NAMES = {"M": LOCALES["it_IT"].men.split(), "F": LOCALES["it_IT"].women.split()}
LAST_NAMES = LOCALES["it_IT"].last.split()
COMPANIES = "Aurora Meridiana Solaria Boreale Lumina Verdemare Altavista Pontelungo".split()
CAPITALS, MIXED = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits

#: Strategies that draw so many characters from an alphabet; a part is (alphabet, number).
DRAWN = {
    "targa": [(string.ascii_uppercase, 2), (string.digits, 3), (string.ascii_uppercase, 2)],
    "pnr": [(CAPITALS, 6)],
    "driver_license": [(CAPITALS, 10)],
    "practice_id": [(CAPITALS, 8)],
    "ticket_id": [(CAPITALS, 8)],
    "policy_number": [(CAPITALS, 10)],
    "loyalty_id": [(CAPITALS, 10)],
}
PLAIN = ("àáâäăãçčďéèêëěíìîïňñóòôöőõřșşšťțúùûüůűýżźžłąęśćńß", "aaaaaaccdeeeeeiiiinnoooooorsssttuuuuuuyzzzlaescns")
COUNTRIES = "IT DE FR ES NL BE AT GB PL PT".split()


def generator(value: str, context: str) -> random.Random:
    return random.Random(int(hashlib.sha256(f"{value}|{context}".encode()).hexdigest()[:16], 16))


def drawn(strategy: str, value: str, context: str, locale: str) -> str:
    """What the seeded strategies draw for a value; an unknown strategy gives capitals and digits."""
    rng = generator(value, context)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    if strategy in DRAWN:
        return "".join(pick(alphabet, n) for alphabet, n in DRAWN[strategy])
    if strategy == "api_key":
        return pick(MIXED, len(value) if 16 <= len(value) <= 64 else 32)
    if strategy == "imei":
        return number(14)
    if strategy == "bic":
        bank = pick(string.ascii_uppercase, 4)
        return bank + rng.choice(COUNTRIES) + pick(CAPITALS, 2) + pick(CAPITALS, 3)
    if strategy == "passport":
        return (locale.split("_")[-1] if "_" in locale else "XX") + number(7)
    if strategy == "identity_card":
        letters = pick(string.ascii_uppercase, 2)
        return letters + number(7) + pick(string.ascii_uppercase, 1)
    if strategy == "health_card":
        return pick(string.ascii_uppercase, 2) + number(13)
    if strategy == "date_shift":
        return str(rng.randint(30, 365))
    if strategy == "salary":
        state = rng.getstate()
        factor = rng.uniform(0.7, 1.3)
        rng.setstate(state)
        return f"{factor!r} {rng.randint(25_000, 80_000)}"
    if strategy == "company":
        return rng.choice(seeds.COMPANY_FORMS.get(locale, seeds.COMPANY_FORMS["en_US"]))
    if strategy == "profile":
        year = rng.randint(1950, 2000)
        month = rng.randint(1, 12)
        day = rng.randint(1, calendar.monthrange(year, month)[1])
        return f"{date(year, month, day)} {rng.choice(list(seeds.CITY_CODES))}"
    return pick(CAPITALS, max(len(value), 8))


def _draw_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([None if row[1] is None else drawn(row[0] or "", row[1], row[2] or "", row[3] or "") for row in zip(*columns)], dtype=object)


def draw(strategy: Column, value: Column, context: Column, locale: Column) -> Column:
    return F.pandas_udf(_draw_batches, "string")(strategy, value, context, locale)


def hashed_number(key: Column, salt: str, digits: int = 8) -> Column:
    """A number from the first hexadecimal digits of a SHA-256."""
    return F.conv(F.substring(value_hash(F.concat(key, F.lit("|" + salt))), 1, digits), 16, 10).cast("long")


def hashed_choice(values: list[str] | Column, key: Column, salt: str) -> Column:
    """One of a list of values, or of an array column."""
    found = F.array(*map(F.lit, values)) if isinstance(values, list) else values
    return F.element_at(found, (hashed_number(key, salt) % F.size(found) + 1).cast("int"))


def hashed_digits(key: Column, salt: str, n: int) -> Column:
    return F.lpad((hashed_number(key, salt, 15) % 10**n).cast("string"), n, "0")


def filled(form: Column, key: Column, salt: str) -> Column:
    """A form with a digit for each ``#`` and a capital letter for each ``?``: the character at place i is chosen by byte
    i % 32 of a SHA-256."""
    byte = lambda h, i: F.conv(F.substr(h, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
    one = lambda h, c, i: F.when(c == "#", (byte(h, i) % 10).cast("string")).when(c == "?", F.char(byte(h, i) % 26 + 65)).otherwise(c)
    fill = lambda h: F.array_join(F.transform(F.split(form, ""), lambda c, i: one(h, c, i)), "")
    return bound(value_hash(F.concat(key, F.lit("|" + salt))), fill)


def of_locale(field: str, locale: Column) -> Column:
    """A list of a locale's table, or a form; a locale without a table has that of en_US."""
    lists = {"first_names": lambda x: x.first_names, "last": lambda x: x.last.split(), "towns": lambda x: x.towns.split(","), "streets": lambda x: x.streets.split(","), "phones": lambda x: list(x.phones)}
    value = lambda x: F.array(*map(F.lit, lists[field](x))) if field in lists else F.lit(getattr(x, field))
    table = F.create_map(*[c for name, x in LOCALES.items() for c in (F.lit(name), value(x))])
    return F.coalesce(F.try_element_at(table, locale), value(LOCALES["en_US"]))


def mod97(text: Column) -> Column:
    """The remainder by 97 of a text in which letters stand for 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def iban_of(key: Column, locale: Column) -> Column:
    """An account number in the form of the locale's country, with its check digits."""
    country = of_locale("country", locale)
    numbered = lambda account: F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    return bound(filled(of_locale("account", locale), key, "account"), numbered)


def address_of(key: Column, locale: Column, town: Column) -> Column:
    form = filled(of_locale("address", locale), key, "address")
    parts = {"{street}": hashed_choice(of_locale("streets", locale), key, "street"), "{number}": hashed_octet(key, "number").cast("string"), "{town}": town}
    for name, value in parts.items():
        form = F.replace(form, F.lit(name), value)
    return form


def hashed_octet(key: Column, salt: str) -> Column:
    return (hashed_number(key, salt) % 254 + 1).cast("int")


def generate(strategy: Column, value: Column, context: Column, locale: Column) -> Column:
    """The fake value of each strategy; an unknown or null strategy gives capitals and digits."""
    key = F.concat_ws("|", value, context, locale)
    strategy = F.coalesce(strategy, F.lit("alphanumeric"))
    seeded = draw(strategy, value, context, locale)
    first, last = hashed_choice(of_locale("first_names", locale), key, "first"), hashed_choice(of_locale("last", locale), key, "last")
    # A user name is written in plain letters.
    user = F.concat(F.regexp_replace(F.translate(F.lower(F.concat(F.substring(first, 1, 1), F.lit("."), last)), *PLAIN), "[^a-z.]", ""), hashed_digits(key, "user", 2))
    town = hashed_choice(of_locale("towns", locale), key, "town")
    company = F.concat(hashed_choice(COMPANIES, key, "company"), F.lit(" "), last)
    card = F.concat(F.lit("4"), hashed_digits(key, "card", 14))
    luhn_card = F.concat(card, digit_sum_luhn(F.concat(F.lit("0"), card)))
    factor, fallback = F.element_at(F.split(seeded, " "), 1).try_cast("double"), F.try_element_at(F.split(seeded, " "), F.lit(2))
    amount = F.bround(salary_amount(value) * factor / 1000, 0) * 1000
    salary = F.coalesce(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")), fallback)
    cases = {
        "person": F.concat(first, F.lit(" "), last),
        "email": F.when(F.contains(value, F.lit("@")), F.concat(user, F.lit("@"), F.substr(value, F.instr(value, "@") + 1, F.length(value)))).otherwise(F.concat(user, F.lit("@example.com"))),
        "phone": filled(hashed_choice(of_locale("phones", locale), key, "phone"), key, "line"),
        "address": address_of(key, locale, town),
        "city": town,
        "username": user,
        "iban": iban_of(key, locale),
        "credit_card": luhn_card,
        "salary": salary,
        "date_shift": shifted_date(value, seeded.try_cast("int")),
        "ip": F.concat_ws(".", F.lit("10"), *[hashed_octet(key, f"ip{i}").cast("string") for i in range(3)]),
        "mac": F.array_join(F.array(*[F.substring(value_hash(F.concat(key, F.lit("|mac"))), 2 * i + 1, 2) for i in range(6)]), ":"),
        "url": F.concat(F.lit("https://www."), F.lower(company).substr(1, 6), F.lit(".example.com/")),
        "gps": F.concat(hashed_digits(key, "lat", 1), F.lit("."), hashed_digits(key, "lat6", 6), F.lit(", "), hashed_digits(key, "lon", 2), F.lit("."), hashed_digits(key, "lon6", 6)),
        "password": F.substr(F.concat(F.lit("aA1!"), F.repeat(value_hash(key), 8)), F.lit(1), F.greatest(F.length(value), F.lit(12))),
        "imei": F.concat(seeded, digit_sum_luhn(seeded)),
        "organization": company,
        "company": F.concat(company, F.lit(" "), seeded),
    }
    result = None
    for name, made in cases.items():
        result = F.when(strategy == name, made) if result is None else result.when(strategy == name, made)
    return result.otherwise(seeded)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join to which a null key is a value like any other; the keys of ``right`` go."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition &= left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])


PERSONA = ["fake_first_name", "fake_last_name", "fake_birth_date", "fake_gender", "fake_city", "fake_belfiore", "fake_cf"]


def profiles(people: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(context_id, profile_key, gender) rows with a coherent invented person each, or with the one that ``stored``
    (context_id, real_hash and the PERSONA columns) has for them."""
    key = F.concat_ws("|", "profile_key", "context_id")
    made = people.withColumn("_drawn", draw(F.lit("profile"), F.col("profile_key"), F.col("context_id"), F.lit("it_IT")))
    male = hashed_choice(FIRST_NAMES["M"], key, "first")
    made = made.select(
        "context_id",
        "profile_key",
        value_hash(F.col("profile_key")).alias("real_hash"),
        F.when(F.col("gender") == "F", hashed_choice(FIRST_NAMES["F"], key, "first")).otherwise(male).alias("fake_first_name"),
        hashed_choice(LAST_NAMES, key, "last").alias("fake_last_name"),
        F.substring("_drawn", 1, 10).cast("date").alias("fake_birth_date"),
        F.col("gender").alias("fake_gender"),
        F.expr("substring(_drawn, 12)").alias("fake_city"),
    )
    made = made.withColumn("fake_belfiore", lookup(seeds.CITY_CODES, F.col("fake_city"))).withColumn(
        "fake_cf", tax_code(F.col("fake_last_name"), F.col("fake_first_name"), F.col("fake_birth_date"), F.col("fake_gender"), F.col("fake_city"))
    )
    if stored is None:
        return made
    old = stored.select("context_id", "real_hash", F.struct(*PERSONA).alias("_old"))
    whole = joined(made, old, ["context_id", "real_hash"], "left")
    chosen = {c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in PERSONA}
    return whole.withColumns(chosen).select(made.columns)


def people_of(values: DataFrame) -> DataFrame:
    """The persons and tax codes among (context_id, pii_type, text, …) rows, with the profile each takes its value from."""
    person = F.col("pii_type") == "PERSON"
    return values.where(F.col("pii_type").isin("PERSON", "FISCAL_CODE")).withColumns(
        {
            "profile_key": F.when(person, name_key(F.col("text"))).otherwise(strip(F.upper(F.col("text")))),
            "gender": F.when(person, F.lit("M")).otherwise(F.coalesce(decoded_tax_code(F.col("text"))["gender"], F.lit("M"))),
        }
    )


def profiles_of(values: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The profiles that the persons and tax codes among some values take their surrogates from."""
    return profiles(people_of(values).groupBy("context_id", "profile_key").agg(F.min("gender").alias("gender")), stored)


def surrogates(values: DataFrame, registry: DataFrame, cached: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(context_id, pii_type, text, language) rows, distinct by all but language, with real_hash and fake_value.

    Persons and tax codes take their value from a profile, ``stored`` or new; other types from the strategy in the registry, or from
    ``cached`` (context_id, pii_type, real_hash, fake_value) where it has one.
    """
    rows = values.join(registry.select(F.col("code").alias("pii_type"), F.col("faker_strategy").alias("strategy")), "pii_type", "left")
    rows = rows.withColumn("real_hash", value_hash(F.col("text")))
    profiled = F.col("pii_type").isin("PERSON", "FISCAL_CODE")
    person = F.col("pii_type") == "PERSON"
    people, made = people_of(rows), profiles_of(rows, stored)
    whole = joined(people, made.select("context_id", "profile_key", "fake_first_name", "fake_last_name", "fake_cf"), ["context_id", "profile_key"])
    whole = whole.withColumn("fake_value", F.when(person, F.concat_ws(" ", "fake_first_name", "fake_last_name")).otherwise(F.col("fake_cf")))
    simple = rows.where(~profiled).withColumn("fake_value", generate(F.col("strategy"), F.col("text"), F.col("context_id"), locale_of(F.coalesce("language", F.lit("it")))))
    columns = ["context_id", "pii_type", "text", "real_hash", "fake_value"]
    found = whole.select(columns).unionByName(simple.select(columns))
    if cached is not None:
        old = cached.select("context_id", "pii_type", "real_hash", F.col("fake_value").alias("_old"))
        found = joined(found, old, ["context_id", "pii_type", "real_hash"], "left").withColumn("fake_value", F.when(F.col("pii_type").isin("PERSON", "FISCAL_CODE"), F.col("fake_value")).otherwise(F.coalesce("_old", "fake_value"))).select(columns)
    return found


def first_forms(entities: DataFrame, row: str = "doc_id") -> DataFrame:
    """Of (row, context_id, language, pii_type, text, start) rows, the first span of each value of a ``row``."""
    first = Window.partitionBy(row, "key").orderBy("start")
    return entities.withColumn("key", token_key(F.col("text"))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
