"""Scalar functions on text: normal forms, hashes, check digits, tax codes, locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import seeds

#: With (?U), Java's classes and boundaries follow Unicode as Python's do.
UNICODE = "(?U)"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, UNICODE + r"^\s+|\s+\z", "")


def token_key(text: Column) -> Column:
    """Two spans with this key in common are the same value."""
    return strip(F.lower(text))


def name_key(text: Column) -> Column:
    return F.regexp_replace(strip(F.lower(text)), UNICODE + r"\s+", " ")


def value_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def seed(value: Column, context: Column) -> Column:
    """The first 64 bits of sha256(value|context), unsigned."""
    return F.conv(F.substring(value_hash(F.concat(value, F.lit("|"), context)), 1, 16), 16, 10).cast("decimal(20,0)")


def locale_of(language: Column) -> Column:
    return F.coalesce(lookup(seeds.LOCALES, F.lower(language)), F.lit("en_US"))


def digit_sum_luhn(body: Column) -> Column:
    """The Luhn digit that follows a string of digits, doubling every second one from the left."""
    digits = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 % 10 + F.floor(c.cast("int") / 5)).cast("int")))
    return F.pmod(10 - F.aggregate(digits, F.lit(0), lambda s, d: s + d) % 10, F.lit(10)).cast("string")


def salary_amount(text: Column) -> Column:
    """An amount written with dots between thousands and a decimal comma."""
    digits = F.regexp_replace(text, "[^0-9.,]", "")
    return F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def shifted_date(text: Column, days: Column) -> Column:
    """A date in one of four layouts some days later in the same layout; other text stays."""
    plain = strip(text)
    result = text
    for layout in ("dd.MM.yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy"):
        lenient = layout.replace("dd", "d").replace("MM", "M")
        day = F.try_to_date(plain, lenient)
        result = F.when(day.isNotNull(), F.date_format(F.date_add(day, days.cast("int")), layout)).otherwise(result)
    return result


def _letters(name: Column, vowels: bool) -> Column:
    return F.regexp_replace(F.upper(name), r"(?U)[^\p{L}]" + ("|[^AEIOU]" if vowels else "|[AEIOU]"), "")


def _code(name: Column) -> Column:
    return F.substring(F.concat(_letters(name, False), _letters(name, True), F.lit("XXX")), 1, 3)


def check_letter(partial: Column) -> Column:
    """The control letter of the first fifteen characters of a tax code; letters at even places count from 10."""
    even = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    chars = F.filter(F.split(partial, ""), lambda c: c != "")
    values = F.transform(chars, lambda c, i: F.coalesce(F.when(i % 2 == 0, lookup(seeds.ODD_VALUES, c)).otherwise(lookup(even, c)), F.lit(0)))
    return F.char(F.aggregate(values, F.lit(0), lambda s, v: s + v) % 26 + 65)


def tax_code(last: Column, first: Column, birth: Column, gender: Column, city: Column) -> Column:
    consonants = _letters(first, False)
    given = F.when(F.length(consonants) >= 4, F.concat(F.substring(consonants, 1, 1), F.substring(consonants, 3, 2))).otherwise(_code(first))
    day = F.dayofmonth(birth) + F.when(F.upper(gender) == "F", 40).otherwise(0)
    partial = F.concat(
        _code(last),
        given,
        F.lpad((F.year(birth) % 100).cast("string"), 2, "0"),
        F.substr(F.lit(seeds.MONTHS), F.month(birth), F.lit(1)),
        F.lpad(day.cast("string"), 2, "0"),
        F.coalesce(lookup(seeds.CITY_CODES, city), F.lit("H501")),
    )
    return F.concat(partial, check_letter(partial))


def decoded_tax_code(code: Column) -> Column:
    """year2, month, day, gender, belfiore of a code; null if it hasn't 16 characters or its day is no number."""
    code = F.upper(strip(code))
    day = F.substring(code, 10, 2).try_cast("int")
    months = {c: i for i, c in enumerate(seeds.MONTHS, 1)}
    return F.when(
        (F.length(code) == 16) & day.isNotNull(),
        F.struct(
            F.substring(code, 7, 2).alias("year2"),
            F.coalesce(lookup(months, F.substring(code, 9, 1)), F.lit(1)).alias("month"),
            F.when(day > 40, day - 40).otherwise(day).alias("day"),
            F.when(day > 40, "F").otherwise("M").alias("gender"),
            F.substring(code, 12, 4).alias("belfiore"),
        ),
    )
