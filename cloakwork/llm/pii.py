"""Format-preserving pseudonyms for numbers, dates and other formatted values, by keyed Feistel networks.

A value that passes its format's check is permuted within the values of that format: an alternating
Feistel network adds to one half of it a keyed hash of the other half, modulo the number of values that half can
take. The same key maps equal values to equal pseudonyms in every document, and different values of a format to
different ones. Everything is an expression over one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Symbols permuted together; a longer run is cut into pieces of so many.
PIECE = 16
#: Digits of a card number.
LEAST_CARD, MOST_CARD = 13, 19
#: The session setting that holds the key; list it in spark.redaction.regex where plans are logged.
KEY_SETTING = "spark.cloakwork.pseudonym.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
PREFIXED_KEY = r"(?<![A-Za-z0-9])(?:sk|pk|rk|gh[pousr])[-_][A-Za-z0-9_]{20,}"
ASSIGNED = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_?key|apikey|auth)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{6,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"(?<![\d+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}"
    r"|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}"
    r"|\+[2-9]\d{0,2}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3})(?!\d)"
)
#: A run of groups of digits, in which ``pieces`` looks for cards; it ends where a date, an SSN or a telephone number begins.
CARD = rf"(?<![\d.-])\d(?:(?:-| (?!{DATE}|{SSN}|{PHONE}))?\d){{12,198}}(?![\d]|[.-]\d)"

#: In this order, the first that matches at a place takes it.
FORMATS = {"email": EMAIL, "access_key": ACCESS_KEY, "prefixed_key": PREFIXED_KEY, "assigned": ASSIGNED, "iban": IBAN, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())


def _hash(key: Column, tweak: Column, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, values_a: Column, values_b: Column, key: Column, tweak: Column) -> Column:
    """A keyed permutation of the pairs (a, b) with a in [0, values_a) and b in [0, values_b)."""

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["a"] + F.pmod(_hash(key, tweak, i, s["b"]), values_a), values_a).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_hash(key, tweak, i, s["a"]), values_b), values_b).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def permute(symbols: Column, radix: int, key: Column, kind: str) -> Column:
    """A keyed permutation of the strings of the same length over the first ``radix`` of 0-9a-z."""

    def piece(k: Column) -> Column:
        part = F.substr(symbols, k * PIECE + 1, F.lit(PIECE))
        size = F.length(part)
        half = F.floor(size / 2).cast("int")
        rest = size - half
        number = lambda s: F.coalesce(F.conv(s, radix, 10).cast("long"), F.lit(0))
        values = lambda n: F.pow(F.lit(float(radix)), n).cast("long")
        tweak = F.concat_ws("/", F.lit(kind), k.cast("string"), F.length(symbols).cast("string"))
        pair = feistel(number(F.substr(part, F.lit(1), half)), number(F.substr(part, half + 1, rest)), values(half), values(rest), key, tweak)
        text = lambda n, width: F.when(width == 0, "").otherwise(F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), width, "0"))
        both = F.transform(F.array(pair), lambda p: F.concat(text(p["a"], half), text(p["b"], rest)))
        return both[0]

    pieces = F.sequence(F.lit(0), F.ceil(F.length(symbols) / PIECE).cast("int") - 1)
    return F.when(F.length(symbols) == 0, "").otherwise(F.array_join(F.transform(pieces, piece), ""))


def put_back(value: Column, symbols: Column, kept: str) -> Column:
    """``value`` with its characters of the class ``kept`` replaced, in order, by ``symbols``."""
    place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{kept}]", "")) + 1
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substr(symbols, place(i), F.lit(1))).otherwise(c)), "")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def only(value: Column, kept: str) -> Column:
    return F.regexp_replace(value, f"[^{kept}]", "")


def digits(value: Column, key: Column, kind: str) -> Column:
    """All digits permuted together, everything else in its place."""
    return _once(permute(only(value, "0-9"), 10, key, kind), lambda new: put_back(value, new, "0-9"))


LOWER, UPPER, LETTER_DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnop"


def letters_and_digits(value: Column, key: Column, kind: str) -> Column:
    """Digits, small letters and capitals, each permuted among their like; everything else in its place."""
    def among(alphabet: str, kept: str):
        def new(v: Column) -> Column:
            numbered = F.translate(only(v, kept), alphabet, LETTER_DIGITS)
            return put_back(v, F.translate(permute(numbered, 26, key, kind + kept), LETTER_DIGITS, alphabet), kept)

        return new

    return _once(_once(digits(value, key, kind), among(LOWER, "a-z")), among(UPPER, "A-Z"))


def secret(value: Column, key: Column) -> Column:
    """A run of hexadecimal digits stays one; any other secret keeps its kinds of characters."""
    return F.when(value.rlike("^[0-9a-f]{8,}$"), permute(value, 16, key, "hex")).otherwise(letters_and_digits(value, key, "secret"))


def luhn(number: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10; 0 for a valid number."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda s, x: (s + x) % 10)


def card(value: Column, key: Column) -> Column:
    """First digit and Luhn check stay, the digits between are permuted; a number that fails the check stays."""

    def new(number: Column) -> Column:
        body = F.concat(F.substr(number, F.lit(1), F.lit(1)), permute(F.substr(number, F.lit(2), F.length(number) - 2), 10, key, "card"))
        return _once(body, lambda b: F.concat(b, F.pmod(luhn(number) - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    number = only(value, "0-9")
    return F.when((F.length(number) >= LEAST_CARD) & (luhn(number) == 0), _once(_once(number, new), lambda n: put_back(value, n, "0-9"))).otherwise(value)


def pieces(run: Column) -> Column:
    """The groups of a run of digits, those of a card as one: from the left, each time as many groups as pass Luhn."""
    groups = F.split(run, "(?=[ -])")

    def cut(g: Column) -> Column:
        part = lambda i, e: F.array_join(F.slice(g, i, e - i + 1), "")

        def valid(i: Column, e: Column) -> Column:
            number = only(part(i, e), "0-9")
            return F.when(F.length(number).between(LEAST_CARD, MOST_CARD), luhn(number) == 0).otherwise(False)

        def step(s: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(F.least(F.size(g), i + MOST_CARD - 1), i, F.lit(-1)), lambda e: valid(i, e))
            add = lambda e: F.struct(F.concat(s["pieces"], F.array(part(i, e))).alias("pieces"), (e + 1).alias("next"))
            return F.when(i < s["next"], s).otherwise(_once(F.coalesce(F.get(ends, F.lit(0)), i), add))

        start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(g)), start, step)["pieces"]

    return _once(groups, cut)


def mod97(text: Column) -> Column:
    """The remainder by 97 of an IBAN whose first four characters are at its end."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def iban(value: Column, key: Column) -> Column:
    """The country stays, the account's digits are permuted, the check digits are made anew."""

    def new(whole: Column) -> Column:
        country = F.substr(whole, F.lit(1), F.lit(2))
        account = digits(F.substr(whole, F.lit(5), F.length(whole)), key, "iban")
        return _once(account, lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))

    whole = F.replace(value, F.lit(" "), F.lit(""))
    valid = mod97(F.concat(F.substr(whole, F.lit(5), F.length(whole)), F.substr(whole, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, _once(_once(whole, new), lambda n: put_back(value, n, "A-Z0-9"))).otherwise(value)


def ipv4(value: Column, key: Column) -> Column:
    """The address as two halves of 16 bits."""
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))

    def new(p: Column) -> Column:
        pair = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
        return F.when(F.exists(p, lambda x: x > 255), value).otherwise(_once(pair, lambda q: F.concat_ws(".", half(q["a"]), half(q["b"]))))

    return _once(part, new)


def date(value: Column, key: Column) -> Column:
    """The day is permuted within its century, and written the same way.

    A century has 36524 = 92 * 397 days, or 36525 = 75 * 487 if it begins with a leap year. A date with
    marks is read as day, month, year, or else as month, day, year.
    """
    iso = value.rlike("^[0-9]{4}")
    mark = F.regexp_extract(value, "[./-]", 0)
    plain = F.regexp_replace(value, "[./]", "-")
    by_day, by_month = F.try_to_date(plain, "d-M-yyyy"), F.try_to_date(plain, "M-d-yyyy")
    parsed = F.when(iso, F.try_to_date(plain, "yyyy-MM-dd")).otherwise(F.coalesce(by_day, by_month))

    def new(day: Column) -> Column:
        start = F.make_date((F.floor(F.year(day) / 100) * 100).cast("int"), F.lit(1), F.lit(1))
        long = F.year(start) % 400 == 0
        minor = F.when(long, 487).otherwise(397).cast("long")
        at = F.datediff(day, start).cast("long")
        pair = feistel(F.floor(at / minor), F.pmod(at, minor), F.when(long, 75).otherwise(92).cast("long"), minor, key, F.concat(F.lit("date"), F.year(start).cast("string")))
        then = F.date_add(start, _once(pair, lambda p: p["a"] * minor + p["b"]).cast("int"))
        padded = value.rlike("^[0-9]{2}[./-][0-9]{2}[./-]")
        first = F.when(by_day.isNotNull(), F.when(padded, F.date_format(then, "dd-MM-yyyy")).otherwise(F.date_format(then, "d-M-yyyy")))
        marked = F.coalesce(first, F.when(padded, F.date_format(then, "MM-dd-yyyy")).otherwise(F.date_format(then, "M-d-yyyy")))
        return F.when(iso, F.date_format(then, "yyyy-MM-dd")).otherwise(F.replace(marked, F.lit("-"), mark))

    return F.coalesce(_once(parsed, lambda d: F.when(d.isNull() | (F.year(d) < 1000), F.lit(None).cast("string")).otherwise(new(d))), value)


def phone(value: Column, key: Column) -> Column:
    """The country code stays; eight to fifteen digits make a number."""
    code = F.regexp_extract(value, r"^\+\d{1,3}[ .-]", 0)
    code = F.when((code == "") & value.startswith("+"), F.substr(value, F.lit(1), F.lit(3))).otherwise(code)
    size = F.length(only(value, "0-9"))
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    return F.when((size >= 8) & (size <= 15), F.concat(code, digits(rest, key, "phone"))).otherwise(value)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one found value; a value that fails its format's check stays."""
    whole = lambda name: value.rlike(f"^(?:{FORMATS[name]})$")
    at = F.instr(value, "@")
    named = F.regexp_extract(value, r"^(.*?[=:]\s*[\"']?)(.*)$", 1)
    return (
        F.when(at > 0, F.concat(letters_and_digits(F.substr(value, F.lit(1), at - 1), key, "email"), F.substr(value, at, F.length(value))))
        .when(whole("access_key"), F.concat(F.substr(value, F.lit(1), F.lit(4)), letters_and_digits(F.substr(value, F.lit(5), F.length(value)), key, "access")))
        .when(whole("prefixed_key"), F.concat(F.substr(value, F.lit(1), F.lit(3)), letters_and_digits(F.substr(value, F.lit(4), F.length(value)), key, "prefixed")))
        .when(whole("assigned"), F.concat(named, secret(F.substr(value, F.length(named) + 1, F.length(value)), key)))
        .when(whole("iban"), iban(value, key))
        .when(whole("ipv4"), ipv4(value, key))
        .when(whole("date"), date(value, key))
        .when(whole("ssn"), digits(value, key, "ssn"))
        .when(whole("phone"), phone(value, key))
        .otherwise(card(value, key))
    )


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_values (how many values were replaced).

    Found are mail addresses (the part before the @), access keys, assigned secrets, IBANs with a valid
    check, IPv4 addresses, calendar dates, social security numbers, telephone numbers and card numbers
    (valid by Luhn). All other text stays as it is. A null text stays null with
    0 values. Repeated rows appear as often as they come in; other columns are ignored; an empty table gives
    no rows. ``key`` defaults to the session setting spark.cloakwork.pseudonym.key.
    """
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING}: pseudonyms without a secret key can be undone by anyone")
    key = F.lit(key)
    found = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(ANY), 0).alias("found"))
    parts = F.transform("found", lambda v: F.when(v.rlike(f"^(?:{CARD})$"), pieces(v)).otherwise(F.array(v)))
    new = F.transform(parts, lambda p: F.transform(p, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new"))))
    replaced = found.select("doc_id", "text", "found", F.when(F.size("found") > 0, new).alias("new"))
    gaps = F.split("text", ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, "new", lambda gap, v: F.concat(gap, F.coalesce(F.array_join(v["new"], ""), F.lit("")))), "")
    changed = F.size(F.filter(F.flatten("new"), lambda v: v["old"] != v["new"]))
    return replaced.select("doc_id", F.when(F.size("found") > 0, rebuilt).otherwise(F.col("text")).alias("text"), F.when(F.size("found") > 0, changed).otherwise(0).cast("long").alias("n_values"))
