"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Method: a value is found by its form and validated (check digits, ranges, calendar). Its digits or
letters are then permuted inside the set of valid values of the same form by a keyed Feistel
network: numbers as pairs of residues (left + F(right) mod a, right + F(left) mod b), strings as
halves whose characters are shifted inside their own class. Each is a bijection, so equal values get
equal pseudonyms in all documents, different values of one form different ones, and check digits,
octets and calendar days stay valid. What fails validation is left as it is.

Main path: split() and regexp_extract_all() by one pattern, transform() over the found values,
array_join() of both; no Python on the executors.

Defined cases: a null text gives a null text and zero counts, an empty one stays empty; repeated
rows each give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.common import only

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Forms, in the order in which they are tried at a place.
FORMS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
_EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-]){FORMS['email']}"
_REST = "|".join(p for k, p in FORMS.items() if k != "email")
PATTERN = rf"{_EMAIL}|(?<![\p{{L}}\p{{N}}_])(?<![0-9][.-])(?:{_REST})(?![\p{{L}}\p{{N}}_])"


def _digest(key: str | Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, a: int | Column, b: int | Column, key: str | Column) -> Column:
    """Permutes 0 .. a * b - 1."""
    a, b = (x.cast("bigint") if isinstance(x, Column) else F.lit(x) for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _number(_digest(key, i, F.lit("l"), s["r"])), a).cast("bigint")
        return F.struct(left.alias("l"), F.pmod(s["r"] + _number(_digest(key, i, F.lit("r"), left)), b).cast("bigint").alias("r"))

    start = F.struct(((value - F.pmod(value, b)) / b).cast("bigint").alias("l"), F.pmod(value, b).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shift(text: Column, digest: Callable[[Column], Column]) -> Column:
    """Each letter or digit moves inside its class by a byte of a digest; everything else stays."""

    def one(c: Column, i: Column) -> Column:
        block = digest(F.floor(i / 32))
        by = F.conv(F.substr(block, F.lit(2) * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")
        move = lambda letters: F.substr(F.lit(letters), F.pmod(F.instr(F.lit(letters), c) - 1 + by, F.lit(len(letters))) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), move(_DIGITS)).when(c.rlike("^[a-z]$"), move(_LOWER)).when(c.rlike("^[A-Z]$"), move(_UPPER)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(F.lit(""))


def shuffle_string(text: Column, key: str) -> Column:
    """Permutes the strings of one shape; a string of one character moves by a keyed constant."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = _shift(s["l"], lambda block: _digest(key, i, F.lit("l"), block, s["r"]))
        return F.struct(left.alias("l"), _shift(s["r"], lambda block: _digest(key, i, F.lit("r"), block, left)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits with every second one doubled; doubled tells whether the last one is."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1 - doubled, F.floor(c.cast("int") * 2 / 10) + F.pmod(c.cast("int") * 2, F.lit(10))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of shape, one after another, replaced by those given; separators stay."""
    before = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, before(i), F.lit(1))).otherwise(c)), "")


def _mod97(text: Column) -> Column:
    """A number of any length, letters as 10 to 35, modulo 97."""

    def turn(s: Column, c: Column) -> Column:
        d = F.when(c.rlike("^[0-9]$"), c.cast("bigint")).otherwise(F.ascii(c) - 55)
        return F.pmod(s * F.when(d > 9, 100).otherwise(10) + d, F.lit(97)).cast("bigint")

    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), turn)


def _email(v: Column, key: str) -> Column:
    local = F.regexp_extract(v, r"^([^@]*)@", 1)
    return F.concat(shuffle_string(local, key + "/email"), F.substr(v, F.length(local) + 1, F.length(v)))


def _iban(v: Column, key: str) -> tuple[Column, Column]:
    bare = F.regexp_replace(v, " ", "")
    n = F.length(bare)
    valid = _mod97(F.concat(F.substr(bare, F.lit(5), n), F.substr(bare, F.lit(1), F.lit(4)))) == 1
    account = shuffle_string(F.substr(bare, F.lit(5), n), key + "/iban")
    country = F.substr(bare, F.lit(1), F.lit(2))
    made = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    spaced = F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(made, i + 1 - F.length(F.regexp_replace(F.substr(v, F.lit(1), i), "[^ ]", "")), F.lit(1)))), "")
    return valid & n.between(15, 34), spaced


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda c: c.cast("bigint"))
    new = feistel(o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3], 65536, 65536, key + "/ip")
    return F.concat_ws(".", *[F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _leaps(y: Column) -> Column:
    """Leap years up to a year."""
    return F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)


def _leap_year(rank: Column) -> Column:
    """The leap year of a rank, from 1; a cycle of 400 years has 97."""
    k = F.pmod(rank - 1, F.lit(97))
    return F.floor((rank - 1) / 97) * 400 + 4 * (k + 1 + F.when(k < 24, 0).when(k < 48, 1).when(k < 72, 2).otherwise(3))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


_LONGEST = (1, 3, 5, 7, 8, 10, 12)  # months of 31 days
_BEFORE, _INSIDE, _EVERY = 387, 194, 2424  # leap years before 1600, from then to 2399, and to 9999


def _date(v: Column, key: str) -> tuple[Column, Column]:
    """Year first; else day before month where that is a day of the calendar, month before day where only this is one.

    A date moves inside a set that has all its combinations: dates of its form, widths of day and month, and
    reading; of days that all months, only some or only leap years have; and of years from 1600 to 2399 or any others.
    """
    longest = F.array(*[F.lit(m) for m in _LONGEST])

    def read(s: Column) -> Column:
        n = lambda i: F.element_at(s["p"], i).cast("bigint")
        return _struct(p=s["p"], iso=s["iso"], a=F.when(s["iso"], n(3)).otherwise(n(1)), b=n(2), y=F.when(s["iso"], n(1)).otherwise(n(3)))

    def judge(s: Column) -> Column:
        y = s["y"]
        leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
        fine = lambda m, d: (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31))
        return _struct(p=s["p"], iso=s["iso"], a=s["a"], b=s["b"], y=y, first=fine(s["b"], s["a"]), late=~s["iso"] & fine(s["a"], s["b"]))

    def arrange(s: Column) -> Column:
        late = s["late"] & ~s["first"]  # month before day: the day is 13 at least
        at = F.when(s["iso"], 3).when(late, 2).otherwise(1)
        return _struct(
            valid=s["first"] | s["late"], iso=s["iso"], late=late, y=s["y"], usual=s["y"].between(1600, 2399),
            day=F.when(late, s["b"]).otherwise(s["a"]), month=F.when(late, s["a"]).otherwise(s["b"]),
            wd=F.length(F.element_at(s["p"], at)), wm=F.length(F.element_at(s["p"], F.when(late, 1).otherwise(2))),
        )

    def classify(s: Column) -> Column:
        kind = F.when((s["day"] == 29) & (s["month"] == 2), 29).when(s["day"] > 30, 31).when(s["day"] > 28, 30).otherwise(28)
        return _struct(**{c: s[c] for c in ("valid", "iso", "late", "y", "usual", "day", "month", "wd", "wm")}, kind=kind)

    def count(s: Column) -> Column:
        """The set as years x months x days, and the date's place in each."""
        kind, y, month = s["kind"], s["y"], s["month"]
        rank = _leaps(y)
        of_leap = F.when(s["usual"], rank - _BEFORE - 1).otherwise(rank - 1 - F.when(y > 2399, _INSIDE).otherwise(0))
        lowest = F.when(kind == 28, F.when(s["late"], 13).otherwise(1)).when(kind == 31, 31).otherwise(29)
        return _struct(
            **{c: s[c] for c in ("valid", "iso", "late", "usual", "wd", "wm", "kind")}, lowest=lowest, of_day=s["day"] - lowest,
            days=F.when(kind == 28, F.when(s["late"], 16).when(s["wd"] == 1, 9).otherwise(28)).when(kind == 30, 2).otherwise(1),
            of_month=F.when(kind == 28, month - 1).when(kind == 30, month - 1 - (month > 2).cast("int")).when(kind == 31, F.array_position(longest, month.cast("int")) - 1).otherwise(0),
            months=F.when(kind == 28, F.when(s["wm"] == 1, 9).otherwise(12)).when(kind == 30, F.when(s["wm"] == 1, 8).otherwise(11)).when(kind == 31, F.when(s["wm"] == 1, 5).otherwise(7)).otherwise(1),
            of_year=F.when(kind == 29, of_leap).when(s["usual"], y - 1600).otherwise(y - 1 - F.when(y > 2399, 800).otherwise(0)),
            years=F.when(kind == 29, F.when(s["usual"], _INSIDE).otherwise(_EVERY - _INSIDE)).otherwise(F.when(s["usual"], 800).otherwise(9199)),
        )

    def permute(s: Column) -> Column:
        form = F.concat_ws("/", F.lit(key), F.lit("date"), *[s[c].cast("string") for c in ("iso", "late", "wd", "wm", "kind", "usual")])
        inner = s["months"] * s["days"]
        new = feistel((s["of_year"] * s["months"] + s["of_month"]) * s["days"] + s["of_day"], s["years"], inner, form)
        return _struct(**{c: s[c] for c in ("valid", "iso", "late", "usual", "wd", "wm", "kind", "lowest", "days", "months")}, new=F.when(s["valid"], new).otherwise(0))

    def write(s: Column) -> Column:
        kind, new = s["kind"], s["new"]
        at, y = F.pmod(F.floor(new / s["days"]), s["months"]), F.floor(new / (s["days"] * s["months"]))
        month = F.when(kind == 28, at + 1).when(kind == 30, at + 1 + (at > 0).cast("int")).when(kind == 31, F.element_at(longest, (at + 1).cast("int"))).otherwise(2)
        leap = _leap_year(F.when(s["usual"], y + _BEFORE + 1).otherwise(y + 1 + F.when(y >= _BEFORE, _INSIDE).otherwise(0)))
        year = F.when(kind == 29, leap).when(s["usual"], y + 1600).otherwise(y + 1 + F.when(y >= 1599, 800).otherwise(0))
        digits = lambda x, w: F.lpad(x.cast("bigint").cast("string"), w, "0")
        d, m, yy = digits(F.pmod(new, s["days"]) + s["lowest"], s["wd"]), digits(month, s["wm"]), digits(year, 4)
        mark = F.regexp_extract(v, r"[-/.]", 0)
        text = F.when(s["iso"], F.concat_ws("-", yy, m, d)).when(s["late"], F.concat(m, mark, d, mark, yy)).otherwise(F.concat(d, mark, m, mark, yy))
        return F.when(s["valid"], text)

    made = _struct(p=F.split(v, r"[-/.]"), iso=v.rlike("^[0-9]{4}-"))
    for stage in (read, judge, arrange, classify, count, permute, write):
        made = _let(made, stage)
    return made.isNotNull(), made


def _ssn(v: Column, key: str) -> tuple[Column, Column]:
    p = F.transform(F.split(v, "-"), lambda c: c.cast("bigint"))
    valid = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
    area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
    new = feistel((area * 99 + p[1] - 1) * 9999 + p[2] - 1, 898 * 99, 9999, key + "/ssn")
    serial, rest = F.pmod(new, F.lit(9999)) + 1, F.floor(new / 9999)
    group, area = F.pmod(rest, F.lit(99)) + 1, F.floor(rest / 99) + 1
    area = F.when(area >= 666, area + 1).otherwise(area)
    return valid, F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))


def _phone(v: Column, key: str) -> Column:
    """The ten national digits are permuted; the country code and the marks stay."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    code = F.substr(digits, F.lit(1), F.length(digits) - 10)
    return _refill(v, F.concat(code, shuffle_string(F.substr(digits, F.length(digits) - 9, F.lit(10)), key + "/phone")))


def _card(v: Column, key: str) -> tuple[Column, Column]:
    digits = F.regexp_replace(v, "[^0-9]", "")
    body = shuffle_string(F.substr(digits, F.lit(1), F.length(digits) - 1), key + "/card")
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body, 1), F.lit(10)), F.lit(10))
    return F.pmod(_luhn_sum(digits, 0), F.lit(10)) == 0, _refill(v, F.concat(body, check.cast("string")))


def replacement(v: Column, key: str) -> Column:
    """A struct of the kind (null: not valid) and the new value."""
    iban_ok, iban = _iban(v, key)
    _, date = _date(v, key)
    ssn_ok, ssn = _ssn(v, key)
    card_ok, card = _card(v, key)
    some = lambda kind, made: F.struct(F.lit(kind).alias("kind"), made.alias("value"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), v.alias("value"))
    is_ = lambda kind: v.rlike(f"^(?:{FORMS[kind]})$")
    return (
        F.when(is_("email"), some("email", _email(v, key)))
        .when(is_("iban"), F.when(iban_ok, some("iban", iban)).otherwise(none))
        .when(is_("ip"), some("ip", _ip(v, key)))
        .when(is_("date"), _let(date, lambda made: F.when(made.isNotNull(), some("date", made)).otherwise(none)))
        .when(is_("ssn"), F.when(ssn_ok, some("ssn", ssn)).otherwise(none))
        .when(is_("phone"), some("phone", _phone(v, key)))
        .when(is_("card"), F.when(card_ok, some("card", card)).otherwise(none))
        .otherwise(none)
    )


def pseudonymise(docs: DataFrame, key: str = "deltaloop", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> for each kind, n_total."""
    t = F.col("_t")
    df = only(docs, id_column, text_column).toDF("doc_id", "_t")
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    df = df.withColumn("_new", F.transform("_found", lambda v: replacement(v, key)))
    gaps = F.split(t, PATTERN, -1)
    joined = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get("_new", i)["value"], F.lit(""))))), "")
    text = F.when(F.size("_found") > 0, joined).otherwise(t)
    of = lambda kind: lambda x: F.coalesce(x["kind"] == kind, F.lit(False))
    counts = [F.size(F.filter("_new", of(k))).cast("bigint").alias(f"n_{k}") for k in FORMS]
    total = F.size(F.filter("_new", lambda x: x["kind"].isNotNull())).cast("bigint").alias("n_total")
    return df.select("doc_id", text.alias("text"), *counts, total)
