"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every value found and validated is permuted, within its own format, by a keyed Feistel network over mixed radices: a
card number becomes another card number with a right check digit, a date another date. What is permuted is the
value's canonical form (a phone's digits, a mail address in lower case), and the permutation depends on the key and
the kind of value only: equal values stay equal across documents in any spelling, and different ones stay different.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import spare

# Formats of the values found, in order of precedence.
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]{0,63}@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,8}[\p{L}\p{M}]{2,24}"
KEY_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{6,}+"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
ISO_DATE = r"(?<![\d/.-])\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d|[-/.]\d)"
DAY_DATE = r"(?<![\d/.-])\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d|[-/.]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)"
# With a plus: the North American plan, then any grouping. Without: three groups with a bracket or marks, a leading 0,
# or a word that says so. Groups parted by blanks alone are no phone.
PHONE = (
    r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\w+])\+[2-9](?:[ .()/-]{0,2}\d){7,14}(?!\d|\.\d)"
    r"|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w|[.-]\d)"
    r"|(?<![\w+.,-])(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{2,8}(?:[ /-]\d{2,8}){0,4}(?!\w|[.,-]\d)"
    r"|\b(?i:tel|telefon|phone|fax|mobile|cell|handy|téléphone|teléfono)[.:]{0,2}\s{1,3}\(?\d(?:[ .()/-]{0,2}\d){6,14}(?!\d)"
)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Characters that become one another.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
KINDS = {"email": EMAIL, "key_id": KEY_ID, "secret": SECRET, "ipv4": IPV4, "date": f"{ISO_DATE}|{DAY_DATE}", "ssn": SSN, "iban": IBAN, "card": CARD, "phone": PHONE}
FOUND = "|".join(f"(?:{p})" for p in KINDS.values())
#: Each format needs one of these, and most texts have none.
HINT = "[0-9@]|(?i:password|passwd|pwd|secret|token|key)"
#: Days of 400 Gregorian years, from this day on; they factor into two radices.
FIRST_DAY, DAY_RADICES = "1700-01-01", (189, 773)
ROUNDS = 8


def _prf(key: Column, kind: str, turn: Column, i: Column, other: Column) -> Column:
    """48 keyed pseudorandom bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key, F.lit(kind), turn, i, other), 256), 1, 12), 16, 10).cast("long")


def _said(other: Column) -> Column:
    """The other half as text; a long one's digest, so that the work stays in proportion to the length."""
    return F.when(F.size(other) > 100, F.sha2(F.array_join(other, ","), 256)).otherwise(F.array_join(other, ","))


def feistel(values: Column, radices: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of arrays of numbers, each below its radix.

    Each round adds to one half a pseudorandom number that depends on the other half, modulo each radix.
    """

    def halves(v: Column, r: Column) -> Column:
        n, h = F.size(v), F.ceil(F.size(v) / 2).cast("int")
        return F.struct(F.slice(v, F.lit(1), h).alias("a"), F.slice(v, h + 1, n - h).alias("b"), F.slice(r, F.lit(1), h).alias("ra"), F.slice(r, h + 1, n - h).alias("rb"))

    start = _let(values, lambda v: _let(radices, lambda r: halves(v, r)))

    def turn(acc: Column, r: Column) -> Column:
        moved = _let(_said(acc["b"]), lambda other: F.transform(acc["a"], lambda x, i: F.pmod(x + _prf(key, kind, r, i, other), F.get(acc["ra"], i))))
        return F.struct(acc["b"].alias("a"), moved.alias("b"), acc["rb"].alias("ra"), acc["ra"].alias("rb"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, r"\D", "")), lambda c: c.cast("long"))


def _longs(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _symbols(s: Column, key: Column, kind: str) -> Column:
    """Permute each character within its alphabet; what has none stays."""
    by_alphabet = lambda c, f, none: reduce(lambda out, a: F.when(F.instr(F.lit(a), c) > 0, f(a)).otherwise(out), ALPHABETS, none)

    def moved(chars: Column) -> Column:
        radices = F.transform(chars, lambda c: by_alphabet(c, lambda a: F.lit(len(a)), F.lit(1)).cast("long"))
        values = F.transform(chars, lambda c: by_alphabet(c, lambda a: F.instr(F.lit(a), c) - 1, F.lit(0)).cast("long"))
        new = feistel(values, radices, key, kind)
        return F.array_join(F.zip_with(chars, new, lambda c, v: by_alphabet(c, lambda a: F.substring(F.lit(a), v.cast("int") + 1, F.lit(1)), c)), "")

    return _let(_chars(s), moved)


def _lowered(s: Column, key: Column, kind: str) -> Column:
    """The lower-cased characters permuted, then given the cases of ``s``."""
    low = F.transform(_chars(s), lambda c: F.lower(c))
    return F.array_join(F.zip_with(_chars(s), _chars(_symbols(F.array_join(low, ""), key, kind)), lambda c, x: F.when(c == F.lower(c), x).otherwise(F.upper(x))), "")


def _email(s: Column, key: Column) -> Column:
    """Name and domain, in lower case, each by itself; the top-level domain stays."""
    domain = F.substring_index(s, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    return F.concat(_lowered(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), _lowered(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), key, "domain"), top)


def _secret(s: Column, key: Column) -> Column:
    """A hexadecimal string of one case within its digits, the same in either case; any other character by character."""
    hexed = F.array_join(
        F.transform(feistel(F.transform(_chars(s), lambda c: F.conv(c, 16, 10).cast("long")), F.transform(_chars(s), lambda c: F.lit(16).cast("long")), key, "secret"), lambda v: F.conv(v.cast("string"), 10, 16)), ""
    )
    plain = _symbols(s, key, "secret")
    return F.when(s.rlike(r"^(?=.*\d)[0-9a-f]{8,}$"), F.lower(hexed)).when(s.rlike(r"^(?=.*\d)[0-9A-F]{8,}$"), F.upper(hexed)).otherwise(plain)


def _laid_out(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced in turn."""
    return _let(digits, lambda d: _spelled(s, d))


def _spelled(s: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.get(digits, acc["i"]).cast("string")).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i"))
    )
    return F.aggregate(_chars(s), start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled."""
    twice = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(twice, F.lit(0).cast("long"), lambda a, d: a + d)


def _card(s: Column, key: Column) -> Column:
    def moved(d: Column) -> Column:
        n = F.size(d)
        middle = F.slice(d, F.lit(2), n - 2)
        new = F.concat(F.slice(d, 1, 1), feistel(middle, F.transform(middle, lambda _: F.lit(10).cast("long")), key, "card"))
        return _laid_out(s, _let(new, lambda x: F.concat(x, F.array(F.pmod(-_luhn(F.concat(x, _longs(0))), F.lit(10))))))

    return _let(_digits(s), moved)


def _cards(s: Column, key: Column) -> Column:
    """The longest, first run of whole digit groups that is a valid card is replaced; groups beside it stay."""
    valid = lambda d: F.size(d).between(13, 19) & (F.pmod(_luhn(d), F.lit(10)) == 0)
    groups = F.split(s, "[ -]", -1)
    upto = lambda i: F.length(F.array_join(F.slice(groups, F.lit(1), i), " "))
    start = lambda i: F.when(i == 0, 0).otherwise(upto(i) + 1)
    span = lambda i, j: F.struct((start(i) - upto(j)).alias("shorter"), start(i).alias("at"), F.substring(s, start(i) + 1, upto(j) - start(i)).alias("card"))
    places = F.sequence(F.lit(0), F.size(groups) - 1)
    spans = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(i + 1, F.size(groups)), lambda j: span(i, j))))
    fit = F.sort_array(F.filter(spans, lambda x: valid(_digits(x["card"]))))
    part = lambda x: F.concat(F.substring(s, F.lit(1), x["at"]), _card(x["card"], key), F.substring(s, x["at"] + F.length(x["card"]) + 1, F.length(s)))
    return F.when(valid(_digits(s)), _card(s, key)).when(F.size(groups) > 1, F.coalesce(_let(F.get(fit, F.lit(0)), lambda x: F.when(x.isNotNull(), part(x))), s)).otherwise(s)


def _ipv4(s: Column, key: Column) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(feistel(octets, _longs(256, 256, 256, 256), key, "ipv4"), ".")).otherwise(s)


def _ssn(s: Column, key: Column) -> Column:
    part = F.transform(F.split(s, "-"), lambda x: x.cast("long"))
    a, g, n = (F.get(part, F.lit(i)) for i in range(3))
    ok = (a >= 1) & (a < 900) & (a != 666) & (g >= 1) & (n >= 1)
    values = F.array(F.when(a > 666, a - 2).otherwise(a - 1), g - 1, n - 1)
    out = lambda v: F.format_string("%03d-%02d-%04d", F.get(v, F.lit(0)) + F.when(F.get(v, F.lit(0)) >= 665, 2).otherwise(1), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)
    return F.when(ok, _let(feistel(values, _longs(898, 99, 9999), key, "ssn"), out)).otherwise(s)


def _date(s: Column, key: Column) -> Column:
    """Year first, or day first, or month first where only that is a date."""
    part = F.split(s, "[-/.]")
    mark = F.regexp_extract(s, "[-/.]", 0)
    at = lambda i: F.get(part, F.lit(i))
    day = lambda y, m, d: F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    year_first = F.length(at(0)) == 4
    day_first = day(at(2), at(1), at(0))
    parsed = F.when(year_first, day(at(0), at(1), at(2))).otherwise(F.coalesce(day_first, day(at(2), at(0), at(1))))
    a, b = DAY_RADICES
    n = F.datediff(parsed, F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = _let(feistel(F.array(F.floor(n / b).cast("long"), F.pmod(n, F.lit(b))), _longs(a, b), key, "date"), lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(v, F.lit(0)) * b + F.get(v, F.lit(1))).cast("int")))
    spelled = lambda d: F.when(year_first, F.concat_ws("-", F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd"))).when(
        day_first.isNotNull(), F.concat_ws("-", F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yyyy"))
    ).otherwise(F.concat_ws("-", F.date_format(d, "MM"), F.date_format(d, "dd"), F.date_format(d, "yyyy")))
    return F.when((n >= 0) & (n < a * b), F.replace(_let(moved, spelled), F.lit("-"), mark)).otherwise(s)


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0).cast("long"), lambda a, c: F.when(c.rlike("^[0-9]$"), a * 10 + c.try_cast("long")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _iban(s: Column, key: Column) -> Column:
    bare = F.regexp_replace(s, " ", "")
    country, body = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))

    def moved(new: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        out = _chars(F.concat(country, check, new))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
        step = lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i"))).otherwise(F.struct(F.concat(acc["out"], F.get(out, acc["i"])).alias("out"), (acc["i"] + 1).alias("i")))
        return F.aggregate(_chars(s), start, step, lambda acc: acc["out"])

    return F.when(_mod97(F.concat(body, F.substring(bare, 1, 4))) == 1, _let(_symbols(body, key, "iban"), moved)).otherwise(s)


def _phone(s: Column, key: Column) -> Column:
    """The country code stays, and a 0 that stands for it; in ten-digit numbers neither the first nor the fourth digit
    becomes 0 or 1."""
    word = F.regexp_extract(s, r"^\D*?(?=[+(]*\d|\+)", 0)
    number = F.substring(s, F.length(word) + 1, F.length(s))
    bare = F.regexp_replace(number, r"[^+\d]", "")
    code = F.coalesce(F.when(bare.startswith("+"), F.substring(F.regexp_extract(bare, COUNTRY, 0), F.lit(2), F.lit(3))).when(bare.startswith("0"), F.lit("0")), F.lit(""))

    def permuted(d: Column, north: Column) -> Column:
        low = lambda i: F.when(north & i.isin(0, 3), 2).otherwise(0)
        new = feistel(F.transform(d, lambda x, i: x - low(i)), F.transform(d, lambda x, i: F.when(north & i.isin(0, 3), 8).otherwise(10).cast("long")), key, "phone")
        return F.transform(new, lambda x, i: x + low(i))

    def moved(parts: Column) -> Column:
        d, north = parts["own"], (F.size(parts["own"]) == 10) & (F.get(parts["own"], F.lit(0)) > 1) & (F.get(parts["own"], F.lit(3)) > 1)
        new = _let(north, lambda n: permuted(d, n))
        return F.when(F.size(d).between(7, 14), F.concat(parts["word"], _laid_out(parts["number"], F.concat(parts["lead"], new)))).otherwise(s)

    def parted(every: Column, size: Column) -> Column:
        return F.struct(word.alias("word"), number.alias("number"), F.slice(every, F.lit(1), size).alias("lead"), F.slice(every, size + 1, F.size(every)).alias("own"))

    return _let(_let(_digits(number), lambda every: _let(F.length(code), lambda size: parted(every, size))), moved)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a value of one of the formats; what does not validate stays as it is."""
    full = lambda p: value.rlike(f"^(?:{p})$")
    name = F.regexp_extract(value, r"^(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?", 0)
    return (
        F.when(full(EMAIL), _email(value, key))
        .when(full(KEY_ID), F.concat(F.substring(value, 1, 4), _symbols(F.substring(value, F.lit(5), F.length(value)), key, "key_id")))
        .when(full(SECRET), F.concat(name, _secret(F.substring(value, F.length(name) + 1, F.length(value)), key)))
        .when(full(IPV4), _ipv4(value, key))
        .when(full(KINDS["date"]), _date(value, key))
        .when(full(SSN), _ssn(value, key))
        .when(full(IBAN), _iban(value, key))
        .when(full(CARD), _cards(value, key))
        .when(full(PHONE), _phone(value, key))
        .otherwise(value)
    )


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(KINDS.items()):
        out = F.when(value.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def found(text: Column) -> Column:
    """All values of the formats, from left to right, validated or not; null text: none."""
    hinted = text.rlike("[0-9@]") | ((text.contains("=") | text.contains(":")) & text.rlike(HINT))
    return F.when(hinted, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced and their number in ``n_pseudonyms`` (replaced if present).

    A null text stays null with 0, an empty one stays empty; an empty table stays empty. Texts of any length are read
    whole; all other columns and rows stay as they are, repeated ones too. Where formats overlap, the leftmost value
    counts, and of those that begin at one place the first format. The key reaches the plan as a subquery's result, so
    no explanation of it and no event log shows it.
    """
    text = F.col(text_col)
    found_col, new_col, key_col = spare(docs, "found", "new", "key")
    secret = docs.sparkSession.sql("SELECT max(k) AS k FROM VALUES (:key) AS t(k)", {"key": key}).scalar()
    rows = docs.withColumn(found_col, found(text)).withColumn(key_col, secret)
    new = rows.withColumn(new_col, F.transform(found_col, lambda m: pseudonym(m, F.col(key_col))))
    # The text between the values, each but the last followed by the pseudonym of the value after it.
    joined = F.array_join(F.zip_with(F.split(text, FOUND, -1), new_col, lambda between, p: F.concat(between, F.coalesce(p, F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip(F.col(found_col).alias("old"), F.col(new_col).alias("new")), lambda x: x["old"] != x["new"]))
    return new.withColumn(text_col, F.when(F.size(found_col) > 0, joined).otherwise(text)).withColumn("n_pseudonyms", F.coalesce(changed, F.lit(0)).cast("long")).drop(found_col, new_col, key_col)
