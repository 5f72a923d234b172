"""Personal data by format-preserving Feistel pseudonyms, in DataFrame functions alone (operator 8).

What is found: e-mail addresses, phone numbers (groups of three, three and four digits; with a country code eight to
fifteen digits in any groups; with a leading zero nine to thirteen), payment cards (13 to 19 digits, an issuer's first digits, Luhn),
IBANs (mod 97), US social security numbers (no reserved area, group or serial), IPv4 addresses (four octets) and
calendar dates (of 1900 to 2099; day and month of two digits). IPv6 addresses and dates with one-digit days or months
are not looked for. Strings that fail their check are left as they are, and what is valid within them is replaced:
every kind is tried at every place, and only values that pass their check take part. Where valid values overlap the
one that begins first is replaced, and of those that begin together the longest.

Each value is permuted within its format by a keyed Feistel network: the value is read as a pair of numbers below a
and b, and in turn each side is moved, modulo its size, by a keyed SHA-256 of the other. That is a bijection, so
equal values get equal pseudonyms in every document, different values different ones, and the key's holder can undo
it. Separators, letter case, country codes, a national number's leading zero, a card's first two digits and an
address's last domain label stay; check digits are computed anew. Letters and digits of addresses move within their
class by the same network.

A text is cut where no value can cross, the pieces that hold a digit or an at sign are worked on, and all is put
together again, in one pass without a shuffle. Null and empty texts stay as they are; equal rows get equal texts; all
other columns are carried along, whatever their names; an empty table gives an empty result. Counts of what was
replaced come in one struct column, whose name gets underscores while the table has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_names

ROUNDS = 8
#: Used where no key is given; a deployment passes a secret of its own.
DEFAULT_KEY = "lodestream-pseudonyms"
KINDS = ("email", "iban", "date", "ssn", "phone", "ip", "card")

_NO, _NOT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}


def _iban() -> str:
    """The known countries' lengths, so that a word after an IBAN is not taken into it; then any country's form."""
    known = []
    for size, lands in IBAN_LENGTHS.items():
        fours, rest = divmod(size - 4, 4)
        known.append(f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    other = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
    return _NO + "(?:" + "|".join([*known, other]) + ")" + _NOT


_PHONES = (
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    r"\+[1-9][0-9]{0,2}(?:[0-9]{6,12}|(?:[ .-](?:\([0-9]{1,5}\)|[0-9]{1,8})){1,6})",
    r"0[0-9]{2,4}[ /-][0-9]{3,8}(?:[ -][0-9]{3,5})?",
    r"0[0-9](?:[ .-][0-9]{2}){4}",
)
#: Forms of the values; the checks are apart. In a pattern \g and \h stand for its own first and second group.
PATTERNS = {
    "email": _NO + r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}" + _NOT,
    "iban": _iban(),
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}([-/])(?:0[1-9]|1[0-2])\g(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[.](?:0[1-9]|1[0-2])[.](?:19|20)[0-9]{2}"
    r"|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}|(?:1[3-9]|2[0-9]|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)[0-9]{2})(?![0-9A-SU-Za-z/-]|T(?![0-9]))",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:" + "|".join(_PHONES) + ")" + _NOT,
    "ip": r"(?<![0-9A-Za-z.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9A-Za-z]|\.[0-9])",
    "card": _NO + r"(?:[0-9]{13,19}|[0-9]{4}( |-)[0-9]{4}\g[0-9]{4}\g[0-9]{1,7}|[0-9]{4}( |-)[0-9]{6}\h[0-9]{5})" + _NOT,
}
#: Places that no value crosses: after marks that none holds, and between a blank and a lower-case or non-ASCII letter.
CUT = r"""(?<=[\n\r\t,;:!?"'<>=])|(?<= )(?=[a-z]|[^\x00-\x7F])"""


def _numbered(kind: str, before: int) -> str:
    """The pattern with its back references counted from ``before`` groups on."""
    return PATTERNS[kind].replace(r"\g", f"\\{before + 1}").replace(r"\h", f"\\{before + 2}")


# --- the permutation ------------------------------------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _prf(key: Column, tweak: Column, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, tweak, step.cast("string"), other.cast("string")), 256)


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: Column, tweak: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs (0 <= l < a, 0 <= r < b), for a and b below 10**15."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def pushed(step: Column, other: Column) -> Column:
        return F.conv(F.substring(_prf(key, tweak, step, other), 1, 15), 16, 10).cast("long")

    def turn(s: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + pushed(step, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + pushed(step, s["l"])) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def digits(value: Column, key: Column, tweak: Column) -> Column:
    """A string of 2 to 28 digits, permuted among those of its length."""
    size = F.length(value)
    half = F.floor(size / 2).cast("int")
    pair = feistel(
        F.substring(value, F.lit(1), half).cast("long"), F.substring(value, half + 1, size).cast("long"), _ten(half), _ten(size - half),
        key, F.concat_ws(":", tweak, size.cast("string"))
    )
    return _let(
        pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), size - half, F.lit("0")))
    )


def _moved(text: Column, code: Column) -> Column:
    """Letters and digits moved within their class by four hex digits of ``code`` each, in turn."""
    return F.when(text == "", text).otherwise(_let(code, lambda x: _moved_by(text, x)))


def _moved_by(text: Column, code: Column) -> Column:
    def step(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        by = F.conv(F.substring(code, ((i - 1) % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        at = F.ascii(c)
        low = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
        return F.when(low.isNull(), c).otherwise(F.char(low + (at - low + by) % F.when(low == 48, 10).otherwise(26)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), step), "")


def characters(value: Column, key: Column, tweak: Column) -> Column:
    """Letters (by case) and digits permuted within their class, in place; all else stays."""
    half = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def turn(s: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(
            F.when(even, _moved(s["l"], _prf(key, tweak, step, s["r"]))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(_moved(s["r"], _prf(key, tweak, step, s["l"]))).alias("r"),
        )

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn)
    return _let(end, lambda p: F.concat(p["l"], p["r"]))


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(form: Column, content: Column, kept: str) -> Column:
    """``form`` with the characters of ``kept`` replaced in turn by those of ``content``."""

    def filled(content: Column) -> Column:
        def step(i: Column) -> Column:
            c = F.substring(form, i, F.lit(1))
            nth = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), f"[^{kept}]", ""))
            return F.when(c.rlike(f"^[{kept}]$"), F.substring(content, nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), step), "")

    return _let(content, filled)


def _luhn_sum(number: Column, check: int) -> Column:
    """Luhn's sum; with ``check`` 1 the last digit is the check digit, with 0 it is still to come."""
    size = F.length(number)

    def add(total: Column, i: Column) -> Column:
        raw = F.substring(number, size - i, F.lit(1)).cast("int")
        d = F.when((i + 1 + check) % 2 == 1, raw * 2).otherwise(raw)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The number that the letters (A is 10) and digits spell, modulo 97."""

    def add(total: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return (total * F.when(digit, 10).otherwise(100) + F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _pseudonyms(key: Column) -> dict[str, tuple]:
    """kind: (check of the value, its pseudonym)."""

    def email(v: Column) -> Column:
        low, last = F.lower(v), F.regexp_extract(v, r"(\.[A-Za-z]+)$", 1)
        body = F.substring(low, F.lit(1), F.length(v) - F.length(last))

        def cased(moved: Column) -> Column:
            def case(i: Column) -> Column:
                c, m = F.substring(v, i, F.lit(1)), F.substring(moved, i, F.lit(1))
                return F.when(c.rlike("^[A-Z]$"), F.upper(m)).otherwise(m)

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(moved)), case), "")

        return F.concat(_let(characters(body, key, F.lit("email")), cased), last)

    def iban(v: Column) -> Column:
        plain = F.regexp_replace(v, " ", "")
        land = F.substring(plain, 1, 2)

        def whole(inner: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(inner, land, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(land, check, inner)

        inner = characters(F.substring(plain, F.lit(5), F.length(plain)), key, F.concat(F.lit("iban"), land))
        return _refilled(v, _let(inner, whole), "A-Z0-9")

    def iban_ok(v: Column) -> Column:
        plain = F.regexp_replace(v, " ", "")
        return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1

    def day_of(v: Column) -> tuple[Column, Column]:
        form = F.when(v.rlike(r"^[0-9]{4}-"), "yyyy-MM-dd").when(v.rlike(r"^[0-9]{4}/"), "yyyy/MM/dd").when(v.contains("."), "dd.MM.yyyy")
        form = form.when(F.substring(v, 1, 2) > "12", "dd/MM/yyyy").otherwise("MM/dd/yyyy")
        return form, F.try_to_timestamp(v, form).cast("date")

    def date(v: Column) -> Column:
        form, day = day_of(v)
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        pair = feistel(F.floor(n / 4297), n % 4297, 17, 4297, key, F.lit("date"))
        return F.when(form == "dd/MM/yyyy", late_date(v)).otherwise(
            _let(pair, lambda p: F.call_function("date_format", F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * 4297 + p["r"]).cast("int")), form))
        )

    def late_date(v: Column) -> Column:
        """Day first and beyond 12, which tells the form, so the day stays beyond 12: days 13 to 28 move with month and year, later ones by year."""
        d, m, y = F.substring(v, 1, 2).cast("int"), F.substring(v, 4, 2).cast("int"), F.substring(v, 7, 4).cast("int")

        def text(d: Column, m: Column, y: Column) -> Column:
            return F.concat_ws("/", F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), y.cast("string"))

        usual = feistel((y - 1900) * 12 + m - 1, d - 13, 2400, 16, key, F.lit("late-date"))
        leap = feistel(F.floor((y - 1904) / 28), F.floor((y - 1904) / 4) % 7, 7, 7, key, F.lit("leap-day"))
        late = feistel(F.floor((y - 1900) / 10), y % 10, 20, 10, key, F.concat(F.lit("late-date"), F.substring(v, 1, 5)))
        out = F.when(d <= 28, _let(usual, lambda p: text(p["r"] + 13, p["l"] % 12 + 1, F.floor(p["l"] / 12) + 1900)))
        out = out.when((d == 29) & (m == 2), _let(leap, lambda p: text(d, m, 1904 + 28 * p["l"] + 4 * p["r"])))
        return out.otherwise(_let(late, lambda p: text(d, m, 1900 + 10 * p["l"] + p["r"])))

    def ssn(v: Column) -> Column:
        area, rest = F.substring(v, 1, 3).cast("int"), (F.substring(v, 5, 2).cast("int") - 1) * 9999 + F.substring(v, 8, 4).cast("int") - 1
        index = F.when(area < 666, area - 1).otherwise(area - 2)
        pair = feistel(index, rest, 898, 989901, key, F.lit("ssn"))

        def text(p: Column) -> Column:
            area = F.when(p["l"] < 665, p["l"] + 1).otherwise(p["l"] + 2)
            return F.concat_ws(
                "-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"),
                F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0")
            )

        return _let(pair, text)

    def phone(v: Column) -> Column:
        land = F.regexp_extract(v, r"^(\+[0-9]{1,3}[ .-]?|0)?(.*)$", 1)
        rest = F.substring(v, F.length(land) + 1, F.length(v))
        return F.concat(land, _refilled(rest, digits(_only_digits(rest), key, F.lit("phone")), "0-9"))

    def phone_ok(v: Column) -> Column:
        n = F.length(_only_digits(v))
        return F.when(v.startswith("+"), n.between(8, 15)).when(v.startswith("0"), n.between(9, 13)).otherwise(True)

    def ip(v: Column) -> Column:
        o = F.split(v, r"\.")
        pair = feistel(o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), 65536, 65536, key, F.lit("ip"))
        return _let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for s in ("l", "r") for x in (F.floor(p[s] / 256), p[s] % 256)]))

    def card(v: Column) -> Column:
        plain = _only_digits(v)
        body = F.concat(F.substring(plain, 1, 2), digits(F.substring(plain, F.lit(3), F.length(plain) - 3), key, F.lit("card")))
        return _refilled(v, _let(body, lambda x: F.concat(x, ((10 - _luhn_sum(x, 0) % 10) % 10).cast("string"))), "0-9")

    def card_ok(v: Column) -> Column:
        plain = _only_digits(v)
        return F.length(plain).between(13, 19) & plain.rlike("^(?:[3-6]|2[2-7])") & (_luhn_sum(plain, 1) % 10 == 0)

    always = lambda v: F.lit(True)
    return {
        "email": (always, email), "iban": (iban_ok, iban), "date": (lambda v: day_of(v)[1].isNotNull(), date), "ssn": (always, ssn),
        "phone": (phone_ok, phone), "ip": (always, ip), "card": (card_ok, card)
    }


def _is(kind: str):
    return lambda x: x == kind


def _raw(s: Column) -> Column:
    return F.struct(s.alias("text"), F.array().cast("array<string>").alias("kinds"))


def _replaced(s: Column, made: dict[str, tuple]) -> Column:
    """struct(text, kinds) of a piece of text: valid values of all kinds, found at every place, replaced from the left."""

    def valid(kind: str) -> Column:
        check, pseudonym = made[kind]
        found = F.regexp_extract_all(s, F.lit(f"(?=({_numbered(kind, 1)}))"), F.lit(1))
        entry = lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind"), pseudonym(v).alias("new"))
        return F.transform(F.filter(F.array_distinct(found), check), entry)

    def put(values: Column) -> Column:
        longest = F.array_sort(F.transform(values, lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("v"))))
        any_of = F.array_join(F.transform(longest, lambda x: x["v"]), r"\E|\Q")
        pattern = F.concat(F.lit(_NO + r"(?:\Q"), any_of, F.lit(r"\E)(?![0-9A-SU-Za-z]|T(?![0-9]))"))
        return F.when(F.size(values) == 0, _raw(s)).otherwise(_let(pattern, lambda p: joined(values, p)))

    def joined(values: Column, pattern: Column) -> Column:
        picks = F.transform(F.regexp_extract_all(s, pattern, F.lit(0)), lambda v: F.filter(values, lambda x: x["value"] == v)[0])

        def text(got: Column, pieces: Column) -> Column:
            made = F.zip_with(F.slice(pieces, 1, F.size(got)), got, lambda a, b: F.concat(a, b["new"]))
            return F.struct(
                F.concat(F.array_join(made, ""), F.element_at(pieces, -1)).alias("text"),
                F.transform(got, lambda x: x["kind"]).alias("kinds")
            )

        return _let(picks, lambda got: _let(F.split(s, pattern), lambda pieces: text(got, pieces)))

    return _let(F.concat(*[valid(k) for k in KINDS]), put)


def pseudonymised(df: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", counts_col: str | None = "replaced") -> DataFrame:
    """``df`` with the personal data of ``text_col`` replaced, and a struct of counts by kind (none if ``counts_col`` is None)."""
    text, made = F.col(f"`{text_col}`"), _pseudonyms(F.lit(key))
    (done,) = free_names(df, "__pii_pieces")
    marked = F.transform(F.split(text, CUT), lambda s: F.when(s.rlike("[0-9@]"), _replaced(s, made)).otherwise(_raw(s)))
    out = df.withColumn(done, F.when(text.rlike("[0-9@]"), marked))
    new = F.array_join(F.transform(done, lambda d: d["text"]), "")
    columns = [F.when(F.col(done).isNotNull(), new).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if counts_col:
        kinds = F.flatten(F.transform(done, lambda d: d["kinds"]))
        counts = [F.coalesce(F.size(F.filter(kinds, _is(k))), F.lit(0)).alias(k) for k in KINDS]
        columns.append(F.struct(*counts).alias(free_names(df, counts_col)[0]))
    return out.select(*columns)
