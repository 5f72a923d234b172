import datetime
import hashlib
import re
from collections import defaultdict

from lodestream.llm import pii
from lodestream.llm.queries import op8_pii

SCHEMA = "doc_id long, text string, replaced string, __pii_matches string"
KEY = pii.DEFAULT_KEY


def prf(tweak, step, other):
    return hashlib.sha256(f"{KEY}|{tweak}|{step}|{other}".encode()).hexdigest()


def feistel(left, right, a, b, tweak):
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = (left + int(prf(tweak, k, right)[:15], 16)) % a
        else:
            right = (right + int(prf(tweak, k, left)[:15], 16)) % b
    return left, right


def digits(s, tweak):
    h = len(s) // 2
    left, right = feistel(int(s[:h]), int(s[h:]), 10**h, 10 ** (len(s) - h), f"{tweak}:{len(s)}")
    return f"{left:0{h}d}{right:0{len(s) - h}d}"


def luhn(s, check=True):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if (i % 2 == 1) == check else 1)
        total += d - 9 * (d > 9)
    return total


def refill(form, content, kept="0123456789"):
    it = iter(content)
    return "".join(next(it) if c in kept else c for c in form)


def pseudonym(kind, v):
    """The numbers' pseudonyms, written anew in Python; None if the value fails its check."""
    if kind == "phone":
        n = len(re.sub(r"\D", "", v))
        if not (8 <= n <= 15 if v[0] == "+" else 9 <= n <= 13 if v[0] == "0" else True):
            return None
        land = re.match(r"(?:\+[0-9]{1,3}[ .-]?|0)?", v).group(0)
        rest = v[len(land) :]
        return land + refill(rest, digits(re.sub(r"\D", "", rest), "phone"))
    if kind == "ip":
        o = list(map(int, v.split(".")))
        left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "card":
        s = re.sub(r"\D", "", v)
        if not re.match("[3-6]|2[2-7]", s) or luhn(s) % 10:
            return None
        body = s[:2] + digits(s[2:-1], "card")
        return refill(v, body + str(-luhn(body, False) % 10))
    if kind == "iban":
        s = v.replace(" ", "")
        return "*" * len(v) if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else None
    if kind == "date":
        d = [int(x) for x in re.split("[-/.]", v)]
        y, m, d = d if v[4] in "-/" else (d[2], d[1], d[0]) if "." in v or d[0] > 12 else (d[2], d[0], d[1])
        try:
            return "*" * len(v) if datetime.date(y, m, d) else None
        except ValueError:
            return None
    return "*" * len(v)


def brute(t):
    """(start, value, kind) of what is to be replaced: every kind at every place, the first to begin, then the longest."""
    found = [(m.start(), -len(m.group(1)), m.group(1), k) for k in pii.KINDS for m in re.finditer(f"(?=({pii._numbered(k, 1)}))", t) if pseudonym(k, m.group(1)) is not None]
    end, out = 0, []
    for at, _, v, k in sorted(found, key=lambda f: f[:2]):
        if at >= end:
            out.append((at, v, k))
            end = at + len(v)
    return out


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_pii(spark, sf).collect()
    assert len(got) == len(docs)
    seen = set()
    for r in got:
        t, end, parts = docs[r.doc_id], 0, []
        for at, v, k in brute(t):
            new = pseudonym(k, v)
            parts += [re.escape(t[end:at]), "." * len(v) if "*" in new else re.escape(new)]
            end = at + len(v)
            seen.add(k)
            assert "*" not in new or v not in r.text or k == "date"
        assert re.fullmatch("".join(parts) + re.escape(t[end:]), r.text, re.S), r.doc_id
    assert len(seen) > 3


CARD, IBAN, SSN, IP = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "97.51.17.173"


def test_valid_values_within_what_fails_its_check(spark):
    hidden = {
        f"ref ID42 {CARD} now": [CARD], f"AB12 {CARD}": [CARD], f"1234 {CARD}": [CARD], f"GB42 {CARD} 11": [CARD],
        f"BE68 5390 0754 7034 PAID {CARD}": ["BE68 5390 0754 7034", CARD], f"{IBAN} USED": [IBAN], f"AB12 CDEF GHIJ {IBAN}": [IBAN],
        f"4111-1111-1111-1112 {SSN} {IP}": [SSN, IP], f"31.02.2020 {CARD} 0000": [CARD], f"2020-02-30 504-555-2652": ["504-555-2652"],
        f"+1 {CARD}": [CARD], f"FR14 {SSN} 2004": [SSN], f"AB12 2020 1999-02-28 X": ["1999-02-28"], f"ZZ99 AAAA BBBB {IP}": [IP], "IT60 X054 a.b@c.de": ["a.b@c.de"],
    }
    for text, new in zip(hidden, one(spark, list(hidden)), strict=True):
        assert len(new) in (len(text), *range(len(text) - 8, len(text) + 9))
        for v in hidden[text]:
            assert v not in new, (text, new)
        assert {v for _, v, _ in brute(text)} == set(hidden[text]), text


def test_other_phones_addresses_and_dates(spark):
    values = ["+49 30 12345678", "020 7946 0958", "+44 20 7946 0958", "06 12 34 56 78", "030 901820", "+493090182000", "-john@x.com", "_john@x.com", "john@x.com-Support", "25/12/1980", "31/01/1999", "29/02/2000", "1999-02-28T10:00:00"]
    got = one(spark, values)
    for v, g in zip(values, got, strict=True):
        assert g != v or "/" in v, v
        assert re.sub("[A-Za-z0-9]", "x", g) == re.sub("[A-Za-z0-9]", "x", v)
    assert got[0].startswith("+49 ") and got[1][0] == got[3][0] == "0" and got[8].endswith("-Support") and got[12].endswith("T10:00:00")
    late = [f"{d:02d}/{m:02d}/{y}" for d in (13, 28, 29, 30, 31) for m in (1, 2, 3, 12) for y in (1904, 2000, 2004, 2096) if not (m == 2 and d > 29)]
    new = one(spark, late)
    assert len(set(new)) == len(late)
    for v in new:
        d, m, y = map(int, v.split("/"))
        assert d > 12 and datetime.date(y, m, d)


def test_the_cut_of_texts_changes_nothing(spark):
    text = f"über {CARD}, {IBAN}\n{SSN}; mail a.b@c.de=b {IP} x 504-555-2652: äöü {CARD}"
    new = one(spark, [text, text.replace(", ", " . ").replace("\n", " . ").replace(";", " ")])
    assert not any(v in n for n in new for v in (CARD, IBAN, SSN, IP, "a.b@c.de", "504-555-2652"))


def one(spark, values):
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_valid_forms_stay_valid_and_equal_values_stay_linked(spark):
    card, mail = "4845168114407329", "Und.34@Mail7.example.com"
    got = one(spark, [card, f"x {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} y", mail, mail.lower(), "+1 (504) 555-2652", "504-555-2652", "1999-02-28", "28.02.1999", "123-45-6789", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "97.51.17.173"])
    assert luhn(got[0]) % 10 == 0 and got[0] != card and got[0][:2] == "48"
    assert got[1] == f"x {got[0][:4]} {got[0][4:8]} {got[0][8:12]} {got[0][12:]} y"
    assert got[2].lower() == got[3] and got[2] != mail and got[2].endswith(".com")
    assert re.sub(r"\D", "", got[4])[1:] == re.sub(r"\D", "", got[5]) and got[4].startswith("+1 (")
    y, m, d = got[6].split("-")
    assert got[7] == f"{d}.{m}.{y}" and "1900" <= y <= "2099"
    assert re.fullmatch(pii.PATTERNS["ssn"], got[8])
    number = "".join(str(int(c, 36)) for c in got[9][4:] + got[9][:4])
    assert int(number) % 97 == 1 and got[10].replace(" ", "") == got[9]
    assert re.fullmatch(pii.PATTERNS["ip"], got[11])


def test_what_fails_its_check_stays(spark):
    same = ["4845168114407328", "0329408264589786", "1999-02-30", "000-12-3456", "DE00370400440532013000", "1.2.3", "token = 57f17a56c90cac3e893f4491169557bdc83d8148", "300.1.1.1", "", "12345"]
    assert one(spark, same) == same


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert n.select(pii.digits(F.col("v"), F.lit("k"), F.lit("t")).alias("p")).distinct().count() == 1000
    days = one(spark, [f"20{y:02d}-0{m}-1{d}" for y in range(10) for m in range(1, 10) for d in range(10)])
    assert len(set(days)) == 900
    two = spark.createDataFrame([(f"{a}{b}",) for a in "abcdefghijklmnopqrstuvwxyz" for b in range(10)], "v string")
    assert two.select(pii.characters(F.col("v"), F.lit("k"), F.lit("t")).alias("p")).filter("p rlike '^[a-z][0-9]$'").distinct().count() == 260


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a", "b"), (1, "mail a@b.de", "a", "b"), (1, "mail a@b.de", "a", "b"), (None, "", None, None)], SCHEMA)
    out = pii.pseudonymised(df, counts_col=None)
    assert out.columns == df.columns
    texts = defaultdict(int)
    for r in out.collect():
        texts[r.text] += 1
    assert texts[None] == 1 and texts[""] == 1 and sorted(texts.values()) == [1, 1, 2]
    assert pii.pseudonymised(df.limit(0), counts_col="n").count() == 0
    wide = pii.pseudonymised(spark.createDataFrame([(1, f"x {CARD}", "a", "b")], SCHEMA))
    assert len(set(wide.columns)) == len(wide.columns) == 5 and wide.first()["replaced"] == "a" and wide.first()["replaced_"].card == 1
