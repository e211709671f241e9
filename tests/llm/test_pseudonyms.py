import datetime
import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from keyloom.llm import pseudonyms

DAY, KEY = datetime.date(1800, 1, 1), "k1"


def feistel(kind, a, b, na, nb, key=KEY):
    for r in range(pseudonyms.ROUNDS):
        f = int(hashlib.sha256(f"{key}:{kind}:{r}:{a if r % 2 else b}".encode()).hexdigest()[:15], 16)
        if r % 2:
            b = (b + f) % nb
        else:
            a = (a + f) % na
    return a, b


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10


def pour(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in form)


def string(kind, s):
    n = len(s) // 2
    a, b = feistel(kind, int(s[:n]), int(s[n:]), 10**n, 10 ** (len(s) - n))
    return f"{a:0{n}}{b:0{len(s) - n}}"


def date(y, m, d):
    try:
        i = (datetime.date(y, m, d) - DAY).days
    except ValueError:
        return None
    if not 0 <= i < 146097:
        return None
    while True:
        a, b = feistel("date", i // 773, i % 773, 189, 773)
        i = a * 773 + b
        if ((DAY + datetime.timedelta(i)).day <= 12) == (d <= 12):
            return DAY + datetime.timedelta(i)


def new(m):
    """kind and text of one match, or (None, text)."""
    x, digits = m, re.sub("[^0-9]", "", m)
    if "@" in x:
        return "email", hashlib.sha256(f"{KEY}:email:{x.lower()}".encode()).hexdigest()[:16] + "@redacted.invalid"
    if x[0] in "+(" or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", x):
        return "phone", pour(x, digits[:-10] + string("phone", digits[-10:]))
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", x):
        p = list(map(int, x.split(".")))
        bare = x == ".".join(map(str, p))
        if max(p) > 255 or not bare and any(len(o) != 3 for o in x.split(".")):
            return None, x
        a, b = feistel("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return "ip", ".".join(f"{o:{'' if bare else '03'}}" for o in (a // 256, a % 256, b // 256, b % 256))
    if q := re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", x):
        d = date(int(q[1]), int(q[3]), int(q[4]))
        return ("date", d.strftime(f"%Y{q[2]}%m{q[2]}%d")) if d else (None, x)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", x):
        area, group, serial = map(int, x.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None, x
        a, b = feistel("ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        i = a // 99
        return "ssn", f"{i + 1 + (i >= 665):03}-{a % 99 + 1:02}-{b + 1:04}"
    if q := re.fullmatch(r"(\d\d)([-/.])(\d\d)\2(\d{4})", x):
        if d := date(int(q[4]), int(q[3]), int(q[1])):
            return "date", d.strftime(f"%d{q[2]}%m{q[2]}%Y")
        if d := date(int(q[4]), int(q[1]), int(q[3])):
            return "date", d.strftime(f"%m{q[2]}%d{q[2]}%Y")
        return None, x
    if luhn(digits):
        return None, x
    body = string("card", digits[:-1])
    return "card", pour(x, body + str(-luhn(body + "0") % 10))


def brute(text):
    kinds = []

    def put(m):
        kind, out = new(m[0])
        kinds.append(kind)
        return out

    out = None if text is None else regex.sub(pseudonyms.ANY, put, text)
    return (out, *(kinds.count(k) for k in ("email", "phone", "ip", "date", "ssn", "card")))


TRICKY = [
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111; not 4111111111111112", "ip 10.0.0.1 256.1.1.1 1.2.3.4.5 v1.2.3 010.000.000.001 01.2.3.4 100.200.100.200 300.000.000.001", "3782 822463 10005, 3782-822463-10005, 3056 930902 5904, 3782 822463-10005 and +0 123 456 7890", "on 2024-02-29, 2023-02-29, 31/12/1999, 12/31/1999, 31.04.2020 and 1799-12-31 2199-12-31",
    "ssn 123-45-6789 000-12-3456 666-12-3456 665-99-9999 667-01-0001 900-12-3456", "+1 (017) 555-7713 +49 123 456 7890 +1-800-555-0100 (212) 555-0187, 212-555-0187 and 212.555.0187; 2125550187 12-555-0187", "é.34@mail7.example.com A.B@x.org @ a@b", "\U0001f600 4111111111111111",
]


@pytest.mark.parametrize("name", ["odd", "empty", "documents", "tricky"])
def test_equals_brute_force(request, spark, name):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if name == "tricky" else request.getfixturevalue(name)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in pseudonyms.mask(docs, KEY).collect()), key=key)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()), key=key)
    kept = pseudonyms.masked(docs, KEY)
    assert kept.columns == docs.columns and sorted((r.doc_id, str(r.text)) for r in kept.collect()) == sorted((r[0], str(r[1])) for r in got)


def test_permutation(spark):
    """All of a small domain is hit once; pseudonyms are valid and keep the format."""
    all_ = spark.range(189 * 773).select(pseudonyms.feistel("date", F.lit("k"), F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773)).alias("x"))
    assert all_.distinct().count() == 189 * 773
    r = random.Random(1)
    cards = ["4" + "".join(r.choice("0123456789") for _ in range(n)) for n in range(11, 18) for _ in range(5)]
    cards = [c + str(-luhn(c + "0") % 10) for c in cards]
    out = [x.text for x in pseudonyms.mask(spark.createDataFrame([(i, c) for i, c in enumerate(cards)], "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert all(luhn(o) == 0 and len(o) == len(c) and o != c for o, c in zip(out, cards)) and len(set(out)) == len(set(cards))


def test_no_two_dates_become_one(spark):
    """Over all dates, in each order: different strings stay different, and can be read in the orders they could be."""
    days = [DAY + datetime.timedelta(i) for i in range(189 * 773)]
    shown = sorted({d.strftime(form) for d in days for form in ("%d/%m/%Y", "%m/%d/%Y")})
    assert len(shown) == 234594
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(shown)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in pseudonyms.mask(docs, KEY).collect()}
    out = [got[i].text for i in range(len(shown))]
    assert len(set(out)) == len(shown) and all(r.n_date == 1 for r in got.values())
    for x, y in zip(shown, out):
        assert [int(x[:2]) <= 12, int(x[3:5]) <= 12] == [int(y[:2]) <= 12, int(y[3:5]) <= 12]
    iso = spark.createDataFrame([(i, d.isoformat()) for i, d in enumerate(days)], "doc_id long, text string").repartition(8)
    linked = {r.doc_id: r.text for r in pseudonyms.mask(iso, KEY).collect()}
    assert len(set(linked.values())) == len(days)
    place = {x: i for i, x in enumerate(shown)}
    for i in range(0, len(days), 97):  # the same day, day first
        assert out[place[days[i].strftime("%d/%m/%Y")]] == datetime.date.fromisoformat(linked[i]).strftime("%d/%m/%Y")


def test_the_key_must_be_given(odd):
    with pytest.raises(TypeError):
        pseudonyms.mask(odd)
