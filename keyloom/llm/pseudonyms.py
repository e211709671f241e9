"""Format-preserving pseudonyms of personal numbers and dates. Column expressions only.

Found and validated: payment cards (13 to 19 digits, plain, in fours or as 4-6-4 and 4-6-5, Luhn), phone
numbers (a country code that doesn't start with 0, or three, three and four digits), IPv4 addresses (octets
to 255, without leading zeros or all of three digits), social security numbers (area, group and serial in
use), dates (year first, or day or month first, from 1800 to 2199) and e-mail addresses. Each kind's values
are numbered, and the number goes through a keyed Feistel network over two mixed-radix halves of
exactly that many values: a permutation of the kind, so equal values stay equal across documents,
different ones stay different, and the result is again valid and in the format it was found in.
The round function is SHA-256 of key, kind, round and half. An e-mail address is no number: it
becomes a keyed digest at an unroutable domain.

A date whose day is at most 12 becomes another such, any other date one with a later day: the network is
applied again until that holds (a walk along its cycle, again a permutation of each class; STEPS at most,
which a walk outlasts with a probability below 1e-25). So a date that can be read day or month first
stays so and is valid either way, one that can be read in only one order keeps it, and no two strings of
one format become the same. Strings that can be read either way are read day first, which
decides only to which year-first date they are linked.

The key has no default: who has it can undo the networks.

Strings that look alike but are not valid stay as they are, and so do null texts (which count no
findings). Repeated rows stay; extra columns are ignored by mask() and kept by masked().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, STEPS = 8, 128
#: Days of 400 Gregorian years, 146097 = 189 * 773, from 1800-01-01; octet pairs; areas (898) by groups (99), and serials.
DAYS, FIRST_DAY = (189, 773), "1800-01-01"
OCTETS, NUMBERS = (65536, 65536), (898 * 99, 9999)
_OUT = r"(?<![0-9A-Za-z.+-])"
#: One pattern a kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?<![0-9A-Za-z])(?:\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?|\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}[ .-][0-9]{3}[ .-])[0-9]{4}(?![0-9A-Za-z])",
    "ip": _OUT + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ymd": r"(?<![0-9A-Za-z])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "dmy": r"(?<![0-9A-Za-z])[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{4,5})(?![0-9A-Za-z])",
}
#: All but addresses start with one of these: other places are passed over at once.
NUMERIC = "(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "email") + ")"
ANY = f"(?:{PATTERNS['email']})|{NUMERIC}"


def feistel(kind: str, key: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct<a, b>: the permuted halves, of range(size_a) and range(size_b)."""

    def f(r: Column, half: Column) -> Column:
        text = F.concat_ws(":", key, F.lit(kind), r.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + F.pmod(f(r, s["b"]), size_a)) % size_a).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + F.pmod(f(r, s["a"]), size_b)) % size_b).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _with(value: Column, make) -> Column:
    """make(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long"))


def _poured(form: Column, digits: Column) -> Column:
    """form with its digits replaced, one by one."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, c):
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, digits.substr(s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), state, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits."""

    def step(s, c):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["sum"] + F.when(s["odd"], twice).otherwise(d)).alias("sum"), (~s["odd"]).alias("odd"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda s: s["sum"])


def _string(kind: str, key: Column, digits: Column) -> Column:
    """A string of digits permuted among those of its length (18 at most)."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    done = feistel(kind, key, _number(digits.substr(F.lit(1), left)), _number(digits.substr(left + 1, n)), size(left), size(n - left))
    return _with(done, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), n - left, "0")))


def _card(x: Column, key: Column) -> Column:
    def valid(digits):
        head = digits.substr(F.lit(1), F.length(digits) - 1)
        new = lambda body: F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        return F.when((luhn_sum(digits) % 10 == 0) & F.length(digits).between(13, 19), _poured(x, _with(_string("card", key, head), new)))

    return _with(_digits(x), valid)


def _phone(x: Column, key: Column) -> Column:
    """The last ten digits change, what stands before them stays."""

    def new(digits):
        head = F.length(digits) - 10
        return _poured(x, F.concat(digits.substr(F.lit(1), head), _string("phone", key, digits.substr(head + 1, F.lit(10)))))

    return _with(_digits(x), new)


def _ip(x: Column, key: Column) -> Column:
    part = lambda i: F.split(x, r"\.")[i].cast("long")
    done = feistel("ip", key, part(0) * 256 + part(1), part(2) * 256 + part(3), *map(F.lit, OCTETS))
    bare = x.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$")
    octet = lambda v: F.when(bare, v.cast("string")).otherwise(F.lpad(v.cast("string"), 3, "0"))
    new = _with(done, lambda s: F.concat_ws(".", *(octet(v) for h in ("a", "b") for v in (F.floor(s[h] / 256), s[h] % 256))))
    return F.when((F.greatest(*map(part, range(4))) <= 255) & (bare | x.rlike(r"^[0-9]{3}(?:\.[0-9]{3}){3}$")), new)


def _ssn(x: Column, key: Column) -> Column:
    area, group, serial = (x.substr(a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - (area > 666).cast("int")
    done = feistel("ssn", key, index * 99 + group - 1, serial - 1, *map(F.lit, NUMBERS))

    def new(s):
        i = F.floor(s["a"] / 99)
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in ((i + 1 + (i >= 665).cast("int"), 3), (s["a"] % 99 + 1, 2), (s["b"] + 1, 4))))

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), _with(done, new))


def _other_day(index: Column, early: Column, key: Column) -> Column:
    """The number of the day that day `index` becomes: both or neither have a day of the month of 12 at most."""

    def step(s, i):
        def moved(t):
            now = t["a"] * DAYS[1] + t["b"]
            return F.struct(now.alias("at"), ((F.dayofmonth(F.date_add(F.lit(FIRST_DAY).cast("date"), now.cast("int"))) <= 12) == early).alias("done"))

        return F.when(s["done"], s).otherwise(_with(feistel("date", key, F.floor(s["at"] / DAYS[1]), s["at"] % DAYS[1], *map(F.lit, DAYS)), moved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(index.cast("long").alias("at"), F.lit(False).alias("done")), step, lambda s: s["at"])


def _date(x: Column, key: Column, form: str, year: int, month: int, day: int) -> Column:
    """x, if it is a date with its parts at these places; `form` writes it again."""
    iso = F.concat_ws("-", x.substr(year, 4), x.substr(month, 2), x.substr(day, 2))
    index = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    mark = x.substr(5 if year == 1 else 3, 1)
    text = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _other_day(index, x.substr(day, 2).cast("int") <= 12, key).cast("int")), form)
    return F.when(index.between(0, DAYS[0] * DAYS[1] - 1), F.replace(text, F.lit("|"), mark))


def _email(x: Column, key: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws(":", key, F.lit("email"), F.lower(x)), 256), 1, 16), F.lit("@redacted.invalid"))


def pseudonym(x: Column, key: Column) -> Column:
    """struct<kind, text>: of a match of ANY; null kind and the match itself where it isn't valid."""
    whole = lambda kind: x.rlike("^(?:" + PATTERNS[kind].replace(r"\2", r"\1").replace(r"\3", r"\1").replace(r"\4", r"\2") + ")$")
    made = {
        "email": _email(x, key), "phone": _phone(x, key), "ip": _ip(x, key), "ymd": _date(x, key, "yyyy|MM|dd", 1, 6, 9), "ssn": _ssn(x, key),
        "dmy": F.coalesce(_date(x, key, "dd|MM|yyyy", 7, 4, 1), _date(x, key, "MM|dd|yyyy", 7, 1, 4)), "card": _card(x, key),
    }
    case = None
    for kind, new in made.items():
        found = F.struct(F.lit("date" if kind in ("ymd", "dmy") else kind).alias("kind"), new.alias("text"))
        case = F.when(whole(kind), found) if case is None else case.when(whole(kind), found)
    return _with(case, lambda s: F.struct(F.when(s["text"].isNotNull(), s["kind"]).alias("kind"), F.coalesce(s["text"], x).alias("text")))


def _made(docs: DataFrame, key: str) -> DataFrame:
    """docs (with a column text) and `changes` (array of struct<kind, text>) and `masked`."""
    # most texts lack what an address needs, and many what a number needs
    address, none = F.contains("text", F.lit("@")), F.array().cast("array<string>")
    found = F.when(address, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).when(F.col("text").rlike("[0-9]"), F.regexp_extract_all("text", F.lit(NUMERIC), F.lit(0))).otherwise(none)
    hits = docs.withColumn("hits", found)
    some = F.size("hits") > 0
    gaps = hits.withColumn("gaps", F.when(some & address, F.split("text", ANY, -1)).when(some, F.split("text", NUMERIC, -1)))
    changed = gaps.withColumn("changes", F.when(some, F.transform("hits", lambda x: pseudonym(x, F.lit(key)))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")))
    joined = F.array_join(F.transform(F.arrays_zip(F.col("gaps").alias("gap"), F.col("changes").alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"]["text"], F.lit("")))), "")
    return changed.withColumn("masked", F.when(some, joined).otherwise(F.col("text")))


def mask(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and how many of each kind: n_email, n_phone, n_ip, n_date, n_ssn, n_card."""
    made = _made(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    count = lambda kind: F.size(F.filter("changes", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select("doc_id", F.col("masked").alias("text"), *map(count, ("email", "phone", "ip", "date", "ssn", "card")))


def masked(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text; all columns stay."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return _made(row, key).select(*(F.col("masked").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
