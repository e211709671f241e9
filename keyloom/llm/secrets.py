"""Secret scans: fixed patterns, and tokens that pass a battery of randomness tests. Column expressions only.

find() gives the spans of assignments, access keys and hexadecimal runs (PATTERNS), and adds
`random`: other tokens (CANDIDATE) that look more random than text does.

The battery takes a token's narrowest encoding (ENCODINGS) and gives three p-values of "its characters
are independent and uniform": the upper tail of the chi-squared of the alphabet's counts, the two-sided
runs test about the alphabet's middle, and the two-sided lag-1 serial correlation. The least of the
three is the token's score.

What is controlled is the share of non-secrets among the reported. The null hypothesis is that a token
is text, and its distribution is taken from the corpus: decoys(), tokens of the same encodings and
lengths made of the documents' own words of less than LEAST characters (joined, in camel case, with
separators, with digits put in), one a document and DECOYS at least in all.
A token's p-value is the share of decoys of its encoding and length class that score as high or higher;
Benjamini and Hochberg's step-up at RATE runs within each length class, so the many short words don't
decide over the few long tokens. Where decoys of a class look as random as keys (short tokens), or are
too few to tell (corpora of short texts), nothing is reported. Tokens that touch a span of PATTERNS are not tested.
A token needs LEAST characters, below which decoys and keys don't differ, and a letter: digits alone
are numbers. Decoys have the least length of their class, at which text looks most random.
Scores are counted in BINS by class and encoding (counts()): some thousand counts come to the driver
however many tokens there are.

A span is kind:start:end in code points, end exclusive, of the whole match. Null counts as empty:
no spans. Equal scores are reported or left together. Repeated rows stay; extra columns are ignored by
find() and kept by redact(), which puts [SECRET] for each stretch that spans cover and leaves rows
without spans (and nulls) as they are. Both read the texts once and write what they found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import texts

#: The kinds in order, their patterns, and the length that a match (of assign: its value) needs.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
}
#: What a text must hold, in lower case, for a match: most texts need no pattern then.
MARKS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "hex": ()}
LEAST = 16
#: '=' only ends a candidate, as padding: what follows it (NAME=value) is one of its own.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
#: What decoys are not made of: candidates, and words at the edges of a stretch, which can be parts of some.
CUT = rf"[A-Za-z0-9+/_-]{{{LEAST},}}|^[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]+$"
#: Encodings from the narrowest: alphabet in order of code. The URL-safe signs count as the other two.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Expected share of non-secrets among the reported; least lengths of the classes; bins of scores; decoys in all, at least (and one a document).
RATE, LENGTHS, BINS, DECOYS = 0.02, (LEAST, 23, 32, 46, 64), 200, 1 << 14
REDACTED = "[SECRET]"


def _places(gaps: Column, hits: Column) -> Column:
    """array<struct<a, b>>: where hits lie, in code points, given the gaps before them."""
    empty = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(0).alias("at"))
    sizes = F.arrays_zip(F.transform(gaps, lambda x: F.char_length(x)).alias("gap"), F.transform(hits, lambda x: F.char_length(x)).alias("hit"))

    def step(acc, x):
        a = acc["at"] + x["gap"]
        b = a + F.coalesce(x["hit"], F.lit(0))
        return F.struct(F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(a.alias("a"), b.alias("b")))).alias("out"), b.alias("at"))

    return F.aggregate(sizes, empty, step, lambda acc: acc["out"])


def _encoding(token: Column) -> Column:
    """struct<code, alphabet>: number and alphabet of the first encoding that holds all of the token; padding is cut and URL-safe signs translated before."""
    case = None
    for code, alphabet in enumerate(ENCODINGS.values()):
        fit = F.struct(F.lit(code).alias("code"), F.lit(alphabet).alias("alphabet"))
        test = F.translate(token, alphabet, "") == ""
        case = F.when(test, fit) if case is None else case.when(test, fit)
    return case


def _let(value: Column, make) -> Column:
    """make(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _upper(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, error below 1e-7)."""

    def tail(z):
        t = F.struct(F.abs(z).alias("x"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t"), z.alias("z"))
        return _let(t, of)

    def of(v):
        x, t = v["x"], v["t"]
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        half = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
        return F.when(v["z"] >= 0, half).otherwise(1 - half)

    return _let(z, tail)


def p_value(token: Column, alphabet: Column) -> Column:
    """The least p of the battery, for a token of this alphabet's characters."""
    codes = lambda v: F.transform(F.split(v["token"], ""), lambda c: (F.instr(v["alphabet"], c) - 1).cast("double"))
    inputs = F.struct(token.alias("token"), alphabet.alias("alphabet"), F.length(token).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"))
    return _let(inputs, lambda v: _let(F.struct(v.alias("v"), codes(v).alias("codes")), lambda w: _battery(w["v"], w["codes"])))


def _battery(v: Column, codes: Column) -> Column:
    token, n, k = v["token"], v["n"], v["k"]
    without = lambda x, c: F.length(F.replace(x, c, F.lit("")))
    zero = F.lit(0.0)
    tallies = F.aggregate(F.array_distinct(F.split(token, "")), zero, lambda s, c: s + F.pow(n - without(token, c), F.lit(2.0)))
    # below and from the alphabet's middle
    half = (k / 2).cast("int")
    sides = F.call_function("translate", token, v["alphabet"], F.concat(F.repeat(F.lit("L"), half), F.repeat(F.lit("H"), half)))
    runs = F.length(F.regexp_replace(F.regexp_replace(sides, "L+", "L"), "H+", "H")).cast("double")
    products = F.aggregate(F.zip_with(F.slice(codes, 1, (n - 1).cast("int")), F.slice(codes, 2, (n - 1).cast("int")), lambda x, y: x * y), zero, lambda s, x: s + x)
    whole = F.struct(
        tallies.alias("tallies"), without(sides, F.lit("L")).cast("double").alias("high"), runs.alias("runs"),
        F.aggregate(codes, zero, lambda s, c: s + c).alias("sum"), F.aggregate(codes, zero, lambda s, c: s + c * c).alias("squares"), products.alias("products"),
    )

    def moments(s):
        mean = 2 * s["high"] * (n - s["high"]) / n + 1
        middle = s["sum"] / n
        return F.struct(
            (s["tallies"] * k / n - n).alias("chi"), s["runs"].alias("runs"), mean.alias("mean"), ((mean - 1) * (mean - 2) / (n - 1)).alias("spread"),
            (s["squares"] / n - middle * middle).alias("variance"), (s["products"] / (n - 1) - middle * middle).alias("along"),
        )

    def least(s):
        df = k - 1
        # Wilson and Hilferty
        p_chi = _upper((F.pow(F.greatest(s["chi"], zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        p_runs = F.when(s["spread"] > 0, 2 * _upper(F.abs(s["runs"] - s["mean"]) / F.sqrt(s["spread"]))).otherwise(zero)
        # the sum of products of neighbours about the mean, without its end terms, which vanish against it
        r = F.when(s["variance"] > 0, s["along"] / s["variance"]).otherwise(F.lit(1.0))
        return F.least(F.lit(1.0), p_chi, p_runs, 2 * _upper(F.abs(r) * F.sqrt(n)))

    return _let(_let(whole, moments), least)


def scored(token: Column) -> Column:
    """struct<class, code, bin> of a token without padding and with the signs of base64."""

    def score(x):
        p = p_value(x["token"], x["at"]["alphabet"])
        n = F.length(x["token"])
        group = sum(((n >= least).cast("int") for least in LENGTHS[1:]), F.lit(0))
        return F.struct(group.alias("class"), x["at"]["code"].alias("code"), F.floor(p * BINS).cast("int").alias("bin"))

    return _let(token, lambda t: _let(F.struct(t.alias("token"), _encoding(t).alias("at")), score))


def _candidates(gaps: Column, tokens: Column, base: Column) -> Column:
    """array<struct<a, b, score>> of the tokens that can be keys: a letter, LEAST characters without padding, no base span."""
    plain = lambda x: F.translate(F.rtrim(x, F.lit("=")), "-_", "+/")
    zipped = F.arrays_zip(_places(gaps, tokens).alias("at"), tokens.alias("token"))
    free = F.filter(zipped, lambda x: x["token"].rlike("[A-Za-z]") & ~F.exists(base, lambda y: (y["a"] < x["at"]["b"]) & (x["at"]["a"] < y["b"])))
    return F.transform(free, lambda x: F.struct(x["at"]["a"].alias("a"), x["at"]["b"].alias("b"), scored(plain(x["token"])).alias("score")))


def decoys(text: Column, seed: Column, many: int) -> Column:
    """array<string>: tokens made of stretches of a text, by hashes of seed; fewer where the text is short."""

    def make(i):
        h = lambda what, n: F.pmod(F.xxhash64(F.lit(what), seed, i), F.lit(n))
        n = F.element_at(F.array(*map(F.lit, LENGTHS)), (h("length", len(LENGTHS)) + 1).cast("int"))
        at = F.floor(h("place", 1 << 30) / float(1 << 30) * F.greatest(F.lit(1), F.length(text) - 2 * n)).cast("int") + 1
        style = h("style", len(ENCODINGS) + 1) + 1  # 0, the first encoding, is a pattern of its own
        return F.struct(n.alias("n"), text.substr(at, F.when(style == 1, 6).otherwise(2) * n + 2 * LEAST).alias("raw"), style.alias("style"), h("digits", 20000).alias("digits"))

    def spell(x):
        raw, style = F.regexp_replace(x["raw"], CUT, ""), x["style"]
        keep = lambda y, other: F.regexp_replace(y, other, "")
        signs = F.regexp_replace(raw, "[^A-Za-z0-9]+", "+")
        long = (
            F.when(style == 1, keep(F.upper(raw), "[^0-9A-F]+")).when(style == 2, keep(F.upper(raw), "[^A-Z2-7]+"))
            .when(style == 3, keep(F.lower(raw), "[^0-9a-z]+")).when(style == 4, keep(F.upper(raw), "[^0-9A-Z]+")).when(style == 5, keep(raw, "[^0-9A-Za-z]+"))
            .when(style == 6, keep(F.initcap(raw), "[^0-9A-Za-z]+")).when(style == 7, signs).otherwise(F.replace(F.initcap(signs), F.lit("+"), F.lit("/")))
        )
        token = F.substring(long, F.lit(1), x["n"])
        # half of them get a number of one to four digits
        number = x["digits"].cast("string")
        put = F.overlay(token, number, F.floor(x["n"] / 2).cast("int"))
        return F.struct(x["n"].alias("n"), F.when((x["digits"] < 10000) & (style > 2), put).otherwise(token).alias("token"))

    spelt = F.transform(F.transform(F.sequence(F.lit(1), F.lit(many)), make), spell)
    return F.transform(F.filter(spelt, lambda x: F.length(x["token"]) == x["n"]), lambda x: x["token"])


def _hits(df: DataFrame, name: str, pattern: str, marks=()) -> DataFrame:
    """df with the matches of a pattern and, where there are any, the gaps."""
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if marks:
        some = [F.contains(F.lower("text"), F.lit(m)) for m in marks]
        hits = F.when(F.array_contains(F.array(*some), True) if len(some) > 1 else some[0], hits).otherwise(none)
    found = df.withColumn(f"{name}_hit", hits)
    return found.withColumn(f"{name}_gap", F.when(F.size(f"{name}_hit") > 0, F.split("text", pattern, -1)).otherwise(none))


def _spans(kind: str, order: int, least: int) -> Column:
    zipped = F.arrays_zip(_places(F.col(f"{kind}_gap"), F.col(f"{kind}_hit")).alias("at"), F.col("assign_value" if kind == "assign" else f"{kind}_hit").alias("value"))
    return F.transform(
        F.filter(zipped, lambda x: F.char_length(x["value"]) >= least),
        lambda x: F.struct(x["at"]["a"].alias("a"), F.lit(order).alias("order"), x["at"]["b"].alias("b"), F.lit(kind).alias("kind")),
    )


def scan(df: DataFrame, seed: Column, least: int = DECOYS) -> DataFrame:
    """df (with a text that isn't null) and base, an array of spans in order; candidates with their scores; and scores of decoys."""
    columns, many = df.columns, -(-least // max(df.count(), 1)) or 1
    for kind, (pattern, _) in PATTERNS.items():
        df = _hits(df, kind, pattern, MARKS[kind])
    value = F.when(F.size("assign_hit") > 0, F.regexp_extract_all("text", F.lit(PATTERNS["assign"][0]), F.lit(1))).otherwise(F.array().cast("array<string>"))
    df = _hits(df, "free", CANDIDATE).withColumn("assign_value", value)
    kinds = [_spans(kind, order, least) for order, (kind, (_, least)) in enumerate(PATTERNS.items())]
    df = df.withColumn("base", F.array_sort(F.concat(*kinds)))
    df = df.withColumn("candidates", _candidates(F.col("free_gap"), F.col("free_hit"), F.col("base")))
    return df.withColumn("decoys", F.transform(decoys(F.col("text"), seed, many), scored)).select(*columns, "base", "candidates", "decoys")


def counts(scanned: DataFrame) -> dict[tuple[bool, int, int], dict[int, int]]:
    """By (decoy, class, code): how many tokens have each bin."""
    one = lambda name, decoy, get: F.transform(name, lambda x: F.struct(F.lit(decoy).alias("decoy"), get(x).alias("score")))
    each = scanned.select(F.explode(F.concat(one("candidates", False, lambda x: x["score"]), one("decoys", True, lambda x: x))).alias("x")).select("x.decoy", "x.score.*")
    out: dict = {}
    for r in each.groupBy("decoy", "class", "code", "bin").agg(F.count("*").alias("n")).collect():  # 2 * LENGTHS * ENCODINGS * (BINS + 1) rows at most
        out.setdefault((r["decoy"], r["class"], r["code"]), {})[r["bin"]] = r["n"]
    return out


def thresholds(tallies: dict[tuple[bool, int, int], dict[int, int]], rate: float = RATE) -> dict[tuple[int, int], int]:
    """By (class, code), the least bin that is reported (absent: none is)."""
    limits = {}
    for group in {c for decoy, c, _ in tallies if not decoy}:
        mine = {code: bins for (decoy, c, code), bins in tallies.items() if not decoy and c == group}
        cells = []  # p-value, tokens, code, bin
        for code, bins in mine.items():
            null = tallies.get((True, group, code), {})
            total = sum(null.values())
            cells += [((1 + sum(n for at, n in null.items() if at >= b)) / (1 + total), many, code, b) for b, many in bins.items()]
        cells.sort()
        m, seen, last = sum(n for _, n, _, _ in cells), 0, -1.0
        for i, (p, many, _, _) in enumerate(cells):
            seen += many
            if (i + 1 == len(cells) or cells[i + 1][0] > p) and p <= rate * seen / m:
                last = p
        for p, _, code, b in cells:
            if p <= last:
                limits[group, code] = min(b, limits.get((group, code), b))
    return limits


def with_spans(scanned: DataFrame, limits: dict[tuple[int, int], int]) -> DataFrame:
    """scanned and spans: base, and the candidates that thresholds() reports."""
    key = lambda group, code: group * len(ENCODINGS) + code
    known = F.create_map(*(F.lit(v) for k, b in (limits or {(-1, 0): 0}).items() for v in (key(*k), b)))
    passed = F.filter("candidates", lambda x: x["score"]["bin"] >= F.coalesce(F.try_element_at(known, key(x["score"]["class"], x["score"]["code"])), F.lit(BINS + 1)))
    more = F.transform(passed, lambda x: F.struct(x["a"].alias("a"), F.lit(len(PATTERNS)).alias("order"), x["b"].alias("b"), F.lit("random").alias("kind")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", more)))


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans: arrays of struct<a, order, b, kind> by start and kind."""
    rows = texts(docs)
    scanned = written(scan(rows, F.xxhash64("doc_id", "text")).drop("text"), "scanned")
    return with_spans(scanned, thresholds(counts(scanned), rate)).select("doc_id", "base", "spans")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with [SECRET] for each stretch of secrets in text; n_chars, if there is one, follows. All columns stay, in order."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    scanned = written(scan(kept, F.xxhash64("row.doc_id", "text")).drop("text"), "scanned")
    found = with_spans(scanned, thresholds(counts(scanned), rate)).withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        # a span that overlaps the one before only lengthens it
        new = x["a"] >= acc["at"]
        gap = F.when(new, F.concat(F.col("text").substr(acc["at"] + 1, x["a"] - acc["at"]), F.lit(REDACTED))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], x["b"]).alias("at"))

    cut = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col("row.text"))
    out = found.select("row", text.alias("text"), (F.size("spans") > 0).alias("changed"))
    columns = []
    for f in docs.schema:
        own = F.col("row")[f.name]
        if f.name == "text":
            own = F.col("text")
        elif f.name == "n_chars":
            own = F.when(F.col("changed"), F.char_length("text").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return out.select(*columns)
