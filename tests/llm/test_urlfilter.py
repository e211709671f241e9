import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from keyloom.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "https://example.org/en/12?x=/de/#f", "https://x.org/en/2", "https://org/", "https://notorg/", "https://x.org", "https://b.com/fr/9", "https://b.com/de/1#a", "https://b.com/en/", "x://y.net?a=1&b=2",
    "https://badexample.org/es/", "https://com/de/", "http://é.com/de/x y",
]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(t), t, a) for a, t in urlfilter.RULES for h, s, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_equal_plain_code(spark, sf):
    odd = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS label", "3 AS slot")
    for pages in (odd, odd.union(odd), spark.read.parquet(f"{sf}/pages.parquet")):
        got = urlfilter.judge(pages).collect()
        assert len(got) == pages.count()
        by = {r.page_id: r.url for r in pages.collect()}
        for r in got:
            host, path, text, verdict = plain(by[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, text) and r.verdict in ("allow", "block")
            assert verdict in (None, r.verdict) and (r.score is None) == (text is not None)
    assert urlfilter.judge(odd.filter("false")).collect() == []
    assert {r.verdict for r in urlfilter.judge(odd, rules=[]).collect()} == {"allow"}


def test_trees_learn_from_labels(spark):
    """Held-out accuracy on a lexical rule."""
    rows = [(i, f"https://h{i % 7}.example.com/{'a/' * (i % 5)}{'9' * (i * 7 % 11)}?q={i}{'&x=1' * (i % 4)}") for i in range(1200)]
    label = lambda u: int(u.count("&") >= 2)
    labelled = spark.createDataFrame([(u, label(u)) for _, u in rows[:800]], "url string, blocked int")
    got = urlfilter.judge(spark.createDataFrame(rows[800:], "page_id long, url string"), rules=[], labelled=labelled).collect()
    assert sum((r.verdict == "block") == bool(label(dict(rows)[r.page_id])) for r in got) / len(got) > 0.95


def test_verdicts_do_not_depend_on_partitions(spark, sf):
    """Far more labelled rows than train_rows: any cut of the table gives the same verdicts and scores."""
    pages = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/pages.parquet").select("page_id", "url")
    cuts = (pages, pages.repartition(7), pages.repartition(3, "url").sortWithinPartitions(F.desc("page_id")))
    first, *rest = ([tuple(r) for r in urlfilter.judge(x, train_rows=300).orderBy("page_id").collect()] for x in cuts)
    assert len(first) == 2500 and all(x == first for x in rest)


def test_training_rows(spark):
    """Half of each label, different urls, least by the hash; repeated rows of one url count once."""
    rows = [(f"http://h/{i % 50}", float(i % 50 < 10), *([0.5] * len(urlfilter.FEATURES))) for i in range(500)]
    known = spark.createDataFrame(rows, "url string, label double, " + ", ".join(f"{f} double" for f in urlfilter.FEATURES))
    for bound, want in ((20, (10, 10)), (40, (20, 10)), (400, (40, 10))):
        got = Counter(r.label for r in urlfilter.training(known, bound).collect())
        assert (got[0.0], got[1.0]) == want


def test_suffix_shares():
    """By brute force over rows: what a fold sees of a suffix holds no row of the fold."""
    r = random.Random(3)
    rows = [(r.randrange(4), r.randrange(urlfilter.FOLDS), float(r.random() < 0.3)) for _ in range(300)]
    cells = Counter((s, f) for s, f, _ in rows)
    marked = [(s, f, n, sum(y for a, b, y in rows if (a, b) == (s, f))) for (s, f), n in cells.items()]
    seen = {s: 10 * (s + 1) for s in range(5)}
    got = urlfilter.suffix_shares(seen, marked)
    assert len(got) == 5 * (urlfilter.FOLDS + 1)
    for slot, fold, pages, blocked in got:
        others = [y for _, f, y in rows if f != fold]
        mine = [y for s, f, y in rows if f != fold and s == slot]
        prior = (sum(others) + 1) / (len(others) + 2)
        assert math.isclose(pages, seen[slot] / 150) and math.isclose(blocked, (sum(mine) + 10 * prior) / (len(mine) + 10))


def test_one_label_null_ids_and_long_urls(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x"), (None, None), (1, "http://" + "a" * 70000 + ".com/" + "b/" * 40000), (1, "http://q.net/" + "9" * 100)], "page_id long, url string")
    for blocked, verdict in ((1, "block"), (0, "allow")):
        labelled = spark.createDataFrame([("http://z.com/1", blocked), ("http://z.com/2", None)], "url string, blocked int")
        got = urlfilter.judge(pages, rules=[], labelled=labelled).collect()
        assert len(got) == 4 and {r.verdict for r in got} == {verdict}
    labelled = spark.createDataFrame([("http://z.com/1", 1), ("http://z.com/2", 0), ("http://" + "z" * 70000, 0)], "url string, blocked int")
    got = urlfilter.judge(pages, labelled=labelled).collect()
    assert len(got) == 4 and all(r.verdict in ("allow", "block") for r in got) and max(len(r.path) for r in got) == 80001


def test_entropy(spark):
    words = ["a", "ab", "aab", "https://x.y/zz", "", "éé中"]
    got = {r.w: r.e for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", urlfilter.entropy(F.col("w")).alias("e")).collect()}
    for w in words:
        assert math.isclose(got[w], -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values()) if w else 0.0, abs_tol=1e-9)
