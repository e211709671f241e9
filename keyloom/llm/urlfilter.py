"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

judge() splits each url, applies the longest rule that fits, and has the trees judge the others.
The trees are trained from labelled URLs: those that a rule decides, or rows of `labelled` (url,
blocked). Of each of the two labels the train_rows / 2 different URLs least by a hash (ties by the
url) are fitted, in that order in one small file, weighted back to the labels' shares: which rows
train, and so every verdict, doesn't depend on how the tables are partitioned. The features are
lexical: length, depth, digit share, entropy, parameters, host labels, hyphens, and two statistics of
the url's suffix (the host's last label, hashed to SUFFIXES slots, so that their table has a fixed
size): its share of all pages and the smoothed share of blocks of its labelled ones. For a row that
trains, the latter leaves out the rows of its own fold (FOLDS, by a hash of the url), so that no row
tells its own label.

A null url, or one without ://, has an empty host and path and fits no rule; the trees judge it too.
Without labelled urls of both kinds, all that no rule fits get the verdict of the one kind there is,
else allow. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written

#: Action, and host with the start of the path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
TRAIN_ROWS, TREES, DEPTH, SUFFIXES, FOLDS, SEED = 10_000, 12, 4, 4096, 5, 7
#: Labelled rows that the prior counts as in a suffix's share of blocks.
PRIOR = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_fragment", "f_suffix", "f_blocked"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    case = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        found = F.struct(F.lit(text).alias("rule"), F.lit(action).alias("verdict"))
        case = F.when(fits, found) if case is None else case.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if case is None else case


def entropy(x: Column) -> Column:
    """Bits a character of a string."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    weigh = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(s, c):
        same = c == s["last"]
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + weigh(s["run"])).alias("sum"))

    n = F.greatest(F.length(x), F.lit(1)).cast("double")
    return F.aggregate(F.array_sort(F.split(x, "")), start, step, lambda s: F.log2(n) - (s["sum"] + weigh(s["run"])) / n)


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the features of a url by itself, and slot, of its suffix."""
    url = F.coalesce("url", F.lit(""))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return df.withColumns({
        "f_length": F.length(url).cast("double"), "f_host": F.length("host").cast("double"), "f_path": F.length("path").cast("double"),
        "f_depth": count(F.col("path"), "/").cast("double"), "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "f_entropy": entropy(url), "f_params": (count(url, "&") + F.contains(url, F.lit("?")).cast("int")).cast("double"),
        "f_labels": count(F.col("host"), ".").cast("double"), "f_hyphens": count(F.col("host"), "-").cast("double"), "f_fragment": F.contains(url, F.lit("#")).cast("double"),
        "slot": F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIXES)),
    })


def suffix_shares(seen: dict[int, int], marked: list[tuple[int, int, int, float]]) -> list[tuple[int, int, float, float]]:
    """(slot, fold, share of pages, smoothed share of blocks among the labelled rows outside the fold; fold -1: among all), from (slot, fold, labels, blocks)."""
    pages = max(sum(seen.values()), 1)
    slots, folds = {}, {f: [0, 0.0] for f in range(FOLDS)}
    for slot, fold, labels, blocks in marked:
        slots.setdefault(slot, {})[fold] = (labels, blocks)
        folds[fold] = [folds[fold][0] + labels, folds[fold][1] + blocks]
    all_labels, all_blocks = (sum(f[i] for f in folds.values()) for i in (0, 1))
    out = []
    for fold in (-1, *range(FOLDS)):
        own = folds.get(fold, (0, 0.0))
        prior = (all_blocks - own[1] + 1) / (all_labels - own[0] + 2)
        for slot in sorted(seen.keys() | slots.keys()):
            rest = [x for f, x in slots.get(slot, {}).items() if f != fold]
            out.append((slot, fold, seen.get(slot, 0) / pages, (sum(x[1] for x in rest) + PRIOR * prior) / (sum(x[0] for x in rest) + PRIOR)))
    return out


def training(known: DataFrame, train_rows: int) -> DataFrame:
    """label and the features of at most train_rows different urls, half of each label, in one order: least by a hash, ties by url."""
    slice_ = F.pmod(F.xxhash64(F.lit("train"), "url"), F.lit(1 << 30))
    picked = None
    for label in (0.0, 1.0):
        mine = known.filter(F.col("label") == label).withColumn("mark", slice_)
        # twice the wanted share of the different urls comes to the sort (all, where they are few)
        different = mine.agg(F.approx_count_distinct("url", 0.02).alias("n")).first()["n"]
        near = mine.filter(F.col("mark") < F.lit(min(1.0, train_rows / max(different, 1)) * (1 << 30)))
        least = near.select("mark", "url", "label", *FEATURES).distinct().orderBy("mark", "url").limit(train_rows // 2)
        picked = least if picked is None else picked.union(least)
    return picked.orderBy("mark", "url", "label").limit(train_rows).select("label", *FEATURES)


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block; null where a rule decides)."""
    spark = pages.sparkSession

    def split(df, *more):
        own = df.select(*more, F.col("url").cast("string").alias("url"))
        host, path = parts(own["url"])
        own = own.withColumns({"host": host, "path": path})
        return lexical(own.withColumn("found", rule(F.col("host"), F.col("path"), rules)))

    urls = split(pages, "page_id")
    known = urls.withColumn("label", (F.col("found.verdict") == "block").cast("double")).filter("found IS NOT NULL") if labelled is None else split(labelled, F.col("blocked").cast("double").alias("label")).filter("label IS NOT NULL")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))
    # one pass each: counts by slot and fold, at most SUFFIXES * FOLDS rows
    seen = {r["slot"]: r["n"] for r in urls.groupBy("slot").agg(F.count("*").alias("n")).collect()}
    marked = known.groupBy("slot", fold.alias("fold")).agg(F.count("*").alias("labels"), F.sum("label").alias("blocks")).collect()
    shares = suffix_shares(seen, [(r["slot"], r["fold"], r["labels"], r["blocks"]) for r in marked])
    table = spark.createDataFrame(shares, "slot long, fold long, f_suffix double, f_blocked double")
    labels, blocks = sum(r["labels"] for r in marked), sum(r["blocks"] for r in marked)
    # fold -1 leaves nothing out
    whole = lambda df, fold: df.withColumn("fold", fold).join(F.broadcast(table), ["slot", "fold"], "left").na.fill(0.0, ["f_suffix", "f_blocked"])

    if not 0 < blocks < labels:
        rest = urls.withColumn("score", F.lit(float(blocks > 0)))
    else:
        train = written(training(whole(known, fold), train_rows), "training")
        taken = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        weight = F.when(F.col("label") == 1, F.lit(blocks / taken[1.0])).otherwise(F.lit((labels - blocks) / taken[0.0]))
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False, weightCol="weight").fit(assemble.transform(train.withColumn("weight", weight)))
        drop_written(spark, train)
        rest = model.transform(assemble.transform(whole(urls, F.lit(-1)))).withColumn("score", vector_to_array("probability")[1])
    return rest.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.when(F.col("found").isNull(), F.col("score")).alias("score"))
