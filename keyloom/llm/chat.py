"""Chat formatting from reply trees: DataFrame operations only.

paths() takes nodes (tree, node, parent, score): node is unique in its tree; a parent that is
null or absent makes a root. Iterative self-joins double the distance to an ancestor with each
step, which gives each node's depth and its branch's mean score after log2(depth) joins; the
leaves are ranked by that score (ties: the lower leaf), and the steps taken backwards list the
nodes on the chosen paths. Only ids are joined; texts come in at the end. Nodes on a cycle have no
root: no path holds them.

conversations() writes each chosen path as one string. Turns are marked START role MIDDLE text END;
control strings inside roles and texts get a backslash after their first character, and
backslashes are doubled, so parsing is exact. `mask` lists the stretches (start, length, in code
points) of assistant texts, between the marks. read() parses strings back.

Null roles, texts and scores count as empty and 0; a null tree is one tree for conversations(). Equal rows of a conversation are turns of their
own in linear_nodes(), which orders turns (null first) and then roles and texts. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: The template's marks, and the strings that texts must not hold unescaped.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SPOKEN = "assistant"


def escape(x: Column) -> Column:
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def linear_nodes(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Nodes of conversations that are lists of turns: each turn answers the one before."""
    turns = rows.select(F.col(tree).cast("long").alias("tree"), F.col(order).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return turns.withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, leaf, rank, branch_score, node, depth (root: 1): the nodes on each tree's `top` best root-to-leaf paths."""
    ids = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    real = ids.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    here = written(ids.join(real, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there") == 1, F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "up")
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    # each step joins only what has not reached its root; what has stays in the parts before
    parts, steps = [here.filter("up IS NULL")], []
    active = here.filter("up IS NOT NULL")
    for _ in range((longest - 1).bit_length()):
        steps.append(active)
        known = active
        for part in parts:
            known = known.union(part)
        far = known.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        joined = written(active.join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), "up")
        parts.append(joined.filter("up IS NULL"))
        active = joined.filter("up IS NOT NULL")
    full = parts[0]
    for part in parts[1:]:
        full = full.union(part)
    parents = here.filter("up IS NOT NULL").select("tree", F.col("up").alias("node"))
    leaves = full.join(parents, ["tree", "node"], "left_anti").withColumn("branch_score", F.col("total") / F.col("depth"))
    if top == 1:
        best = leaves.groupBy("tree").agg(F.max(F.struct("branch_score", (-F.col("node")).alias("low"))).alias("x")).select("tree", (-F.col("x.low")).alias("leaf"), F.lit(1).alias("rank"), F.col("x.branch_score").alias("branch_score"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "node"))
        best = leaves.withColumn("rank", rank).filter(F.col("rank") <= top).select("tree", F.col("node").alias("leaf"), "rank", "branch_score")
    held = best.withColumn("node", F.col("leaf"))
    for step in reversed(steps):
        held = written(held.union(held.join(step.select("tree", "node", "up"), ["tree", "node"]).select("tree", "leaf", "rank", "branch_score", F.col("up").alias("node"))), "held")
    return held.join(full.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "rank", "branch_score", "node", "depth")


def conversations(nodes: DataFrame, top: int = 1, spoken: str = SPOKEN) -> DataFrame:
    """tree, leaf, rank, branch_score, formatted, mask (array of struct<start, size>)."""
    nodes = nodes.withColumn("tree", F.struct("tree"))  # which is never null, and joins
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths(nodes, top).join(said, ["tree", "node"])
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)), escape(F.col("text"))
    pieces = turns.select("tree", "leaf", "rank", "branch_score", "depth", (F.col("role") == spoken).alias("spoken"), F.char_length(head).alias("before"), F.char_length(body).alias("size"), F.concat(head, body, F.lit(END)).alias("piece"))
    earlier = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("piece")).over(earlier), F.lit(0)) + F.col("before")
    placed = pieces.withColumn("stretch", F.when(F.col("spoken"), F.struct(at.cast("long").alias("start"), F.col("size").cast("long").alias("size"))))
    whole = placed.groupBy("tree", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "stretch"))).alias("turns"))
    return whole.select("tree.tree", "leaf", "rank", "branch_score", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda x: x["stretch"]), lambda x: x.isNotNull()).alias("mask"))


def read(formatted: DataFrame) -> DataFrame:
    """conversations()'s rows with turns (array of struct<role, text>) and spoken (array of texts under the mask), parsed from the string."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)

    def turn(x):
        at = F.instr(x, MIDDLE)
        return F.struct(unescape(x.substr(F.lit(len(START) + 1), at - len(START) - 1)).alias("role"), unescape(x.substr(at + len(MIDDLE), F.length(x))).alias("text"))

    turns = F.transform(F.filter(parts, lambda x: x != ""), turn)
    spoken = F.transform("mask", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), spoken.alias("spoken"))


def digests(parsed: DataFrame) -> DataFrame:
    loss = F.array_join("spoken", "")
    return parsed.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
