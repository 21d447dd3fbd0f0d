"""Conversations from reply trees, as text with turn marks and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm._store import checkpointed

START, END = "<|im_start|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    """No control string is left: backslashes are doubled, then each "<|" gets one between."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(_escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    parts = F.split(role, "\\\\\\\\", -1)  # at doubled backslashes
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))
    return F.array_join(plain, "\\")


def _of(tree: str, node: str) -> Column:
    """Joins the right side's (t, n) to the left side's columns."""
    return F.col(tree).eqNullSafe(F.col("t")) & (F.col(node) == F.col("n"))


def climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (tree, leaf, score, n_turns) with the sums up to their roots, and tables k of (t, n, up): who is 2^k steps up.

    nodes: tree, node, parent, score. Self-joins double the steps: a path of n messages takes log2(n) rounds, each checkpointed.
    A parent that isn't there counts as none; a null tree is a tree of its own. What is on a cycle of parents, or replies to it, has
    no root: the rounds end when the steps exceed the largest tree, and what is still climbing then is in no path.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = nodes.join(known, _of("tree", "parent"), "left").select("tree", "node", F.col("n").alias("up"), "score", F.lit(1).cast("long").alias("n_turns"))
    up = checkpointed(up)
    inner = up.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = up.join(inner, _of("tree", "node"), "left_anti").select("tree", F.col("node").alias("leaf"))
    most = up.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, step = [], 1
    while step <= most and not (climbing := up.where("up IS NOT NULL")).isEmpty():
        jumps.append(climbing.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up"))
        above = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("score").alias("more"), F.col("n_turns").alias("turns"))
        higher = climbing.join(above, _of("tree", "up")).select("tree", "node", F.col("far").alias("up"), F.col("score") + F.col("more"), F.col("n_turns") + F.col("turns"))
        up = checkpointed(up.where("up IS NULL").union(higher))
        step *= 2
    done = up.where("up IS NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), "score", "n_turns")
    return leaves.join(done, _of("tree", "leaf")).select("tree", "leaf", "score", "n_turns"), jumps


def paths_up(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """chosen(tree, leaf, ...) with (node, distance) of every message from the leaf up to its root."""
    paths = chosen.withColumns({"node": F.col("leaf"), "distance": F.lit(0).cast("long")})
    for k, jump in enumerate(jumps):
        longer = paths.join(jump, _of("tree", "node")).withColumns({"node": F.col("up"), "distance": F.col("distance") + (1 << k)})
        paths = checkpointed(paths.unionByName(longer.select(paths.columns)))
    return paths


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, score, n_turns, formatted, loss_spans): the best paths of each tree as conversations.

    messages: tree, node, parent, role, text, score; null roles and texts are empty, null scores 0. The paths of a tree are
    ranked by their summed score, then length, then the smaller leaf; the first `branches` are kept, and only these are followed
    message by message. Of rows that repeat a (tree, node) the least by (parent, role, text, score) counts; rows without a node are left
    out, and so is what is on a cycle of parents or replies to one. Each turn is
    <|im_start|>role, a newline, the text, <|im_end|> and a newline; control strings inside are escaped and can be taken
    back. loss_spans has for each assistant turn its number, the start of its text in `formatted`, the start in
    its own turn, and its length in code points. Further columns are left out; no messages give no rows. One conversation is one
    output row and therefore one group.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    said = F.struct("parent", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    body = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(said).alias("m")).select("tree", "node", "m.*")
    leaves, jumps = climbed(body.select("tree", "node", "parent", "score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    best = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    chosen = paths_up(best.withColumnRenamed("score", "total"), jumps)
    same = _of("tree", "node")
    body = body.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    head = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    turns = chosen.join(body, same).select(
        "tree", "leaf", "branch", "total", "n_turns", (F.col("n_turns") - F.col("distance") - 1).alias("turn"), head.alias("head"), _escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss")
    )
    turns = turns.withColumn("whole", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(F.char_length("whole")).over(before), F.lit(0)))
    span = F.struct("turn", (F.col("begin") + F.char_length("head")).alias("start"), F.char_length("head").alias("inner"), F.char_length("body").alias("length"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "whole")))
    grouped = turns.groupBy("tree", "leaf", "branch", F.col("total").alias("score"), "n_turns").agg(
        F.array_join(F.transform(parts, lambda x: x["whole"]), "").alias("formatted"), F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans")
    )
    return grouped


def read_chats(chats: DataFrame) -> DataFrame:
    """(tree, leaf, turns, loss_text), read back from `formatted` and `loss_spans`: turns is an array of (role, text)."""
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    rows = chats.select("tree", "leaf", "loss_spans", pieces.alias("pieces"))

    def turn(x: Column) -> Column:
        inner = F.substring(x, F.lit(len(START) + 1), F.char_length(x))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(_unescaped_role(role).alias("role"), _unescaped(F.substring(inner, F.char_length(role) + 2, F.char_length(inner))).alias("text"))

    def under(s: Column) -> Column:
        return _unescaped(F.substring(F.get(F.col("pieces"), s["turn"].cast("int")), s["inner"] + 1, s["length"]))

    return rows.select("tree", "leaf", F.transform("pieces", turn).alias("turns"), F.array_join(F.transform("loss_spans", under), "").alias("loss_text"))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Reply trees of conversations(conv_id, turn, role, text): each row replies to the one before it by turn.

    Rows that repeat a turn follow each other in the order of role and text; a null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))
