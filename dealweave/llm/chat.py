"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parents. Self-joins that double their reach each round (a message knows
its ancestor 1, 2, 4, ... steps up, and the sums over the way) give every leaf its root, depth and path
score in a logarithmic number of rounds; the leaves of a tree are ranked by mean score, and a second
run over the same jump tables, longest first, enumerates the messages of each chosen root-to-leaf path.
Each path is formatted as one conversation, with the spans that count for the loss.

Template: every turn is `### ROLE: TEXT</turn>` and a line feed. Inside roles and texts the control
strings are escaped reversibly: `\\` as `\\0`, `###` as `\\1`, `</turn>` as `\\2`, and `:` in roles as `\\3`,
so an escaped text holds no control string and the output can be read back exactly.

Defined results: null texts and roles are empty; a null conversation id is one conversation; a missing
parent makes a message a root; of messages with equal ids the least by (role, text) stays; messages on a
cycle belong to no path; equal scores are ranked by depth, then id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.common import written

TURN_END = "</turn>"
# Control strings and their escapes, in the order in which they are replaced.
ESCAPES = (("\\", "\\0"), ("###", "\\1"), (TURN_END, "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))


def escape(c, table=ESCAPES) -> F.Column:
    for plain, code in table:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c, table=ESCAPES) -> F.Column:
    for plain, code in reversed(table):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def as_tree(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages: each turn answers the one before; repeated turns go by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = rows.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return out.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _messages(tree: DataFrame) -> DataFrame:
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    rows = tree.select(conv, F.col("msg_id").cast("long").alias("node"), F.col("parent_id").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    least = rows.groupBy("conv", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    return least.select("conv", "node", "m.*")


def jump_tables(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, node, depth, total) of messages that reach a root, and the tables (conv, node, up) of ancestors 1, 2, 4, ... steps up."""
    known = messages.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    now = messages.select("conv", "node", "parent", "score").join(known, ["conv", "parent"], "left")
    up = F.when(F.col("known"), F.col("parent"))
    now = written(now.select("conv", "node", up.alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "jump")
    most = messages.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while (1 << len(jumps)) <= most and not (open_ := now.where("up IS NOT NULL")).isEmpty():
        jumps.append(open_.select("conv", "node", "up"))
        there = now.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        step = open_.join(there, ["conv", "up"]).select("conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        now = written(step.union(now.where("up IS NULL").select(*step.columns)), "jump")
    return now.where("up IS NULL").drop("up"), jumps


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, path, place, role, text): the messages of the `branches` best root-to-leaf paths of each conversation, path being the leaf."""
    messages = written(_messages(tree), "messages")
    reached, jumps = jump_tables(messages)
    parents = messages.select("conv", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = reached.join(parents, ["conv", "node"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")))
    chosen = written(ranked.where(F.col("rank") <= branches).select("conv", F.col("node").alias("path"), "node", F.col("depth").alias("place")), "paths")
    for k in reversed(range(len(jumps))):
        higher = chosen.join(jumps[k], ["conv", "node"]).select("conv", "path", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        chosen = written(chosen.union(higher), "paths")
    return chosen.join(messages.select("conv", "node", "role", "text"), ["conv", "node"]).drop("node")


def format_paths(steps: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv, path, formatted, mask): one row per path; mask has a (turn, turn_start, start, end) in code points for each turn of role `learn`, ends open."""
    head = F.concat(F.lit("### "), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    rows = steps.select("conv", "path", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("part", F.concat("head", "body", F.lit(TURN_END + "\n")))
    before = Window.partitionBy("conv", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turn_start", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    start = F.col("turn_start") + F.length("head")
    span = F.when(F.col("role") == learn, F.struct((F.col("place") - 1).alias("turn"), "turn_start", start.alias("start"), (start + F.length("body")).alias("end")))
    turns = F.sort_array(F.collect_list(F.struct("place", "part", span.alias("span"))))
    out = rows.groupBy("conv", "path").agg(turns.alias("turns"))
    mask = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return out.select("conv", "path", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), mask.alias("mask"))


def format_chats(tree: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """(conv_id: string, path, formatted, mask) of the best branches of each tree (conv_id, msg_id, parent_id, role, text, score)."""
    out = format_paths(paths(tree, branches), learn)
    return out.withColumn("conv_id", F.when(F.col("conv") != "", F.col("conv"))).drop("conv")


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (array of role and text) and learned (array of text), both read from formatted and mask alone."""
    parts = F.split("formatted", TURN_END + "\n", -1)
    out = chats.withColumn("parts", F.slice(parts, F.lit(1), F.size(parts) - 1))

    def turn(p):
        role = F.substring_index(F.substring(p, F.lit(5), F.length(p)), ": ", 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(p, F.length(role) + 7, F.length(p))).alias("text"))

    def under(m):
        part = F.get("parts", m["turn"].cast("int"))
        return unescape(F.substring(part, (m["start"] - m["turn_start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))

    return out.withColumns({"turns": F.transform("parts", turn), "learned": F.transform("mask", under)}).drop("parts")
