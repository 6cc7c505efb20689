"""Conversations out of reply trees, with DataFrame functions only.

Each message names its parent. Self-joins on the parent double the known part of every path (the ancestor
2**k steps up, the scores on the way), so the number of joins is the logarithm of the depth. A leaf stands
for the path from its root; branches are ranked by mean score, ties by leaf id, and each chosen path becomes
one conversation in the template

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

for each turn. In texts every `<`, any number of `%`, `|` gets one more `%`, so no control string is left and
one `%` less gives the text back. In roles `%`, line feed and `<` are written %25, %0A and %3C.

Edge cases: null texts and roles are empty strings; a null, missing or own parent makes a message a root;
messages of a cycle have no root and are left out; of rows with one (conversation, id) the first by role and
text is kept; null conversation ids are one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import store

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(%*)\|", r"<%$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<%(%*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees of one branch: (conv, id, parent, role, text, score); ties of turn go by role, then text."""
    w = Window.partitionBy(conv).orderBy(turn, F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    numbered = rows.select(F.col(conv).alias("conv"), F.row_number().over(w).cast("long").alias("id"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return numbered.select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(conv, leaf, score, pos, id): the chosen root-to-leaf paths, pos 0 at the root.

    messages: conv, id, parent, score (null score: 0). top: branches kept of each conversation; None keeps all.
    """
    key = F.coalesce(F.col("conv").cast("string"), F.lit("\0null"))
    nodes = store(messages.select("conv", key.alias("tree"), F.col("id"), F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    known = nodes.select("tree", F.col("id").alias("parent"))
    linked = nodes.join(known.withColumn("real", F.lit(True)), ["tree", "parent"], "left")
    level = store(linked.select("tree", "id", F.when(F.col("real"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "paths")
    levels, most = [level], nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(levels) - 1)) < most:
        here = levels[-1]
        there = here.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        joined = here.join(there, ["tree", "up"], "left")
        levels.append(store(joined.select("tree", "id", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps")), "paths"))
    parents = level.where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    rooted = levels[-1].where("up IS NULL")
    leaves = rooted.join(parents, ["tree", "id"], "left_anti").withColumn("score", F.col("total") / F.col("steps"))
    if top is not None:
        w = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
        leaves = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    found = leaves.select("tree", F.col("id").alias("leaf"), "score", "steps", F.lit(0).cast("long").alias("above"), "id")
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].where("up IS NOT NULL").select("tree", "id", "up")
        found = found.unionByName(found.join(step, ["tree", "id"]).select("tree", "leaf", "score", "steps", (F.col("above") + (1 << k)).alias("above"), F.col("up").alias("id")))
        found = store(found, "members") if k % 4 == 0 and k else found
    return found.select("tree", "leaf", "score", (F.col("steps") - 1 - F.col("above")).alias("pos"), "id")


def format_trees(messages: DataFrame, top: int | None = None, trained: str = "assistant") -> DataFrame:
    """One row for each chosen path: conv, leaf, score, formatted string, spans array<struct<start, chars>>.

    spans lists the code point ranges of formatted that are under the loss mask: the texts of role trained.
    """
    first = messages.groupBy("conv", "id").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", "score")).alias("m")).select("conv", "id", "m.*")
    first = store(first, "messages")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    key = F.coalesce(F.col("conv").cast("string"), F.lit("\0null"))
    turns = paths(first, top).join(first.select("conv", key.alias("tree"), "id", "role", "text"), ["tree", "id"])
    w = Window.partitionBy("tree", "leaf").orderBy("pos")
    turn = F.concat(head, body, F.lit(END + "\n"))
    before = F.sum(F.length(turn)).over(w) - F.length(turn) + F.length(head)
    placed = turns.select("conv", "tree", "leaf", "score", "pos", turn.alias("turn"), F.when(F.col("role") == trained, F.struct(before.alias("start"), F.length(body).cast("long").alias("chars"))).alias("span"))
    each = placed.groupBy("tree", "leaf").agg(F.first("conv").alias("conv"), F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "turn", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return each.select("conv", "leaf", "score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(bare, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
