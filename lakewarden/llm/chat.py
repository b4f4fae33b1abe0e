r"""Chat formatting over reply trees.

Messages point to the one they answer. Iterated self-joins enumerate every path
from a root to a leaf: jump tables hold each message's ancestor 2^k steps up,
and from each leaf all ancestors are reached by taking the jumps from the
longest to the shortest, so a thread of n messages takes log2(n) joins. Branches
are ranked by the sum of their messages' scores, and each chosen path becomes
one text with turn markers, and a mask of what a model is to learn.

Control strings inside a text are escaped, and can be read back: a backslash is
doubled, and one is put behind the first character of each control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

# The template's markers, and control strings of public chat templates
START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|nl|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    for control in CONTROL:
        text = F.replace(text, F.lit(f"{control[0]}\\{control[1:]}"), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def threads(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages (conv, id, parent, role, text, score) of linear conversations: each turn answers the one before."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    at = F.row_number().over(order).cast("bigint")
    return rows.select("conv", at.alias("id"), "role", "text").select(
        "conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, branch, up, role, text): the chosen paths; ``up`` counts the steps to the leaf.

    Branches are numbered from 1 by descending score, ties by the leaf's id. A
    message whose parent is NULL or unknown is a root. Of rows with the same
    conversation and id the first by role and text counts. Messages that answer
    each other in a circle belong to no path.
    """
    one = Window.partitionBy("conv", "id").orderBy("role", "text")
    unique = messages.withColumn("_at", F.row_number().over(one)).where("_at = 1").drop("_at")
    nodes = written(unique.withColumn("node", F.monotonically_increasing_id()), "chat-nodes")
    parents = nodes.select(F.col("conv").alias("c"), F.col("id").alias("p"), F.col("node").alias("up"))
    jump = nodes.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p"))).select("node", "up")
    jump = written(jump, "chat-jumps")
    leaves = nodes.select("node").join(jump.select(F.col("up").alias("node")), "node", "left_anti")
    total, jumps = nodes.count(), []
    while not jump.isEmpty() and 2 ** len(jumps) <= total:
        jumps.append(jump)
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
        jump = written(jump.join(further, "up").select("node", F.col("beyond").alias("up")), "chat-jumps")
    circular = jump.select("node")  # still not at a root after as many steps as there are messages
    steps = leaves.join(circular, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(jumps))):
        steps = written(steps, "chat-steps")
        hop = jumps[k].select("node", F.col("up").alias("to"))
        more = steps.join(hop, "node").select("leaf", F.col("to").alias("node"), F.col("up") + 2**k)
        steps = steps.union(more)
    steps = written(steps, "chat-paths")
    scores = nodes.select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
    ranked = steps.join(scores, "node").groupBy("leaf").agg(F.sum("score").alias("score"))
    ids = nodes.select(F.col("node").alias("leaf"), "conv", F.col("id").alias("leaf_id"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf_id")
    ranked = ranked.join(ids, "leaf").withColumn("branch", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    return steps.join(ranked, "leaf").join(nodes.select("node", "role", "text"), "node").select(
        "conv", F.col("leaf_id").alias("leaf"), "branch", "up", "role", "text"
    )


def formatted(chosen: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, leaf, branch, text, loss): one row per path; ``loss`` are spans of the text, in code points, ends exclusive."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(BREAK))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = chosen.select(
        "conv", "leaf", "branch", "up", head.alias("head"), escaped(F.col("text")).alias("body"),
        F.col("role").isin(*learn_from).alias("learn"),
    )
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("conv", "leaf", "branch").orderBy(F.desc("up"))
    rows = rows.withColumn("end", F.sum(size).over(before) - len(END))
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.concat("head", "body", F.lit(END)).alias("turn"),
        F.when(F.col("learn"), F.struct((F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end"))).alias("loss"),
    )
    return rows.groupBy("conv", "leaf", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv", "leaf", "branch",
        F.array_join("turns.turn", "").alias("text"),
        F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    pieces = F.split(text, r"\Q" + END + r"\E", -1)

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(START) + 1, 2**31 - 1)
        role = F.substring_index(rest, "\n", 1)
        return F.struct(
            unescaped(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescaped(F.substr(rest, F.length(role) + 2)).alias("text"),
        )

    return let(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def masked_text(text: Column, loss: Column) -> Column:
    """What lies under the mask, unescaped and in order."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), ""
    )


def format_chats(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Linear conversations as formatted texts: (conv, leaf, branch, text, loss), one row each.

    Turns are ordered by number, equal numbers by role and text; repeated rows
    are turns of their own. A NULL role or text is empty, and NULL is a
    conversation like any other. Other columns are ignored.
    """
    return formatted(paths(threads(conversations, conv, turn, role, text)))
