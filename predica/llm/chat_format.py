"""Chat formatting of reply trees, with DataFrame functions only.

A message names the message that it replies to. Self-joins enumerate the paths from roots to leaves by doubling: round k
knows each message's ancestor 2**k replies up and what its path there scores, so a thread of n replies takes log2(n)
rounds, not n. A leaf's branch is ranked by the sum of its messages' scores (then by length, then by the leaf's least
id); the best `branches` of a tree are laid out by walking the same tables down from the longest jump, each message
once, and formatted as one conversation each.

Template: `<|turn|>` role `<|body|>` text `<|end|>` and a newline for each turn. Inside roles and texts a backslash
becomes \\0, `<` becomes \\1 and `[` becomes \\2: no control string that begins with either, of this template or another,
survives, and read_back() undoes it. The loss mask has, for each assistant turn, the turn's number and the place and
length of its escaped text in code points of the turn.

Scale: joins are on (tree, message), so a tree with a third of all messages is spread until its chosen path becomes one
value, which its formatted conversation is by definition. Rounds are checkpointed. Defined cases: null text or role is
empty; a null parent, or one that isn't there, makes a root; a null tree id is a tree of its own; null scores count 0;
repeated rows of (tree, message) count once; messages in a circle have no root and are left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Fixed values of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
ASSISTANT = "assistant"


def escape(col: Column) -> Column:
    for char, mark in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        col = F.replace(col, F.lit(char), F.lit(mark))
    return col


def unescape(col: Column) -> Column:
    for char, mark in (("[", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        col = F.replace(col, F.lit(mark), F.lit(char))
    return col



def jumps(nodes: DataFrame) -> list[DataFrame]:
    """[(tree, node, up, score, length)] by round k: the ancestor 2**k up, or null past the root, and the sum of scores and
    number of messages from the node to just below it."""
    parents = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = nodes.join(parents, nodes["tree"].eqNullSafe(F.col("t")) & (nodes["parent"] == F.col("p")), "left")
    now = checkpointed(linked.select("tree", "node", F.col("p").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.lit(1).cast("long").alias("length")))
    rounds, most = [now], max(1, now.count()).bit_length() + 1
    while len(rounds) <= most and not now.where("up IS NOT NULL").isEmpty():
        # Messages that have come to their root stay as they are; only the others are joined.
        going, above = now.where("up IS NOT NULL"), now.toDF("t", "n", "u", "s", "l")
        joined = going.join(above, going["tree"].eqNullSafe(F.col("t")) & (going["up"] == F.col("n")))
        moved = joined.select("tree", "node", F.col("u").alias("up"), (F.col("score") + F.col("s")).alias("score"), (F.col("length") + F.col("l")).alias("length"))
        now = checkpointed(now.where("up IS NULL").union(moved))
        rounds.append(now)
    return rounds


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, leaf, score, length, node, place): the messages of the chosen paths; place 0 is the root."""
    rounds = jumps(nodes)
    done = rounds[-1].where("up IS NULL").select("tree", "node", "score", "length")
    replied = rounds[0].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = done.join(replied, done["tree"].eqNullSafe(F.col("t")) & (done["node"] == F.col("u")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("length").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = chosen.select("tree", "rank", F.col("node").alias("leaf"), "score", "length", "node", (F.col("length") - 1).alias("place"))
    for k in range(len(rounds) - 1, -1, -1):
        up = rounds[k].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"))
        step = path.join(up, path["tree"].eqNullSafe(F.col("t")) & (path["node"] == F.col("n")), "left")
        here, there = F.struct("node", "place"), F.struct(F.col("u").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        both = step.withColumn("at", F.explode(F.when(F.col("u").isNull(), F.array(here)).otherwise(F.array(here, there))))
        path = both.select("tree", "rank", "leaf", "score", "length", "at.node", "at.place")
    return path


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, score, n_turns, formatted, loss) for each chosen path.

    messages: (tree, node, parent, role, text, score); loss: array of (turn, start, length).
    """
    nodes = checkpointed(messages.dropDuplicates(["tree", "node"]))
    paths = best_paths(nodes.select("tree", "node", "parent", "score"), branches)
    bodies = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(bodies, paths["tree"].eqNullSafe(F.col("t")) & (paths["node"] == F.col("n")))
    head, body = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)), escape(F.col("text"))
    parts = turns.select("tree", "rank", "score", F.struct(F.col("place"), F.concat(head, body, F.lit(END)).alias("piece"), (F.col("role") == ASSISTANT).alias("learn"), F.char_length(head).alias("start"), F.char_length(body).alias("length")).alias("part"))
    whole = parts.groupBy("tree", "rank").agg(F.first("score").alias("score"), F.array_sort(F.collect_list("part")).alias("parts"))
    learned = F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["place"].alias("turn"), p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("tree", "rank", "score", F.size("parts").cast("long").alias("n_turns"), F.array_join("parts.piece", "").alias("formatted"), learned.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text")))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    pieces = F.split(formatted, r"(?=<\|turn\|>)")
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(F.element_at(pieces, (s["turn"] + 1).cast("int")), s["start"] + 1, s["length"]))), "")


def thread_messages(conversations: DataFrame) -> DataFrame:
    """Messages of conversations whose rows are in order of turn: each replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    saying = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :s), (-1L, 1L, 'assistant', :s) AS t(conv_id, turn, role, text)", {"s": saying})
    done = format_conversations(thread_messages(conversations.select("conv_id", "turn", "role", "text").union(more)))
    read = done.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
