"""Reply trees and the conversations that are read off them, with DataFrame functions only.

Messages of a tree name the message they answer. Iterative self-joins list the path from
every leaf up to its root: round k joins the ancestors found so far to the links that
jump 2^k messages up, and these links to themselves, so a thread of n messages takes
log2(n) rounds whatever the number of trees. All joins are equalities on message numbers
between written tables, so a tree with a third of all messages is spread like any other,
and a message under many branches is split by adaptive execution. Rows carry numbers
only; texts are joined once, to the chosen paths.

A path's score is the mean of its messages' scores; the ``top`` best paths of every tree
are chosen (all where it is None; partial ranks are cut before the shuffle), and each
becomes one conversation:

    <|im_start|>role<|im_sep|>text<|im_end|> and a line end, per message.

In roles and texts ``<``, any number of backslashes and ``|`` get one backslash more, so
no control string can come from them, and taking one off again restores every text. The
result also gives the conversation as ``segments``, whose texts joined are ``formatted``
and of which exactly the assistants' texts are under the loss mask. A conversation is one
value, so one task writes it; nothing else grows with it.

Defined cases: a message answers only what has a smaller number in its own tree, any
other parent (null, absent, itself, later) counts as none, so there are no cycles and
the message begins a path of its own; messages without a number cannot be placed and are
left out; of several with the same tree and number the least by parent, role, text and
score stands; a null tree is a tree of its own; null roles and texts are empty; a path
without scores has score 0; ties go to the smaller leaf; no messages give no rows; input
columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.llm.common import named
from shockspan.operators.features import ranked
from shockspan.session import stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """tree, id, parent, role, text, score of plain conversations: every turn answers the one before.

    Turns are in order of turn (nulls first), role and text, and numbered over all
    conversations; the number before that of a first turn stands in another tree.
    """
    text = [F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    rows = rows.select(named(conv_col).alias("tree"), named(turn_col).alias("turn"), *text)
    placed = ranked(rows, [F.col(c).asc_nulls_first() for c in ("tree", "turn", "role", "text")], "id")
    return placed.select("tree", "id", (F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(links: DataFrame) -> DataFrame:
    """leaf, node, back: every node on the way from a leaf (back = 0) to its root.

    ``links``: node and the node above, ``up``, null for roots; longs without cycles.
    """
    jump = links.filter("up IS NOT NULL")
    leaves = links.join(jump.select(F.col("up").alias("node")), "node", "left_anti")
    found = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    step = 1
    while not jump.isEmpty():
        above = found.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("back") + step).alias("back"))
        found = stored(found.union(above), "paths")
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = stored(jump.join(further, "up").select("node", F.col("next").alias("up")), "jumps")
        step *= 2
    return found


def segments(turns: Column) -> Column:
    """(text, loss) pieces of a conversation, from its turns in order."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def turn(t: Column) -> Column:
        head = F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP))
        return F.array(
            piece(head, F.lit(False)), piece(escaped(t["text"]), t["role"] == "assistant"), piece(F.lit(END), F.lit(False))
        )

    return F.flatten(F.transform(turns, turn))


def texts_of(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def turns_in(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, read back."""

    def turn(x: Column) -> Column:
        parts = F.split(x, r"<\|im_(?:sep|end)\|>")
        return F.struct(unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text"))

    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.size(pieces)), turn)


def formatted_paths(
    messages: DataFrame, tree_col: str = "tree", id_col: str = "id", parent_col: str = "parent", role_col: str = "role",
    text_col: str = "text", score_col: str = "score", top: int | None = 1,
) -> DataFrame:
    """tree, leaf, path_rank, path_score, n_turns, formatted, segments of the chosen paths."""
    rows = messages.select(
        named(tree_col).alias("tree"), named(id_col).cast("long").alias("id"), named(parent_col).cast("long").alias("parent"),
        *[F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
        named(score_col).cast("double").alias("score"),
    ).filter("id IS NOT NULL")
    # of repeated numbers one stands; the numbers below are those of the written rows
    rows = rows.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    rows = stored(rows.select("tree", "id", "m.*", F.monotonically_increasing_id().alias("node")), "messages")
    above = rows.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("node").alias("up"))
    mine = rows.select("tree", "node", "score", F.col("id").alias("own"), F.when(F.col("parent") < F.col("id"), F.col("parent")).alias("parent"))
    links = mine.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left")
    links = stored(links.select("node", "up"), "links")
    found = paths(links)
    scored = found.join(rows.select("node", "score"), "node").groupBy("leaf").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("path_score"))
    ends = scored.join(rows.select(F.col("node").alias("leaf"), "tree", F.col("id").alias("leaf_id")), "leaf")
    order = W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf_id")
    if top is not None:
        ends = ends.withColumn("path_rank", F.row_number().over(order)).filter(F.col("path_rank") <= top)
    else:  # no task ranks a tree of any size
        ends = ends.withColumn("path_rank", F.lit(None).cast("int"))
    ends = stored(ends, "chosen")
    turns = found.join(ends.select("leaf"), "leaf").join(rows.select("node", "role", "text"), "node")
    turns = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))
    out = turns.withColumn("n_turns", F.size("turns")).withColumn("segments", segments(F.col("turns"))).join(ends, "leaf")
    return out.select(
        F.col("tree").alias(tree_col), F.col("leaf_id").alias("leaf"), "path_rank", "path_score", "n_turns",
        texts_of(F.col("segments")).alias("formatted"), "segments",
    )
