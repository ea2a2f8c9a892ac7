"""The trie of shared conversation beginnings, with totals over its subtrees.

Every distinct sequence of first turns is a node. Turns are digested once (role and
text apart), placed in their conversation by ranges of (conversation, turn), and a
sequence is known by the running sums of two 60-bit digests of (place, turn), which fit
decimals exactly; two sequences of one depth are taken for the same if both sums agree.
Prefixes are then a grouped aggregate with partial results before the shuffle: a first
turn that a third of all conversations share is one row per task. Subtree totals come
from parallel tree contraction (see ``contraction``), so no conversation's length and no
node's fan-out sets the number of rounds or the size of a task.

``ends_sha256`` is a digest of a list of ids, one value by its definition; the ids are
sorted and joined in ranges first, and the node gets one text per range.

Defined cases: turns are in order of turn (nulls first), role, text; null roles and
texts are empty; turns without a conversation id belong to none and are left out;
repeated rows are turns of their own; conversations without turns end at the root; a
table without conversations has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import named
from shockspan.llm.contraction import subtree_totals
from shockspan.llm.ordered import dealt, running
from shockspan.session import stored

KEY = ["depth", "s1", "s2"]


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), digest, n_bytes of every turn."""
    rows = turns.select(named(conv_col).cast("long").alias("conv"), named(turn_col).alias("turn"), _text(named(role_col)).alias("role"), _text(named(text_col)).alias("text"))
    order = ["turn", "role", "text"]
    rows = running(dealt(rows.filter("conv IS NOT NULL"), "conv", order), "conv", order, {"pos": F.lit(1).cast("long")})
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv", "pos", F.sha2(whole, 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns``: conv, pos without gaps from 1, digest, n_bytes; ``convs``: the distinct
    ids of all conversations, those without turns too.
    """
    rows = dealt(turns.select("conv", "pos", "digest", "n_bytes"), "conv", ["pos"])
    item = F.sha2(F.concat_ws(":", "pos", "digest"), 256)
    part = [F.conv(F.substring(item, a, 15), 16, 10).cast("decimal(20,0)") for a in (1, 16)]
    rows = rows.withColumns({"i1": part[0], "i2": part[1]})
    rows = running(rows, "conv", ["pos"], {"s1": F.col("i1"), "s2": F.col("i2")})
    wide = "decimal(38,0)"
    rows = rows.select(
        "conv", F.col("pos").alias("depth"), *[F.col(c).cast(wide).alias(c) for c in ("s1", "s2")],
        *[(F.col(f"s{k}") - F.col(f"i{k}")).cast(wide).alias(f"p{k}") for k in (1, 2)], "n_bytes",
    )
    zero = F.lit(0).cast(wide)
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), F.lit(None).cast(wide).alias("p1"), F.lit(None).cast(wide).alias("p2"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"),
    )
    rows = stored(rows, "prefixes")
    nodes = rows.groupBy(*KEY, "p1", "p2").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    nodes = stored(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(above, ["depth", "p1", "p2"], "left")
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")
    tree = stored(tree.select("id", "parent", *KEY, "conv_id", "parent_conv_id", "n_convs", saved), "tree")
    children = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = stored(tree.join(children, "id", "left").fillna(0, ["n_children"]), "counted")
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    totals = subtree_totals(tree.select("id", "parent", leaf, "saved_tokens"), ["n_leaves", "saved_tokens"])

    last = rows.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("k"))
    last = convs.join(last, "conv", "left").select("conv", *[F.coalesce(f"k.{c}", F.lit(0)).alias(c) for c in KEY])
    last = stored(last.repartitionByRange("conv").withColumn("_range", F.spark_partition_id()), "ends")

    def joined(values: Column) -> Column:
        return F.array_join(values, ",")

    pieces = last.groupBy(*KEY, "_range").agg(joined(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    ends = pieces.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("_range", "ids"))).alias("ids"))
    ends = ends.select(*KEY, F.sha2(joined(F.transform("ids", lambda p: p["ids"])), 256).alias("ends_sha256"))

    out = tree.drop("saved_tokens").join(totals, "id").join(ends, KEY, "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they stand (see ``trie``)."""
    placed = stored(digests(turns, conv_col, turn_col, role_col, text_col), "digests")
    return trie(placed, placed.select("conv").distinct())
