"""A prefix trie of conversations, rolled up by centroid decomposition.

``rebuild`` gives every conversation its turns; a node is a distinct prefix, known by
its depth and the ``xor`` of the 2 x 64-bit hashes of its (place, role, text)s, so that
prefixes of conversations of any length come from one running total.  What a subtree
sums up cannot be had level by level (a conversation may be millions of turns deep) nor
by collecting a subtree.  It is summed over components of the parent-edge forest:

* Every node knows ``load``, the number of turns its members have from this node on: a plain aggregate.  Within a
  component it is the subtree's total of positive weights, the component's own at its top.
* Nodes holding more than half of their component's load form the path from the top to the centroid, the deepest one.
* Removing the centroid leaves the subtrees of its children, each with at most half the load, and the rest, with less
  than half.  What the centroid and its children's components sum up is added to every node of the
  centroid-to-top path, and their load taken off it.
* Which child of the centroid a node lies below is read from the turn of the node's own conversation at that depth:
  one join for each piece of a conversation, not a walk.

Each round at least halves the load of every component.  Components of at most
``local_load`` are summed inside a task, many of them together.  So a node's total is the
sum over the components in which it was on the path, plus that of the last one.

Rows without conv_id take no part; null roles and texts are empty; turns are ordered by
``turn`` (null first), then role and text, repeated rows being repeated turns; other columns are left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from ..session import materialize, ship_package
from .common import join_counted
from .digest import ordered_digests

#: Components of at most this load are summed by one task.
LOCAL_LOAD = 1 << 17
#: Nodes of one conversation are dealt by pieces of this depth.
PIECE = 4096
#: First turns a conversation may take from another.
SHARED = 8


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, ta, tb, nbytes, n_turns``: places from 0, two hashes of (role, text), the text's UTF-8 bytes."""
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = ("sum", F.lit(1).cast("long"))
    placed = running_totals(rows, ["conv_id"], ["turn", "role", "text"], {"at": one}, {"n_turns": one})
    return placed.select("conv_id", (F.col("at") - 1).alias("pos"), F.xxhash64(F.lit(11), "role", "text").alias("ta"),
                         F.xxhash64(F.lit(13), "role", "text").alias("tb"),
                         F.octet_length("text").cast("long").alias("nbytes"), "n_turns")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first ``h = crc32(decimal c) % 9`` turns of conversation ``c - c % 5``, then its own
    from its h-th on: ``(conv_id, depth, ta, tb, nbytes)`` with depths from 1, and ``(conv_id, length)`` of all conversations.

    ``%`` takes the sign of c, as SQL has it."""
    placed = materialize(ordered_turns(turns), "turns")
    turn = ["ta", "tb", "nbytes"]
    base = F.col("conv_id") - F.col("conv_id") % 5
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("long")
    convs = placed.groupBy("conv_id").agg(F.first("n_turns").alias("own")).withColumns({"base": base, "h": head})
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(lengths, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("kept"))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.col("kept")), "convs")
    heads = placed.filter((F.col("conv_id") % 5 == 0) & (F.col("pos") < SHARED)) \
        .select(F.col("conv_id").alias("base"), "pos", *turn)
    shared = heads.join(convs.filter("h > 0").select("conv_id", "base", "h"), "base").filter("pos < h") \
        .select("conv_id", (F.col("pos") + 1).alias("depth"), *turn)
    # the own turns come behind what was taken: as many as the base has, at most h
    kept = placed.filter(F.col("pos") >= head).select("conv_id", "pos", *turn)
    total = convs.agg(F.sum("kept")).first()[0] or 0
    own = join_counted(kept, convs.filter("kept > 0").select("conv_id", "h", "taken", "kept"), ["conv_id"], "kept", total) \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), *turn)
    return shared.unionByName(own), convs.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, pa, pb, nbytes, length``: the node (a, b) every turn leads to, its parent's, the UTF-8 bytes
    of the turn's text and the number of the conversation's turns."""
    narrow = rows.select("conv_id", F.col("depth").cast("long").alias("depth"),
                         *[F.xxhash64(F.lit(seed), "depth", "ta", "tb").alias(n) for seed, n in ((11, "ha"), (13, "hb"))], "nbytes")
    placed = running_totals(narrow, ["conv_id"], ["depth"], {"a": ("xor", F.col("ha")), "b": ("xor", F.col("hb"))},
                            {"length": ("sum", F.lit(1).cast("long"))})
    return placed.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"),
                         F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "nbytes", "length")


def trie_nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: key ``a, b``, parent ``pa, pb`` (null for the root, whose key is 0, 0), ``conv_id`` (smallest member),
    ``depth, n_convs, load, nbytes, n_children, parent_conv_id``."""
    load = F.sum(F.col("length") - F.col("depth") + 1).alias("load")
    nodes = paths.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), load, F.min("nbytes").alias("nbytes"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                     F.sum(F.col("length") + 1).alias("load")).filter("n_convs > 0") \
        .select(zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), "conv_id", zero.alias("depth"),
                "n_convs", "load", zero.alias("nbytes"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    children = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")
    # a node's parent has the same smallest member but where the member's own piece of the trie begins:
    # one node for each conversation at most asks for its parent's
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"))
    tops = nodes.join(first.withColumnRenamed("own_from", "depth"), ["conv_id", "depth"]).select("a", "b", "pa", "pb")
    above = nodes.filter("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"),
                                                  F.col("conv_id").alias("above"), "n_children")
    asked = join_counted(tops.filter("pa IS NOT NULL"), above, ["pa", "pb"], "n_children", nodes.count()).select("a", "b", "above")
    return nodes.join(asked, ["a", "b"], "left").withColumn(
        "parent_conv_id", F.when(F.col("pa").isNotNull(), F.coalesce("above", "conv_id"))).drop("above")


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], local_load: int = LOCAL_LOAD) -> DataFrame:
    """``a, b`` and, for each column of ``values``, its total over the node's subtree.

    ``nodes`` has ``a, b, pa, pb, conv_id, depth, load`` and the values (longs); ``paths`` leads from (conv_id, depth) to
    the node of a conversation at a depth.
    """
    sums = [f"s_{v}" for v in values]
    state = nodes.select("a", "b", "pa", "pb", "conv_id", "depth", "load", *values,
                         *[F.lit(0).cast("long").alias(s) for s in sums],
                         F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"))
    state = materialize(state, "components")
    ways = paths.select("conv_id", "depth", "a", "b", "pa", "pb")
    settled = []
    while True:
        total = state.groupBy("ca", "cb").agg(F.max("load").alias("total"), F.count(F.lit(1)).alias("size"))
        big = (F.col("total") > local_load) & (F.col("size") > 1)
        state = state.join(total, ["ca", "cb"])
        settled.append(state.filter(~big).drop("total", "size"))
        state = state.filter(big)
        if state.isEmpty():
            break
        state = materialize(_split(state, ways, values, sums), "components")
    done = reduce(DataFrame.unionByName, settled)
    return _local_sums(materialize(done, "settled"), values, sums, local_load)


def _split(state: DataFrame, ways: DataFrame, values: list[str], sums: list[str]) -> DataFrame:
    """One round: every component of ``state`` loses its centroid; totals go up the centroid-to-top paths."""
    comp = ["ca", "cb"]
    heavy = F.col("load") * 2 > F.col("total")
    centroid = state.filter(heavy).groupBy(*comp).agg(
        F.max_by(F.struct("a", "b", "load", "depth"), "depth").alias("c"))
    centroid = centroid.select(*comp, F.col("c.a").alias("xa"), F.col("c.b").alias("xb"), F.col("c.load").alias("xload"),
                               F.col("c.depth").alias("xdepth"))
    state = state.join(centroid, comp).withColumn("piece", F.floor(F.col("depth") / PIECE))
    # the node of each conversation just below the centroid's depth: asked once a piece, not once a node
    asks = state.filter("depth > xdepth").select(*comp, "conv_id", "piece", "xa", "xb", (F.col("xdepth") + 1).alias("depth")).distinct()
    below = asks.join(ways.select("conv_id", "depth", F.col("a").alias("na"), F.col("b").alias("nb"), "pa", "pb"), ["conv_id", "depth"]) \
        .filter("pa = xa AND pb = xb").select(*comp, "conv_id", "piece", "na", "nb")
    state = state.join(below, [*comp, "conv_id", "piece"], "left")
    state = state.withColumn("na", F.when(F.col("depth") > F.col("xdepth"), F.col("na"))) \
        .withColumn("is_x", (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb")))
    totals = state.filter("is_x OR na IS NOT NULL").groupBy(*comp).agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    state = state.join(totals, comp)
    out = {s: F.col(s) + F.when(heavy, F.col(f"t_{v}")).otherwise(0) for v, s in zip(values, sums)}
    # the centroid has all it will get: it stays behind alone, with nothing left to sum
    out |= {v: F.when(F.col("is_x"), 0).otherwise(F.col(v)) for v in values}
    out["load"] = F.when(F.col("is_x"), 1).when(heavy, F.col("load") - F.col("xload")).otherwise(F.col("load"))
    for c, x, n in (("ca", "a", "na"), ("cb", "b", "nb")):
        out[c] = F.when(F.col("is_x"), F.col(x)).when(F.col("na").isNotNull(), F.col(n)).otherwise(F.col(c))
    # an upper component keeps its top's key; the centroid, where it was the top, hands its own on to nobody
    return state.withColumns(out).select("a", "b", "pa", "pb", "conv_id", "depth", "load", *values, *sums, "ca", "cb")


def _local_sums(settled: DataFrame, values: list[str], sums: list[str], local_load: int) -> DataFrame:
    """Adds the totals within the last components, many of which a task sums together."""
    bins = max(1, math.ceil(settled.count() / local_load))
    # pandas turns longs beside nulls into floats: the root, which alone has no parent, names itself
    binned = settled.select("a", "b", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb"), "depth", "ca", "cb", *values, *sums,
                            F.pmod(F.xxhash64("ca", "cb"), F.lit(bins)).alias("bin"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = {k: i for i, k in enumerate(zip(frame["a"], frame["b"]))}
        ca, cb = frame["ca"].to_numpy(), frame["cb"].to_numpy()
        up = np.full(len(frame), -1)
        for i, k in enumerate(zip(frame["pa"], frame["pb"])):
            j = row.get(k, i)
            if j != i and ca[i] == ca[j] and cb[i] == cb[j]:
                up[i] = j
        total = frame[values].to_numpy(dtype=np.int64).copy()
        for i in np.argsort(-frame["depth"].to_numpy(), kind="stable"):
            if up[i] >= 0:
                total[up[i]] += total[i]
        out = frame[["a", "b"]].copy()
        for k, (v, s) in enumerate(zip(values, sums)):
            out[v] = frame[s].to_numpy() + total[:, k]
        return out

    return binned.groupBy("bin").applyInPandas(run, "a long, b long, " + ", ".join(f"{v} long" for v in values))


def end_digests(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of the nodes at which conversations end."""
    ends = paths.filter("depth = length").select("a", "b", "conv_id").unionByName(
        convs.filter("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id"))
    ends = ends.withColumn("id", F.col("conv_id").cast("string"))
    return ordered_digests(ends, ["a", "b"], ["conv_id"], {"ends_sha256": "id"}, seps={"ends_sha256": ","})


def prefix_trie(rows: DataFrame, convs: DataFrame, local_load: int = LOCAL_LOAD) -> DataFrame:
    """The trie of ``rows(conv_id, depth, ta, tb, nbytes)``, depths from 1 without gaps, and ``convs(conv_id, length)``: per node
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    ship_package(rows.sparkSession)
    paths = materialize(prefixes(rows), "paths")
    nodes = trie_nodes(paths, convs).withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("nbytes")})
    nodes = materialize(nodes, "nodes")
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(nodes, paths, values, local_load)
    empty = F.sha2(F.lit(b""), 256)
    return (nodes.drop(*values).join(sums, ["a", "b"]).join(end_digests(paths, convs), ["a", "b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values,
                    F.coalesce("ends_sha256", empty).alias("ends_sha256")))


def conversation_trie(turns: DataFrame, local_load: int = LOCAL_LOAD) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations."""
    return prefix_trie(*rebuild(turns), local_load=local_load)
