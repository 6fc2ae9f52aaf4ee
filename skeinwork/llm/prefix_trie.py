"""The prefix trie of conversations, by digests of fixed-length blocks of turns.

A conversation is cut into blocks of ``BLOCK`` turns. A block's digest is the exclusive or of its turns' 128-bit hashes, each
taken with the turn's place, so the digest of a whole prefix is the exclusive or of its blocks. Conversations are grouped by
the prefixes that end with a block first: such a group is a class, known from then on by its smallest conversation and its
size, and only that conversation's turns stand for it. Where a class has no sibling, its turns are a plain path. Where siblings
diverge, and only there, prefixes are told apart turn by turn. No text moves, only digests and lengths.

Sums over a subtree need no walk: what a node saves is put down to its smallest conversation, so a subtree's sum is that of its
members' later turns, and a class adds up the later blocks of all its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm import common
from skeinwork.operators.order import ordinal_within
from skeinwork.session import hot_and_cold

#: Turns of a block; blocks that one window adds up.
BLOCK, STRIDE = 4, 1024
#: Rows of a lookup table (50 bytes each) that may be broadcast; of a larger one only the frequent keys are.
LOOKUP_ROWS = 200_000
#: What the contract of the query says of rebuilt conversations.
FAMILY, HEADS = 100, 6

PREFIX = ["k", "a", "b"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns by ``turn``, null first, ties by digest; rows without a conversation are none."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    placed = ordinal_within(rows, ["conv_id"], ["turn", "digest"], "pos")
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "digest", "chars")


def with_shared_heads(placed: DataFrame) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % 6 turns of c - c % 100, in place of as many of its own."""
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    known = sizes.select("conv_id", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    lengths = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), "n")
    known = common.stored(known.join(lengths, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "heads")
    shared = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    first = shared.join(known, "base").filter("pos <= h").select("conv_id", "pos", "digest", "chars")
    own = placed.join(known, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    return first.unionByName(own)


def _running(df: DataFrame, ordinal: str, columns: dict[str, Column], add, zero: int = 0) -> DataFrame:
    """``add`` of each column over the earlier blocks of a conversation, in strides, so that no window holds a long one whole."""
    cut = df.withColumn("cut", F.floor(F.col(ordinal) / STRIDE).cast("long"))
    earlier = Window.partitionBy("conv_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("conv_id", "cut").agg(*[add(c).alias(f"t_{n}") for n, c in columns.items()])
    bases = totals.select("conv_id", "cut", *[F.coalesce(add(F.col(f"t_{n}")).over(earlier), F.lit(zero)).alias(f"t_{n}") for n in columns])
    inside = Window.partitionBy("conv_id", "cut").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(add(c).over(inside), F.lit(zero)).alias(n) for n, c in columns.items()])
    return local.join(bases, ["conv_id", "cut"]).drop("cut")


def blocks(turns: DataFrame, every: DataFrame) -> DataFrame:
    """(conv_id, k, m, s_a, s_b, a, b): a conversation's blocks of m turns, prefixes before and after; block -1 is the root."""
    cut = turns.groupBy("conv_id", "k").agg(F.count("*").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    run = _running(cut, "k", {"p": F.col("x"), "q": F.col("y")}, F.bit_xor)
    start = [F.col("p").bitwiseXOR(F.col("t_p")).alias("s_a"), F.col("q").bitwiseXOR(F.col("t_q")).alias("s_b")]
    run = run.select("conv_id", "k", "m", "x", "y", *start)
    run = run.select("conv_id", "k", "m", "s_a", "s_b", F.col("s_a").bitwiseXOR(F.col("x")).alias("a"), F.col("s_b").bitwiseXOR(F.col("y")).alias("b"))
    none = F.lit(None).cast("long")
    root = every.select("conv_id", F.lit(-1).cast("long").alias("k"), F.lit(0).cast("long").alias("m"), none.alias("s_a"), none.alias("s_b"),
                        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return run.unionByName(root)


def _look_up(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join on a unique key; keys that ``n`` says many rows have are broadcast, so none of them is one task."""
    hot, cold = hot_and_cold(lookup, LOOKUP_ROWS, n)
    joined = rows.join(hot, keys)
    if cold is not None:
        joined = joined.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select(*joined.columns))
    return joined


def classes(cut: DataFrame, held: common.Held) -> DataFrame:
    """(k, m, s_a, s_b, a, b, n, rep, siblings, prep): equal prefixes that end with a block, and what precedes them."""
    found = held.stored(cut.groupBy("k", "m", "s_a", "s_b", "a", "b").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")), "classes")
    below = found.filter("k >= 0").groupBy("k", "s_a", "s_b").agg(F.count("*").alias("siblings"))
    above = found.select((F.col("k") + 1).alias("k"), F.col("a").alias("s_a"), F.col("b").alias("s_b"), F.col("rep").alias("prep"))
    start = ["k", "s_a", "s_b"]
    return held.stored(_look_up(found.filter("k >= 0"), held.stored(below.join(above, start), "above"), start, "siblings"), "known")


def paths(turns: DataFrame, found: DataFrame, held: common.Held) -> DataFrame:
    """(rep, k, pos, chars, node, n, up) for each turn of each class: its node's smallest conversation and size, and its parent's."""
    stand = found.select(F.col("rep").alias("conv_id"), "k", "s_a", "s_b", "n", "siblings", "prep")
    rows = turns.join(stand, ["conv_id", "k"]).withColumnRenamed("conv_id", "rep")
    begins = F.col("pos") == F.col("k") * BLOCK + 1
    plain = rows.filter("siblings = 1").select(
        "rep", "k", "pos", "chars", F.col("rep").alias("node"), "n", F.when(begins, F.col("prep")).otherwise(F.col("rep")).alias("up")
    )
    inside = Window.partitionBy("rep", "k").orderBy("pos")
    split = rows.filter("siblings > 1").select(
        "rep", "k", "pos", "chars", "prep", F.col("n").alias("own"),
        F.col("s_a").bitwiseXOR(F.bit_xor("x").over(inside)).alias("a"), F.col("s_b").bitwiseXOR(F.bit_xor("y").over(inside)).alias("b"),
    )
    split = held.stored(split, "split")
    nodes = split.groupBy("pos", "a", "b").agg(F.min("rep").alias("node"), F.sum("own").alias("n"), F.count("*").alias("met"))
    told = _look_up(split, held.stored(nodes, "met"), ["pos", "a", "b"], "met")
    up = F.when(begins, F.col("prep")).otherwise(F.lag("node").over(inside))
    return held.stored(plain.unionByName(told.select("rep", "k", "pos", "chars", "node", "n", up.alias("up"))), "paths")


def listed_digests(ends: DataFrame) -> DataFrame:
    """(k, a, b, ends_sha256): SHA-256 of the ids of each group, ascending and comma-joined.

    A digest is sequential, so a group is one task's, but only as a sorted stream of ids: nothing of it is held.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in PREFIX], 1)
            ids = batch.column("conv_id").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(ids)] if len(ids) else []
            done = []
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[begin].tolist())
                text = ",".join(map(str, ids[begin:end].tolist())).encode()
                if key == now:
                    digest.update(b"," + text)
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text)
            yield rows(done)
        yield rows([] if now is None else [(*now, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*PREFIX, "ends_sha256"])

    ordered = ends.select(*PREFIX, "conv_id").repartition(*PREFIX).sortWithinPartitions(*PREFIX, "conv_id")
    return ordered.mapInArrow(walk, "k long, a long, b long, ends_sha256 string")


def prefix_trie(placed: DataFrame, every: DataFrame) -> DataFrame:
    """The nodes of the trie of ``placed`` (conv_id, pos from 1, digest, chars), whose conversations are ``every`` (conv_id).

    A node is a distinct sequence of first turns: (conv_id, smallest member; depth; parent_conv_id, null for the root; n_convs;
    n_children; n_leaves; saved_tokens; ends_sha256). A conversation without turns is a member of the root alone. No
    conversations give no nodes. Repeated turns are turns each; conversations of equal turns share all their nodes.
    """
    held = common.Held()
    at = F.col("pos").cast("long")
    turns = held.stored(
        placed.select(
            "conv_id", at.alias("pos"), F.floor((at - 1) / BLOCK).cast("long").alias("k"), "chars",
            F.xxhash64("pos", "digest").alias("x"), F.xxhash64(F.lit("second"), "digest", "pos").alias("y"),
        ),
        "turns",
    )
    cut = held.stored(blocks(turns, every), "blocks")
    found = classes(cut, held)
    path = paths(turns, found, held)
    nodes = _nodes(path, cut, held)
    sums = _class_sums(nodes, cut, held)

    zero = F.lit(0).cast("long").alias("depth")
    top = sums.filter("k = -1").select(F.col("first").alias("conv_id"), zero, F.col("rest").alias("saved_tokens"), F.col("leaves").alias("n_leaves"))
    totals = _node_sums(path, found.join(sums, PREFIX).select("rep", "k", "rest", "leaves")).unionByName(top)

    last = cut.groupBy("conv_id").agg(F.max(F.struct(*PREFIX)).alias("last")).select("conv_id", "last.*")
    digests = held.stored(listed_digests(last), "digests")
    closed = digests.join(found.select(*PREFIX, "rep", (F.col("k") * BLOCK + F.col("m")).alias("pos")), PREFIX).select("rep", "pos", "ends_sha256")
    ends = closed.join(path, ["rep", "pos"]).select(F.col("node").alias("conv_id"), F.col("pos").alias("depth"), "ends_sha256")
    bare = digests.join(sums.select(*PREFIX, "first"), PREFIX).filter("k = -1").select(F.col("first").alias("conv_id"), zero, "ends_sha256")
    ends = ends.unionByName(bare)

    key = ["conv_id", "depth"]
    out = nodes.join(totals, key).join(ends, key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = common.stored(out, "trie")
    held.clear()
    return out


def _nodes(path: DataFrame, cut: DataFrame, held: common.Held) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, chars, n_children) of every node, the root with them."""
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    top = cut.filter("k = -1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select("conv_id", zero.alias("depth"), none.alias("parent_conv_id"), "n_convs", zero.alias("chars"))
    nodes = path.filter("node = rep").select("rep", "pos", "up", "n", "chars").toDF(*top.columns).unionByName(top)
    above = [F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")]
    below = nodes.filter("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left")
    return held.stored(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")


def _class_sums(nodes: DataFrame, cut: DataFrame, held: common.Held) -> DataFrame:
    """(k, a, b, first, rest, leaves): a class's smallest member, what its members save after its block, and the leaves they end in."""
    gains = nodes.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("k")).agg(
        F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("w"), F.count_if(F.col("n_children") == 0).alias("leaf")
    )
    own = cut.join(gains, ["conv_id", "k"], "left").select(
        "conv_id", *PREFIX, (-F.col("k")).alias("back"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("w", "leaf")]
    )
    later = _running(own, "back", {"p": F.col("w"), "q": F.col("leaf")}, F.sum)
    rest, leaves = F.col("p") + F.col("t_p"), F.col("q") + F.col("t_q") + F.col("leaf")
    return held.stored(later.groupBy(*PREFIX).agg(F.min("conv_id").alias("first"), F.sum(rest).alias("rest"), F.sum(leaves).alias("leaves")), "sums")


def _node_sums(path: DataFrame, sums: DataFrame) -> DataFrame:
    """(conv_id, depth, saved_tokens, n_leaves): a node adds up its classes, each from its own turn on."""
    tail = Window.partitionBy("rep", "k").orderBy(F.desc("pos"))
    gain = F.sum(F.when(F.col("node") == F.col("rep"), (F.col("n") - 1) * F.col("chars")).otherwise(0)).over(tail)
    rows = path.select("rep", "k", "pos", "node", gain.alias("gain")).join(sums, ["rep", "k"])
    return rows.groupBy(F.col("node").alias("conv_id"), F.col("pos").alias("depth")).agg(
        F.sum(F.col("rest") + F.col("gain")).alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )
