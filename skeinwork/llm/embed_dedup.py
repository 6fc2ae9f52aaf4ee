"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. Rotated and cut into blocks, two such vectors are within their
block's proportional share of that distance in at least one block. Each block is range-joined by itself, on rows that hold
its coordinates only: labels of many vectors are cut into cells first, and in a cell boxes of points are split until few
points are left or their boxes lie too far apart. Whole vectors move only for what meets in some block, and are verified
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from skeinwork.llm import common
from skeinwork.llm.components import components
from skeinwork.session import broadcast_checked

COSINE = 0.98
BLOCKS = 6
#: Rotated coordinates are whole multiples of this, so that distances in blocks are exact in any order of summing.
UNIT = 2.0**-20
#: Vectors of a label, and of a cell, that one task takes; larger ones are cut into cells, and cells into sides.
SIDE = 8192
#: Vectors that the places of the cuts are read from, and the most times a label is halved. Links don't depend on either.
SAMPLE, HALVINGS = 1000, 40
#: Points of a box that are compared without splitting it again, and rows of a matrix of whole vectors.
LEAF, ROWS = 32, 256
SEED = 11


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def bounds(size: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def budget(size: int, width: int, cosine: float) -> float:
    """A block's squared radius in units, with room for rounding the coordinates."""
    share = np.sqrt((2 - 2 * cosine) * width / size) + np.sqrt(width) * UNIT
    return float((share / UNIT) ** 2) + 1


def links_at_all():
    """Whether a row can link: an id, a label, a vector of finite components that isn't zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(there & finite & some, F.lit(False))


def turned(classes: DataFrame) -> DataFrame:
    """The classes with their rotated coordinates, which are computed once: other shapes could round them otherwise."""
    schema = StructType([*classes.schema.fields, StructField("size", IntegerType()), StructField("turned", BinaryType())])
    names = schema.names

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for begin in range(0, at.size, 1024):
                    part = batch.take(pa.array(at[begin : begin + 1024]))
                    plain = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    whole = np.rint(unit(plain.reshape(-1, size)) @ rotation(size) / UNIT).astype(np.int32)
                    columns = [pa.array([size] * part.num_rows, pa.int32()), pa.array([x.tobytes() for x in whole], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)

    return classes.mapInArrow(turn, schema)


def unit(plain: np.ndarray) -> np.ndarray:
    scaled = plain / np.abs(plain).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def halved(classes: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The classes with how often their label is halved, and per vector size the quartiles of the rotated coordinates.

    Quartiles come from at most ``SAMPLE`` vectors of labels that are halved at all; a size not among them is not cut.
    """
    counts = classes.groupBy("label", "size").count().filter(F.col("count") > SIDE)
    counts = counts.select("label", "size", F.ceil(F.log2(F.col("count") / SIDE)).cast("int").alias("halvings"))
    known = classes.join(broadcast_checked(counts, 100_000), ["label", "size"], "left").fillna(0, ["halvings"])
    drawn = known.filter("halvings > 0").orderBy(F.xxhash64("turned"), "node").limit(SAMPLE).select("size", "turned").collect()
    cuts = {}
    for size in {row["size"] for row in drawn}:
        points = np.frombuffer(b"".join(row["turned"] for row in drawn if row["size"] == size), np.int32).reshape(-1, size)
        cuts[size] = np.quantile(points, [0.25, 0.5, 0.75], axis=0).round().astype(np.int64)
    return known, cuts


def cells(points: np.ndarray, cuts: np.ndarray, halvings: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's own cell, and (row, cell) of all smaller cells that lie within squared distance ``reach`` of a point.

    Dimensions are halved in turn, at the middle first, then at the quartiles. Of two points in different cells the one in
    the greater cell visits the other, so they meet once.
    """
    own = np.zeros(len(points), np.int64)
    row, cell, far = np.arange(len(points)), own.copy(), np.zeros(len(points))
    width = points.shape[1]
    for d in range(min(width, halvings)):
        edges = np.unique(cuts[:, d] if halvings > width + d else cuts[1:2, d])
        x = points[:, d].astype(np.int64)
        home = np.searchsorted(edges, x, "right")
        low, high = np.concatenate([[-(1 << 40)], edges]), np.concatenate([edges, [1 << 40]])
        away = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0).astype(float) ** 2
        many = len(edges) + 1
        own = own * many + home
        total = (far[:, None] + away[row]).ravel()
        cell = (cell[:, None] * many + np.arange(many)).ravel()
        row = np.repeat(row, many)
        near = total <= reach
        row, cell, far = row[near], cell[near], total[near]
    smaller = cell < own[row]
    return own, row[smaller], cell[smaller]


def placed(classes: DataFrame, cuts: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Each class with its coordinates at home in a cell of every block, and as a visitor where its radius reaches."""
    schema = "label string, size int, block int, cell long, home boolean, node long, at binary"
    names = [field.split()[0] for field in schema.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, halvings = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("size", "halvings"))
            for size, times in sorted(set(zip(sizes.tolist(), halvings.tolist(), strict=True))):
                rows = np.flatnonzero((sizes == size) & (halvings == times))
                for begin in range(0, rows.size, 1024):
                    yield from _place(batch.take(pa.array(rows[begin : begin + 1024])), size, times)

    def _place(batch: pa.RecordBatch, size: int, times: int) -> Iterator[pa.RecordBatch]:
        whole = np.frombuffer(b"".join(batch.column("turned").to_pylist()), np.int32).reshape(-1, size)
        for block, (a, b) in enumerate(bounds(size)):
            points = np.ascontiguousarray(whole[:, a:b])
            often = min(times, 2 * (b - a), HALVINGS) if size in cuts else 0
            own, guest, cell = cells(points, cuts[size][:, a:b] if often else np.empty((3, 0)), often, budget(size, b - a, cosine))
            row = np.concatenate([np.arange(len(points)), guest])
            at = pa.array([x.tobytes() for x in points], pa.binary())
            columns = [
                batch.column("label").cast(pa.string()).take(pa.array(row)), np.full(row.size, size), np.full(row.size, block),
                np.concatenate([own, cell]), np.arange(row.size) < len(points), batch.column("node").take(pa.array(row)), at.take(pa.array(row)),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return classes.mapInArrow(place, schema)


KEYS = ["label", "size", "block", "cell", "first", "second"]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with the task they meet in: cells of many rows are cut into sides by hash, and each two sides are a task."""
    key = ["label", "size", "block", "cell"]
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides")).filter("sides > 1")
    joined = rows.join(broadcast_checked(counts, 100_000), key, "left").fillna(1, ["sides"])
    joined = joined.withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return joined.withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other")).drop("sides", "other")


def meets(points: np.ndarray, home: np.ndarray, second: np.ndarray | None, reach: float) -> tuple[np.ndarray, int]:
    """Which points lie within squared distance ``reach`` of another, and how many pairs were looked at to know.

    With ``second`` only points on different sides of it are compared. Visitors are not compared with visitors.
    """
    found, looked = np.zeros(len(points), bool), 0
    every = np.arange(len(points))
    todo = [(every, every, True)] if second is None else [(every[~second], every[second], False)]
    while todo:
        a, b, same = todo.pop()
        if not same:
            for _ in range(2):  # what lies too far from the other's box has no partner there
                if not a.size or not b.size:
                    break
                low, high = points[a].min(0), points[a].max(0)
                away = np.maximum(np.maximum(low - points[b], points[b] - high), 0)
                a, b = b[(away * away).sum(1) <= reach], a
        if not a.size or not b.size or (same and a.size < 2):
            continue
        if max(a.size, b.size) > LEAF:
            if a.size < b.size:
                a, b = b, a
            spread = points[a]
            order = np.argpartition(spread[:, np.argmax(np.ptp(spread, 0))], a.size // 2)
            left, right = a[order[: a.size // 2]], a[order[a.size // 2 :]]
            todo += [(left, left, True), (right, right, True), (left, right, False)] if same else [(left, b, False), (right, b, False)]
            continue
        u, v = points[a], points[b]
        near = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T) <= reach
        near &= home[a][:, None] | home[b][None, :]
        if same:
            np.fill_diagonal(near, False)
        looked += a.size * (a.size - 1) // 2 if same else near.size
        found[a] |= near.any(1)
        found[b] |= near.any(0)
    return found, looked


def candidates(rows: DataFrame, cosine: float) -> DataFrame:
    """The dealt rows, without their coordinates, that are near another row of their task in the block."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        size, block = int(group["size"].iloc[0]), int(group["block"].iloc[0])
        a, b = bounds(size)[block]
        points = np.frombuffer(b"".join(group["at"]), np.int32).reshape(-1, b - a).astype(np.float64)
        second = (group["side"] == group["second"]).to_numpy() if group["first"].iloc[0] != group["second"].iloc[0] else None
        found, _ = meets(points, group["home"].to_numpy(), second, budget(size, b - a, cosine))
        return group.loc[found, [*KEYS, "home", "side", "node"]]

    schema = "label string, size int, block int, cell long, first int, second int, home boolean, side int, node long"
    return rows.groupBy(*KEYS).applyInPandas(join, schema)


def links(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, n, root): links found of a class in a task, copies counted, and a class it is connected to there.

    ``rows`` are candidates with copies, turned and embedding. A pair meets once in each block that it passes and is counted
    in the first of them. A node has a row for each stretch of ``ROWS`` others that it links with, so no pairs are listed.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        size, block = int(group["size"].iloc[0]), int(group["block"].iloc[0])
        group = group.sort_values("node", ignore_index=True)
        spans = bounds(size)[: block + 1]
        whole = np.frombuffer(b"".join(group["turned"]), np.int32).reshape(-1, size).astype(np.float64)
        vectors = unit(np.stack(group["embedding"].to_list()).astype(np.float64))
        node, copies, home, side = (group[c].to_numpy() for c in ("node", "copies", "home", "side"))
        across = group["first"].iloc[0] != group["second"].iloc[0]
        out = []
        for begin in range(0, node.size, ROWS):
            own = slice(begin, begin + ROWS)
            rest = slice(begin, None)  # every pair once: the smaller node in the stretch
            candidate = (node[own][:, None] < node[rest][None, :]) & (home[own][:, None] | home[rest][None, :])
            if across:
                candidate &= side[own][:, None] != side[rest][None, :]
            for k, (a, b) in enumerate(spans):
                u, v = whole[own, a:b], whole[rest, a:b]
                near = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T) <= budget(size, b - a, cosine)
                candidate &= near if k == block else ~near
            i, j = np.nonzero(candidate)
            true = [
                (vectors[own][i[p : p + 65536]] * vectors[rest][j[p : p + 65536]]).sum(1) >= cosine for p in range(0, i.size, 65536)
            ]
            true = np.concatenate([np.empty(0, bool), *true])
            i, j = i[true], j[true]
            if not i.size:
                continue
            n = np.bincount(j, copies[own][i], node.size - begin)
            n[: copies[own].size] += np.bincount(i, copies[rest][j], copies[own].size)
            root = node[rest].copy()
            while True:
                before = root.copy()
                np.minimum.at(root, j, root[i])
                np.minimum.at(root, i, root[j])
                if np.array_equal(root, before):
                    break
            some = n > 0
            out.append(pd.DataFrame({"node": node[rest][some], "n": n[some].astype(np.int64), "root": root[some]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "n": [], "root": []}, dtype=np.int64)

    return rows.groupBy(*KEYS).applyInPandas(compare, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and their cosine is at least ``cosine``. Equal vectors are one class, counted but not
    paired. Vectors that are null, zero, of another length, or hold null or non-finite components link with nothing, nor do
    rows without a label or an id; they are their own component. Repeated rows link with each other. An id only names: rows
    that repeat one with other vectors or labels link by their own, and a component is named by its smallest id, so two that
    hold rows of one id can share a name.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    good = vectors.filter(links_at_all())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    # numbers that stay as they are stored
    classes = common.stored(turned(classes.withColumn("node", F.monotonically_increasing_id())), "classes")
    rows = common.stored(placed(*halved(classes), cosine), "placed")
    met = common.stored(candidates(dealt(rows), cosine), "met")
    met = met.join(classes.select("node", "copies", "turned", "embedding"), "node")
    found = common.stored(links(met, cosine), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = roots.join(classes.select("node", "vec_id"), "node")
    names = members.groupBy("root").agg(F.min("vec_id").alias("name"))
    named = roots.join(names, "root").select("node", "name")
    known = classes.join(counts, "node", "left").join(named, "node", "left")
    known = known.select(
        F.col("label").alias("l"), F.col("embedding").alias("e"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("name", "vec_id").alias("c"),
    )
    linked = good.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n", "c")
    lone = vectors.filter(~links_at_all()).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c"))
    every = linked.unionByName(lone)
    return every.select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("c")).alias("kept"))
