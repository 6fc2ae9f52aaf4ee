"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell. For an anchor, a codeword
bounds the half score of every vector it holds: the product with the codeword plus the anchor's norm times the codeword's
radius. A heap visits cells by the sum of both bounds, best first (the multi-sequence walk), and stops once no cell left can
hold a row that belongs to what is asked: the best positives, or the best rows of each positive's score window.

Rows lie in shards of bounded bytes, each indexed whole where it lies; anchors go to every shard in blocks of bounded size, and
the shards' best rows are merged. Results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm import common
from skeinwork.session import scratch_path

#: Bytes of vectors that one index holds, rows of a cell to aim at, and rows of a shard its codebooks are fitted on.
SHARD_BYTES, CELL_ROWS, SAMPLE, ROUNDS = 16 << 20, 32, 2048, 6
#: Rows scored between two looks at whether the search may stop; anchors that are broadcast at once.
STEP, ANCHORS = 512, 16_384
#: Room for rounding in a bound; scores are whole numbers.
SLACK = 0.5
LONG = 2**63 - 1


def codebook(half: np.ndarray, size: int) -> np.ndarray:
    """Codewords by k-means on evenly spaced rows."""
    sample = half[np.linspace(0, len(half) - 1, min(SAMPLE, len(half))).astype(int)]
    words = sample[np.linspace(0, len(sample) - 1, size).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest(sample, words)
        counts = np.bincount(near, minlength=size)
        sums = np.zeros_like(words)
        np.add.at(sums, near, sample)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def nearest(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1)[None] - 2 * (half @ words.T)).argmin(1)


class MultiIndex:
    """Rows of one length, sorted by cell."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        plain = vectors.astype(np.float64)
        cut = vectors.shape[1] // 2
        self.cut, self.side = cut, max(1, isqrt(len(ids) // CELL_ROWS))
        self.words, self.radii, codes = [], [], []
        for half in (plain[:, :cut], plain[:, cut:]):
            words = codebook(half, self.side)
            code = nearest(half, words)
            radius = np.full(self.side, -np.inf)
            np.maximum.at(radius, code, np.sqrt(((half - words[code]) ** 2).sum(1)))
            self.words.append(words)
            self.radii.append(radius)
            codes.append(code)
        cell = codes[0] * self.side + codes[1]
        order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[order], np.arange(self.side**2 + 1)).tolist()
        self.ids, self.ties, self.labels = ids[order], ties[order], labels[order]
        self.plain, self.whole = plain[order], vectors[order]
        self.most = float(np.abs(plain).max(initial=0))

    def visits(self, anchor: np.ndarray, ceiling: float = np.inf) -> Iterator[tuple[np.ndarray, float]]:
        """(rows, bound): rows of the next cells, and what no row of a later cell exceeds. Cells all above ``ceiling`` are left out."""
        upper, lower, order = [], [], []
        for half, words, radii in zip((anchor[: self.cut], anchor[self.cut :]), self.words, self.radii, strict=True):
            middle, reach = words @ half, np.sqrt(half @ half) * np.maximum(radii, 0)
            bound = np.where(radii < 0, -np.inf, middle + reach)
            by = np.argsort(-bound, kind="stable")[: int((radii >= 0).sum())]
            order.append(by.tolist())
            upper.append(bound[by].tolist())
            lower.append((middle - reach)[by].tolist())
        (up, across), (low, along), (first, second) = upper, lower, order
        heap = [(-(up[0] + across[0]), 0, 0)]
        pieces, held = [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(across):
                heapq.heappush(heap, (-(up[i] + across[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up):
                heapq.heappush(heap, (-(up[i + 1] + across[0]), i + 1, 0))
            cell = first[i] * self.side + second[j]
            a, b = self.starts[cell], self.starts[cell + 1]
            if a < b and low[i] + along[j] - SLACK <= ceiling:
                pieces.append(np.arange(a, b))
                held += b - a
            if held >= STEP or not heap:
                yield np.concatenate(pieces) if pieces else np.empty(0, np.int64), (-heap[0][0] + SLACK if heap else -np.inf)
                pieces, held = [], 0

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole inner products; beyond what doubles hold exactly they are taken in Python's integers and end at those of a long."""
        if self.most * float(np.abs(anchor.astype(np.float64)).max(initial=0)) * max(1, anchor.size) < 2**52:
            return (self.plain[rows] @ anchor.astype(np.float64)).astype(np.int64)
        exact = [sum(int(x) * int(y) for x, y in zip(row, anchor, strict=True)) for row in self.whole[rows]]
        return np.array([max(-LONG, min(LONG, s)) for s in exact], np.int64)

    def best(self, held: tuple[np.ndarray, np.ndarray], rows: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` of rows held and new: higher scores, then smaller ids."""
        rows, scores = np.concatenate([held[0], rows]), np.concatenate([held[1], scores])
        order = np.lexsort((self.ties[rows], self.ids[rows], -scores))[:n]
        return rows[order], scores[order]

    def positives(self, anchor_id: int, tie: int, label: int, anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``n`` other rows of the anchor's label."""
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for rows, bound in self.visits(anchor.astype(np.float64)):
            rows = rows[(self.labels[rows] == label) & ((self.ids[rows] != anchor_id) | (self.ties[rows] != tie))]
            held = self.best(held, rows, self.scores(rows, anchor), n)
            if len(held[0]) == n and held[1][-1] > bound:
                break
        return held

    def windows(self, label: int, anchor: np.ndarray, spans: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each span of scores, ends included, the best ``n`` rows of other labels in it."""
        held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in spans]
        live = [k for k, (low, high) in enumerate(spans) if low <= high]
        if not live:
            return held
        for rows, bound in self.visits(anchor.astype(np.float64), max(spans[k][1] for k in live)):
            rows = rows[self.labels[rows] != label]
            scores = self.scores(rows, anchor)
            for k in live:
                low, high = spans[k]
                least = max(low, int(held[k][1][-1])) if len(held[k][0]) == n else low
                inside = (scores >= least) & (scores <= high)
                if inside.any():
                    held[k] = self.best(held[k], rows[inside], scores[inside], n)
            live = [k for k in live if bound >= spans[k][0] and not (len(held[k][0]) == n and held[k][1][-1] > bound)]
            if not live:
                break
        return held


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, tie, q): rows with an id, a label and a finite vector, in whole numbers; equal rows once, dealt by content."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = vectors.filter(there).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("q")).distinct()
    return rows.select("vec_id", "label", F.xxhash64("label", "q").alias("tie"), "q")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[MultiIndex]:
    """Indexes over the rows of a task, by length of vector, each of bounded bytes."""
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
    held: dict[int, int] = {}

    def index(size: int) -> MultiIndex:
        columns = [np.concatenate(c) for c in zip(*waiting.pop(size), strict=True)]
        held.pop(size)
        return MultiIndex(*columns)

    for batch in batches:
        sizes = pc.list_value_length(batch.column("q")).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            some = batch.take(pa.array(np.flatnonzero(sizes == size)))
            vectors = some.column("q").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, size)
            for begin in range(0, len(vectors), most := max(256, SHARD_BYTES // (8 * max(1, size)))):
                piece = slice(begin, begin + most)
                waiting.setdefault(size, []).append((*(some.column(c).to_numpy()[piece] for c in ("vec_id", "tie", "label")), vectors[piece]))
                held[size] = held.get(size, 0) + len(vectors[piece])
                if held[size] >= most:
                    yield index(size)
    for size in list(waiting):
        yield index(size)


_POSITIVES = "anchor_id long, anchor_tie long, positive_score long, positive_id long, positive_tie long"
_NEGATIVES = f"{_POSITIVES}, negative_score long, negative_id long, negative_tie long"


def _first(df: DataFrame, keys: list[str], kind: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key; a task keeps no more of its own before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(f"{kind}_score"), f"{kind}_id", f"{kind}_tie")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _rows(schema: str, columns: list[list]) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    arrays = [pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for c in columns] if columns else [pa.array([], pa.int64())] * len(names)
    return pa.RecordBatch.from_arrays(arrays, names)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding, label).

    Anchors are the rows whose id ``every`` divides; a positive is one of the first ``positives`` other rows of its label, a
    negative one of the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.
    Rows without an id, and those of null labels, null vectors or components that are null or not finite, take no part. Equal
    rows count once; rows that repeat an id with another label or vector are rows each, told apart by content where scores tie.
    Vectors of different lengths do not meet; those of no length score 0. Components beyond a long count as its ends.
    """
    spark = vectors.sparkSession
    held = common.Held()
    rows = held.stored(taking_part(vectors).repartition(common.parts(spark), "vec_id", "tie"), "rows")
    chosen = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-chosen.count() // ANCHORS))
    out = scratch_path(spark, "negatives")
    for block in range(blocks):
        anchors = chosen.filter(F.pmod(F.xxhash64("tie", "vec_id"), F.lit(blocks)) == block).collect()
        asked = spark.sparkContext.broadcast([(r["vec_id"], r["tie"], r["label"], np.array(r["q"], np.int64)) for r in anchors])
        found = held.stored(_first(rows.mapInArrow(_positives(asked, positives), _POSITIVES), ["anchor_id", "anchor_tie"], "positive", positives), "positives")
        spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in found.collect():
            spans.setdefault((r["anchor_id"], r["anchor_tie"]), []).append((r["positive_score"], r["positive_id"], r["positive_tie"]))
        wanted = spark.sparkContext.broadcast(spans)
        mined = rows.mapInArrow(_negatives(asked, wanted, negatives, low, high), _NEGATIVES)
        keys = [field.split()[0] for field in _POSITIVES.split(", ")]
        _first(mined, keys, "negative", negatives).write.parquet(f"{out}/block={block}")
        asked.unpersist()
        wanted.unpersist()
    held.clear()
    return spark.read.schema(f"{_NEGATIVES}, rank int").parquet(out).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _positives(asked, n: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in shards(batches):
            columns: list[list] = [[] for _ in range(5)]
            for anchor_id, tie, label, anchor in asked.value:
                if anchor.size == index.plain.shape[1]:
                    rows, scores = index.positives(anchor_id, tie, label, anchor, n)
                    for column, values in zip(columns, (np.full(rows.size, anchor_id), np.full(rows.size, tie), scores, index.ids[rows], index.ties[rows]), strict=True):
                        column.append(values)
            yield _rows(_POSITIVES, columns)

    return look


def _negatives(asked, wanted, n: int, low: int, high: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in shards(batches):
            columns: list[list] = [[] for _ in range(8)]
            for anchor_id, tie, label, anchor in asked.value:
                some = wanted.value.get((anchor_id, tie), [])
                if anchor.size != index.plain.shape[1] or not some:
                    continue
                spans = [(-(-low * score // 100), high * score // 100) for score, _, _ in some]
                for positive, (rows, scores) in zip(some, index.windows(label, anchor, spans, n), strict=True):
                    same = [np.full(rows.size, x) for x in (anchor_id, tie, *positive)]
                    for column, values in zip(columns, (*same, scores, index.ids[rows], index.ties[rows]), strict=True):
                        column.append(values)
            yield _rows(_NEGATIVES, columns)

    return look
