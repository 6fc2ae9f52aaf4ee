"""SimHash near-duplicates: fingerprints embedded as per-segment bit counts, joined on a grid under Manhattan distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common
from skeinwork.llm.components import components
from skeinwork.session import broadcast_checked

SHINGLE = 3
SEED = 42
#: The 64 bits are cut into so many segments of two; a point's coordinates are their bit counts, 0 to 2.
SEGMENTS = 32
WIDTH = 64 // SEGMENTS
#: Rows to drop that may be broadcast (16 bytes each); more are joined by a shuffle.
DROPPED_ROWS = 1_000_000

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' hashes; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        runs = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
        runs = [line[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in runs), np.uint64, len(runs))
    counts = np.zeros(64, np.int64)
    for begin in range(0, hashes.size, 4096):
        bits = np.unpackbits(hashes[begin : begin + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint16)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, digest) of every row; null and empty texts have fingerprint zero. The digest is Spark's xxhash64 of the
    text, which tells rows of one id apart."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(found), batch.column("digest")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(take, "doc_id long, fp long, digest long")


def _signed(mask: int) -> int:
    return mask - (1 << 64 if mask >> 63 else 0)


def _point(fp: Column) -> Column:
    """The point of a fingerprint: the count of set bits of each two, 0 to 2, in those two bits."""
    pairs = F.lit(0x5555555555555555)
    upper = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(upper).bitwiseAND(pairs).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(pairs), 1))


def _flipped(value: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*(value.bitwiseXOR(F.lit(_signed(m)).cast("long")) for m in masks)))


#: A count, kept modulo 4, changes by one either way where its lower bit or both its bits flip.
STEPS = [0, *(m << (WIDTH * s) for s in range(SEGMENTS) for m in (1, 3))]
FLIPS = [0, *(1 << k for k in range(64))]


def met_cells(points: DataFrame) -> DataFrame:
    """The grid cells in which two of ``points`` (fp, distinct) meet.

    Each point stands in its own cell and in the 64 at Manhattan distance one, so two points of distance two at most always meet;
    that distance never exceeds the number of differing bits. A cell's points are counted, not paired. The chance that two random
    fingerprints meet is about 2e-11.
    """
    cells = points.select("fp", _flipped(_point(F.col("fp")), STEPS).alias("cell"))
    return cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("cell")


def verified_links(points: DataFrame, met: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that meet in the grid and differ in at most two bits; they span every such link.

    Two fingerprints differ in at most two bits exactly when some third one differs from both in at most one bit, and its
    point is a cell that both stand in. So within each cell where points met, they are compared at these midpoints, which can
    have 65 visitors at most: the smallest visitor is linked with the others. Each such pair is a true link, and every true
    link's ends meet at a midpoint.
    """
    visits = points.select("fp", _flipped(F.col("fp"), FLIPS).alias("mid")).withColumn("cell", _point(F.col("mid")))
    inside = visits.join(met, "cell", "left_semi")
    hubs = inside.groupBy("cell", "mid").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    hubs = hubs.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return hubs.filter("a != b").distinct()


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, digest, root, component_id) of every row of ``docs``; the root, a fingerprint, tells components apart."""
    marks = common.stored(fingerprints(docs), "fingerprints")
    classes = common.stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    points = classes.select("fp")
    roots = components(verified_links(points, common.stored(met_cells(points), "met")))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = common.stored(joined.join(least, "root").select("fp", "root", "component_id"), "components")
    return marks.join(known, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most two differing bits, the row itself included.
    Texts without words, null ones too, have fingerprint zero and link like any other. A row without an id links, but
    names a component only by others' ids; repeated rows each get a row. Copies are one class by fingerprint and are never
    paired.
    """
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return members(docs).select("doc_id", shown, "component_id")


def one_of_each(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """One row of ``docs`` of each component, all columns kept: of its smallest doc_id, and if that id has several texts, the
    one of smallest digest. Rows without an id stay; with ``unnamed`` they come after all that have one, so one stays, of
    smallest digest, only where nothing else of its component does.

    Only the rows to drop are looked up, by id and digest; while they are few they are broadcast, after counting.
    """
    found = common.stored(members(docs), "members")
    counted = found.groupBy("doc_id", "digest", "root").agg(F.count("*").alias("n"))
    first = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("digest").alias("first"))
    stays = F.col("digest").eqNullSafe(F.col("first")).alias("stays")
    named = counted.filter("doc_id is not null").join(first, "doc_id", "left")
    rows = common.stored(named.select("doc_id", "digest", "root", "n", stays), "rows")
    if unnamed:
        others = counted.filter("doc_id is null")
        alone = others.groupBy("root").agg(F.min("digest").alias("first")).join(rows.filter("stays").select("root"), "root", "left_anti")
        others = others.join(alone, "root", "left").select("doc_id", "digest", "root", "n", stays)
        rows = common.stored(rows.unionByName(others), "rows")
    other, digest = common.fresh(docs, "doc_id", "digest")
    gone = rows.filter("not stays").select("doc_id", "digest").toDF(other, digest)
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.xxhash64("text") == F.col(digest))
    kept = docs.join(broadcast_checked(gone, DROPPED_ROWS), same, "left_anti")
    if rows.filter("stays and n > 1").isEmpty():
        return kept
    without = kept.filter("doc_id is null")
    without = without.dropDuplicates(["text"]) if unnamed else without
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(without)
