"""The duplicate finders against plain twins, on awkward documents."""

import hashlib
from collections import Counter

import brute
import numpy as np
import pytest

from skeinwork.llm import components, embed_dedup, line_dedup, relay, simhash, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.awkward(), brute.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows():
    return [r[:2] for r in brute.awkward()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def same(found, wanted):
    assert Counter(tuple(r) for r in found.collect()) == Counter(wanted)


def test_repeated_windows(docs, rows, empty):
    found = substring_dedup.repeated_windows(docs)
    same(found.select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.windows(rows))
    kept = {r["doc_id"]: r for r in found.filter("doc_id > 1").collect()}
    assert kept[3]["kept"] == "" and kept[18]["n_removed"] == 0 and kept[19]["n_removed"] == 1500
    assert substring_dedup.repeated_windows(empty).count() == 0


def test_windows_of_null_and_repeated_ids_in_several_passes(spark):
    passages = [brute.prose(70 + k, 30) for k in range(3)]
    own = lambda k: brute.prose(100 + k, 20)
    passes = [
        [(None, own(0) + " " + passages[0]), (5, passages[0] + " " + own(1))], [(None, own(2) + " " + passages[0])],
        [(7, own(3) + " " + passages[1]), (6, passages[1])], [(7, passages[1] + " " + own(4))],
        [(9, passages[2] + " " + own(5)), (8, own(6) + " " + passages[2])], [(9, own(7) + " " + passages[2])], [(9, own(8) + passages[2])],
    ]
    table = spark.createDataFrame(spark.sparkContext.parallelize(passes, len(passes)).flatMap(list), "doc_id long, text string")
    found = substring_dedup.repeated_windows(table)
    wanted = brute.windows([r for rows in passes for r in rows])
    assert sum(removed > 0 for _, _, removed, _ in wanted) == 7
    same(found.select("doc_id", "n_words", "n_removed", "kept_sha256"), wanted)


def test_every_window_holds_an_aligned_anchor():
    for a in range(substring_dedup.PERIOD):
        for b in range(substring_dedup.PERIOD):
            shifts = [d for d in range(substring_dedup.PERIOD) if {(a + d) % 7, (b + d) % 7} <= set(substring_dedup.COVER)]
            assert shifts and min(shifts) + substring_dedup.ANCHOR <= substring_dedup.WINDOW


def test_repeated_strings(docs, rows, empty):
    def tie(doc_id, text):
        data = (text or "").encode()
        doc = np.array([relay.common.NO_ID if doc_id is None else doc_id], np.int64)
        return int(relay.row_keys(doc, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])

    found = suffix_dedup.repeated_strings(docs)
    same(found.drop("kept"), brute.strings(rows, tie))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found.collect())
    assert suffix_dedup.repeated_strings(empty).count() == 0


def test_run_index_is_the_suffix_order():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n).tolist()) for n in (40, 1, 17, 60)] + [b"abab" * 12, b"a" * 30]
    index = suffix_dedup.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    places = [(t[k:], which) for which, t in enumerate(texts) for k in range(len(t) + 1)]
    order = sorted(range(len(places)), key=lambda p: (places[p][0], p))
    row = np.empty(len(places), int)
    row[order] = np.arange(len(places))
    assert index.rows().tolist() == row.tolist()
    assert index.starts.size < len(places)
    shared = index.statistics()
    for above, here in zip(order[:-1], order[1:]):
        a, b = places[above][0], places[here][0]
        assert shared[here] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_later_strings_of_long_and_periodic_texts():
    rng = np.random.default_rng(8)
    noise = bytes(rng.integers(0, 256, 300).tolist())
    texts = [b"ab" * 6000, noise, b"x" + noise[50:] + b"abab" * 90, b"", b"c" * 99, noise[:120] * 2]
    sizes, doc = np.array([len(t) for t in texts]), np.arange(len(texts))
    which, place = suffix_dedup.later_strings(np.frombuffer(b"".join(texts), np.uint8), sizes, doc, doc.astype(np.uint64), doc * 0)
    seen, wanted = set(), set()
    for i, text in enumerate(texts):
        for k in range(len(text) - 99):
            wanted |= {(i, k)} if text[k : k + 100] in seen else set()
            seen.add(text[k : k + 100])
    assert sorted(zip(which.tolist(), place.tolist())) == sorted(wanted)


def test_simhash(docs, rows, empty):
    marks = [brute.fingerprint(t) for _, t in rows]
    assert [simhash.fingerprint((t or "").encode()) for _, t in rows] == marks
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 2]
    root = brute.classes(len(rows), linked)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    same(simhash.near_duplicates(docs), [(i, f"{m:016x}", least.get(r)) for (i, _), m, r in zip(rows, marks, root)])
    kept = simhash.one_of_each(docs).cache()
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({**dict.fromkeys(least.values(), 1), None: 2})
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [b ^ (1 << int(p)) ^ (1 << int(q)) for b in base[:30].tolist() for p, q in rng.integers(0, 63, (6, 2))]
    points = sorted({*base.tolist(), *near, -1, -1 ^ (1 << 62), (-1 << 63), 0})
    table = spark.createDataFrame([(p,) for p in points], "fp long")
    linked = [(a, b) for a in range(len(points)) for b in range(a) if ((points[a] ^ points[b]) & (1 << 64) - 1).bit_count() <= 2]
    edges = [(points.index(r["a"]), points.index(r["b"])) for r in simhash.verified_links(table, simhash.met_cells(table)).collect()]
    pairs = {frozenset(pair) for pair in linked}
    assert all(frozenset(e) in pairs for e in edges)
    assert brute.classes(len(points), edges) == brute.classes(len(points), linked)


def test_random_fingerprints_do_not_meet(spark):
    points = np.unique(np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)).tolist()
    table = spark.createDataFrame([(p,) for p in points], "fp long")
    assert simhash.met_cells(table).count() == 0
    twin = spark.createDataFrame([(p,) for p in [*points, points[0] ^ 3, points[1] ^ (5 << 40)]], "fp long")
    cells = {r["cell"] for r in simhash.met_cells(twin).collect()}
    count = lambda p: sum((p >> 2 * s & 3).bit_count() << 2 * s for s in range(32))
    assert count(points[0]) - (1 << 64 if count(points[0]) >> 63 else 0) in cells or points[0] & 3 in (0, 3)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 8), (8, 8), (None, 4), (20, 19), (19, 18), (18, 17), (17, 16), (7, 8)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 12))
    rows = [(i, (base[i % 30] + rng.normal(size=12) * (0.1 if i % 3 else 0.0)).astype(np.float32).tolist(), i % 2) for i in range(120)]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0] * 11 + [None], [1.0] * 11 + [float("inf")]]
    rows += [(200 + k, v, 1) for k, v in enumerate(odd)] + [(300, rows[0][1], None), (None, rows[0][1], 0), (301, [1.0] * 5, 1), (302, [2.0] * 5, 1)]
    return [*rows, rows[3], rows[3]]


def test_embeddings(spark, monkeypatch):
    rows = vectors()
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, copies int").repartition(4)
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = []
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= embed_dedup.COSINE:
                    near.append((a, b))
    assert len(near) > 100
    root, count = brute.classes(len(rows), near), Counter(a for a, _ in near)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    wanted = [(i, count[k], least.get(root[k]), i == least.get(root[k])) for k, (i, *_) in enumerate(rows)]
    same(embed_dedup.near_duplicates(table), wanted)
    monkeypatch.setattr(embed_dedup, "SIDE", 3)  # cells in many tasks
    same(embed_dedup.near_duplicates(table), wanted)
    assert embed_dedup.near_duplicates(table.filter("false")).count() == 0


def test_embedding_blocks():
    """Points meet in cells and boxes exactly as by brute force, and most pairs of isotropic points are never looked at."""
    rng = np.random.default_rng(5)
    points = np.rint(rng.normal(size=(3000, 10)) * 1000)
    points[:40] = points[0] + np.rint(rng.normal(size=(40, 10)) * 20)
    points[40:60] = points[40]
    square = (points**2).sum(1)
    wanted = square[:, None] + square[None, :] - 2 * points @ points.T <= 650.0**2
    np.fill_diagonal(wanted, False)
    assert 60 <= wanted.any(1).sum() < 1000
    home = np.ones(len(points), bool)
    found, looked = embed_dedup.meets(points, home, None, 650.0**2)
    assert np.array_equal(found, wanted.any(1)) and looked < 0.2 * len(points) * (len(points) - 1) / 2
    home, second = rng.random(len(points)) < 0.5, rng.random(len(points)) < 0.3
    found, _ = embed_dedup.meets(points, home, second, 650.0**2)
    assert np.array_equal(found, (wanted & (home[:, None] | home[None, :]) & (second[:, None] != second[None, :])).any(1))
    cuts = np.quantile(points, [0.25, 0.5, 0.75], axis=0).round().astype(np.int64)
    for halvings in (0, 1, 7, 14, 20):
        own, row, cell = embed_dedup.cells(points.astype(np.int32), cuts, halvings, 650.0**2)
        there = [dict() for _ in range(2)]
        for i, c in enumerate(own.tolist()):
            there[0].setdefault(c, []).append(i)
        for i, c in zip(row.tolist(), cell.tolist(), strict=True):
            there[1].setdefault(c, []).append(i)
        times = np.zeros(wanted.shape, int)
        for c, homes in there[0].items():
            times[np.ix_(homes, homes)] += 1
            times[np.ix_(homes, there[1].get(c, []))] += 1
            times[np.ix_(there[1].get(c, []), homes)] += 1
        assert (times[wanted] == 1).all() and times.max() == 1


def test_embeddings_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 12))
    near = lambda k: (base[k] + rng.normal(size=12) * 0.02).astype(np.float32).tolist()
    rows = [(1, near(0), 0), (1, near(0), 0), (2, near(0), 0), (1, near(1), 0), (3, near(1), 0), (1, near(1), 1), (4, near(1), 1)]
    rows += [(7, near(2), 0), (7, near(3), 1), (6, near(2), 0), (8, near(3), 1), (9, near(3), 1), (5, near(3), 1)]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows))
             if a != b and rows[a][2] == rows[b][2] and units[a] @ units[b] >= embed_dedup.COSINE]
    root, count = brute.classes(len(rows), links), Counter(a for a, _ in links)
    least = {r: min(i for (i, *_), x in zip(rows, root) if x == r) for r in root}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    same(embed_dedup.near_duplicates(table), [(i, count[k], least[root[k]], i == least[root[k]]) for k, (i, *_) in enumerate(rows)])


def test_lines(spark, empty):
    rows = [(i, "menu \n" + f"own {i}\n\n  footer{i % 2}", f"s{i}") for i in range(12)]
    rows += [(50, None, "s1"), (51, "", "s2"), (52, "menu\nmenu", None), (53, "\n", "s3"), (0, "other under a known id\nmenu", "s0"), rows[1]]
    rows += [(60 + k, "just nine", f"s{k}") for k in range(9)] + [(80 + k, "exactly ten", f"s{k}") for k in range(10)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, key string, row int")
    spread = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            spread.setdefault(line.strip(" "), set()).update({site} - {None})
    wanted = []
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [line for line in lines if not line.strip(" ") or len(spread[line.strip(" ")]) < 10]
        wanted.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    same(line_dedup.without_boilerplate(table), wanted)
    assert line_dedup.without_boilerplate(empty).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use for themselves, in either case, do not clash and come back as they were."""
    from skeinwork.llm import decontam, mixing

    names = ["_source", "TOP", "edge", "_times", "turn", "key", "ranges", "items", "digest", "_doc_id", "gone_id", "size", "h", "root"]
    rows = [(i, brute.prose(i % 5, 30), f"s{i % 2}", *range(len(names))) for i in range(20)]
    docs = spark.createDataFrame([*rows, (50, "", "s0", *range(len(names)))], f"doc_id long, text string, source string, {', '.join(f'{n} int' for n in names)}")
    items = spark.createDataFrame([(k, brute.prose(k, 30)) for k in range(2)], "item_id long, text string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    for size in (decontam.AUTOMATON_NODES, 10):
        decontam.AUTOMATON_NODES, before = size, decontam.AUTOMATON_NODES
        clean = decontam.clean(spark, docs, items)
        assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {50, *(i for i in range(20) if i % 5 > 1)}
        decontam.AUTOMATON_NODES = before
    taken = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert mixing.mixed(docs).columns == docs.columns and max(taken.values()) == 2
