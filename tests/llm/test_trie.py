"""The conversation trie against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skeinwork.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k int, pos string, node long, rep long"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), role, text))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[: heads[c]] + ts[heads[c] :] for c, ts in turns.items()}


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]] += 1
    for prefix, some in members.items():
        gain = (len(some) - 1) * len(prefix[-1][1]) if prefix else 0
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += gain
            leaves[prefix[:d]] += kids[prefix] == 0
    out = []
    for prefix, some in members.items():
        ends = ",".join(str(c) for c in sorted(some) if len(convs[c]) == len(prefix))
        up = min(members[prefix[:-1]]) if prefix else None
        out.append((min(some), len(prefix), up, len(some), kids[prefix], leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def random_rows(seed, words, longest):
    """Few different turns, so that conversations share, end inside and part anywhere; copies, gaps, ties, nulls."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(100, 160), *range(200, 212), *range(300, 340), 405, 1000]:
        n = int(rng.integers(1, longest))
        shared = rng.integers(0, words, n)
        for t in range(n):
            text = ["", "a", "é∂", None, "longer text of a turn", "b" * 50][int(shared[t]) % 6]
            rows.append((c, int(t // rng.integers(1, 3)) if t % 7 else None, ["user", None, ""][int(shared[t]) % 3], text))
    some = rng.integers(0, words, 37)
    for c in range(500, 540):  # a group of copies, longer by turns
        rows += [(c, t, "user", f"copied {x}") for t, x in enumerate(some[: 37 - (c % 4)])]
    rows += [(300, t, "user", f"long {t}") for t in range(120)]
    rows += [(None, 1, "user", "of no conversation"), rows[0], rows[0]]
    return [(*r, 3, 4, "x", 5, 6) for r in rows]


def found(spark, rows, monkeypatch=None):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    placed = prefix_trie.numbered(table)
    trie = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(placed), placed.select("conv_id").distinct())
    return sorted((tuple(r) for r in trie.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed, words, longest", [(1, 2, 12), (2, 5, 30)])
def test_trie(spark, seed, words, longest):
    rows = random_rows(seed, words, longest)
    assert found(spark, rows) == nodes(rebuilt(rows))


def test_frequent_keys_apart_and_long_conversations_in_strides(spark, monkeypatch):
    """Lookup tables beyond their bound and more blocks than one window adds up give the same nodes."""
    monkeypatch.setattr(prefix_trie, "LOOKUP_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "STRIDE", 4)
    rows = random_rows(3, 3, 9)
    assert found(spark, rows) == nodes(rebuilt(rows))


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "text", 0, 0, "", 0, 0)]) == []


def test_conversations_without_turns(spark):
    few = [c for c in range(700, 760) if zlib.crc32(str(c).encode()) % 6 > 1]
    rows = [(c, 0, "user", "its only turn, replaced", 0, 0, "", 0, 0) for c in few if c != 700]
    got = found(spark, rows)
    assert got == nodes(rebuilt(rows)) and got[0][1] == 0 and got[0][5] == 1 and len(got) == 1
