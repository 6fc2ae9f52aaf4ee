"""The secret scan: base patterns against plain ones, the models on strings they have not seen."""

import hashlib
import re

import brute
import numpy as np
import pytest

from skeinwork.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = [sum(k == kind for _, k, _ in found) for kind in range(3)]
    listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)


def texts():
    key, rng = "AKIA" + "7QX2" * 4, np.random.default_rng(2)
    known = [
        None, "", " ", f"é {key} ñ token=abc", "token: abc password = 'hunter22' API_KEY=x.y/z+1=", "ToKeN\"  :  \"0123456789abcdef0123456789",
        "secret==abcdef secretsecret=abcdefgh", "passwd='", "a" * 23, "f" * 24, "token=token=tokenx", "AKIAAKIA" + "A" * 12, "AKIA" + "A" * 15,
        "ſecret=longenough", "toKen=longenough apikey:'abcdef", "deadbeef" * 400, "token \n= abcdefg", "x" * 50_000 + " token=" + "9" * 9_000,
    ]
    parts = ["token", "=", ":", " ", '"', "abc123", "API_key", "AKIA", "ZZ99", "deadbeef", "é", "secret", "\n", "passwd", "0" * 24, "'"]
    return known + ["".join(rng.choice(parts, int(rng.integers(1, 30)))) for _ in range(300)]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [(i, t, "extra", 7) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, rows[4][1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int").repartition(3)
    found = secrets.secret_spans(spark, docs).collect()
    assert len(found) == len(rows)
    wanted = {i: plain(t or "") for i, t, *_ in rows}
    for r in found:
        counts = (r["n_assign"], r["n_access"], r["n_hex"])
        assert (*counts, r["base_sha256"]) == wanted[r["doc_id"]][:4], rows[r["doc_id"] or 4]
        own = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert ",".join(own) == wanted[r["doc_id"]][4] and len(own) + r["n_added"] == len([s for s in r["spans"].split(",") if s])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secret_spans(spark, empty).count() == 0


def test_added_spans_are_random_strings_no_pattern_touches(spark):
    rng = np.random.default_rng(99)
    planted = [bytes(rng.choice(np.frombuffer(a, np.uint8), 40)).decode() for a in secrets.ALPHABETS[2:] for _ in range(40)]
    rows = [(i, f"Ünd the key is ({s}), keep_it_in section-12-of-the-manual2. {brute.prose(i, 40)}") for i, s in enumerate(planted)]
    rows.append((len(rows), "token=" + planted[0]))
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [found[i] == f"random:16:{16 + len(s)}" for i, s in enumerate(planted)]
    assert np.mean(hits) >= 0.95
    assert found[len(planted)] == f"assign:0:{6 + len(planted[0])}"


@pytest.mark.parametrize("fold", range(3))
def test_held_out_accuracy(fold):
    samples = secrets.labelled()
    rest, held = [s for i, s in enumerate(samples) if i % 3 != fold], [s for i, s in enumerate(samples) if i % 3 == fold]
    models = secrets.train(rest)
    raw = [s.encode() for s, _ in held]
    ends = np.cumsum([len(r) for r in raw])
    scores = models.scores(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    truth = np.array([y for _, y in held])
    assert np.mean(scores[truth] >= secrets.THRESHOLD) >= 0.97 and np.mean(scores[~truth] >= secrets.THRESHOLD) <= 0.05


def test_touching():
    base = [(0, "hex", 50), (5, "assign", 10), (60, "hex", 70)]
    assert list(secrets.untouched([(2, 3), (49, 52), (50, 55), (55, 61), (70, 80)], base)) == [(50, "random", 55), (70, "random", 80)]
