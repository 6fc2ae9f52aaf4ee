"""The language predictor against plain counting."""

import math
import random
from collections import Counter

import pytest

from skeinwork.operators import language

CODES = ["xx", "aa"]


def grams(text):
    low = (text or "").lower()
    return [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)]


@pytest.mark.parametrize("limit", [1_000_000, 150])
def test_scores(spark, monkeypatch, limit):
    monkeypatch.setattr(language, "PASS_CHARS", 40)
    chance = random.Random(4)
    spell = lambda letters, n: "".join(chance.choice(letters) for _ in range(n))
    known = [(i, spell("abÉ \n", 30), "aa") for i in range(9)] + [(i, spell("xyé😀\x00", 30), "xx") for i in range(9, 18)]
    known += [(18, "other", "zz"), (19, "none", None), (20, None, "aa")]
    table = spark.createDataFrame(known, "k int, text string, lang string").repartition(3)
    model = language.train_languages(table, CODES)
    counts = {c: Counter(g for _, t, lang in known if lang == c for g in grams(t)) for c in CODES}
    kinds = {g for _, t, _ in known for g in grams(t)}
    weight = {g: [round(math.log((counts[c][g] + 1) / (counts[c].total() + len(kinds))) * 1e6) for c in CODES] for g in kinds}
    assert {r["gram"]: list(r["weights"]) for r in model.collect()} == weight
    asked = [(1, "ab ba"), (2, ""), (3, None), (4, "yx😀"), (1, "xyx"), (None, "ÉÉ"), (5, "qqq")]
    found = language.predict_languages(spark.createDataFrame(asked, "k int, text string"), "k", model, CODES, limit=limit)
    wanted = []
    for k, t in asked:
        sums = {c: sum(weight[g][j] for g in grams(t) if g in weight) for j, c in enumerate(CODES)}
        best = max(sums.values())
        wanted.append((k, min(c for c in CODES if sums[c] == best), best))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_rare_characters_and_tasks_of_many_passes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    chance = random.Random(9)
    texts = ["".join(chance.choice("ab\x00é中文😀") for _ in range(chance.randrange(0, 30))) for _ in range(40)] + [None, ""]
    codes = np.array([chance.randrange(3) for _ in texts])
    wanted = Counter((g, c) for t, c in zip(texts, codes.tolist()) for g in grams(t))
    monkeypatch.setattr(language, "CELLS", 80)
    found = [language.pass_counts(pa.array(texts[i : i + 5], pa.string()), codes[i : i + 5], 3, 3) for i in range(0, len(texts), 5)]
    keys, table = language.merged_counts(found)
    assert len(set(keys.tolist())) == keys.size
    assert {(language.gram_of(k), c): n for k, row in zip(keys.tolist(), table.tolist()) for c, n in enumerate(row) if n} == wanted
