"""Encoding, masking and vocabulary training against small plain-Python twins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators import entities, labelled, masking, vocab, wordpiece
from skeinwork.plans import tokens
from skeinwork.session import frozen

TABLES = "/root/testdata/sf0.001"
TOKENS = [*vocab.SPECIALS, "un", "##aff", "##able", "##a", "a", "hello", ",", "##ff", "b"]
IDS = {t: i for i, t in enumerate(TOKENS)}


def cut(word):
    """Greedy longest match of one word."""
    if len(word) > 100:
        return [1]
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in IDS:
                out.append(IDS[piece])
                start = end
                break
        else:
            return [1]
    return out or [1]


WORDS = ["unaffable", "una", "hello", "xyz", "a" * 101, "a" * 100, "aff", "unaffablex", ",", "b"]


def test_segment(spark):
    types = spark.createDataFrame([(w, 1) for w in WORDS], "word string, n int")
    got = {r["word"]: r["pieces"] for r in wordpiece.segment(types, vocab.from_tokens(spark, TOKENS)).collect()}
    assert got == {w: cut(w) for w in WORDS}


@pytest.mark.parametrize("remembered", [1_000_000, 1])
def test_encode_with_and_without_remembered_words(spark, monkeypatch, remembered):
    monkeypatch.setattr(wordpiece, "MEMO_WORDS", remembered)
    texts = [(1, "hello, unaffable b b b"), (2, ""), (3, "b xyz " * 400), (4, None)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    encoded = wordpiece.encode(df, "doc_id", vocab.from_tokens(spark, TOKENS), max_len=16)
    got = {r["doc_id"]: r["input_ids"] for r in encoded.collect()}
    for key, text in texts:
        ids = [i for w in (text or "").replace(",", " , ").split() for i in cut(w)]
        assert got[key] == [2, *ids[:14], 3]


def test_trie_is_the_longest_match(spark):
    chance = random.Random(3)
    spell = lambda most: "".join(chance.choice("ab#é") for _ in range(chance.randrange(1, most)))
    for _ in range(60):
        tokens = [*vocab.SPECIALS, *{chance.choice(["", "##"]) + spell(5) for _ in range(chance.randrange(1, 14))}]
        ids = {t: i for i, t in enumerate(tokens)}
        trie = wordpiece.Trie(tokens, list(ids.values()))
        for word in [spell(12) for _ in range(80)]:
            out, start = [], 0
            while start < len(word) and out != [1]:
                ends = [e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in ids]
                out, start = (out + [ids[("##" if start else "") + word[start : ends[0]]]], ends[0]) if ends else ([1], len(word))
            assert list(trie.pieces(word)) == out, (tokens, word)


def test_cut_words_keeps_rows_and_columns(spark):
    rows = [(1, ["hello", "b", "hello"], ["una"]), (1, None, []), (None, [], ["xyz", "a" * 101, ""]), (1, ["hello", "b", "hello"], ["una"])]
    df = spark.createDataFrame(rows, "k int, x array<string>, y array<string>").repartition(1)
    got = sorted(map(repr, (tuple(r) for r in wordpiece.cut_words(df, ["x", "y"], vocab.from_tokens(spark, TOKENS)).collect())))
    cutting = lambda ws: ([i for w in ws or [] for i in cut(w)], [len(cut(w)) for w in ws or []])
    assert got == sorted(repr((k, x, y, *cutting(x), *cutting(y))) for k, x, y in rows)
    assert wordpiece.cut_words(df.limit(0), ["x"], vocab.from_tokens(spark, TOKENS)).count() == 0


def test_padding_modes(spark):
    df = spark.createDataFrame([(1, "hello b"), (2, "b")], "doc_id int, text string")
    words = vocab.from_tokens(spark, TOKENS)
    rows = {r["doc_id"]: r for r in wordpiece.encode(df, "doc_id", words, pad="longest").collect()}
    assert rows[1]["input_ids"] == [2, IDS["hello"], IDS["b"], 3] and rows[2]["input_ids"] == [2, IDS["b"], 3, 0]
    assert rows[2]["attention_mask"] == [1, 1, 1, 0]
    full = wordpiece.encode(df, "doc_id", words, max_len=6, pad="max_length").collect()
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == 6 for r in full)


def test_slice_pad(spark):
    df = spark.createDataFrame([([7, 8], [9, 10, 11]), ([7], [])], "a array<int>, b array<int>")
    rows = df.select(wordpiece.pair_template(F.col("a"), F.col("b"), 6).alias("p")).collect()
    assert rows[0]["p"]["input_ids"] == [2, 7, 8, 3, 9, 10]
    assert rows[0]["p"]["token_type_ids"] == [0, 0, 0, 0, 1, 1]
    assert rows[1]["p"]["input_ids"] == [2, 7, 3, 3]


@pytest.mark.parametrize("size_a", [0, 1, 4, 5, 9])
@pytest.mark.parametrize("size_b", [0, 1, 4, 5, 9])
@pytest.mark.parametrize("most", [8, 9])
def test_longest_first(spark, size_a, size_b, most):
    a, b = list(range(10, 10 + size_a)), list(range(30, 30 + size_b))
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    got = df.select(wordpiece.pair_template(F.col("a"), F.col("b"), most, "longest_first").alias("p")).first()["p"]
    while len(a) + len(b) > most - 3:
        (a if len(a) > len(b) else b).pop()
    assert got["input_ids"] == [2, *a, 3, *b, 3]


@pytest.mark.parametrize("size, wanted", [(512, 77), (10, 2), (30, 4), (1, 1), (1000, 80)])
def test_budget(spark, size, wanted):
    assert spark.range(1).select(masking.budget(F.lit(size))).first()[0] == wanted


def always(_):
    """A bound above every draw: each chosen piece becomes the mask id and can be seen."""
    return "g"


def test_whole_words_by_hand(spark, monkeypatch):
    monkeypatch.setattr(masking, "below", always)
    continues = [False] * 7 + [True] * 3
    rows = [
        (1, [2, 5, 7, 3]),  # budget one piece, the only word has two: nothing fits
        (2, [2, 5, 6, 3]),  # one of two words
        (3, [2, 5, 3]),
        (4, [2, 3]),
        (5, [2, 7, 8, 3] + [0] * 9),  # a word may begin with a continuation; budget two of thirteen
        (6, []),
    ]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>")
    got = {r["k"]: r["input_ids"] for r in masking.mask_whole_words(df, "k", 1, continues, skip_padding=True).collect()}
    assert got[1] == [2, 5, 7, 3] and got[2] in ([2, 4, 6, 3], [2, 5, 4, 3]) and got[3] == [2, 4, 3]
    assert got[4] == [2, 3] and got[5] == [2, 4, 4, 3] + [0] * 9 and got[6] == []
    padded = {r["k"]: r["input_ids"] for r in masking.mask_whole_words(df, "k", 1, continues).collect()}
    assert padded[5] in ([2, 4, 4, 3] + [0] * 9, [*padded[5][:13]]) and padded[5].count(4) == 2


@pytest.mark.parametrize("skip_padding", [False, True])
def test_whole_words_keep_to_their_budget(spark, monkeypatch, skip_padding):
    import hashlib

    chance = np.random.default_rng(5)
    continues = (np.arange(60) >= 5) & (chance.random(60) < 0.4)
    rows = []
    for k in range(60):
        inner = chance.integers(5, 60, int(chance.choice([0, 1, 7, 60, 510]))).tolist()
        rows.append((k, [2, *inner, 3] + [0] * int(chance.choice([0, 9]))))
    df = spark.createDataFrame(rows, "k int, input_ids array<int>")
    flags = [bool(c) for c in continues]
    drawn = {r["k"]: r for r in masking.mask_whole_words(df, "k", 3, flags, skip_padding=skip_padding).collect()}
    monkeypatch.setattr(masking, "below", always)
    seen = {r["k"]: r for r in masking.mask_whole_words(df, "k", 3, flags, skip_padding=skip_padding).collect()}
    outcomes = []
    for k, ids in rows:
        ids, out, other = np.array(ids), np.array(seen[k]["input_ids"]), np.array(drawn[k]["input_ids"])
        assert seen[k]["labels"] == drawn[k]["labels"] == ids.tolist()
        free = ~np.isin(ids, [0, 2, 3] if skip_padding else [2, 3])
        at = np.flatnonzero(free)
        if not at.size:
            assert np.array_equal(out, ids)
            continue
        word = np.cumsum(~continues[ids[at]] | (np.arange(at.size) == 0)) - 1
        taken = out[at] == 4
        assert np.array_equal(out[~free], ids[~free]) and np.array_equal(out[at][~taken], ids[at][~taken])
        sizes, hits = np.bincount(word), np.bincount(word, taken)
        assert set(hits / sizes) <= {0.0, 1.0}  # whole words or none of it
        most = min(80, max(1, round(ids.size * 0.15)))
        assert hits.sum() <= most
        heads = at[np.unique(word, return_index=True)[1]]
        texts = [hashlib.sha256(f"3:order:{k}:{i // 8}".encode()).hexdigest()[i % 8 * 8 : i % 8 * 8 + 8] for i in heads]
        order = np.lexsort((heads, texts))
        size, chosen = sizes[order], hits[order] > 0
        before = np.cumsum(size * chosen) - size * chosen
        assert np.array_equal(before + size <= most, chosen)  # taken exactly where it still fits
        assert np.array_equal(other[out == ids], ids[out == ids])
        outcomes += [np.select([y == 4, y == x], ["mask", "same"], "other") for x, y in zip(ids[at][taken], other[at][taken])]
    share = {name: np.mean(np.array(outcomes) == name) for name in ("mask", "same", "other")}
    assert abs(share["mask"] - 0.8) < 0.05 and abs(share["same"] - 0.1) < 0.04 and abs(share["other"] - 0.1) < 0.04


def test_mask_tokens_invariants(spark):
    encoded = frozen(tokens._encoded(spark, TABLES)[0])
    rows = masking.mask_tokens(encoded, "doc_id", 9).collect()
    changed = total = 0
    for row in rows:
        for x, y in zip(row["input_ids"], row["labels"]):
            assert x == y or (x == 4 and y > 4)
            changed, total = changed + (x != y), total + (y > 4)
    assert 0.14 < changed / total < 0.16


def test_masked_share_of_whole_words(spark):
    encoded, words = tokens._encoded(spark, TABLES)
    masked = masking.mask_whole_words(encoded, "doc_id", 9, vocab.continuation_flags(words))
    share = masking.masked_share(masked).first()["share"]
    assert 0.10 < share < 0.13


def train_by_hand(counts, size, least=2):
    """One merge at a time; only the words of the merged pair are counted again."""
    letters = sorted({c for w in counts for c in w})
    split = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in counts}
    out = dict.fromkeys([*vocab.SPECIALS, *letters, *sorted({s for p in split.values() for s in p[1:]})])
    pairs, held = {}, {}

    def add(word):
        for pair in zip(split[word], split[word][1:]):
            pairs[pair] = pairs.get(pair, 0) + counts[word]
            held.setdefault(pair, set()).add(word)

    for word in split:
        add(word)
    while len(out) < size and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < least:
            break
        out[best[0] + best[1].removeprefix("##")] = None
        for word in held.pop(best):
            for pair in zip(split[word], split[word][1:]):
                pairs[pair] -= counts[word]
            merged, parts = [], split[word]
            while parts:
                two = tuple(parts[:2]) == best
                merged.append(best[0] + best[1].removeprefix("##") if two else parts[0])
                parts = parts[1 + two :]
            split[word] = merged
            add(word)
        pairs = {p: n for p, n in pairs.items() if n > 0 and p != best}
    return list(out)


def test_training_on_a_corpus_equals_one_merge_at_a_time(spark):
    counts = frozen(vocab.word_counts(tokens.documents(spark, TABLES)))
    got = [r["token"] for r in vocab.train(counts, vocab_size=1500).orderBy("id").collect()]
    assert got == train_by_hand({r["word"]: r["n"] for r in counts.collect()}, 1500)


@pytest.mark.parametrize("limit", [60_000, 40, 3])
def test_training_equals_one_merge_at_a_time(spark, limit):
    chance = random.Random(11)
    counts = {}
    for _ in range(120):
        word = "".join(chance.choice("aabcde") for _ in range(chance.randrange(1, 8)))
        counts[word] = counts.get(word, 0) + chance.choice([1, 2, 3, 40])
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [r["token"] for r in vocab.train(df, vocab_size=60, look=16, limit=limit).orderBy("id").collect()]
    assert got == train_by_hand(counts, 60)


def some_words(seed, letters="aabcde", most=8, words=120):
    chance = random.Random(seed)
    counts = {}
    for _ in range(words):
        word = "".join(chance.choice(letters) for _ in range(chance.randrange(1, most)))
        counts[word] = counts.get(word, 0) + chance.choice([1, 2, 3, 40])
    return counts


def test_words_that_fit_are_merged_without_rounds(spark, monkeypatch):
    def no_round(*_):
        raise AssertionError("the words were gone through for a round")

    monkeypatch.setattr(vocab, "state_pairs", no_round)
    counts = some_words(5)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert [r["token"] for r in vocab.train(df, vocab_size=200).orderBy("id").collect()] == train_by_hand(counts, 200)


def test_encoding_on_a_trained_vocabulary_takes_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(vocab, "state_pairs", None)
    monkeypatch.setattr(vocab.train, "__defaults__", (300, *vocab.train.__defaults__[1:]))
    assert tokens.wordpiece_encode_trained(spark, TABLES).count() == tokens.documents(spark, TABLES).count()


def test_a_trained_training_table_takes_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(vocab, "state_pairs", None)
    monkeypatch.setattr(vocab.train, "__defaults__", (300, *vocab.train.__defaults__[1:]))
    assert tokens.training_table_trained(spark, TABLES).count() == tokens.documents(spark, TABLES).count()


def test_a_round_trip_carries_pieces_alone(spark, monkeypatch):
    carried = []
    decode = wordpiece.decode_words
    monkeypatch.setattr(wordpiece, "decode_words", lambda df, *a: carried.append(df.columns) or decode(df, *a))
    monkeypatch.setattr(vocab.train, "__defaults__", (300, *vocab.train.__defaults__[1:]))
    got = {r["doc_id"]: (r["n_words"], r["words"]) for r in tokens.trained_round_trip(spark, TABLES).collect()}
    listed = tokens.corpus_words(spark, TABLES).collect()
    assert got == {r["doc_id"]: (len(r["w"]), " ".join(w if len(w) <= 100 else "[UNK]" for w in r["w"])) for r in listed}
    assert carried == [["doc_id", "w_ids", "w_sizes"]]


def test_words_that_do_not_fit_are_merged_by_their_stretches(spark, monkeypatch):
    from skeinwork.operators import merges

    settled = []
    merged = merges.StretchMerger.merges
    monkeypatch.setattr(merges.StretchMerger, "merges", lambda self, *a: settled.append(merged(self, *a)) or settled[-1])
    counts = some_words(6, most=12)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [r["token"] for r in vocab.train(df, vocab_size=80, look=8, limit=620).orderBy("id").collect()]
    assert got == train_by_hand(counts, 80) and max(map(len, settled)) > 1


@pytest.mark.parametrize("passes", [3, 1000])
@pytest.mark.parametrize("letters", ["ab", "aabcde"])
def test_merges_in_one_process_equal_one_at_a_time(monkeypatch, passes, letters):
    import numpy as np

    from skeinwork.operators import merges

    monkeypatch.setattr(merges, "PASS", passes)
    monkeypatch.setattr(merges, "PAIRS_MOST", passes)
    monkeypatch.setattr(merges, "SHARE", 2)
    monkeypatch.setattr(merges, "TABLE_SYMBOLS", passes)
    for seed in range(6):
        counts = some_words(seed, letters, 10)
        start = train_by_hand(counts, 0)
        numbers = {t: i for i, t in enumerate(start, merges.FIRST)}
        words = sorted(counts, key=lambda w: -counts[w])
        flat = np.array([numbers[c if i == 0 else "##" + c] for w in words for i, c in enumerate(w)], np.uint16)
        whole = np.zeros(len(words), bool)
        cells = np.append(merges.laid(flat, np.array([len(w) for w in words]), whole, whole), flat.dtype.type(merges.GAP))
        found = merges.Merger(cells, np.array([counts[w] for w in words]), ["", "", *start]).merges(set(start), 10_000, 2)
        assert list(dict.fromkeys([*start, *(merges.merged_name(*pair) for pair in found)])) == train_by_hand(counts, 10_000)


def test_training_ends_with_the_pairs(spark):
    counts = {"abab": 3, "aab": 2, "b": 9, "ccc": 2, "cccc": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert [r["token"] for r in vocab.train(df).orderBy("id").collect()] == train_by_hand(counts, 30_500)
    assert vocab.train(df.limit(0)).count() == len(vocab.SPECIALS)


@pytest.mark.parametrize("align", ["word", "first_piece"])
def test_entity_rows(spark, align):
    sentence = [("unaffable", "X"), ("", "O"), ("hello,b", "Y"), ("xyz", "X"), ("a", "O")]
    rows = [("1", i, w, label) for i, (w, label) in enumerate(sentence)] + [("2", 0, "b", "X")]
    df = spark.createDataFrame(rows, "id string, pos int, word string, label string")
    index = labelled.label_index(df)
    number = {r["label"]: r["idx"] for r in index.collect()}
    out = entities.entity_rows(df, index, vocab.from_tokens(spark, TOKENS), length=12, pad_label=9, align=align)
    got = {r["id"]: r for r in out.collect()}
    ids, labels = [], [9]
    for word, label in sentence:
        pieces = [p for part in word.replace(",", " , ").split() for p in cut(part)]
        ids += pieces
        labels += [number[label]] + [9] * (len(pieces) - 1) if pieces else []
    wanted = [2, *ids, 3]
    assert got["1"]["input_ids"] == wanted + [0] * (12 - len(wanted))
    assert sum(got["1"]["attention_mask"]) == len(wanted)
    if align == "word":
        labels = [number[label] for _, label in sentence]
    assert got["1"]["labels"] == labels + [9] * (12 - len(labels))


def test_a_pass_takes_few_words_however_large_the_batch():
    import pyarrow as pa

    rows = [["a"] * n for n in (3, 0, 4, 30, 1, 1)] + [None, ["b"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["w"])
    cut = list(wordpiece._passes(batch, ["w"], 10))
    assert [row for part in cut for row in part.column(0).to_pylist()] == rows
    assert [sum(len(r or []) for r in part.column(0).to_pylist()) for part in cut] == [7, 30, 2, 9]


def test_only_contexts_that_are_asked_for_are_counted(spark):
    from collections import Counter

    from skeinwork.operators import fill

    texts = ["a b c a b d", "a", "", "b c a b c", None]
    corpus = spark.createDataFrame([(t.split() if t is not None else None,) for t in texts], "w array<string>")
    every = Counter()
    for words in (t.split(" ") for t in texts if t):
        every.update(zip(["", *words], [*words[1:], ""], words))
    both = spark.createDataFrame([("a", "c"), ("", ""), ("x", "y")], "l string, r string")
    found = {tuple(r) for r in fill.neighbour_counts(corpus, both).collect()}
    assert found == {(k[0], k[1], k[2], n) for k, n in every.items() if k[:2] in {("a", "c"), ("", "")}}
    left = Counter()
    for (before, _, word), n in every.items():
        left[before, word] += n
    found = {tuple(r) for r in fill.neighbour_counts(corpus, both.select("l").distinct()).collect()}
    assert found == {(*k, n) for k, n in left.items() if k[0] in {"a", ""}}


def test_pairs_of_a_training_round_are_those_of_all_words(spark):
    words = spark.createDataFrame([("abab", 3), ("b", 5), ("bab", 2)], "word string, n bigint")
    spelled = words.select("n", F.array_join(vocab.symbols(F.col("word")), " ").alias("s")).repartition(2)
    found = {tuple(r) for r in vocab.state_pairs(spelled).collect()}
    assert found == {tuple(r) for r in vocab.pair_counts(words).collect()} and len(found) == 4


def test_each_distinct_token_of_a_pass_is_cut_once(spark):
    import pyarrow as pa

    seen = []

    def note(token):
        seen.append(token)
        return tuple(i for word in token.split() for i in cut(word))

    texts = ["b b a b", None, "", "   b  a", "a" + " " * 9 + "b b b b", "a b"]
    got = wordpiece._text_ids(pa.array(texts, pa.string()), note, {}, 3).to_pylist()
    assert got == [[i for word in (t or "").split() for i in cut(word)][:3] for t in texts]
    assert sorted(seen) == ["", "a", "b"]
    every = wordpiece._text_ids(pa.array(texts, pa.string()), note, {}, None).to_pylist()
    assert every == [[i for word in (t or "").split() for i in cut(word)] for t in texts]


def test_texts_are_cut_as_their_words_are(spark):
    words = vocab.from_tokens(spark, [*TOKENS, "é", "e", "σ", "ς", "##ς", "日"])
    texts = ["Una,b Hello\nÉ é b", "日本b ΑΣ σ—b", "x" * 101 + " b", "", None, "­ ­" * 40 + " hello b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for most in (4, None):
        one = wordpiece.encode(df, "k", words, max_len=most)
        two = wordpiece.encode_words(df.select("k", text.words(F.col("text")).alias("w")), "k", words, max_len=most)
        assert sorted(one.collect()) == sorted(two.collect())


def test_words_are_counted_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(vocab, "PASS_BYTES", 10)
    chars = [chr(p) for p in range(0x300) if not 0xD800 <= p < 0xE000]
    texts = [f"A{c}b{c}" for c in chars] + [" ".join(f"x{c}Y" for c in chars), "Éé—É “a” ΟΔΟΣ, b", "가 a日b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {tuple(r) for r in vocab.counted(df, text.words(F.col("text"))).collect()}
    assert {tuple(r) for r in vocab.word_counts(df).collect()} == want


def test_whole_words_are_masked_by_passes(spark, monkeypatch):
    """Rows are worked on in batches of arrays, not id by id; a pass may end anywhere, and what is missing stays missing."""
    rows = [(k, [2, *range(5, 5 + k % 9), 3]) for k in range(50)] + [(50, None), (51, [2, None, 7, None, 3]), (None, [5, 6, 7])]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>").coalesce(1)
    masked = masking.mask_whole_words(df, "k", 3, [False] * 7 + [True] * 9)
    assert "ArrowEvalPython" in masked._jdf.queryExecution().toString()
    whole = masked.collect()
    monkeypatch.setattr(masking, "PASS_IDS", 7)
    assert masking.mask_whole_words(df, "k", 3, [False] * 7 + [True] * 9).collect() == whole
    assert [tuple(r)[::2] for r in whole] == rows and whole[50]["input_ids"] is None
    assert [x is None for x in whole[51]["input_ids"]] == [False, True, False, True, False]
