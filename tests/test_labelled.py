"""Tagged spans, label sets, relations and question files against hand-made results."""

import random

from pyspark.sql import functions as F

from skeinwork.operators import labelled, language, metrics, order, runs

LINES = [
    "1|t|Role of (ataxia) gene",
    "1|a|Ataxia occurs.",
    "1\t9\t15\tataxia\tSpecificDisease\tD1",
    "   ",
    "1\t22\t28\tAtaxia\tSpecificDisease\tD1",
    "2|t|no spans",
    "a|b|c|d",
    "1\tx\t28\tAtaxia\tSpecificDisease\tD1",
]


def lines_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_no bigint, value string")


def test_tagged_spans(spark):
    docs, spans, rejects = labelled.split_tagged_lines(lines_of(spark, LINES))
    assert (docs.count(), spans.count()) == (3, 2)
    assert sorted(r["line_no"] for r in rejects.collect()) == [6, 7]
    got = labelled.span_labels(docs, spans).orderBy("id", "pos").collect()
    assert [(r["word"], r["start"], r["label"]) for r in got if r["id"] == "1"] == [
        ("Role", 0, "O"), ("of", 5, "O"), ("(ataxia)", 8, "SpecificDisease"), ("gene", 17, "O"),
        ("Ataxia", 22, "SpecificDisease"), ("occurs.", 29, "O"),
    ]
    assert [r["label"] for r in got if r["id"] == "2"] == ["O", "O"]


def test_random_spans_match_a_character_map(spark):
    """Many lines per document, double spaces, overlapping, overlong and empty spans."""
    chance = random.Random(3)
    values = []
    for doc in ("x", "y"):
        for _ in range(30):
            words = ["".join(chance.choice("ab(é") for _ in range(chance.randrange(0, 6))) for _ in range(8)]
            values.append(f"{doc}|a|{' '.join(words)}")
        for _ in range(150):
            start = chance.randrange(0, 1200)
            end = start + chance.choice([-2, 0, 1, 5, 40, 300])
            values.append(f"{doc}\t{start}\t{end}\ts\tL{chance.randrange(9)}\tc")
    values.append("y\t700\t900000000\ts\tHUGE\tc")
    docs, spans, _ = labelled.split_tagged_lines(lines_of(spark, values))
    marks, texts = {}, {}
    for value in values:
        if value[1] == "|":
            texts.setdefault(value[0], []).append(value[4:])
        else:
            doc, start, end, _, label, _ = value.split("\t")
            for i in range(int(start), min(int(end), 5000)):
                marks[doc, i] = label
    wanted = []
    for doc, parts in texts.items():
        at = 0
        for pos, word in enumerate(" ".join(parts).split(" ")):
            wanted.append((doc, pos, at, word, marks.get((doc, at + word.startswith("(")), "O")))
            at += len(word) + 1
    got = labelled.span_labels(docs, spans).collect()
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_groups_and_indices(spark):
    rows = [("1", 1, "b", "X"), ("1", 0, "a", "O"), ("2", 0, "c", "O")]
    tokens = spark.createDataFrame(rows, "id string, pos int, word string, label string")
    grouped = {r["id"]: r for r in labelled.grouped_sentences(tokens).collect()}
    assert grouped["1"]["sentence"] == "a b" and grouped["1"]["labels"] == ["O", "X"]
    index = labelled.label_index(tokens)
    assert {r["label"]: r["idx"] for r in index.collect()} == {"O": 0, "X": 1}
    unseen = spark.createDataFrame([("3", 0, "d", "NEW")], tokens.schema)
    assert labelled.with_label_ids(unseen, index).first()["label_id"] is None
    df = spark.createDataFrame([([1, 2], [1, 3])], "l array<int>, n array<int>")
    row = df.select(
        labelled.padded_labels(F.col("l"), 4).alias("p"), labelled.labels_on_pieces(F.col("l"), F.col("n"), 6).alias("q")
    ).first()
    assert row["p"] == [1, 2, 4, 4] and row["q"] == [4, 1, 2, 4, 4, 4]


def test_relations_part_into_known_and_rejects(spark):
    rows = [("<< a >> x [[ b ]] .", "AGONIST"), ("no marks", "AGONIST"), ("<< a >> [[ b ]]", "OTHER")]
    df = spark.createDataFrame(rows, "text string, label string")
    for variant in ("token", "substring"):
        known, rejects = labelled.relation_records(df, variant)
        assert [r["class"] for r in known.collect()] == [2] and rejects.count() == 2


def test_exact_rank_and_split(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    ranks = [r["rank"] for r in order.exact_rank(df, "k", 1).collect()]
    assert sorted(ranks) == list(range(1000))
    parts = {r["split"]: r["count"] for r in order.train_test(df.filter("k < 997"), "k", 42).groupBy("split").count().collect()}
    assert parts == {"test": 200, "train": 797}
    sizes = {r["batch_id"]: r["count"] for r in order.batches(df, "k", 112, 7).groupBy("batch_id").count().collect()}
    assert sorted(sizes.values()) == [104] + [112] * 8
    assert order.batches(df, "k", 112, 7, drop_last=True).count() == 896


def test_rank_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one = {r["k"]: r["rank"] for r in order.exact_rank(df.repartition(1), "k", 5).collect()}
    many = {r["k"]: r["rank"] for r in order.exact_rank(df.repartition(7), "k", 5).collect()}
    assert one == many


def test_ordinal_within_a_hot_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 7).alias("t"), "id")
    got = order.ordinal_within(rows, ["g"], ["t", "id"]).collect()
    hot = sorted((r["seq"], r["t"], r["id"]) for r in got if r["g"] == "hot")
    assert [h[0] for h in hot] == list(range(2000))
    assert [h[1:] for h in hot] == sorted(h[1:] for h in hot)
    assert all(r["seq"] == 0 for r in got if r["g"] != "hot")


def test_running_before(spark):
    rows = [("a", i, i % 5) for i in range(50)] + [("b", 9, 2)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    got = {(r["g"], r["n"]): r["s"] for r in order.running_before(df, ["g"], "n", {"s": F.col("v")}, block=8).collect()}
    assert all(got["a", i] == sum(j % 5 for j in range(i)) for i in range(50)) and got["b", 9] == 0


def test_metrics(spark):
    df = spark.createDataFrame([([1, 0], [1, 1]), ([1, 1], [0, 1])], "t array<int>, p array<int>")
    row = metrics.multilabel_micro_f1(df, "p", "t").first()
    assert (row["tp"], row["fp"], row["fn"]) == (2, 1, 1) and round(row["micro_f1"], 4) == 0.6667
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "truth string, pred string")
    report = {r["label"]: r for r in metrics.class_report(pairs).collect()}
    assert report["a"]["recall"] == 0.5 and report["a"]["precision"] == 1.0 and report["c"]["f1"] == 0.0
    assert report["b"]["support"] == 1 and abs(report["accuracy"]["f1"] - 1 / 3) < 1e-9


def test_loss_blocks_leave_out_the_rest(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(23)], "run string, seq int, loss double")
    assert sorted(r["mean_loss"] for r in runs.loss_blocks(df).collect()) == [4.5, 14.5]


def test_sampling_guards_short_epochs(spark):
    df = spark.createDataFrame([("r", 0, i, 1.0) for i in range(1, 8)], "run string, epoch int, step int, loss double")
    assert runs.sampled_steps(df).count() == 7


def test_overrides_and_rounding(spark):
    df = spark.createDataFrame([(3, "a"), (4, "b")], "row_idx int, model_name string")
    new = spark.createDataFrame([(4, "z")], "row_idx int, model_name string")
    got = {r["row_idx"]: r["model_name"] for r in runs.with_overrides(df, new, "row_idx", "model_name").collect()}
    assert got == {3: "a", 4: "z"}
    assert spark.range(1).select(F.bround(F.lit(76.5))).first()[0] == 76


def test_language_model_beyond_the_limit_gives_the_same(spark):
    rows = [(1, "en", "the cat the"), (2, "fr", "le chat été"), (3, "en", "that"), (4, "fr", ""), (5, "en", None)]
    df = spark.createDataFrame(rows, "k int, lang string, text string")
    model = language.train_languages(df, ["en", "fr"])
    small = language.predict_languages(df, "k", model, ["en", "fr"], limit=5).collect()
    whole = language.predict_languages(df, "k", model, ["en", "fr"]).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, whole)) and len(whole) == 5
    assert {r["k"]: r["lang"] for r in whole}[2] == "fr"


def test_pieces_meet_spans_over_block_ends(spark):
    """Blocks of five characters: words longer than a block, brackets and empty words at their ends, copies of one text."""
    chance = random.Random(8)
    values, texts, marks = [], {}, {}
    for doc in "abcdef":
        for line in range(3):
            text = "".join(chance.choice("xy(( é😀 ") for _ in range(chance.randrange(0, 40)))
            values.append(f"{doc}|a|{text}")
            texts.setdefault(doc, []).append(text)
        for _ in range(12):
            start = chance.randrange(0, 100)
            end, label = start + chance.randrange(0, 12), f"L{chance.randrange(4)}"
            values.append(f"{doc}\t{start}\t{end}\ts\t{label}\tc")
            marks |= {(doc, i): label for i in range(start, end)}
    wanted, sentences = [], {}
    for doc, parts in texts.items():
        at = 0
        for pos, word in enumerate(" ".join(parts).split(" ")):
            wanted.append((doc, pos, at, word, marks.get((doc, at + word.startswith("(")), "O")))
            at += len(word) + 1
    docs, spans, _ = labelled.split_tagged_lines(lines_of(spark, values))
    blocks = labelled.span_blocks(docs, spans, 5)
    assert sorted(map(tuple, labelled.block_words(blocks).collect())) == sorted(wanted)
    assert blocks.count() < len(wanted)
    for r in labelled.grouped_blocks(blocks).collect():
        mine = [w for w in sorted(wanted) if w[0] == r["id"]]
        assert (r["words"], r["labels"], r["sentence"]) == ([w[3] for w in mine], [w[4] for w in mine], " ".join(texts[r["id"]]))
    index = labelled.label_index(spark.createDataFrame(wanted, "id string, pos int, start int, word string, label string"))
    number = {r["label"]: r["idx"] for r in index.collect()}
    for r in labelled.first_label_ids(blocks, index, 7).collect():
        assert r["label_ids"] == [number[w[4]] for w in sorted(wanted) if w[0] == r["id"]][:7]
