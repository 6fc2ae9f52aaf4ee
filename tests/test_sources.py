"""Readers and writers: round trips through files in a new folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skeinwork.functions.draws import below
from skeinwork.operators import labelled, language, order, runs, vocab, wordpiece
from skeinwork.session import at_most, local_session, shared_dir
from skeinwork.sources import readers, sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_line_numbers_over_many_splits(spark, folder):
    lines = [f" line {i} " + "x" * (i % 50) for i in range(5000)]
    write(f"{folder}/a.txt", "\n".join(lines) + "\n")
    write(f"{folder}/b.txt", "only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = readers.numbered_lines(spark, folder).collect()
        first = readers.read_lines(spark, f"{folder}/a.txt", sample_size=3).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r["line_no"]: r["value"] for r in got if r["file"].endswith("a.txt")}
    assert [a[i] for i in range(5000)] == lines
    assert [(r["line_no"], r["value"]) for r in got if r["file"].endswith("b.txt")] == [(0, "only")]
    assert [r["text"] for r in first] == [line.strip() for line in lines[:3]]


def test_line_numbers_when_the_split_size_changes(spark, folder):
    lines = [f"line {i}" for i in range(20_000)]
    write(f"{folder}/a.txt", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        numbered = readers.numbered_lines(spark, folder)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        got = {r["line_no"]: r["value"] for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got.get(i) for i in range(20_000)] == lines


@pytest.mark.parametrize("name", ["a b", "ü+1", "50%", "x#y"])
def test_file_names_as_they_are(spark, folder, name):
    write(f"{folder}/f/{name}.v2.txt", "1.5\n")
    assert [r["doc_id"] for r in readers.whole_files(spark, f"{folder}/f").collect()] == [name]
    assert [r["run"] for r in readers.float_log(spark, f"{folder}/f").collect()] == [name]


def test_bad_input_is_rejected_not_fatal(spark, folder):
    write(f"{folder}/l/r.txt", "1.5\nabc\n\n2.5\n")
    assert [tuple(r) for r in readers.float_log(spark, f"{folder}/l").orderBy("seq").collect()] == [("r", 0, 1.5), ("r", 3, 2.5)]
    assert [tuple(r) for r in readers.float_log_rejects(spark, f"{folder}/l").collect()] == [("r", 1, "abc")]
    write(f"{folder}/j/x.jsonl", '{"text": "a", "label": "b"}\n{"text": "a", \n\nnull x\n')
    assert readers.json_lines(spark, f"{folder}/j", readers.RELATION_SCHEMA).collect() == [("a", "b")]
    assert readers.json_line_rejects(spark, f"{folder}/j", readers.RELATION_SCHEMA).count() == 2
    values = spark.createDataFrame([(1, '{"7": {"QUESTION": "q"}}'), (2, '{"7": '), (3, "[]")], "n int, value string")
    assert readers.explode_indexed(values).count() == 1
    assert {r["n"] for r in readers.malformed(values, readers.INDEXED_SCHEMA).collect()} == {2, 3}
    nested = spark.createDataFrame([(1, '{"questions": [{"body": "b"}]}'), (2, '{"questions": [')], "n int, value string")
    assert readers.nested_values(nested).count() == 1
    assert [r["n"] for r in readers.malformed(nested, readers.NESTED_SCHEMA).collect()] == [2]


def test_rows_without_a_group_stay(spark):
    rows = [("a", 1), ("a", 2), (None, 5), (None, 3)]
    df = spark.createDataFrame(rows, "run string, at int")
    numbered = order.ordinal_within(df, ["run"], ["at"])
    assert {(r["run"], r["at"]): r["seq"] for r in numbered.collect()} == {("a", 1): 0, ("a", 2): 1, (None, 3): 0, (None, 5): 1}
    running = order.running_before(numbered, ["run"], "seq", {"before": F.col("at")}, block=1)
    assert {(r["run"], r["at"]): r["before"] for r in running.collect()} == {("a", 1): 0, ("a", 2): 1, (None, 3): 0, (None, 5): 3}
    losses = spark.createDataFrame([(None, 0, k) for k in range(1, 21)] + [("a", None, 1)], "run string, epoch int, step int")
    assert runs.sampled_steps(losses).count() == 11


def test_rows_that_share_a_key_are_encoded_apart(spark):
    words = vocab.from_tokens(spark, [*vocab.SPECIALS, "a", "b", "##b"])
    df = spark.createDataFrame([(1, "a b"), (1, "ab"), (None, "b"), (None, None)], "k int, text string")
    got = sorted((r["k"] or 0, r["input_ids"]) for r in wordpiece.encode(df, "k", words).collect())
    assert got == [(0, [2, 3]), (0, [2, 6, 3]), (1, [2, 5, 6, 3]), (1, [2, 5, 7, 3])]


def test_listing(spark, folder):
    for name in ("b.pt", "a.pt", "c.txt"):
        write(f"{folder}/{name}", "x")
    assert [r["name"] for r in readers.list_files(spark, folder, suffix="pt").collect()] == ["a.pt", "b.pt"]
    assert readers.list_files(spark, folder, suffix="pt", first=1).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.list_files(spark, f"{folder}/none")


def test_whole_files_and_first_lines(spark, folder):
    write(f"{folder}/12.v1.txt", "one\ntwo")
    write(f"{folder}/.hidden", "no")
    assert [tuple(r) for r in readers.whole_files(spark, folder).collect()] == [("12", "one two")]
    assert [tuple(r) for r in readers.first_lines(spark, folder).collect()] == [("12", "one")]


def test_json_shapes(spark, folder):
    record = {"QUESTION": "q?", "CONTEXTS": ["a", "b"], "final_decision": "maybe", "more": 1}
    write(f"{folder}/i/x.json", json.dumps({"7": record, "8": {**record, "final_decision": "odd"}}))
    known, rejects = labelled.questions_three_way(readers.indexed_json(spark, f"{folder}/i"), compat=False)
    assert [(r["id"], r["context"], r["class"]) for r in known.collect()] == [("7", "a b", 1)] and rejects.count() == 1
    write(f"{folder}/t/x.json", '{"7": "yes"}')
    assert [tuple(r) for r in readers.ground_truth(spark, f"{folder}/t").collect()] == [("7", "yes")]
    question = {"body": "b", "snippets": [{"text": "a"}, {"text": "b"}]}
    answers = [{"exact_answer": "yes"}, {"exact_answer": [["x"]]}, {}]
    for i, answer in enumerate(answers):
        write(f"{folder}/n/{i}.json", json.dumps({"questions": [{**question, **answer}]}, indent=1))
    kept = labelled.questions_binary(readers.nested_json(spark, f"{folder}/n")).collect()
    assert [(r["context"], r["class"]) for r in kept] == [("a b", 1)]
    write(f"{folder}/r.jsonl", '{"text": "<< a >> [[ b ]]", "label": "AGONIST"}\n')
    assert readers.json_lines(spark, f"{folder}/r.jsonl", readers.RELATION_SCHEMA).count() == 1


def test_vocabulary_round_trip(spark, folder):
    words = vocab.from_tokens(spark, [*vocab.SPECIALS, "b", "a"])
    sinks.save_vocabulary(words, folder)
    assert readers.vocabulary(spark, f"{folder}/text").orderBy("id").collect() == words.orderBy("id").collect()


def test_encodings_round_trip(spark, folder):
    df = spark.createDataFrame([(1, [2, 3], "x"), (2, [2, 3], "y"), (3, [2, 3], "y")], "k int, input_ids array<int>, source string")
    sinks.save_encodings(df, folder)
    assert readers.encodings(spark, folder, ["y"]).count() == 2
    counts = {r["source"]: r["n_rows"] for r in spark.read.parquet(f"{folder}/manifest").collect()}
    assert counts == {"x": 1, "y": 2}


def test_logs_and_results(spark, folder):
    write(f"{folder}/l/run_a.txt", "3.5\n2.5\n\n")
    log = readers.float_log(spark, f"{folder}/l", stride=350).orderBy("seq").collect()
    assert [tuple(r) for r in log] == [("run_a", 0, 3.5, 0), ("run_a", 1, 2.5, 350)]
    record = [("m", [42], 8, 4, "f1", [0.5], 0.5)]
    df = spark.createDataFrame(record, readers.RUN_SCHEMA)
    for _ in range(2):
        sinks.append_run_records(df, f"{folder}/runs")
    assert readers.run_records(spark, f"{folder}/runs").count() == 2
    sinks.save_results(df.select("model_name", "mean_score"), f"{folder}/csv")
    assert spark.read.csv(f"{folder}/csv", header=True).columns == ["model_name", "mean_score"]


def test_every_document_is_kept_or_rejected(spark):
    docs = spark.createDataFrame(
        [(1, "en", "x" * 999), (2, "en", "x" * 998), (3, "fr", "x" * 2000), (4, None, "x")], "doc_id int, lang string, text string")
    assert [r["doc_id"] for r in language.accepted(docs).collect()] == [1]
    reasons = {r["doc_id"]: r["reason"] for r in language.rejected(docs).collect()}
    assert reasons == {2: "short", 3: "language", 4: "language"}


def test_size_check_and_bounds(spark):
    assert at_most(spark.range(5), 5) and not at_most(spark.range(6), 5)
    assert below(0.5) == "80000000"
    with pytest.raises(ValueError):
        below(1.0)


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(local_session())


def test_named_files_appear_all_or_none(spark, folder):
    """Files appear when all tasks are done; a task that fails for good, or a name given twice, leaves nothing behind."""
    rows = spark.createDataFrame([(f"f{i}.txt", f"text {i}") for i in range(40)] + [("ü .txt", "é"), ("empty.txt", None)], "name string, text string")
    assert sinks.save_named_files(rows.repartition(5), f"{folder}/all") == 42
    assert sorted(os.listdir(f"{folder}/all")) == sorted([r["name"] for r in rows.collect()] + ["_commits", "_pending"])
    assert os.listdir(f"{folder}/all/_pending") == []
    assert open(f"{folder}/all/ü .txt", encoding="utf-8").read() == "é" and open(f"{folder}/all/empty.txt").read() == ""
    record = json.load(open(f"{folder}/all/_commits/" + os.listdir(f"{folder}/all/_commits")[0]))
    assert record == {"files": 42, "bytes": sum(len((r["text"] or "").encode()) for r in rows.collect())}
    assert sinks.save_named_files(spark.createDataFrame([("f1.txt", "new")], "name string, text string"), f"{folder}/all") == 1
    assert open(f"{folder}/all/f1.txt").read() == "new" and open(f"{folder}/all/f2.txt").read() == "text 2"
    assert readers.list_files(spark, f"{folder}/all").count() == 41  # all but the empty one
    assert sinks.save_named_files(rows.filter("false"), f"{folder}/none") == 0

    for case, text in enumerate(["raise_error('lost')", "text"]):
        bad = rows.repartition(5).withColumn("text", F.when(F.col("name") == "f7.txt", F.expr(text)).otherwise(F.col("text")))
        bad = bad if case == 0 else bad.unionByName(rows.filter("name = 'f7.txt'"))
        with pytest.raises(Exception):
            sinks.save_named_files(bad, f"{folder}/bad{case}")
        left = [f for _, _, files in os.walk(f"{folder}/bad{case}") for f in files]
        assert left == []
    for name in (None, "", "a/b"):
        with pytest.raises(Exception):
            sinks.save_named_files(spark.createDataFrame([(name, "x")], "name string, text string"), f"{folder}/odd")
    assert [f for _, _, files in os.walk(f"{folder}/odd") for f in files] == []
