"""Worked-out examples for text functions, and a plain Python twin for the sentence rules."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import arrays, labels, markers, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Dr. Smith arrived. He paid 3.5 dollars.", ["Dr. Smith arrived.", "He paid 3.5 dollars."]),
        ("in 2010. 5 patients died.", ["in 2010.5 patients died."]),
        ("See Fig. 2 shows.", ["See Fig.", ".2 shows."]),
        ("Visit example.com now!", ["Visit example.com now!"]),
        ('He said "Stop." Then left.', ['He said "Stop".', "Then left."]),
        ("no terminator", []),
        ("", []),
        ("One  two.\nThree?  tail", ["One two.", "Three?"]),
        ("Acme Inc. He left. U.S.A. They won!", None),
    ],
)
def test_sentences(spark, given, wanted):
    if wanted is None:
        wanted = by_python(given)
    assert one(spark, given, text.sentences) == wanted


def by_python(given):
    """The rule list applied with Python's ``re``."""
    out = f" {given}  "
    for kind, what, replacement in text.SENTENCE_RULES:
        what = what.replace(text.WHITESPACE, r"\s")
        out = out.replace(what, replacement) if kind == "literal" else re.sub(what, replacement, out)
    return [re.sub(r"\s+", " ", s.strip()) for s in out.split("<stop>")[:-1]]


def test_sentences_match_python_on_whole_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "text", text.sentences(F.col("text")).alias("s")
    ).collect()
    assert len(rows) > 100
    for row in rows:
        assert row["s"] == by_python(row["text"])


def test_figure_option(spark):
    assert one(spark, "See Fig. 2 shows.", lambda x: text.sentences(x, compat=False)) == ["See Fig. 2 shows."]


def is_ideograph(c):
    ranges = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text.IDEOGRAPHS)
    return any(int(a, 16) <= ord(c) <= int(b, 16) for a, b in ranges)


SAMPLES = ["É  café\tNAÏVE\x00x", "漢字kana", "한국어 각", "ﬁn Å ñ", "a­b​c", "ελληνικά!", "“q”—z", "x́y"]


@pytest.mark.parametrize("given", SAMPLES)
def test_normalise(spark, given):
    kept = "".join(
        c for c in given if c in "\t\n\r" or (c != "�" and not unicodedata.category(c).startswith("C"))
    )
    spaced = "".join(f" {c} " if is_ideograph(c) else (" " if c.isspace() else c) for c in kept)
    plain = "".join(c for c in unicodedata.normalize("NFD", spaced) if unicodedata.category(c) != "Mn")
    assert one(spark, given, text.normalise) == plain.lower()


def test_pre_tokens(spark):
    assert one(spark, "don't  stop, «now»…", text.words) == ["don", "'", "t", "stop", ",", "«", "now", "»", "…"]


def test_strip(spark):
    assert one(spark, " \n a b  \x1c", text.strip) == "a b"


@pytest.mark.parametrize(
    "path, name",
    [("/m/4GB/model-0-3531-4GB", "model-0-3531-4GB"), ("/m/8GB/run_8.v1/", "run_8")],
)
def test_model_name(spark, path, name):
    assert one(spark, path, text.model_name) == name


def test_marker_spans(spark):
    given = "<< aspirin >> inhibits [[ COX-2 enzyme ]] ."
    span = one(spark, given, markers.token_span)
    assert (span["ss"], span["se"], span["os"], span["oe"]) == (1, 1, 5, 6)
    assert tuple(one(spark, given, markers.substring_span)) == (" aspirin ", "yme ")
    assert tuple(one(spark, given, lambda x: markers.substring_span(x, 2))) == (" aspirin ", " COX-2 enzyme ")
    assert one(spark, "no marks", markers.token_span)["ss"] is None
    assert one(spark, "no marks", markers.substring_span)["subj"] is None


def test_hallmarks(spark):
    line = "< <Resisting cell death--Apoptosis AND Genomic instability and mutation--DNA damage<NULL--x<  B --c"
    assert one(spark, line, labels.hallmarks) == ["Resisting cell death", "B"]
    assert one(spark, line, lambda x: labels.hallmarks(x, True)) == [
        "Resisting cell death", "Genomic instability and mutation", "B"]
    assert one(spark, "< < < ", labels.hallmarks) == []


@pytest.mark.parametrize("parts", [["a", "b"], ["it's"], ["say \"x\"", "it's \"y\""], ["back\\slash\n"], []])
def test_context_rendering(spark, parts):
    df = spark.createDataFrame([(parts,)], "x array<string>")
    assert df.select(labels.joined_context(F.col("x"))).first()[0] == str(parts)


def test_arrays(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9, 0.5],)], "s array<double>")
    row = df.select(
        arrays.argmax(F.col("s")).alias("a"), arrays.threshold(F.col("s")).alias("t"), arrays.top_k(F.col("s"), 2).alias("k")
    ).first()
    assert row["a"] == 1 and row["t"] == [0, 1, 1, 1]
    assert [tuple(k) for k in row["k"]] == [(1, 1, 0.9), (2, 2, 0.9)]
