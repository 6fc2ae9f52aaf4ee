"""Readers: numbered lines, whole files, JSON shapes, encodings, loss logs, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import file_stem, strip
from skeinwork.operators.order import first_rows
from skeinwork.session import broadcast_checked, frozen

# Field names of the question-answer and run-record files.
INDEXED_SCHEMA = "MAP<STRING, STRUCT<QUESTION: STRING, CONTEXTS: ARRAY<STRING>, final_decision: STRING>>"
NESTED_SCHEMA = (
    "questions ARRAY<STRUCT<body: STRING, exact_answer: STRING, snippets: ARRAY<STRUCT<text: STRING>>>>"
)
RELATION_SCHEMA = "text STRING, label STRING"
RUN_SCHEMA = (
    "model_name STRING, seeds ARRAY<INT>, batch_size INT, epochs INT, metric STRING, "
    "scores ARRAY<DOUBLE>, mean_score DOUBLE"
)

SPLIT_LIMIT = 500_000


def list_files(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", first: int | None = None) -> DataFrame:
    """Sorted ``(path, name)`` of the files under ``path`` by name prefix and suffix; the first n.

    Only names and sizes are read. An unknown path is an error. Spark's scans pass over files without a byte: they are not
    listed, nor read by any reader here.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(path)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("path")
    return named if first is None else named.limit(first)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, name, line_no, value)`` with zero-based line numbers per file, in file order.

    A scan keeps the rows of one file split in order, so a line's place is its row id less the
    split's least, plus the lines in earlier splits of the file. The scanned rows themselves are
    frozen with their row ids, and offsets are counted from the frozen rows: another scan could cut
    the files elsewhere. No file passes through one task.
    """
    scan = frozen(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_row"),
            "value",
        )
    )
    splits = scan.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return scan.join(broadcast_checked(offsets, SPLIT_LIMIT), ["file", "_at"]).select(
        "file", "name", (F.col("_base") + F.col("_row") - F.col("_first")).alias("line_no"), "value"
    )


def read_lines(spark: SparkSession, path: str, sample_size: int | None = None) -> DataFrame:
    """``(text)`` one row per stripped line; with ``sample_size`` the first lines in file order."""
    if sample_size:
        head = first_rows(numbered_lines(spark, path), ["file", "line_no"], sample_size)
        return head.select("file", "line_no", strip(F.col("value")).alias("text"))
    return spark.read.text(path).select(strip(F.col("value")).alias("text"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)`` per file: the name up to its first dot, newlines turned into spaces.
    Files whose name starts with a dot or underscore are skipped."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        file_stem(F.col("_metadata.file_name")).alias("doc_id"), F.replace("value", F.lit("\n"), F.lit(" ")).alias("text")
    )


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, value)``: the first line of each file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        file_stem(F.col("_metadata.file_name")).alias("doc_id"), F.split("value", "\n")[0].alias("value")
    )


CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the lines that parse; ``json_line_rejects`` has the others."""
    read = _json_lines(spark, path, schema)
    return read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def json_line_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(value)``: the lines that are no JSON object of the schema."""
    read = _json_lines(spark, path, schema)
    return read.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value"))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = F.from_json("value", f"{schema}, {CORRUPT} STRING", options)
    return lines.select(parsed.alias("_r")).select("_r.*")


def indexed(value: Column, schema: str = INDEXED_SCHEMA) -> Column:
    """Map of a JSON object keyed by row id; NULL if it is malformed."""
    return F.from_json(value, schema)


def indexed_json(spark: SparkSession, path: str) -> DataFrame:
    """``(id, QUESTION, CONTEXTS, final_decision)`` from files that hold one object keyed by id."""
    return explode_indexed(spark.read.text(path, wholetext=True))


def explode_indexed(values: DataFrame) -> DataFrame:
    """The entries of the objects that parse; ``malformed`` has the others."""
    return values.select(F.explode(indexed(F.col("value"))).alias("id", "_r")).select("id", "_r.*")


def malformed(values: DataFrame, schema: str) -> DataFrame:
    """Rows of ``values`` whose JSON text ``value`` is no object of the schema."""
    return values.filter(F.from_json("value", schema, {"mode": "PERMISSIVE"}).isNull() | _broken(schema))


def _broken(schema: str) -> Column:
    """A struct schema reads a malformed text as a struct of NULLs, so it is asked for the corrupt text."""
    if schema.upper().startswith("MAP<"):
        return F.lit(False)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json("value", f"{schema}, {CORRUPT} STRING", options)[CORRUPT].isNotNull()


GROUND_TRUTH_SCHEMA = "MAP<STRING, STRING>"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label)`` from an object of scalars keyed by id."""
    values = spark.read.text(path, wholetext=True)
    return values.select(F.explode(F.from_json("value", GROUND_TRUTH_SCHEMA)).alias("id", "label"))


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """``(body, exact_answer, snippets)`` of every question in a file or a folder of files.
    An answer that is no string reads as its JSON text."""
    return nested_values(spark.read.text(path, wholetext=True))


def nested_values(values: DataFrame) -> DataFrame:
    """The same from a column ``value`` of JSON texts; other columns stay."""
    others = [c for c in values.columns if c != "value"]
    parsed = F.from_json("value", NESTED_SCHEMA)
    return values.select(*others, F.inline(parsed["questions"]))


def encodings(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Saved encodings, optionally of some sources only; other sources' folders are not read."""
    saved = spark.read.parquet(f"{path}/rows")
    return saved if sources is None else saved.filter(F.col("source").isin(sources))


def float_log(spark: SparkSession, path: str, stride: int | None = None) -> DataFrame:
    """``(run, seq, loss)`` of logs with one number per line; ``run`` is the file's stem.

    Lines that are no number keep their place in the count; ``float_log_rejects`` has them.
    """
    log = _float_log(spark, path).filter(F.col("loss").isNotNull()).drop("value")
    return log if stride is None else log.withColumn("step", F.col("seq") * stride)


def float_log_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``(run, seq, value)`` of the lines of logs that are neither blank nor a number."""
    return _float_log(spark, path).filter(F.col("loss").isNull()).drop("loss")


def _float_log(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).filter(strip(F.col("value")) != "")
    return lines.select(
        file_stem(F.col("name")).alias("run"), F.col("line_no").alias("seq"), "value",
        strip(F.col("value")).try_cast("double").alias("loss"),
    )


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of a vocabulary text file; the id is the line number."""
    return numbered_lines(spark, path).select(F.col("value").alias("token"), F.col("line_no").cast("int").alias("id"))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, RUN_SCHEMA)
