"""Queries over files: each writes the given tables as files of one kind, then reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import order, vocab
from skeinwork.plans import corpus, experiments
from skeinwork.plans.tables import documents, table
from skeinwork.session import frozen, scratch_path
from skeinwork.sources import readers, sinks

NO_NUMBER, BLANK = 40, 50


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as lines in several files: each line's number is its place in its file."""
    path = scratch_path(spark, "lines")
    one_line = F.regexp_replace("text", r"[\r\n]+", " ")
    lines = table(spark, folder, "documents").select(F.concat(F.format_string("%012d", "doc_id"), F.lit("\t"), one_line).alias("value"))
    sinks.append_lines(lines.repartitionByRange("value").sortWithinPartitions("value"), path)
    doc_id = F.split_part("value", F.lit("\t"), F.lit(1)).cast("bigint").alias("doc_id")
    read = readers.numbered_lines(spark, path).select("file", "line_no", doc_id, F.length("value").alias("n_chars"))
    placed = order.ordinal_within(read, ["file"], ["doc_id"], "place")  # ids lead the lines, so their order is the lines'
    return placed.select("doc_id", "n_chars", (F.col("line_no") == F.col("place")).alias("in_place"))


def _items(spark, folder, name) -> str:
    """Benchmark texts as one file each, hidden ones beside them."""
    path = scratch_path(spark, "items")
    items = table(spark, folder, "benchmark").select(F.expr(name).alias("name"), "text")
    hidden = items.select(F.concat(F.lit("_"), "name").alias("name"), "text")
    sinks.save_named_files(items.unionByName(hidden), path)
    return path


def list_files(spark, folder):
    path = _items(spark, folder, "concat('item-', item_id, '.txt')")
    return readers.list_files(spark, path, "item-", ".txt").select("name")


def whole_files(spark, folder):
    return readers.whole_files(spark, _items(spark, folder, "concat(item_id, ' ü.v1.txt')"))


def first_lines(spark, folder):
    return readers.first_lines(spark, _items(spark, folder, "concat(item_id, ' ü.v1.txt')"))


def _turns(spark, folder) -> str:
    """Turns as JSON lines, every fifth turn's line cut short."""
    path = scratch_path(spark, "turns")
    whole = F.to_json(F.struct("text", F.col("role").alias("label")))
    line = F.when(F.col("turn") % 5 == 4, F.expr("substr(whole, 1, length(whole) - 2)")).otherwise(F.col("whole"))
    turns = table(spark, folder, "conversations").withColumn("whole", whole)
    sinks.append_lines(turns.select(line.alias("value")), path)
    return path


def json_lines(spark, folder):
    return readers.json_lines(spark, _turns(spark, folder), readers.RELATION_SCHEMA).select("text", "label")


def json_line_rejects(spark, folder):
    return readers.json_line_rejects(spark, _turns(spark, folder), readers.RELATION_SCHEMA).agg(F.count("value").alias("n"))


def nested_folder(spark, folder):
    """A folder of nested files, one question each."""
    path = scratch_path(spark, "nested")
    answer = F.when(F.col("item_id") % 3 == 0, "yes").when(F.col("item_id") % 3 == 1, "no").otherwise("other")
    snippets = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text")))
    question = F.struct(F.col("text").alias("body"), answer.alias("exact_answer"), snippets.alias("snippets"))
    files = table(spark, folder, "benchmark").select(
        F.concat("item_id", F.lit(".json")).alias("name"), F.to_json(F.struct(F.array(question).alias("questions"))).alias("text"))
    sinks.save_named_files(files, path)
    return readers.nested_json(spark, path).select("body", "exact_answer", F.size("snippets").alias("n_snippets"))


def ground_truth(spark, folder):
    """Labels as objects of scalars keyed by id, some hundred to a file."""
    path = scratch_path(spark, "truth")
    entries = F.collect_list(F.struct(F.col("doc_id").cast("string").alias("k"), F.col("quality").cast("string").alias("v")))
    grouped = table(spark, folder, "labels").groupBy(F.floor(F.col("doc_id") / 256).alias("g")).agg(entries.alias("e"))
    files = grouped.select(F.concat("g", F.lit(".json")).alias("name"), F.to_json(F.map_from_entries("e")).alias("text"))
    sinks.save_named_files(files, path)
    return readers.ground_truth(spark, path)


def encodings(spark, folder):
    path = scratch_path(spark, "encodings")
    rows = table(spark, folder, "documents").select("doc_id", "source", F.array("doc_id", "n_chars").alias("input_ids"))
    sinks.save_encodings(rows, path)
    read = readers.encodings(spark, path)
    return read.select("doc_id", "source", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"))


def encodings_manifest(spark, folder):
    """Row counts that the writer noted, beside those that are read."""
    path = scratch_path(spark, "encodings")
    sinks.save_encodings(table(spark, folder, "documents").select("doc_id", "source"), path)
    noted = spark.read.parquet(f"{path}/manifest").groupBy("source").agg(F.sum("n_rows").alias("n_saved"))
    return noted.join(readers.encodings(spark, path).groupBy("source").agg(F.count("*").alias("n_read")), "source", "full")


def _indexed(spark, folder) -> str:
    """Objects keyed by id, one file each for some items; files of every fifth item break off."""
    path = scratch_path(spark, "indexed")
    decision = F.when(F.col("item_id") % 2 == 0, "yes").otherwise("no")
    entry = F.struct(F.col("text").alias("QUESTION"), F.split("text", " ").alias("CONTEXTS"), decision.alias("final_decision"))
    whole = F.col("item_id") % 5 != 3
    rows = table(spark, folder, "benchmark").select(
        F.concat(F.floor(F.col("item_id") / 4), F.when(whole, ".json").otherwise(" cut.json")).alias("name"), whole.alias("whole"),
        F.struct(F.col("item_id").cast("string").alias("k"), entry.alias("v")).alias("e"),
    )
    json = F.to_json(F.map_from_entries(F.collect_list("e")))
    files = rows.groupBy("name", "whole").agg(json.alias("text"))
    cut = F.when(F.col("whole"), F.col("text")).otherwise(F.substr("text", F.lit(1), F.length("text") - 3))
    sinks.save_named_files(files.select("name", cut.alias("text")), path)
    return path


def indexed_json(spark, folder):
    found = readers.indexed_json(spark, _indexed(spark, folder))
    return found.select("id", F.col("QUESTION").alias("question"), F.size("CONTEXTS").alias("n_contexts"), "final_decision")


def indexed_json_rejects(spark, folder):
    """Files that hold no whole object."""
    values = spark.read.text(_indexed(spark, folder), wholetext=True)
    return readers.malformed(values, readers.INDEXED_SCHEMA).agg(F.count("*").alias("n_files"))


def _logs(spark, folder) -> str:
    """A log for each event type and day, with blank lines and lines that are no number."""
    path = scratch_path(spark, "logs")
    value = F.when(F.col("event_id") % BLANK == 0, "").when(F.col("event_id") % NO_NUMBER == 1, "n/a").otherwise(F.col("value").cast("string"))
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    events = table(spark, folder, "events").select(
        F.concat("event_type", F.lit(" "), day, F.lit(".txt")).alias("name"), "event_id", value.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    sinks.save_named_files(events.groupBy("name").agg(joined.alias("text")), path)
    return path


def float_log(spark, folder):
    return readers.float_log(spark, _logs(spark, folder), experiments.runs.STEP_STRIDE).select("run", "seq", "loss", "step")


def float_log_rejects(spark, folder):
    return readers.float_log_rejects(spark, _logs(spark, folder)).select("run", "seq", "value")


def vocabulary(spark, folder):
    """Words by falling count as a vocabulary file; an id is a line number."""
    path = scratch_path(spark, "vocabulary")
    counts = frozen(vocab.word_counts(documents(spark, folder)))
    sinks.save_vocabulary(vocab.ranked_tokens([counts.select(F.col("word").alias("token"), "n")]), path)
    return readers.vocabulary(spark, f"{path}/text")


def run_record_file(spark, folder):
    path = scratch_path(spark, "records")
    sinks.append_run_records(experiments._records(spark, folder), path)
    read = readers.run_records(spark, path)
    return read.groupBy("model_name").agg(
        F.count("*").alias("n_records"), F.sum(F.size("scores")).alias("n_scores"), F.bround(F.max("mean_score"), 4).alias("best"))


def results_csv(spark, folder):
    path = scratch_path(spark, "results")
    sinks.save_results(experiments.stacked_results(spark, folder), path)
    return spark.read.csv(path, header=True, schema="task STRING, model_name STRING, metric STRING, score DOUBLE")


def dropped_columns(spark, folder):
    return table(spark, folder, "events").drop("props", "ts")


def constant_column(spark, folder):
    """One column set to a constant in all rows, the others as they are."""
    return table(spark, folder, "labels").withColumn("toxic", F.lit(9))


def documents_in_rows(spark, folder):
    """Lines that aren't blank, numbered over each document."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    numbered = order.ordinal_within(lines.filter(F.trim("line") != ""), ["doc_id"], ["at"], "line_no")
    return numbered.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_no"))


QUERIES = {
    query.__name__: query
    for query in (
        numbered_lines, list_files, whole_files, first_lines, json_lines, json_line_rejects, nested_folder, ground_truth,
        encodings, encodings_manifest, indexed_json, indexed_json_rejects, float_log, float_log_rejects, vocabulary, run_record_file, results_csv, dropped_columns, constant_column,
        documents_in_rows,
    )
}

_LOG = f"""log as (select event_type || ' ' || strftime(ts, '%Y-%m-%d') as run,
    row_number() over (partition by event_type, strftime(ts, '%Y-%m-%d') order by event_id) - 1 as seq, event_id, value from events)"""

ORACLES = {
    "numbered_lines": r"""select doc_id, cast(length(regexp_replace(text, '[\r\n]+', ' ', 'g')) + 13 as integer) as n_chars,
        true as in_place from documents""",
    "list_files": "select 'item-' || item_id || '.txt' as name from benchmark",
    "whole_files": "select item_id || ' ü' as doc_id, replace(text, chr(10), ' ') as text from benchmark",
    "first_lines": "select item_id || ' ü' as doc_id, split_part(text, chr(10), 1) as value from benchmark",
    "json_lines": "select text, role as label from conversations where turn % 5 <> 4",
    "json_line_rejects": "select count(*) as n from conversations where turn % 5 = 4",
    "nested_folder": """select text as body, case item_id % 3 when 0 then 'yes' when 1 then 'no' else 'other' end as exact_answer,
        cast(len(string_split(text, ' ')) as integer) as n_snippets from benchmark""",
    "ground_truth": "select cast(doc_id as varchar) as id, cast(quality as varchar) as label from labels",
    "encodings": "select doc_id, source, doc_id || ' ' || n_chars as input_ids from documents",
    "encodings_manifest": "select source, count(*) as n_saved, count(*) as n_read from documents group by source",
    "indexed_json": """select cast(item_id as varchar) as id, text as question, cast(len(string_split(text, ' ')) as integer) as n_contexts,
        case when item_id % 2 = 0 then 'yes' else 'no' end as final_decision from benchmark where item_id % 5 <> 3""",
    "indexed_json_rejects": "select count(distinct item_id // 4) as n_files from benchmark where item_id % 5 = 3",
    "float_log": f"""with {_LOG} select run, seq, value as loss, seq * 350 as step from log
        where event_id % {BLANK} <> 0 and event_id % {NO_NUMBER} <> 1""",
    "float_log_rejects": f"""with {_LOG} select run, seq, 'n/a' as value from log
        where event_id % {BLANK} <> 0 and event_id % {NO_NUMBER} = 1""",
    "vocabulary": f"""with {corpus.WORD_COUNTS} select word as token,
        cast(row_number() over (order by n desc, word) - 1 as integer) as id from counts""",
    "run_record_file": f"""select model_name, count(*) as n_records, cast(sum(n) as bigint) as n_scores, max(m) as best
        from (select task, model_name, count(*) as n, round_even(avg(score), 4) as m from {experiments._RECORDS} group by all)
        group by model_name""",
    "results_csv": experiments.ORACLES["stacked_results"],
    "dropped_columns": "select event_id, user_id, event_type, value from events",
    "constant_column": "select doc_id, quality, cast(9 as integer) as toxic from labels",
    "documents_in_rows": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
        select doc_id, count(*) as n_lines, count(*) - 1 as last_no from l where trim(line) <> '' group by doc_id""",
}
