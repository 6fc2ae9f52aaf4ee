"""The loss monitor when lines come twice or late."""

from skeinwork.sources import sinks
from skeinwork.streaming import live


def test_a_block_is_written_once_and_repeated_lines_count_once(spark, folder):
    def losses(places):
        return spark.createDataFrame([("a", 0, k, float(k)) for k in places], live.LOSS_SCHEMA)

    def monitor():
        live.watch_blocks(live.loss_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state")
        written = spark.read.schema("run STRING, block BIGINT, mean_loss DOUBLE").parquet(f"{folder}/out")
        return sorted(map(tuple, written.collect()))

    sinks.append_losses(losses(range(8)), f"{folder}/in")
    assert monitor() == []
    sinks.append_losses(losses([7, 8, 9]), f"{folder}/in")
    assert monitor() == [("a", 0, 4.5)]
    sinks.append_losses(losses([3, *range(10, 20)]), f"{folder}/in")
    assert monitor() == [("a", 0, 4.5), ("a", 1, 14.5)]
    sinks.append_losses(losses([*range(10), *range(20, 25)]), f"{folder}/in")
    assert monitor() == [("a", 0, 4.5), ("a", 1, 14.5)]


def test_state_does_not_grow_with_what_has_passed(spark, folder):
    for k in range(5):
        rows = [(run, 0, seq, float(seq)) for run in ("a", None) for seq in range(k * 25, k * 25 + 25)]
        sinks.append_losses(spark.createDataFrame(rows, live.LOSS_SCHEMA).coalesce(1), f"{folder}/in")
    keys = live.watch_blocks(live.loss_stream(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/state")
    assert len(keys) >= 5 and max(keys) == 2
    written = spark.read.schema("run STRING, block BIGINT, mean_loss DOUBLE").parquet(f"{folder}/out").collect()
    assert sorted((r["run"] or "", r["block"], r["mean_loss"]) for r in written) == sorted((run, b, b * 10 + 4.5) for run in ("a", "") for b in range(12))


def test_settled_blocks_by_hand():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, step = State(), live._settled(3)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["seq", "loss"])])
    first = live.PART * 3
    out = lambda frames: [row for found in step(("r", 1), frames, state) for row in found.values.tolist()]
    assert out(frame((first + 1, 2.0), (first + 4, 7.0), (first + 1, 2.0))) == []
    assert out(frame((first, 1.0), (first + 2, 3.0), (first + 5, 1.0))) == [["r", live.PART, 6.0]]
    assert sorted(state.get[1]) == [first + 4, first + 5]
    assert out(frame((first, 1.0), (first + 1, 1.0), (first + 2, 1.0), (first + 3, 0.5))) == [["r", live.PART + 1, 8.5]]
    assert state.get[1] == []


def test_masked_words_of_a_stream_are_those_of_a_batch(spark, folder):
    from skeinwork.operators import masking, vocab, wordpiece

    words = vocab.from_tokens(spark, [*vocab.SPECIALS, "a", "##b", "##a", "b", "c"])
    flags = vocab.continuation_flags(words)
    rows = [(k, "ab aab c " * (k + 1)) for k in range(8)]
    for half in (rows[:4], rows[4:]):
        spark.createDataFrame(half, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{folder}/docs")

    def masked(df):
        encoded = wordpiece.encode(df, "doc_id", words).select("doc_id", "input_ids")
        return masking.mask_whole_words(encoded, "doc_id", 3, flags)

    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/docs")
    live.run_to_files(masked(stream), f"{folder}/out", f"{folder}/state")
    found = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    assert found == sorted(map(tuple, masked(spark.read.parquet(f"{folder}/docs")).collect())) and len(found) == 8


def test_documents_in_one_file_or_in_parts_are_streamed(spark, folder):
    from skeinwork.plans import streams

    rows = [(k, "Some words are here. " * 60, "en") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.repartition(3).write.parquet(f"{folder}/parts/documents.parquet")
    docs.toPandas().to_parquet(f"{folder}/documents.parquet")
    for query, columns in ((streams.stream_prep, 3), (streams.stream_mask, 3), (streams.stream_mask_whole_word, 3)):
        parts, one = (sorted(map(tuple, query(spark, path).collect())) for path in (f"{folder}/parts", folder))
        assert parts == one and len(one) == 6 and len(one[0]) == columns
