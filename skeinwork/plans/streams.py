"""Queries that run as streams over all input there is, then end."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import masking, vocab, wordpiece
from skeinwork.plans.experiments import LOSSES, losses
from skeinwork.plans.corpus import KEPT
from skeinwork.plans import sql, tokens
from skeinwork.plans.tables import table
from skeinwork.session import scratch_path
from skeinwork.sources import sinks
from skeinwork.streaming import live


def stream_loss(spark, folder):
    path, out = scratch_path(spark, "losses"), scratch_path(spark, "blocks")
    sinks.append_losses(losses(spark, folder).select("run", "epoch", "seq", "loss"), path)
    live.watch_blocks(live.loss_stream(spark, path, 3), out, scratch_path(spark, "state"))
    return spark.read.parquet(out).select("run", "block", "mean_loss")


def _document_stream(spark, folder):
    """The documents as a stream, one file or a folder of parts. The path is a pattern, since Spark takes a plain one for a folder."""
    schema = table(spark, folder, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")


def stream_prep(spark, folder):
    out = scratch_path(spark, "prepared")
    live.run_to_files(live.prepared(_document_stream(spark, folder)), out, scratch_path(spark, "state"))
    done = spark.read.parquet(out)
    return done.select("doc_id", F.array_join("sentences", "\n").alias("sentences"), "normal")


def _encoded_stream(spark, folder, words):
    """Documents of the stream encoded row by row: workers keep the trie and the words they have cut."""
    return wordpiece.encode(_document_stream(spark, folder), "doc_id", words).select("doc_id", "input_ids")


def _written(spark, masked, name):
    out = scratch_path(spark, name)
    live.run_to_files(masked, out, scratch_path(spark, "state"))
    done = spark.read.parquet(out)
    return done.select("doc_id", tokens.shown("input_ids").alias("input_ids"), tokens.shown("labels").alias("labels"))


def stream_mask(spark, folder):
    """Encode and mask a stream against the static vocabulary."""
    words = tokens.corpus_vocabulary(spark, folder)
    return _written(spark, masking.mask_tokens(_encoded_stream(spark, folder, words), "doc_id", tokens.SEED), "masked")


def stream_mask_whole_word(spark, folder):
    """The same by whole words; what a row becomes does not depend on its micro-batch."""
    words = tokens.corpus_vocabulary(spark, folder)
    flags = vocab.continuation_flags(words)
    masked = masking.mask_whole_words(_encoded_stream(spark, folder, words), "doc_id", tokens.SEED, flags)
    return _written(spark, masked, "masked_words")


QUERIES = {"stream_loss": stream_loss, "stream_prep": stream_prep, "stream_mask": stream_mask, "stream_mask_whole_word": stream_mask_whole_word}

_NORMAL = f"lower(strip_accents(regexp_replace(text, {sql.quote(sql.WHITESPACE)}, ' ', 'g')))"

ORACLES = {
    "stream_loss": f"""with {LOSSES} select run, seq // 10 as block, round_even(avg(loss), 3) as mean_loss
        from losses group by all having count(*) = 10""",
    "stream_prep": f"""with kept as (select doc_id, {sql.strip('text')} as text from documents where {KEPT})
        select doc_id, array_to_string({sql.sentences('text')}, chr(10)) as sentences, {_NORMAL} as normal from kept""",
    "stream_mask": tokens.ORACLES["mask_tokens"],
    "stream_mask_whole_word": tokens.ORACLES["mask_whole_word"],
}
