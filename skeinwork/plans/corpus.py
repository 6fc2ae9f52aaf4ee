"""Queries over the raw corpus: filters, sentences, words, vocabulary statistics, language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators import language, metrics, order, vocab
from skeinwork.plans import sql
from skeinwork.plans.tables import documents, spread, table
from skeinwork.session import frozen, scratch_path
from skeinwork.sources import readers, sinks

LANGUAGES = ["de", "en", "es", "fr"]


def corpus_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Kept documents, their sentences, and per source the counts and the mean length."""
    kept = language.accepted(documents(spark, folder))
    listed = kept.select("source", text.sentences(F.col("text")).alias("s"))
    characters = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    sums = listed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size("s").cast("bigint")).alias("n_sentences"),
        F.sum(characters).alias("n_chars"),
    )
    return sums.select("source", "n_docs", "n_sentences", F.round(F.col("n_chars") / F.col("n_sentences"), 4).alias("mean_chars"))


def lang_length_filter(spark, folder):
    return language.accepted(documents(spark, folder)).select("doc_id", "lang", "text")


def reject_counts(spark, folder):
    return language.reject_counts(language.rejected(documents(spark, folder)))


def lang_predict(spark, folder):
    """Learnt from the documents of even id, predicted for all."""
    docs = documents(spark, folder)
    model = language.train_languages(docs.filter("doc_id % 2 = 0"), LANGUAGES)
    return language.predict_languages(docs, "doc_id", model, LANGUAGES)


def _with_predicted(spark, folder):
    """Each document's ``size`` and its predicted language in place of the given one, which is ``given``; in one pass over the texts."""
    docs = documents(spark, folder)
    model = language.train_languages(docs.filter("doc_id % 2 = 0"), LANGUAGES)
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("lang").alias("given"), F.length("text").alias("size"))
    return language.predict_languages(rows, "doc_id", model, LANGUAGES, keep=["given", "size"])


def lang_predict_accuracy(spark, folder):
    """Per language, for documents the model has learnt from and for the others."""
    docs = _with_predicted(spark, folder).withColumn("unseen", F.col("doc_id") % 2 == 1)
    found = metrics.accuracy(docs, "lang", "given", ["unseen", "given"])
    return found.select("unseen", "given", F.bround("accuracy", 6).alias("accuracy"), "n")


def lang_filter_predicted(spark, folder):
    """Documents kept by their predicted language, and the others with the reason."""
    docs = frozen(_with_predicted(spark, folder).select("doc_id", "lang", "size"))
    kept = language.accepted(docs, size="size").select("doc_id", "lang", F.lit("kept").alias("reason"))
    return kept.unionByName(language.rejected(docs, size="size").select("doc_id", "lang", "reason"))


def sentence_split(spark, folder):
    docs = documents(spark, folder)
    return text.sentence_rows(docs, ["doc_id"])


def sentence_split_turns(spark, folder):
    turns = spread(table(spark, folder, "conversations"))
    return text.sentence_rows(turns, ["conv_id", "turn"])


def normalise_pretokenise(spark, folder):
    docs = documents(spark, folder)
    listed = docs.select("doc_id", text.words(F.col("text")).alias("w"))
    return listed.select("doc_id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"))


def word_counts(spark, folder):
    return vocab.word_counts(documents(spark, folder))


def alphabet_top(spark, folder):
    return vocab.alphabet(vocab.word_counts(documents(spark, folder)))


def pair_counts(spark, folder):
    return vocab.pair_counts(vocab.word_counts(documents(spark, folder)))


def vocab_train(spark, folder):
    return vocab.train(frozen(vocab.word_counts(documents(spark, folder))))


def read_lines_sample(spark, folder):
    """Documents written as numbered lines, read back, first thousand in order."""
    path = scratch_path(spark, "lines")
    docs = documents(spark, folder)
    one_line = F.regexp_replace("text", r"[\r\n]+", " ")
    ranked = order.ordinal_within(docs.select(F.lit(0).alias("g"), "doc_id", one_line.alias("t")), ["g"], ["doc_id"])
    lines = ranked.select(F.concat(F.format_string("%012d", "seq"), F.lit("\t"), "t").alias("value"))
    sinks.append_lines(lines, path)
    read = readers.read_lines(spark, path)
    parts = read.select(F.split_part("text", F.lit("\t"), F.lit(1)).cast("bigint").alias("row"), "text")
    return order.first_rows(parts, ["row"], 1000)


def profile(spark, folder):
    """Row counts of all tables."""
    names = [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    ]
    out = None
    for name in names:
        part = table(spark, folder, name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("table_name", "n_rows")


QUERIES = {
    "corpus_sentences": corpus_sentences,
    "lang_length_filter": lang_length_filter,
    "reject_counts": reject_counts,
    "lang_predict": lang_predict,
    "lang_predict_accuracy": lang_predict_accuracy,
    "lang_filter_predicted": lang_filter_predicted,
    "sentence_split": sentence_split,
    "sentence_split_turns": sentence_split_turns,
    "normalise_pretokenise": normalise_pretokenise,
    "word_counts": word_counts,
    "alphabet_top": alphabet_top,
    "pair_counts": pair_counts,
    "vocab_train": vocab_train,
    "read_lines_sample": read_lines_sample,
    "profile": profile,
}

KEPT = "lang = 'en' and length(text) + 1 >= 1000"
WORD_COUNTS = f"""
words as (select unnest({sql.words('text')}) as word from documents),
counts as (select word, count(*) as n from words group by word)"""

_WEIGHTS = ", ".join(
    f"cast(round(ln((n_{c} + 1) / (t_{c} + kinds)::double) * 1000000) as bigint) as w_{c}" for c in LANGUAGES
)
_GRAMS = """
chars as (select doc_id, lang, list_filter(string_split(lower(text), ''), lambda c: c <> '') as c from documents),
grams as (
    select doc_id, lang, unnest(list_concat(list_concat(c,
        list_transform(c[:-2], lambda x, i: x || c[i + 1])),
        list_transform(c[:-3], lambda x, i: x || c[i + 1] || c[i + 2]))) as gram
    from chars)"""

_PREDICTED = f"""
        with {_GRAMS},
        counts as (select gram, {', '.join(f"count(*) filter (lang = '{c}') as n_{c}" for c in LANGUAGES)}
            from grams where doc_id % 2 = 0 group by gram),
        totals as (select count(*) as kinds, {', '.join(f"sum(n_{c}) as t_{c}" for c in LANGUAGES)} from counts),
        model as (select gram, {_WEIGHTS} from counts, totals),
        sums as (select d.doc_id, {', '.join(f"coalesce(sum(w_{c}), 0) as s_{c}" for c in LANGUAGES)}
            from documents d left join grams g on d.doc_id = g.doc_id left join model m on g.gram = m.gram
            group by d.doc_id),
        best as (select *, greatest({', '.join(f's_{c}' for c in LANGUAGES)}) as b from sums),
        predicted as (select doc_id, case {' '.join(f"when s_{c} = b then '{c}'" for c in LANGUAGES)} end as lang,
            cast(b as bigint) as score from best)"""

ORACLES = {
    "corpus_sentences": f"""
        with kept as (select source, {sql.strip('text')} as text from documents where {KEPT}),
        listed as (select source, {sql.sentences('text')} as s from kept)
        select source, count(*) as n_docs, cast(sum(len(s)) as bigint) as n_sentences,
            round(sum(list_sum(list_transform(s, lambda x: length(x)))) / sum(len(s)), 4) as mean_chars
        from listed group by source""",
    "lang_length_filter": f"select doc_id, lang, {sql.strip('text')} as text from documents where {KEPT}",
    "reject_counts": f"""
        select lang, case when lang = 'en' then 'short' else 'language' end as reason, count(*) as n
        from documents where not ({KEPT}) group by all""",
    "lang_predict": f"""
        {_PREDICTED}
        select doc_id, lang, score from predicted""",
    "lang_predict_accuracy": f"""
        {_PREDICTED}
        select doc_id % 2 = 1 as unseen, d.lang as given, round_even(avg((p.lang = d.lang)::int), 6) as accuracy, count(*) as n
        from documents d join predicted p using (doc_id) group by all""",
    "lang_filter_predicted": f"""
        {_PREDICTED}
        select doc_id, p.lang, case when p.lang <> 'en' then 'language' when length(text) + 1 < 1000 then 'short' else 'kept' end as reason
        from documents d join predicted p using (doc_id)""",
    "sentence_split": f"""
        with listed as (select doc_id, {sql.sentences('text')} as s from documents)
        select doc_id, cast(i - 1 as integer) as sent_idx, s[i] as sentence
        from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from listed)""",
    "sentence_split_turns": f"""
        with listed as (select conv_id, turn, {sql.sentences('text')} as s from conversations)
        select conv_id, turn, cast(i - 1 as integer) as sent_idx, s[i] as sentence
        from (select conv_id, turn, s, unnest(range(1, len(s) + 1)) as i from listed)""",
    "normalise_pretokenise": f"""
        with listed as (select doc_id, {sql.words('text')} as w from documents)
        select doc_id, cast(len(w) as integer) as n_words, array_to_string(w, ' ') as words from listed""",
    "word_counts": f"with {WORD_COUNTS} select word, n from counts",
    "alphabet_top": f"""
        with {WORD_COUNTS},
        chars as (select unnest(string_split(word, '')) as char, n from counts)
        select char, cast(sum(n) as bigint) as n from chars group by char order by sum(n) desc, char limit 1000""",
    "pair_counts": f"""
        with {WORD_COUNTS},
        parts as (select n, list_transform(string_split(word, ''),
            lambda c, i: case when i = 1 then c else '##' || c end) as p from counts),
        pairs as (select n, p[i] as l, p[i + 1] as r from (select n, p, unnest(range(1, len(p))) as i from parts))
        select l as "left", r as "right", cast(sum(n) as bigint) as n from pairs group by l, r""",
    "read_lines_sample": f"""
        with ranked as (select row_number() over (order by doc_id) - 1 as row,
            regexp_replace(text, '[\\r\\n]+', ' ', 'g') as t from documents)
        select row, {sql.strip("lpad(cast(row as varchar), 12, '0') || chr(9) || t")} as text
        from ranked order by row limit 1000""",
    "profile": " union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows from {t}"
        for t in [
            "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
            "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
        ]
    ),
}
