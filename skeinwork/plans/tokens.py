"""Queries over encoded text: subword ids, pairs, per-token and whole-word masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators import fill, masking, vocab, wordpiece
from skeinwork.plans import sql
from skeinwork.plans.tables import documents, spread, table
from skeinwork.session import frozen, stored

# The vocabulary of the queries that have a SQL twin: specials, all characters alone and as continuation, the most frequent
# words and word endings, up to the size of a trained one. The queries named "trained" train theirs.
TOP_WORDS, TOP_ENDINGS, ENDING = 26_000, 4_000, 3
SEED = 17


def rule_vocabulary(counts: DataFrame) -> DataFrame:
    spark = counts.sparkSession
    size = len(vocab.SPECIALS)
    specials = spark.createDataFrame([(t, size - i) for i, t in enumerate(vocab.SPECIALS)], "token string, n bigint")
    chars = vocab.alphabet(counts)
    frequent = counts.orderBy(F.desc("n"), F.asc("word")).limit(TOP_WORDS)
    endings = (
        counts.filter(F.length("word") > ENDING)
        .groupBy(F.substr("word", F.length("word") - (ENDING - 1), F.lit(ENDING)).alias("ending"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.asc("ending"))
        .limit(TOP_ENDINGS)
    )
    continued = F.lit(vocab.PREFIX)
    return frozen(
        vocab.ranked_tokens(
            [
                specials,
                chars.select(F.col("char").alias("token"), "n"),
                chars.select(F.concat(continued, "char").alias("token"), "n"),
                frequent.select(F.col("word").alias("token"), "n"),
                endings.select(F.concat(continued, "ending").alias("token"), "n"),
            ]
        )
    )


def corpus_words(spark, folder) -> DataFrame:
    """``(doc_id, w)``: the normalised words of each document, written once, as one text each: no word holds a space."""
    joined = F.array_join(text.words(F.col("text")), " ").alias("joined")
    written = stored(documents(spark, folder).select("doc_id", joined), "words")
    none = F.array().cast("array<string>")
    return written.select("doc_id", F.when(F.col("joined") == "", none).otherwise(F.split("joined", " ")).alias("w"))


def corpus_vocabulary(spark, folder) -> DataFrame:
    return rule_vocabulary(frozen(vocab.word_counts(documents(spark, folder))))


def trained_vocabulary(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The documents' words, and a vocabulary trained on them to the full size."""
    listed = corpus_words(spark, folder)
    return listed, vocab.train(frozen(vocab.counted(listed, F.col("w"))))


def shown(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


def wordpiece_encode(spark, folder):
    encoded = wordpiece.encode(documents(spark, folder), "doc_id", corpus_vocabulary(spark, folder), pad="longest")
    return encoded.select(
        "doc_id",
        shown("input_ids").alias("input_ids"),
        shown("attention_mask").alias("attention_mask"),
        F.size("token_type_ids").alias("n_types"),
    )


def wordpiece_whole(spark, folder):
    """Whole texts, no cut: the subword count of every document."""
    encoded = wordpiece.encode(documents(spark, folder), "doc_id", corpus_vocabulary(spark, folder), max_len=None)
    ids = F.col("input_ids")
    return encoded.select(
        "doc_id",
        F.size(ids).alias("n_ids"),
        F.size(F.filter(ids, lambda x: x == masking.UNK)).alias("n_unknown"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("id_sum"),
    )


def wordpiece_encode_trained(spark, folder):
    """The encoding on a trained vocabulary."""
    listed, words = trained_vocabulary(spark, folder)
    encoded = wordpiece.encode_words(listed, "doc_id", words, pad="longest")
    return encoded.select("doc_id", shown("input_ids").alias("input_ids"), shown("attention_mask").alias("attention_mask"))


def trained_round_trip(spark, folder):
    """Whole texts on a trained vocabulary and back: the words as they were, none unknown but those too long to be cut."""
    listed, words = trained_vocabulary(spark, folder)
    cut = wordpiece.decode_words(wordpiece.cut_words(listed, ["w"], words, keep=False), "w_ids", "w_sizes", words)
    return cut.select("doc_id", F.size("w_sizes").alias("n_words"), F.col("decoded").alias("words"))


def training_table_trained(spark, folder):
    """What training reads, on a trained vocabulary: whole words masked, padding never drawn."""
    listed, words = trained_vocabulary(spark, folder)
    encoded = wordpiece.encode_words(listed, "doc_id", words, pad="longest").drop("token_type_ids")
    flags = vocab.continuation_flags(words)
    return _shown_table(masking.mask_whole_words(encoded, "doc_id", SEED, flags, skip_padding=True))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("_next")
    )
    answered = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("_next"), F.col("text").alias("context"))
    return asked.join(answered, ["conv_id", "_next"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "question", "context"
    )


def fill_mask(spark, folder):
    """Every turn with its middle word masked: the five best words by their neighbours in the documents, filled in."""
    turns = spread(table(spark, folder, "conversations"))
    listed = frozen(turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.words(F.col("text")).alias("w")))
    masked = listed.withColumn("at", F.floor(F.size("w") / 2).cast("int"))
    found = fill.fill_masked(masked, "id", corpus_words(spark, folder).select("w"))
    return found.select("id", "rank", "candidate", F.round("score", 6).alias("score"), "sequence")


def pair_rejects(spark, folder):
    """Turns that are in no pair: system turns, unanswered questions, answers to nothing."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    paired = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left_semi")
    role = F.when(F.col("turn") == F.col("_last"), "assistant").otherwise("user")
    used = paired.withColumn("_last", F.col("turn")).select("conv_id", F.explode(F.array(F.col("turn") - 1, "turn")).alias("turn"), "_last")
    used = used.select("conv_id", "turn", role.alias("role"))
    left = turns.join(used, ["conv_id", "turn", "role"], "left_anti")
    return left.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role")


def pair_encode_slice(spark, folder):
    pairs = turn_pairs(spread(table(spark, folder, "conversations")))
    encoded = wordpiece.encode_pair(pairs, "id", corpus_vocabulary(spark, folder), "question", "context", 128)
    return encoded.select("id", *[shown(c).alias(c) for c in ("input_ids", "token_type_ids", "attention_mask")])


def pair_encode_longest_first(spark, folder):
    pairs = turn_pairs(spread(table(spark, folder, "conversations")))
    encoded = wordpiece.encode_pair(
        pairs, "id", corpus_vocabulary(spark, folder), "question", "context", 128, mode="longest_first"
    )
    return encoded.select("id", *[shown(c).alias(c) for c in ("input_ids", "token_type_ids", "attention_mask")])


def _encoded(spark, folder, pad: str = "none"):
    words = corpus_vocabulary(spark, folder)
    return wordpiece.encode(documents(spark, folder), "doc_id", words, pad=pad).drop("token_type_ids"), words


def training_table(spark, folder):
    """What training reads: ids padded to the longest row and masked token by token, attention, labels."""
    encoded, _ = _encoded(spark, folder, "longest")
    return _shown_table(masking.mask_tokens(encoded, "doc_id", SEED))


def training_table_whole_word(spark, folder):
    """The same masked by whole words; padding counts in the budget and can be drawn, as first built."""
    encoded, words = _encoded(spark, folder, "longest")
    return _shown_table(masking.mask_whole_words(encoded, "doc_id", SEED, vocab.continuation_flags(words)))


def training_table_no_padding(spark, folder):
    """The same, but padding is never drawn."""
    encoded, words = _encoded(spark, folder, "longest")
    flags = vocab.continuation_flags(words)
    return _shown_table(masking.mask_whole_words(encoded, "doc_id", SEED, flags, skip_padding=True))


def _shown_table(masked: DataFrame) -> DataFrame:
    return masked.select("doc_id", *[shown(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def mask_fraction_padded(spark, folder):
    encoded, _ = _encoded(spark, folder, "longest")
    share = masking.masked_share(masking.mask_tokens(encoded, "doc_id", SEED))
    return share.select("masked", "others", F.round("share", 6).alias("share"))


def mask_tokens(spark, folder):
    encoded, _ = _encoded(spark, folder)
    masked = masking.mask_tokens(encoded, "doc_id", SEED)
    return masked.select("doc_id", shown("input_ids").alias("input_ids"), shown("labels").alias("labels"))


def mask_fraction(spark, folder):
    encoded, _ = _encoded(spark, folder)
    share = masking.masked_share(masking.mask_tokens(encoded, "doc_id", SEED))
    return share.select("masked", "others", F.round("share", 6).alias("share"))


def mask_whole_word(spark, folder):
    encoded, words = _encoded(spark, folder)
    masked = masking.mask_whole_words(encoded, "doc_id", SEED, vocab.continuation_flags(words))
    return masked.select("doc_id", shown("input_ids").alias("input_ids"), shown("labels").alias("labels"))


QUERIES = {
    "wordpiece_encode": wordpiece_encode,
    "wordpiece_whole": wordpiece_whole,
    "wordpiece_encode_trained": wordpiece_encode_trained,
    "trained_round_trip": trained_round_trip,
    "training_table_trained": training_table_trained,
    "pair_encode_slice": pair_encode_slice,
    "pair_rejects": pair_rejects,
    "fill_mask": fill_mask,
    "pair_encode_longest_first": pair_encode_longest_first,
    "mask_tokens": mask_tokens,
    "mask_fraction": mask_fraction,
    "mask_whole_word": mask_whole_word,
    "mask_fraction_padded": mask_fraction_padded,
    "training_table": training_table,
    "training_table_whole_word": training_table_whole_word,
    "training_table_no_padding": training_table_no_padding,
}

VOCABULARY = f"""
corpus_words as (select unnest({sql.words('text')}) as word from documents),
counts as (select word, count(*) as n from corpus_words group by word),
chars as (select char, cast(sum(n) as bigint) as n from
    (select unnest(string_split(word, '')) as char, n from counts) group by char order by sum(n) desc, char limit 1000),
stacked as (
    select unnest({[t for t in vocab.SPECIALS]}) as token, unnest([5, 4, 3, 2, 1]) as n, 0 as place
    union all select char, n, 1 from chars
    union all select '##' || char, n, 2 from chars
    union all select * from (select word, n, 3 from counts order by n desc, word limit {TOP_WORDS})
    union all select * from (select '##' || ending, n, 4 from
        (select right(word, {ENDING}) as ending, sum(n) as n from counts where length(word) > {ENDING} group by 1)
        order by n desc, ending limit {TOP_ENDINGS})),
first_place as (select token, min((place, -n)) as k from stacked group by token),
vocabulary as (select token, row_number() over (order by k, token) - 1 as id from first_place)"""


def cut(lists: str) -> str:
    """CTEs up to ``pieces(word, ids)`` for all words of a select."""
    return f"""
types as (select distinct word from ({lists})),
starts as (select word, unnest(range(0, length(word))) as s from types where length(word) <= 100),
cuts as (select word, s, unnest(range(1, length(word) - s + 1)) as l from starts),
hits as (select word, s, max(l) as l, max_by(id, l) as id from cuts join vocabulary
    on token = case when s > 0 then '##' else '' end || substr(word, s + 1, l) group by word, s),
found as (select word, list([s, l, id] order by s) as h from hits group by word),
walk as (select word, list_reduce(h, lambda a, x: case when x[1] = a[1]
    then list_concat(list_concat([a[1] + x[2]], a[2:]), [x[3]]) else a end, [0::bigint]) as r from found),
done as (select word, r[2:] as ids from walk where r[1] = length(word)),
pieces as (select t.word, coalesce(d.ids, [1]) as ids from types t left join done d on t.word = d.word)"""


def encoded(most: int | None) -> str:
    head = "" if most is None else f"[:{most}]"
    inner = "" if most is None else f"[:{most - 2}]"
    return f"""
with {VOCABULARY},
docs as (select doc_id, {sql.words('text')} as w from documents),
tokens as (select doc_id, i, w[i] as word from (select doc_id, w, unnest(range(1, len(w{head}) + 1)) as i from docs)),
{cut('select word from tokens')},
rows as (select t.doc_id, flatten(list(p.ids order by t.i)) as ids from tokens t join pieces p on t.word = p.word group by t.doc_id),
enc as (select d.doc_id, list_concat(list_concat([2], coalesce(r.ids, []){inner}), [3]) as ids
    from docs d left join rows r on d.doc_id = r.doc_id)"""


def joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def pair_sql(mode: str, most: int) -> str:
    room = most - 3
    if mode == "longest_first":
        keep_a = f"case when la + lb <= {room} then la else least(la, greatest({(room + 1) // 2}, {room} - lb)) end"
        keep_b = f"case when la + lb <= {room} then lb else least(lb, greatest({room // 2}, {room} - la)) end"
    else:
        keep_a, keep_b = "la", "lb"
    return f"""
with {VOCABULARY},
pairs as (select u.conv_id || '-' || u.turn as id, {sql.words('u.text')} as a, {sql.words('v.text')} as b
    from conversations u join conversations v on u.conv_id = v.conv_id and v.turn = u.turn + 1
    where u.role = 'user' and v.role = 'assistant'),
tokens as (
    select id, 0 as side, i, a[i] as word from (select id, a, unnest(range(1, len(a) + 1)) as i from pairs)
    union all select id, 1, i, b[i] from (select id, b, unnest(range(1, len(b) + 1)) as i from pairs)),
{cut('select word from tokens')},
sides as (select t.id, t.side, flatten(list(p.ids order by t.i)) as ids from tokens t join pieces p on t.word = p.word group by all),
both_sides as (select p.id, coalesce(x.ids, []) as a, coalesce(y.ids, []) as b from pairs p
    left join sides x on x.id = p.id and x.side = 0 left join sides y on y.id = p.id and y.side = 1),
sizes as (select *, len(a) as la, len(b) as lb from both_sides),
kept as (select id, a[:{keep_a}] as a, b[:{keep_b}] as b from sizes),
full_ids as (select id, list_concat(list_concat(list_concat([2], a), list_concat([3], b)), [3]) as ids,
    len(a) + 2 as first_part from kept)
select id,
    {joined(f"list_resize(ids[:{most}], {most}, 0)")} as input_ids,
    {joined(f"list_transform(range(1, {most} + 1), lambda i: case when i > first_part and i <= len(ids) then 1 else 0 end)")} as token_type_ids,
    {joined(f"list_transform(range(1, {most} + 1), lambda i: case when i <= len(ids) then 1 else 0 end)")} as attention_mask
from full_ids"""


_BOUND = format(int(0.15 * (1 << 32)), "08x")
_MASKED = f"""
masked as (select doc_id, ids, list_transform(ids, lambda x, i: case when x > 4 and
    {sql.position_draw(str(SEED), 'doc_id', 'i - 1')} < '{_BOUND}' then 4 else x end) as m from enc)"""
_KEEP_MASK, _KEEP_SAME = format(int(0.8 * (1 << 32)), "08x"), format(int(0.5 * (1 << 32)), "08x")

PADDED = encoded(512).replace("enc as (select d.doc_id", "short as (select d.doc_id") + """,
longest as (select max(len(ids)) as m from short),
sizes as (select doc_id, len(ids) as real, m as full_size from short, longest),
enc as (select doc_id, list_resize(ids, m, 0) as ids from short, longest)"""
_ATTENTION = f"{joined('list_transform(range(0, full_size), lambda i: case when i < real then 1 else 0 end)')} as attention_mask"


def _whole_word(rows: str, fixed: str) -> str:
    return f"""{rows},
positions as (select doc_id, i - 1 as i, ids[i] as x, len(ids) as n
    from (select doc_id, ids, unnest(range(1, len(ids) + 1)) as i from enc)),
candidates as (select p.*, row_number() over (partition by doc_id order by i) as k, token like '##%' as c
    from positions p join vocabulary on id = x where x not in {fixed}),
numbered as (select *, sum(case when k = 1 or not c then 1 else 0 end) over (partition by doc_id order by k) as w from candidates),
groups as (select doc_id, w, min(i) as i, count(*) as size,
    least(80, greatest(1, cast(round_even(any_value(n) * 0.15::double, 0) as integer))) as cap from numbered group by doc_id, w),
ordered as (select doc_id, any_value(cap) as cap, list([size, w]::bigint[] order by
    {sql.position_draw(f'{SEED}:order', 'doc_id', 'i')}, i) as g from groups group by doc_id),
pick as (select doc_id, list_reduce(g, lambda a, x: case when a[1] + x[1] <= a[2]
    then list_concat(list_concat([a[1] + x[1]], a[2:]), [x[2]]) else a end, [0::bigint, cap::bigint]) as r from ordered),
taken as (select doc_id, unnest(r[3:]) as w from pick),
chosen as (select n.doc_id, n.i from numbered n join taken p on n.doc_id = p.doc_id and n.w = p.w),
replaced as (select p.doc_id, p.i, p.x, case when c.i is null then p.x
    when {sql.draw(f"'{SEED}:piece', p.doc_id, p.i", '0')} < '{_KEEP_MASK}' then 4
    when {sql.draw(f"'{SEED}:piece', p.doc_id, p.i", '1')} < '{_KEEP_SAME}' then p.x
    else cast('0x' || {sql.draw(f"'{SEED}:piece', p.doc_id, p.i", '2')} as bigint) % (select count(*) from vocabulary) end as y
    from positions p left join chosen c on c.doc_id = p.doc_id and c.i = p.i)
select doc_id, {joined('list(y order by i)')} as input_ids, {joined('list(x order by i)')} as labels from replaced group by doc_id"""


ORACLES = {
    "trained_round_trip": f"""with listed as (select doc_id, {sql.words('text')} as w from documents)
select doc_id, cast(len(w) as integer) as n_words,
    array_to_string(list_transform(w, lambda x: case when length(x) > 100 then '[UNK]' else x end), ' ') as words from listed""",
    "wordpiece_encode": f"""{encoded(512)},
longest as (select max(len(ids)) as m from enc)
select doc_id, {joined('list_resize(ids, m, 0)')} as input_ids,
    {joined('list_transform(range(0, m), lambda i: case when i < len(ids) then 1 else 0 end)')} as attention_mask,
    cast(m as integer) as n_types from enc, longest""",
    "wordpiece_whole": f"""{encoded(None)}
select doc_id, cast(len(ids) as integer) as n_ids, cast(len(list_filter(ids, lambda x: x = 1)) as integer) as n_unknown,
    cast(list_sum(ids) as bigint) as id_sum from enc""",
    "pair_encode_slice": pair_sql("slice", 128),
    "fill_mask": f"""with docs as (select {sql.words('text')} as w from documents),
places as (select coalesce(w[i - 1], '') as l, coalesce(w[i + 1], '') as r, w[i] as w
    from (select w, unnest(range(1, len(w) + 1)) as i from docs)),
counts as (select l, r, w, count(*) as n from places group by all),
turns as (select conv_id || '-' || turn as id, {sql.words('text')} as w from conversations),
asked as (select id, w, len(w) // 2 + 1 as i, case when len(w) > 1 then w[len(w) // 2] else '' end as l,
    coalesce(w[len(w) // 2 + 2], '') as r from turns where len(w) > 0),
both_sides as (select id, c.w, c.n / sum(c.n) over (partition by id) as s from asked a join counts c on c.l = a.l and c.r = a.r),
lefts as (select l, w, sum(n) as n from counts group by all),
left_side as (select id, c.w, {fill.BACK_OFF}::double * (c.n / sum(c.n) over (partition by id)) as s from asked a join lefts c on c.l = a.l),
overall as (select w, {fill.BACK_OFF ** 2}::double * (sum(n) / sum(sum(n)) over ()) as s from counts group by w),
top_words as (select * from overall order by s desc, w limit 5),
every as (select * from both_sides union all select * from left_side union all select id, t.w, t.s from asked, top_words t),
scored as (select id, w, max(s) as s from every group by all),
ranked as (select *, row_number() over (partition by id order by s desc, w) as k from scored)
select k.id, cast(k as integer) as rank, k.w as candidate, round(s, 6) as score,
    array_to_string(list_concat(list_concat(a.w[:a.i - 1], [k.w]), a.w[a.i + 1:]), ' ') as sequence
from ranked k join asked a on a.id = k.id where k <= 5""",
    "pair_rejects": """select c.conv_id || '-' || c.turn as id, c.role from conversations c where not exists (
        select 1 from conversations o where o.conv_id = c.conv_id and (c.role = 'user' and o.role = 'assistant' and o.turn = c.turn + 1
            or c.role = 'assistant' and o.role = 'user' and o.turn = c.turn - 1))""",
    "pair_encode_longest_first": pair_sql("longest_first", 128),
    "mask_tokens": f"""{encoded(512)}, {_MASKED}
select doc_id, {joined('m')} as input_ids, {joined('ids')} as labels from masked""",
    "mask_fraction": f"""{encoded(512)}, {_MASKED},
sums as (select cast(sum(len(list_filter(m, lambda x: x = 4))) as bigint) as masked,
    cast(sum(len(list_filter(ids, lambda x: x <> 4))) as bigint) as others from masked)
select masked, others, round(masked / others, 6) as share from sums""",
    "mask_whole_word": _whole_word(encoded(512), "(2, 3)"),
    "mask_fraction_padded": f"""{PADDED}, {_MASKED},
sums as (select cast(sum(len(list_filter(m, lambda x: x = 4))) as bigint) as masked,
    cast(sum(len(list_filter(ids, lambda x: x <> 4))) as bigint) as others from masked)
select masked, others, round(masked / others, 6) as share from sums""",
    "training_table": f"""{PADDED}, {_MASKED}
select doc_id, {joined('m')} as input_ids, {_ATTENTION}, {joined('ids')} as labels from masked join sizes using (doc_id)""",
    "training_table_whole_word": f"""with t as ({_whole_word(PADDED, "(2, 3)")}),
{PADDED.strip().removeprefix('with')} select t.*, {_ATTENTION} from t join sizes using (doc_id)""",
    "training_table_no_padding": f"""with t as ({_whole_word(PADDED, "(0, 2, 3)")}),
{PADDED.strip().removeprefix('with')} select t.*, {_ATTENTION} from t join sizes using (doc_id)""",
}
