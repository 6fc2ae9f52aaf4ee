"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common, decontam, embed_dedup, hard_negatives, line_dedup, mixing, pii, prefix_trie, quality, secrets, simhash, substring_dedup, suffix_dedup, tokens_out
from skeinwork.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.without_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(spark, table(spark, folder, "documents"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, folder, "documents"), texts=False).drop("kept")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return tokens_out.token_table(spark, table(spark, folder, "documents"), vocabulary_path())


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_windows(table(spark, folder, "documents"), texts=False).drop("kept")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    placed = common.stored(prefix_trie.numbered(table(spark, folder, "conversations")), "placed")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(placed), placed.select("conv_id").distinct())


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", relabelled))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(spark, table(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_line_dedup, op2_personal_data, op3_suffix_dedup, op4_mixing, op5_simhash, op6_embedding_dedup,
        op7_decontamination, op8_quality, op9_token_shards, op10_substring_dedup, op11_prefix_trie, op12_hard_negatives, op13_secrets,
    )
}

_LINES = """
lines as (select doc_id, source, i, l[i] as line from (select doc_id, source, l, unnest(range(1, len(l) + 1)) as i
    from (select doc_id, source, string_split(text, chr(10)) as l from documents))),
wide as (select trim(line, ' ') as key from lines where trim(line, ' ') <> '' group by all having count(distinct source) >= 10)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _runs(size: int) -> str:
    """Distinct runs of words of the items, each with its number of words and its items."""
    return f"""
items as (select item_id, regexp_extract_all({_LOWER}, '{_PLAIN_WORD}') as w from benchmark),
runs as (select distinct item_id, array_to_string(w[i:i + {size - 1}], ' ') as run, least(len(w), {size}) as n
    from (select item_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct n from runs)"""


ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""with {_LINES},
judged as (select doc_id, i, line, trim(line, ' ') <> '' and key is not null as gone from lines left join wide on key = trim(line, ' '))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by doc_id""",
    "op3_suffix_dedup": """with docs as (select doc_id, encode(coalesce(text, '')) as b from documents),
places as (select doc_id, i, hex(b[i:i + 99]) as run
    from (select doc_id, b, unnest(range(1, octet_length(b) - 98)) as i from docs)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by run order by doc_id, i) as k from places) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 100)) as p from later),
bytes as (select doc_id, unnest(range(1, octet_length(b) + 1)) as p, b from docs),
marked as (select b.doc_id, b.p, hex(b.b[b.p:b.p]) as byte, g.p is not null as gone from bytes b left join gone g on g.doc_id = b.doc_id and g.p = b.p),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as first from marked),
sums as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (first) as n_spans,
    sha256(unhex(coalesce(string_agg(byte, '' order by p) filter (not gone), ''))) as kept from edges group by doc_id)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    coalesce(kept, sha256('')) as kept_sha256 from docs left join sums using (doc_id)""",
    "op4_mixing": f"""with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size,
    substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as h from documents),
sums as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from sized group by source),
known as (select *, ([5, 2, 1])[(place - 1) % 3 + 1] as weight, 2 * source_size as cap from sums),
shared as (select *, row_number() over w as rank, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over (w rows between current row and unbounded following))::double as share
    from known window w as (order by cap / weight::double, place)),
opened as (select *, min(case when share * weight < cap then rank end) over () as first_open from shared),
levels as (select *, max(case when rank = first_open then share end) over () as level from opened),
goals as (select source, source_size, case when first_open is null or rank < first_open then cap::double else level * weight end as target from levels),
rounds as (select *, least(case when source_size > 0 then floor(target / source_size) else 0 end, 2) as times from goals),
ends as (select s.*, sum(size) over (partition by source order by h) as after from sized s),
steps as (select e.*, after - sum(size) over (partition by source, h) as before from ends e),
judged as (select s.doc_id, s.size, r.source_size, r.target, r.times, s.before, s.after, r.target - r.times * r.source_size as budget
    from steps s join rounds r on s.source is not distinct from r.source)
select doc_id, size, source_size, target, cast(size * (times + case when after <= budget
    or before <= budget and after > budget and after - budget < budget - before then 1 else 0 end) as bigint) as taken from judged""",
    "op6_embedding_dedup": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
    and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join roots on roots.a = vec_id left join counts on counts.a = vec_id""",
    "op7_decontamination": f"""with {_runs(decontam.WINDOW)},
docs as (select doc_id, regexp_extract_all({_LOWER}, '{_PLAIN_WORD}') as w from documents),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes)),
met as (select p.doc_id, p.i, p.n, r.item_id from places p join runs r using (run, n)),
hits as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from met) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
    from (select distinct doc_id, cast(item_id as varchar) as item from met) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (doc_id) left join found using (doc_id)""",
    "op10_substring_dedup": f"""with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
places as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as run
    from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs)),
least as (select run, min(doc_id) as first from places group by run),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from places join least using (run) where doc_id > first),
marked as (select d.doc_id, d.k, d.w[d.k] as word, g.k is not null as gone
    from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from docs) d left join gone g on g.doc_id = d.doc_id and g.k = d.k),
sums as (select doc_id, count(*) filter (gone) as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by k) filter (not gone), '')) as kept from marked group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept, sha256('')) as kept_sha256
from docs left join sums using (doc_id)""",
    "op11_prefix_trie": """with placed as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first,
        md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as p,
        {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t from conversations where conv_id is not null),
own as (select c, list(t order by p) as turns, list_transform(flatten(list_transform(string_split(cast(c as varchar), ''),
        lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])), lambda x: cast(x as bigint)) as bits from placed group by c),
hashed as (select c, turns, xor(list_reduce(list_prepend(4294967295, bits), lambda a, x: case when x >= 0 then xor(a, x)
        when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 6 as h from own),
rebuilt as (select a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns
    from hashed a left join hashed b on b.c = a.c - a.c % 100),
paths as (select c, len(turns) as size, d, turns[1:d] as prefix from (select c, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
nodes as (select d, prefix, min(c) as conv_id, count(*) as n, case when d = 0 then 0 else length(prefix[d].text) end as chars,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (size = d), '')) as ends from paths group by d, prefix),
kids as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as k from nodes where d > 0 group by all),
known as (select n.*, coalesce(k, 0) as k from nodes n left join kids using (d, prefix)),
below as (select t as d, prefix[1:t] as prefix, count(*) filter (k = 0) as leaves, sum((n - 1) * chars) as saved
    from (select *, unnest(range(0, d + 1)) as t from known) group by all)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, n.k as n_children, leaves as n_leaves,
    cast(saved as bigint) as saved_tokens, n.ends as ends_sha256
from known n join below b using (d, prefix) left join nodes p on p.d = n.d - 1 and p.prefix = n.prefix[1:n.d - 1]""",
    "op12_hard_negatives": """with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10""",
}
