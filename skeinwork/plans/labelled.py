"""Queries over labelled data: tagged spans, label sets, relations, questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import labels as label_functions
from skeinwork.operators import entities, labelled
from skeinwork.plans import sql, tokens
from skeinwork.plans.tables import documents, spread, table
from skeinwork.plans.tokens import shown, turn_pairs
from skeinwork.session import frozen, stored
from skeinwork.sources import readers

STEP = 40


def tagged_lines(docs: DataFrame) -> DataFrame:
    """Documents written as tagged-span lines: title, abstract, and two overlapping spans per 40
    characters."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    clean = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.translate(title, "|\t", "  ").alias("title"),
        F.translate(F.substr("text", F.length(title) + 2), "|\t\n", "   ").alias("abstract"),
    )

    def line(number, *fields):
        return F.struct(F.lit(number).cast("bigint").alias("line_no"), F.concat(*fields).alias("value"))

    def span(k, number, start, length, label):
        tab = F.lit("\t")
        first = k * STEP + start
        return F.struct(
            (k * 2 + number).cast("bigint").alias("line_no"),
            F.concat_ws("\t", "id", first, first + length, F.concat(F.lit("s"), k), label, F.lit("c")).alias("value"),
        )

    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.floor((F.length("title") + F.length("abstract")) / STEP).cast("int")),
            lambda k: F.array(
                span(k, 2, 0, 12 + k % 5 * 6, F.concat(F.lit("L"), k % 4)),
                span(k, 3, 10, F.lit(15), F.concat(F.lit("M"), k % 3)),
            ),
        )
    )
    texts = F.array(
        line(0, "id", F.lit("|t|"), "title"), line(1, "id", F.lit("|a|"), "abstract")
    )
    return clean.select(F.inline_outer(F.concat(texts, spans)))


def _tagged(spark, folder):
    """Texts and spans of the documents. The lines are stored, since both are read from them."""
    lines = stored(tagged_lines(documents(spark, folder)), "lines")
    docs, spans, _ = labelled.split_tagged_lines(lines)
    return docs, spans


def span_labels(spark, folder):
    return labelled.span_labels(*_tagged(spark, folder))


def sentence_group(spark, folder):
    grouped = labelled.grouped_blocks(labelled.span_blocks(*_tagged(spark, folder)))
    return grouped.select("id", F.size("words").alias("n_words"), F.array_join("labels", " ").alias("labels"), "sentence")


def _index(blocks) -> DataFrame:
    return labelled.label_index(blocks.select(F.explode_outer("labels").alias("label")))


def label_index(spark, folder):
    return _index(labelled.span_blocks(*_tagged(spark, folder)))


def label_pad(spark, folder):
    blocks = stored(labelled.span_blocks(*_tagged(spark, folder)).select("id", "pos", "labels"), "blocks")
    known = labelled.first_label_ids(blocks, frozen(_index(blocks)))
    return known.select("id", shown(labelled.padded_labels(F.col("label_ids"))).alias("label_ids"))


def entity_encode(spark, folder):
    blocks = stored(labelled.span_blocks(*_tagged(spark, folder)).select("id", "pos", "text", "labels"), "blocks")
    rows = entities.block_entity_rows(blocks, frozen(_index(blocks)), tokens.corpus_vocabulary(spark, folder))
    return rows.select("id", *[shown(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def label_lines(spark, folder) -> DataFrame:
    """Label files as a table ``(doc_id, value)``, with blanks, doubles, NULL and AND."""
    known = table(spark, folder, "labels").join(documents(spark, folder).select("doc_id", "lang", "source"), "doc_id")
    value = F.concat(
        F.lit("< <"), "lang", F.lit("--"), "source",
        F.when(F.col("quality") == 1, F.lit("<  quality--q")).otherwise(F.lit("<NULL--n")),
        F.when(F.col("toxic") == 1, F.concat(F.lit("< toxic --t AND quality--z<"), "lang", F.lit("--again"))).otherwise(F.lit("")),
        F.lit("<"),
    )
    return known.select("doc_id", value.alias("value"))


def hallmark_parse(spark, folder):
    return labelled.document_labels(label_lines(spark, folder))


def hallmark_sets(spark, folder):
    sets = labelled.label_sets(labelled.document_labels(label_lines(spark, folder), split_and=True))
    return sets.select("doc_id", F.array_join("labels", ",").alias("labels"))


def multi_hot(spark, folder):
    pairs = labelled.document_labels(label_lines(spark, folder))
    hot = labelled.multi_hot(pairs, labelled.class_names(pairs))
    return labelled.with_text(hot, documents(spark, folder).select("doc_id", "text"))[0]


RELATION_NAMES = [*label_functions.RELATION, "UNDEFINED"]


def relation_rows(spark, folder) -> DataFrame:
    """Every document as a relation record: its first and last word marked."""
    w = F.split(F.regexp_replace("text", r"\n+", " "), " ")
    text = F.concat_ws(
        " ", F.lit("<<"), F.element_at(w, 1), F.lit(">>"), F.array_join(F.slice(w, 2, F.size(w)), " "),
        F.lit("[["), F.element_at(w, -1), F.lit("]] ."),
    )
    name = F.element_at(F.array(*[F.lit(n) for n in RELATION_NAMES]), (F.col("doc_id") % len(RELATION_NAMES) + 1).cast("int"))
    return documents(spark, folder).select("doc_id", text.alias("text"), name.alias("label"))


def marker_token_span(spark, folder):
    return labelled.relation_records(relation_rows(spark, folder))[0].select("doc_id", "ss", "se", "os", "oe", "class")


def marker_substring(spark, folder):
    known = labelled.relation_records(relation_rows(spark, folder), "substring")[0]
    return known.select("doc_id", "subj", "obj", "segment", "class")


def _decisions(spark, folder):
    kind = F.col("event_type")
    label = F.when(kind == "click", "yes").when(kind == "view", "maybe").when(kind == "purchase", "no").otherwise(kind)
    return labelled.encoded_labels(table(spark, folder, "events").select("event_id", label.alias("label")), "label", label_functions.THREE_WAY)


def label_encode(spark, folder):
    return _decisions(spark, folder)[0].select("event_id", "class")


def label_rejects(spark, folder):
    return _decisions(spark, folder)[1].groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, folder):
    return turn_pairs(spread(table(spark, folder, "conversations")))


def qa_indexed(spark, folder):
    """Pairs written as one-entry indexed JSON objects, read back, contexts rendered as a list."""
    size = F.length("context") % 4
    record = F.struct(
        F.col("question").alias("QUESTION"),
        F.split("context", "\n").alias("CONTEXTS"),
        F.when(size == 0, "yes").when(size == 1, "maybe").when(size == 2, "no").otherwise("unsure").alias("final_decision"),
    )
    values = _pairs(spark, folder).select(F.to_json(F.create_map("id", record)).alias("value"))
    known = labelled.questions_three_way(readers.explode_indexed(values))[0]
    return known.select("id", "question", "context", "class")


def qa_nested(spark, folder):
    """Pairs written as nested question files, read back; list-valued answers drop out."""
    size = F.length("context") % 4
    snippets = F.transform(F.split("context", "\n"), lambda t: F.struct(t.alias("text"))).alias("snippets")

    def file(answer):
        question = F.struct(F.col("question").alias("body"), answer.alias("exact_answer"), snippets)
        return F.to_json(F.struct(F.array(question).alias("questions")))

    word = F.when(size == 0, "yes").when(size == 1, "no").otherwise("maybe")
    value = F.when(size == 3, file(F.array(F.array(F.lit("yes"))))).otherwise(file(word))
    values = _pairs(spark, folder).select("id", value.alias("value"))
    return labelled.questions_binary(readers.nested_values(values)).select("id", "question", "context", "class")


QUERIES = {
    "span_labels": span_labels,
    "sentence_group": sentence_group,
    "label_index": label_index,
    "label_pad": label_pad,
    "entity_encode": entity_encode,
    "hallmark_parse": hallmark_parse,
    "hallmark_sets": hallmark_sets,
    "multi_hot": multi_hot,
    "marker_token_span": marker_token_span,
    "marker_substring": marker_substring,
    "label_encode": label_encode,
    "label_rejects": label_rejects,
    "qa_indexed": qa_indexed,
    "qa_nested": qa_nested,
}

_WORDS = f"""
parts as (select cast(doc_id as varchar) as id, split_part(text, chr(10), 1) as t, text from documents),
bodies as (select id, translate(t, '|' || chr(9), '  ') || ' ' ||
    translate(substr(text, length(t) + 2), '|' || chr(9) || chr(10), '   ') as body from parts),
listed as (select id, string_split(body, ' ') as w from bodies),
words as (select id, i - 1 as pos, w[i] as word from (select id, w, unnest(range(1, len(w) + 1)) as i from listed)),
placed as (select *, coalesce(sum(length(word) + 1) over (partition by id order by pos
    rows between unbounded preceding and 1 preceding), 0) as start from words),
steps as (select id, unnest(range(0, (length(body) - 1) // {STEP} + 1)) as k from bodies),
spans as (
    select id, 2 * k + 2 as line_no, k * {STEP} as s, k * {STEP} + 12 + k % 5 * 6 as e, 'L' || (k % 4) as label from steps
    union all select id, 2 * k + 3, k * {STEP} + 10, k * {STEP} + 25, 'M' || (k % 3) from steps),
cells as (select id, unnest(range(s, e)) as c, line_no, label from spans),
marks as (select id, c, max_by(label, line_no) as label from cells group by id, c),
labelled as (select p.id, p.pos, cast(p.start as bigint) as start, p.word, coalesce(m.label, 'O') as label
    from placed p left join marks m on m.id = p.id and m.c = p.start + case when p.word like '(%' then 1 else 0 end)"""
_INDEX = """
counted as (select label, count(*) as n from labelled group by label),
numbered as (select label, n, cast(row_number() over (order by n desc, label) - 1 as integer) as idx from counted)"""
_TRUE_PAIRS = """
marked as (select l.doc_id, lang, quality, toxic from labels l join documents d on l.doc_id = d.doc_id),
pairs as (select doc_id, lang as label from marked
    union select doc_id, 'quality' from marked where quality = 1
    union select doc_id, 'toxic' from marked where toxic = 1)"""
_CLASS = "case label " + " ".join(f"when '{n}' then {c}" for n, c in label_functions.RELATION.items()) + " end"
_RELATIONS = f"""
w as (select doc_id, string_split(regexp_replace(text, '\\n+', ' ', 'g'), ' ') as w from documents),
named as (select doc_id, '<< ' || w[1] || ' >> ' || array_to_string(w[2:], ' ') || ' [[ ' || w[-1] || ' ]] .' as text,
    ({RELATION_NAMES})[doc_id % {len(RELATION_NAMES)} + 1] as label from w),
rel as (select doc_id, text, cast({_CLASS} as integer) as class from named where label <> 'UNDEFINED')"""
_PAIRS = """
pairs as (select u.conv_id || '-' || u.turn as id, u.text as question, v.text as context
    from conversations u join conversations v on u.conv_id = v.conv_id and v.turn = u.turn + 1
    where u.role = 'user' and v.role = 'assistant')"""
_QUOTED = """case when contains(p, '''') and not contains(p, '"') then '"' || e || '"'
    else '''' || replace(e, '''', '\\''') || '''' end"""

ORACLES = {
    "span_labels": f"with {_WORDS} select id, pos, start, word, label from labelled",
    "sentence_group": f"""with {_WORDS}
        select id, cast(count(*) as integer) as n_words, string_agg(label, ' ' order by pos) as labels,
            string_agg(word, ' ' order by pos) as sentence from labelled group by id""",
    "label_index": f"with {_WORDS}, {_INDEX} select label, n, idx from numbered",
    "label_pad": f"""with {_WORDS}, {_INDEX},
        ids as (select id, list(idx order by pos) as l from labelled join numbered using (label) group by id)
        select id, array_to_string(list_resize(l[:200], 200, 4), ' ') as label_ids from ids""",
    "entity_encode": f"""with {_WORDS}, {_INDEX},
        rows as (select id, list(idx order by pos) as l, {sql.words("string_agg(word, ' ' order by pos)")} as w
            from labelled join numbered using (label) group by id),
        {tokens.VOCABULARY.replace("counts as", "word_totals as").replace("from counts", "from word_totals")},
        seen as (select id, i, w[i] as word from (select id, w, unnest(range(1, len(w[:200]) + 1)) as i from rows)),
        {tokens.cut('select word from seen')},
        flat as (select s.id, flatten(list(p.ids order by s.i)) as ids from seen s join pieces p on s.word = p.word group by s.id),
        enc as (select r.id, l, list_concat(list_concat([2], coalesce(f.ids, [])[:198]), [3]) as ids
            from rows r left join flat f on r.id = f.id)
        select id, array_to_string(list_resize(ids, 200, 0), ' ') as input_ids,
            array_to_string(list_transform(range(1, 201), lambda i: case when i <= len(ids) then 1 else 0 end), ' ') as attention_mask,
            array_to_string(list_resize(l[:200], 200, 4), ' ') as labels from enc""",
    "hallmark_parse": f"with {_TRUE_PAIRS} select doc_id, label from pairs",
    "hallmark_sets": f"""with {_TRUE_PAIRS},
        more as (select * from pairs union select doc_id, 'quality' from marked where toxic = 1)
        select doc_id, string_agg(label, ',' order by label) as labels from more group by doc_id""",
    "multi_hot": f"""with {_TRUE_PAIRS},
        hot as (select doc_id, {', '.join(f"cast(max(case when label = '{c}' then 1 else 0 end) as integer) as {c}"
            for c in ('de', 'en', 'es', 'fr', 'quality', 'toxic'))} from pairs group by doc_id)
        select h.*, d.text from hot h join documents d on h.doc_id = d.doc_id""",
    "marker_token_span": f"""with {_RELATIONS},
        t as (select doc_id, class, string_split(text, ' ') as t from rel),
        tokens as (select doc_id, class, i - 1 as i, t[i] as x from (select doc_id, class, t, unnest(range(1, len(t) + 1)) as i from t)),
        kinds as (select doc_id, class, i, case when contains(x, '<<') then 'ss' when contains(x, '>>') then 'se'
            when contains(x, '[[') then 'os' when contains(x, ']]') then 'oe' end as kind from tokens)
        select doc_id, cast(max(i) filter (kind = 'ss') + 1 as integer) as ss, cast(max(i) filter (kind = 'se') - 1 as integer) as se,
            cast(max(i) filter (kind = 'os') + 1 as integer) as os, cast(max(i) filter (kind = 'oe') - 1 as integer) as oe, class
        from kinds group by doc_id, class""",
    "marker_substring": f"""with {_RELATIONS},
        cut as (select doc_id, class,
            substr(text, instr(text, '<<') + 2, greatest(instr(text, '>>') - instr(text, '<<') - 2, 0)) as subj,
            substr(text, instr(text, '[[') + 12, greatest(instr(text, ']]') - instr(text, '[[') - 12, 0)) as obj from rel)
        select doc_id, subj, obj, subj || ' ' || obj as segment, class from cut""",
    "label_encode": """select event_id, cast(case event_type when 'click' then 0 when 'view' then 1 else 2 end as integer) as class
        from events where event_type in ('click', 'view', 'purchase')""",
    "label_rejects": """select event_type as label, count(*) as n from events
        where event_type not in ('click', 'view', 'purchase') group by event_type""",
    "qa_indexed": f"""with {_PAIRS},
        parts as (select *, list_transform(string_split(context, chr(10)), lambda p:
            struct_pack(p := p, e := replace(replace(replace(p, '\\', '\\\\'), chr(13), '\\r'), chr(9), '\\t'))) as c from pairs)
        select id, question, '[' || array_to_string(list_transform(c, lambda x: {_QUOTED.replace("(p,", "(x.p,").replace("(e,", "(x.e,").replace("|| e ||", "|| x.e ||")}), ', ') || ']' as context,
            cast(length(context) % 4 as integer) as class
        from parts where length(context) % 4 < 3""",
    "qa_nested": f"""with {_PAIRS}
        select id, question, replace(context, chr(10), ' ') as context,
            cast(1 - length(context) % 4 as integer) as class
        from pairs where length(context) % 4 < 2""",
}
