"""Queries for order, splits, metrics, rankings and linear heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import arrays
from skeinwork.operators import head, metrics, order, runs
from skeinwork.plans import sql
from skeinwork.plans.experiments import SEEDS
from skeinwork.plans.tables import spread, table
from skeinwork.plans.tokens import shown
from skeinwork.session import frozen

SEED, BATCH, PARTS = 42, 112, 8


def _keys(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source")


def train_test_split(spark, folder):
    return order.train_test(_keys(spark, folder), "doc_id", SEED)


def batches(spark, folder):
    return order.batches(_keys(spark, folder), "doc_id", BATCH, SEED, epoch=1)


def batches_drop_last(spark, folder):
    return order.batches(_keys(spark, folder), "doc_id", 64, SEED, drop_last=True)


def batches_by_shard(spark, folder):
    """Two epochs of a loader that opens one source after the other."""
    return order.batches_by_shard(_keys(spark, folder), "doc_id", "source", BATCH, SEED, epochs=2)


def shuffle_epoch(spark, folder):
    return order.shuffled(table(spark, folder, "events").select("event_id", "event_type"), "event_id", SEED, epoch=3)


def step_counts(spark, folder):
    return order.step_counts(_keys(spark, folder), ["source"], 8, 4)


def fold_union(spark, folder):
    keys = table(spark, folder, "documents").select("doc_id", "lang")
    both = order.folds(train=keys.filter("lang <> 'en'"), test=keys.filter("lang = 'en'"))
    return both.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark, folder):
    """Labelled documents with a rule as the predictor."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    rule = (F.col("n_chars") % 3 > 0).cast("int")
    other = (F.col("n_chars") % 10 == 0).cast("int")
    predictions = docs.select("doc_id", "source", "lang", "n_chars", rule.alias("pred"), other.alias("pred_toxic"))
    return metrics.joined_predictions(predictions, table(spark, folder, "labels"), "doc_id")


def prediction_join(spark, folder):
    scored = metrics.accuracy(_judged(spark, folder), "pred", "quality", ["lang"])
    return scored.select("lang", F.bround("accuracy", 6).alias("accuracy"), "n")


def accuracy(spark, folder):
    return metrics.accuracy(_judged(spark, folder), "pred", "quality").select(F.bround("accuracy", 6).alias("accuracy"), "n")


def _arrays(spark, folder):
    judged = _judged(spark, folder)
    return judged.select(
        "source", F.array("pred", "pred_toxic").alias("p"), F.array("quality", "toxic").alias("t")
    )


def micro_f1_single(spark, folder):
    out = metrics.token_micro_f1(_arrays(spark, folder), "p", "t", ["source"])
    return out.select("source", F.bround("micro_f1", 6).alias("micro_f1"), "n")


def micro_f1_multi(spark, folder):
    out = metrics.multilabel_micro_f1(_arrays(spark, folder), "p", "t", ["source"])
    return out.select("source", "tp", "fp", "fn", F.bround("micro_f1", 6).alias("micro_f1"))


def class_report(spark, folder):
    docs = table(spark, folder, "documents")
    guess = F.when(F.col("n_chars") % 5 == 0, "en").when(F.col("n_chars") % 7 == 0, "it").otherwise(F.col("lang"))
    report = metrics.class_report(docs.select(F.col("lang").alias("truth"), guess.alias("pred")))
    return report.select("label", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _scores(spark, folder):
    vectors = table(spark, folder, "embeddings")
    wide = F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", "label", wide.alias("v"))


def logloss(spark, folder):
    """Cross entropy, with and without a second softmax, and binary cross entropy, of whole vectors as scores."""
    bits = F.transform("v", lambda _, i: ((F.col("label") + i) % 3 % 2).cast("double"))
    rows = _scores(spark, folder).select(F.col("v").alias("s"), F.col("label").alias("t"), F.col("v").alias("z"), bits.alias("y"))
    return rows.agg(
        F.bround(F.avg(metrics.cross_entropy(F.col("s"), F.col("t"))), 6).alias("cross_entropy"),
        F.bround(F.avg(metrics.cross_entropy(metrics.softmax(F.col("s")), F.col("t"))), 6).alias("double_softmax"),
        F.bround(F.avg(metrics.cross_entropy(metrics.softmax(F.col("s")), F.col("t"), True)), 6).alias("log_loss"),
        F.bround(F.avg(metrics.binary_cross_entropy(F.col("z"), F.col("y"))), 6).alias("binary_cross_entropy"),
    )


def batch_mean_loss(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", F.floor(F.col("event_id") / 32).alias("batch"), F.col("value").alias("loss"))
    out = metrics.batch_mean_loss(events, "batch", "loss", ["event_type"])
    return out.select("event_type", F.bround("loss", 6).alias("loss"), "n_batches")


def topk_candidates(spark, folder):
    listed = _scores(spark, folder).select("vec_id", F.posexplode("v").alias("candidate", "score"))
    return metrics.top_candidates(listed, "vec_id", "candidate", "score", 5).select(
        "vec_id", "candidate", F.bround("score", 6).alias("score"), "rank")


def topk_arrays(spark, folder):
    best = _scores(spark, folder).select("vec_id", F.inline(arrays.top_k(F.col("v"), 5)))
    return best.select("vec_id", "rank", "candidate", F.bround("score", 6).alias("score"))


def argmax_threshold(spark, folder):
    return _scores(spark, folder).select(
        "vec_id", arrays.argmax(F.col("v")).alias("best"), shown(arrays.threshold(F.col("v"), 0.1)).alias("flags"))


def _width(vectors) -> int:
    return vectors.agg(F.max(F.size("embedding"))).first()[0]


def head_score(spark, folder):
    vectors = table(spark, folder, "embeddings")
    weights = head.weight_rows(head.centroids(vectors, "embedding", "label", _width(vectors)), "label")
    scored = head.score_head(spread(vectors), "embedding", weights)
    return scored.select(
        "vec_id", arrays.argmax(F.col("scores")).alias("pred"), F.bround(F.array_max("scores"), 5).alias("top_score"))


def gather_concat(spark, folder):
    """Equal slices of each vector as token vectors; two of them gathered and joined."""
    size = _width(table(spark, folder, "embeddings")) // PARTS
    tokens = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.slice(F.col("v"), k * size + 1, size))
    picked = _scores(spark, folder).select(
        "vec_id",
        arrays.gather_concat(
            tokens, (F.col("vec_id") % PARTS).cast("int"), (F.col("vec_id") * 3 % PARTS).cast("int")
        ).alias("h"),
    )
    weighted = F.aggregate(F.transform("h", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return picked.select("vec_id", F.size("h").alias("n"), F.bround(weighted, 6).alias("weighted"))


def head_fit(spark, folder):
    """Fit a head per seed on its split; accuracy on the held-out rows, as one run record."""
    vectors = frozen(spread(table(spark, folder, "embeddings")))
    out = None
    for run, seed in enumerate(SEEDS):
        parts = frozen(order.train_test(vectors, "vec_id", seed))
        scored = head.fit_head(parts.filter("split = 'train'"), parts.filter("split = 'test'"), "embedding", "label")
        row = metrics.accuracy(scored, "pred", "label").select(
            F.lit("linear").alias("model_name"), F.lit(run + 1).alias("run_no"), F.lit(seed).alias("seed"), F.col("accuracy").alias("score"))
        out = row if out is None else out.unionByName(row)
    records = runs.run_records(out, 0, 20, "accuracy")
    return records.select("model_name", shown("seeds").alias("seeds"), "epochs", "metric", F.size("scores").alias("n_scores"), "mean_score")


STEPS = 5


def head_fit_seeds(spark, folder):
    """Heads of all seeds fitted in the same passes over the table; accuracy on each seed's held-out rows, as one run record."""
    parts = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    dims = _width(parts)
    names = [f"split_{seed}" for seed in SEEDS]
    for seed, name in zip(SEEDS, names):
        parts = order.train_test(parts, "vec_id", seed).withColumnRenamed("split", name)
    parts = frozen(spread(parts))
    classes, weights = head.fit_heads(parts, "embedding", "label", names, dims, STEPS)
    told = head.heads_predicted(parts, "embedding", ["label", *names], classes, weights).select(
        "label", F.posexplode(F.arrays_zip(F.array(*[F.lit(s) for s in SEEDS]).alias("seed"), F.array(*names).alias("split"), F.col("preds").alias("pred"))).alias("no", "x"))
    told = told.filter("x.split = 'test' and label is not null")
    right = (F.get(F.lit(classes), F.col("x.pred")) == F.col("label")).cast("double")
    scores = told.groupBy((F.col("no") + 1).alias("run_no"), F.col("x.seed").alias("seed")).agg(F.avg(right).alias("score"))
    records = runs.run_records(scores.withColumn("model_name", F.lit("softmax")), 0, STEPS, "accuracy")
    return records.select("model_name", shown("seeds").alias("seeds"), "epochs", "metric", F.explode("scores").alias("score"), "mean_score")


QUERIES = {
    "train_test_split": train_test_split,
    "batches": batches,
    "batches_drop_last": batches_drop_last,
    "batches_by_shard": batches_by_shard,
    "shuffle_epoch": shuffle_epoch,
    "step_counts": step_counts,
    "fold_union": fold_union,
    "prediction_join": prediction_join,
    "accuracy": accuracy,
    "micro_f1_single": micro_f1_single,
    "micro_f1_multi": micro_f1_multi,
    "class_report": class_report,
    "logloss": logloss,
    "batch_mean_loss": batch_mean_loss,
    "topk_candidates": topk_candidates,
    "topk_arrays": topk_arrays,
    "argmax_threshold": argmax_threshold,
    "head_score": head_score,
    "gather_concat": gather_concat,
    "head_fit": head_fit,
    "head_fit_seeds": head_fit_seeds,
}


def _heads_sql() -> str:
    """Full-batch steps from zero weights, one chain of tables a step."""
    seeds = ", ".join(map(str, SEEDS))
    parts = [f"""with r as materialized (select seed, vec_id, label,
            row_number() over (partition by seed order by md5(concat_ws(':', seed, vec_id)), vec_id) - 1 as k,
            count(*) over (partition by seed) as n from embeddings, (select unnest([{seeds}]) as seed)),
        cells as materialized (select vec_id, i, embedding[i]::double as x
            from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
        t as materialized (select seed, vec_id, label, count(*) over (partition by seed) as n from r where k >= ceil(0.2::double * n)),
        w0 as (select seed, c, i, 0::double as w from (select unnest([{seeds}]) as seed), (select distinct label as c from embeddings),
            (select distinct i from cells))"""]
    for k in range(1, STEPS + 1):
        parts.append(f"""z{k} as (select t.seed, vec_id, label, n, c, sum(x * w) as z
            from t join cells using (vec_id) join w{k - 1} as w on w.seed = t.seed and w.i = cells.i group by all),
        e{k} as (select *, exp(z - max(z) over (partition by seed, vec_id)) as e from z{k}),
        d{k} as (select seed, vec_id, n, c, e / sum(e) over (partition by seed, vec_id) - (c = label)::integer as d from e{k}),
        g{k} as (select seed, c, i, sum(d * x / n) as g from d{k} join cells using (vec_id) group by all),
        w{k} as materialized (select seed, c, i, w - g as w from w{k - 1} join g{k} using (seed, c, i))""")
    parts.append(f"""raw as (select r.seed, vec_id, label, c, sum(x * w) as z from r join cells using (vec_id)
            join w{STEPS} as w on w.seed = r.seed and w.i = cells.i where k < ceil(0.2::double * n) group by all),
        best as (select seed, vec_id, label, arg_max(c, z) as pred from raw group by all),
        scores as (select seed, round_even(avg((pred = label)::integer), 6) as score from best group by seed)
        select 'softmax' as model_name, '{seeds.replace(",", "")}' as seeds, cast({STEPS} as integer) as epochs, 'accuracy' as metric, score,
            round_even(avg(score) over (), 4) as mean_score from scores""")
    return ",\n        ".join(parts)


_JUDGED = """
judged as (select d.doc_id, source, lang, cast(n_chars % 3 > 0 as integer) as pred,
    cast(n_chars % 10 = 0 as integer) as pred_toxic, quality, toxic
    from documents d join labels l on d.doc_id = l.doc_id)"""
_CELLS = f"""{_JUDGED},
cells as (select source, pred as p, quality as t from judged union all select source, pred_toxic, toxic from judged)"""
_TOP = """
listed as (select vec_id, i - 1 as candidate, embedding[i]::double as score
    from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
ranked as (select *, row_number() over (partition by vec_id order by score desc, candidate) as rank from listed)
select vec_id, cast(candidate as integer) as candidate, round_even(score, 6) as score, cast(rank as integer) as rank
from ranked where rank <= 5"""
_SOFT = "list_transform(s, lambda x: exp(x - list_max(s)) / list_sum(list_transform(s, lambda y: exp(y - list_max(s)))))"


def _ce(scores: str) -> str:
    return f"ln(list_sum(list_transform({scores}, lambda x: exp(x)))) - ({scores})[t + 1]"


ORACLES = {
    "train_test_split": f"""with r as (select doc_id, source, {sql.shuffle_rank(str(SEED), 'doc_id')} as k, count(*) over () as n from documents)
        select doc_id, source, case when k < ceil(0.2::double * n) then 'test' else 'train' end as split from r""",
    "batches": f"""with r as (select doc_id, source, {sql.shuffle_rank(f'{SEED}:1', 'doc_id')} as k from documents)
        select doc_id, source, cast(1 as integer) as epoch, k // {BATCH} as batch_id, cast(k % {BATCH} as integer) as pos_in_batch from r""",
    "batches_drop_last": f"""with r as (select doc_id, source, {sql.shuffle_rank(f'{SEED}:0', 'doc_id')} as k, count(*) over () as n from documents)
        select doc_id, source, cast(0 as integer) as epoch, k // 64 as batch_id, cast(k % 64 as integer) as pos_in_batch
        from r where k < n // 64 * 64""",
    "batches_by_shard": f"""with r as (select doc_id, source, e as epoch, count(*) over (partition by e, source) as n,
            row_number() over (partition by e, source order by md5(concat_ws(':', {SEED}, e, doc_id)), doc_id) - 1 as k
            from documents, (select cast(unnest(range(0, 2)) as integer) as e)),
        s as (select epoch, source, sum(ceil(n / {BATCH}::double)) over (partition by epoch order by source) - ceil(n / {BATCH}::double) as b
            from (select distinct epoch, source, n from r))
        select doc_id, r.source, r.epoch, cast(b + k // {BATCH} as bigint) as step, k // {BATCH} as batch_id,
            cast(k % {BATCH} as integer) as pos_in_batch from r join s on r.epoch = s.epoch and r.source = s.source""",
    "shuffle_epoch": f"""select event_id, event_type, {sql.shuffle_rank(f'{SEED}:3', 'event_id')} as position,
        cast(3 as integer) as epoch from events""",
    "step_counts": """select source, count(*) as n_rows, cast(ceil(count(*) / 8::double) as bigint) as n_batches,
        cast(floor(count(*) / 8::double * 4) as bigint) as n_steps from documents group by source""",
    "fold_union": "select case when lang = 'en' then 'test' else 'train' end as split, lang, count(*) as n from documents group by all",
    "prediction_join": f"""with {_JUDGED} select lang, round_even(avg((pred = quality)::int), 6) as accuracy, count(*) as n
        from judged group by lang""",
    "accuracy": f"with {_JUDGED} select round_even(avg((pred = quality)::int), 6) as accuracy, count(*) as n from judged",
    "micro_f1_single": f"""with {_CELLS} select source, round_even(avg((p = t)::int), 6) as micro_f1, count(*) as n
        from cells group by source""",
    "micro_f1_multi": f"""with {_CELLS},
        c as (select source, sum(p * t) as tp, sum(p * (1 - t)) as fp, sum((1 - p) * t) as fn from cells group by source)
        select source, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
            case when 2 * tp + fp + fn = 0 then 0.0 else round_even(2 * tp / (2 * tp + fp + fn)::double, 6) end as micro_f1 from c""",
    "class_report": """
        with j as (select lang as t, case when n_chars % 5 = 0 then 'en' when n_chars % 7 = 0 then 'it' else lang end as p from documents),
        names as (select t as label from j union select p from j),
        c as (select label, (select count(*) from j where p = label) as predicted, (select count(*) from j where t = label) as support,
            (select count(*) from j where t = label and p = label) as hits from names),
        r as (select *, case when predicted = 0 then 0.0 else hits / predicted::double end as precision,
            case when support = 0 then 0.0 else hits / support::double end as recall from c),
        f as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from r),
        stacked as (
            select label, precision, recall, f1, support from f
            union all select 'accuracy', sum(hits) / sum(support)::double, sum(hits) / sum(support)::double, sum(hits) / sum(support)::double, sum(support) from f
            union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from f
            union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                sum(f1 * support) / sum(support), sum(support) from f)
        select label, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1,
            cast(support as bigint) as support from stacked""",
    "logloss": f"""
        with r as (select embedding::double[] as s, label as t,
            list_sum(list_transform(embedding::double[], lambda z, i: greatest(z, 0) - z * ((label + i - 1) % 3 % 2)
                + ln(1 + exp(-abs(z))))) / len(embedding) as bce from embeddings),
        p as (select *, {_SOFT} as q from r)
        select round_even(avg({_ce('s')}), 6) as cross_entropy, round_even(avg({_ce('q')}), 6) as double_softmax,
            round_even(avg(-ln(q[t + 1])), 6) as log_loss,
            round_even(avg(bce), 6) as binary_cross_entropy
        from p""",
    "batch_mean_loss": """with m as (select event_type, event_id // 32 as b, avg(value) as l from events group by all)
        select event_type, round_even(avg(l), 6) as loss, count(*) as n_batches from m group by event_type""",
    "topk_candidates": f"with {_TOP}",
    "topk_arrays": f"with {_TOP}",
    "argmax_threshold": """select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as best,
        array_to_string(list_transform(embedding, lambda x: case when x::double >= 0.1::double then 1 else 0 end), ' ') as flags from embeddings""",
    "head_score": """
        with cells as (select label, vec_id, i, embedding[i]::double as x
            from (select label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
        w as (select label, i, avg(x) as w from cells group by all),
        raw as (select c.vec_id, w.label, sum(c.x * w.w) as z from cells c join w on c.i = w.i group by all),
        shifted as (select *, exp(z - max(z) over (partition by vec_id)) as e from raw)
        select vec_id, cast(arg_max(label, e) as integer) as pred, round_even(max(e) / sum(e), 5) as top_score
        from shifted group by vec_id""",
    "gather_concat": """
        with h as (select vec_id, list_concat(embedding[(vec_id % 8) * k + 1:(vec_id % 8) * k + k],
            embedding[(vec_id * 3 % 8) * k + 1:(vec_id * 3 % 8) * k + k])::double[] as h
            from (select *, (select max(len(embedding)) // 8 from embeddings) as k from embeddings))
        select vec_id, cast(len(h) as integer) as n,
            round_even(list_sum(list_transform(h, lambda x, i: x * i)), 6) as weighted from h""",
    "head_fit_seeds": _heads_sql(),
}
