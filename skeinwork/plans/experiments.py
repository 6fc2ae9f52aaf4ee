"""Queries over loss logs and experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import order, runs
from skeinwork.plans.tables import table
from skeinwork.session import frozen

SEEDS = [42, 43, 44, 45, 46]

# Corpus size and steps of the ten models, and the corrected names of rows 4 to 6.
CORPUS_SIZES = ["20GB", "4GB", "4GB", "4GB", "8GB", "8GB", "8GB", "12GB", "12GB", "12GB"]
PRETRAINING_STEPS = [1000000, 3500, 67000, 130000, 7063, 63500, 162449, 10500, 42000, 63500]
NAMES_8GB = ["model-trained-0-7063-8GB", "model-trained-8-63567-8GB", "model-trained-22-162449-8GB"]


def unordered_losses(spark, folder) -> DataFrame:
    """Events as loss logs: type = run, day = epoch, value = loss."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("run"),
        F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        F.col("value").alias("loss"),
    )


def losses(spark, folder) -> DataFrame:
    """The same in time order, with each loss's ordinal in its run."""
    return order.ordinal_within(unordered_losses(spark, folder), ["run"], ["at", "event_id"], "seq")


def loss_blocks(spark, folder):
    return runs.loss_blocks(losses(spark, folder))


def epoch_mean(spark, folder):
    return runs.epoch_means(unordered_losses(spark, folder))


def cum_steps(spark, folder):
    return runs.cumulative_steps(unordered_losses(spark, folder))


def sampled_steps(spark, folder):
    """Steps counted from 1 in each epoch; each k-th is kept."""
    numbered = order.ordinal_within(losses(spark, folder), ["run", "epoch"], ["seq"], "_in_epoch")
    stepped = frozen(numbered.withColumn("step", F.col("_in_epoch") + 1).drop("_in_epoch"))
    return runs.sampled_steps(stepped).select("run", "epoch", "step", "loss")


def step_axis(spark, folder):
    return runs.step_axis(losses(spark, folder)).select("run", "seq", "step", "loss")


def run_grid(spark, folder):
    sources = table(spark, folder, "documents").select("source").distinct()
    path = F.when(F.col("source") == "src0", runs.BASE_MODEL).otherwise(
        F.concat(F.lit("/models/"), "source", F.lit("-checkpoints/run_"), "source", F.lit(".v1"),
                 F.when(F.col("source") == "src1", "").otherwise("/")))
    return runs.run_grid(sources.select(path.alias("model_path")), SEEDS)


def _records(spark, folder) -> DataFrame:
    """Run records per task and model from the events of all types."""
    events = table(spark, folder, "events")
    model = F.concat(F.lit("model-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"))
    task = F.col("event_type").alias("task")
    scores = events.groupBy(task, model.alias("model_name"), (F.col("event_id") % 5).cast("int").alias("k")).agg(
        F.avg(F.col("value") / 500).alias("score"))
    seeded = scores.select("task", "model_name", (F.col("k") + 1).alias("run_no"), (F.col("k") + 42).alias("seed"), "score")
    return runs.run_records(seeded, 8, 4, "f1-score (micro)", by=["task"])


def run_stats(spark, folder):
    return _records(spark, folder).select(
        "task", "model_name", F.array_join(F.transform("seeds", lambda s: s.cast("string")), " ").alias("seeds"), "batch_size",
        "epochs", "metric", F.size("scores").alias("n_scores"), F.bround(F.array_max("scores"), 6).alias("best"), "mean_score")


def results_table(spark, folder):
    """Results of all tasks stacked; the first ten rows of one get sizes, steps and fixed names."""
    stacked = frozen(stacked_results(spark, folder))
    rows = order.ordinal_within(stacked, ["task"], ["model_name"], "row_idx")
    ten = order.row_slice(rows.filter("task = 'click'"), "row_idx", 0, 9)
    dims = spark.createDataFrame(
        [(i, c, s) for i, (c, s) in enumerate(zip(CORPUS_SIZES, PRETRAINING_STEPS))],
        "row_idx bigint, corpus_size string, pretraining_steps int")
    names = spark.createDataFrame([(4 + i, n) for i, n in enumerate(NAMES_8GB)], "row_idx bigint, model_name string")
    wide = runs.with_overrides(runs.with_columns_by_row(ten, dims), names, "row_idx", "model_name")
    return runs.best_first(wide).select("model_name", "metric", "score", "corpus_size", "pretraining_steps")


def stacked_results(spark, folder):
    return runs.stacked_results(_records(spark, folder))


QUERIES = {
    "loss_blocks": loss_blocks,
    "epoch_mean": epoch_mean,
    "cum_steps": cum_steps,
    "sampled_steps": sampled_steps,
    "step_axis": step_axis,
    "run_grid": run_grid,
    "run_stats": run_stats,
    "results_table": results_table,
    "stacked_results": stacked_results,
}

LOSSES = """
losses as (select event_type as run, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as epoch, value as loss,
    row_number() over (partition by event_type order by ts, event_id) - 1 as seq from events)"""


_RECORDS = """(select event_type as task, 'model-' || lpad(cast(user_id % 12 as varchar), 2, '0') as model_name, event_id % 5 as k,
        round_even(avg(value / 500), 6) as score from events group by all)"""


_STACKED = f"""
stacked as (
    select task, model_name, round_even(avg(score), 4) as score from {_RECORDS} group by all)"""

ORACLES = {
    "loss_blocks": f"""with {LOSSES} select run, seq // 10 as block, round_even(avg(loss), 3) as mean_loss
        from losses group by all having count(*) = 10""",
    "epoch_mean": f"""with {LOSSES} select run, epoch, round_even(avg(loss), 3) as mean_loss, count(*) as n_losses
        from losses group by all""",
    "cum_steps": f"""with {LOSSES}, e as (select run, epoch, count(*) as steps from losses group by all)
        select run, epoch, steps, cast(sum(steps) over (partition by run order by epoch) as bigint) as overall_steps from e""",
    "sampled_steps": f"""with {LOSSES},
        n as (select *, row_number() over (partition by run, epoch order by seq) as step from losses),
        t as (select *, max(step) over (partition by run, epoch) as steps from n)
        select run, epoch, step, loss from t where step % greatest(steps // 10, 1) = 0""",
    "step_axis": f"with {LOSSES} select run, seq, seq * 350 as step, loss from losses",
    "run_grid": """
        with s as (select distinct source from documents),
        m as (select case when source = 'src0' then 'bert-base-uncased' else '/models/' || source || '-checkpoints/run_' || source
            || '.v1' || case when source = 'src1' then '' else '/' end end as model_path,
            case when source = 'src0' then 'bert-base-uncased' else 'run_' || source end as model_name,
            case when source = 'src0' then 'bert-base-uncased' else 'corpus' end as tokenizer from s)
        select *, cast(41 + run_no as integer) as seed from m, (select unnest([1, 2, 3, 4, 5])::integer as run_no)""",
    "run_stats": f"""select task, model_name, string_agg(cast(k + 42 as varchar), ' ' order by k) as seeds, cast(8 as integer) as batch_size,
        cast(4 as integer) as epochs, 'f1-score (micro)' as metric, cast(count(*) as integer) as n_scores, max(score) as best,
        round_even(avg(score), 4) as mean_score from {_RECORDS} group by task, model_name""",
    "results_table": f"""with {_STACKED},
        r as (select *, row_number() over (partition by task order by model_name) as i from stacked),
        dims as (select unnest(range(1, 11)) as i, unnest({CORPUS_SIZES}) as corpus_size,
            unnest({PRETRAINING_STEPS}) as pretraining_steps)
        select case when i between 5 and 7 then ({NAMES_8GB})[i - 4] else model_name end as model_name, 'f1-score (micro)' as metric,
            score, corpus_size, pretraining_steps from r join dims using (i) where task = 'click'""",
    "stacked_results": f"with {_STACKED} select task, model_name, 'f1-score (micro)' as metric, score from stacked",
}
