"""Model evaluation: confusion counts, ranking metrics, calibration, threshold and weight search, slices, weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.registry import query
from stepfree.running import running
from stepfree.shared import discard, stored
from stepfree.views import register, with_views


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "prediction")
    return spark.table("prediction")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, keys: list[str | Column], score: Column, threshold: Column, target: Column) -> DataFrame:
    """tp, fp, tn, fn and the metrics that follow, in one pass."""
    hit = score >= threshold
    counts = df.groupBy(*keys).agg(
        F.count_if(hit & (target == 1)).alias("tp"), F.count_if(hit & (target == 0)).alias("fp"), F.count_if(~hit & (target == 0)).alias("tn"), F.count_if(~hit & (target == 1)).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    return counts.select("*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


_CONFUSION = """select {keys}, count(*) filter (where {hit} and target = 1) as tp, count(*) filter (where {hit} and target = 0) as fp,
 count(*) filter (where not ({hit}) and target = 0) as tn, count(*) filter (where not ({hit}) and target = 1) as fn from {src} group by {keys}"""
_METRICS = """case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
 case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1"""


@query(
    "agg_confusion",
    with_views(
        f"with c as ({_CONFUSION.format(keys='task', hit='score_a >= 0.5e0', src='prediction')}), m as (select *, {_METRICS} from c) "
        "select task, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from m"
    ),
)
def agg_confusion(spark, sf_dir):
    out = confusion(predictions(spark, sf_dir), ["task"], F.col("score_a"), F.lit(0.5), F.col("target"))
    return out.select("task", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "agg_roc_auc",
    with_views("""with r as (select task, target, rank() over (partition by task order by score_a) + (count(*) over (partition by task, score_a) - 1) / 2e0 as rk from prediction)
select task, round((sum(rk) filter (where target = 1) - p * (p + 1) / 2) / (p * n), 6) as auc from (select *, sum(target) over (partition by task) as p, sum(1 - target) over (partition by task) as n from r) group by task, p, n having p * n > 0"""),
)
def agg_roc_auc(spark, sf_dir):
    """Rank-sum area with average ranks for ties. Ties are counted before ranking, so running sums go over distinct scores."""
    by_score = predictions(spark, sf_dir).groupBy("task", "score_a").agg(F.count("*").alias("n"), F.sum("target").alias("p"))
    placed = running(by_score, ["task"], [F.asc("score_a")], last=("sum", "n"))
    ranked = placed.withColumn("rank", F.col("last") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("task").agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.where("p * q > 0").select("task", F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


@query(
    "agg_avg_precision",
    with_views("""with s as (select task, score_a, count(*) as n, sum(target) as p from prediction group by task, score_a),
c as (select task, p, sum(p) over (partition by task order by score_a desc) / sum(n) over (partition by task order by score_a desc) as prec, sum(p) over (partition by task) as total from s)
select task, round(sum(p * prec / total), 6) as ap from c where total > 0 group by task"""),
)
def agg_avg_precision(spark, sf_dir):
    by_score = predictions(spark, sf_dir).groupBy("task", "score_a").agg(F.count("*").alias("n"), F.sum("target").alias("p"))
    steps = running(by_score, ["task"], [F.desc("score_a")], hits=("sum", "p"), seen=("sum", "n"))
    gain = F.col("p") * (F.col("hits") / F.col("seen")) / F.col("total_hits")
    return steps.where("total_hits > 0").groupBy("task").agg(F.round(F.sum(gain), 6).alias("ap"))


@query("agg_brier", with_views("select task, round(avg(power(score_a - target, 2)), 6) as brier from prediction group by task"))
def agg_brier(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("task").agg(F.round(F.avg(F.pow(F.col("score_a") - F.col("target"), 2)), 6).alias("brier"))


@query(
    "agg_ece",
    with_views("""with b as (select task, least(floor(score_a * 10), 9) as bin, avg(score_a) as conf, avg(target) as acc, count(*) as n from prediction group by 1, 2)
select task, round(sum(n * abs(conf - acc)) / sum(n), 6) as ece from b group by task"""),
)
def agg_ece(spark, sf_dir):
    binned = predictions(spark, sf_dir).groupBy("task", F.least(F.floor(F.col("score_a") * 10), F.lit(9)).alias("bin"))
    bins = binned.agg(F.avg("score_a").alias("conf"), F.avg("target").alias("acc"), F.count("*").alias("n"))
    return bins.groupBy("task").agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"))


_GRID = "(select unnest(range(1, 20)) * 0.05e0 as threshold)"


@query(
    "agg_threshold_search",
    with_views(
        f"with x as (select p.*, t.threshold from prediction p, {_GRID} t), c as ({_CONFUSION.format(keys='task, threshold', hit='score_a >= threshold', src='x')}), m as (select *, {_METRICS} from c) "
        "select task, round(threshold, 4) as threshold, round(f1, 6) as f1 from m qualify row_number() over (partition by task order by round(f1, 9) desc, round(recall, 9) desc, threshold) = 1"
    ),
)
def agg_threshold_search(spark, sf_dir):
    """Best F1 over 19 thresholds; ties go to the higher recall, then to the lower threshold.

    Every row is counted once, in the grid step its score reaches; running sums give the rest.
    """
    step = F.least(F.lit(19), F.floor(F.col("score_a") / 0.05 + 1e-9)).cast("int")
    exact = F.size(F.filter(F.sequence(F.lit(1), F.lit(19)), lambda k: F.col("score_a") >= k * 0.05))
    binned = predictions(spark, sf_dir).withColumn("step", F.when(step >= 0, exact)).groupBy("task", "step").agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    grid = binned.select("task").distinct().crossJoin(F.broadcast(spark.range(1, 20).select(F.col("id").cast("int").alias("k"))))
    sums = grid.join(binned, "task").groupBy("task", "k").agg(
        F.sum(F.when(F.col("step") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("step") >= F.col("k"), F.col("n") - F.col("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("step") < F.col("k"), F.col("p")).otherwise(0)).alias("fn"),
    )
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    ranked = sums.withColumn("f1", f1).withColumn("rn", F.row_number().over(W.partitionBy("task").orderBy(F.desc(F.round("f1", 9)), F.desc(F.round(recall, 9)), "k")))
    return ranked.where("rn = 1").select("task", F.round(F.col("k") * 0.05, 4).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(
    "agg_ensemble_search",
    with_views(
        f"with x as (select p.task, p.target, w.w, t.threshold, p.score_a * w.w + p.score_b * (1 - w.w) as s from prediction p, (select unnest(range(0, 5)) * 0.25e0 as w) w, (select unnest(range(1, 10)) * 0.1e0 as threshold) t), "
        f"c as ({_CONFUSION.format(keys='task, w, threshold', hit='s >= threshold', src='x')}), m as (select *, {_METRICS} from c) "
        "select task, round(w, 3) as w, round(threshold, 3) as threshold, round(f1, 6) as f1 from m qualify row_number() over (partition by task order by round(f1, 9) desc, w, threshold) = 1"
    ),
)
def agg_ensemble_search(spark, sf_dir):
    """Best weight of two scores and threshold by F1: 45 settings.

    A row is counted once a weight, in the step its weighted score reaches; sums over steps give the thresholds.
    """
    weighted = predictions(spark, sf_dir).select("task", "target", "score_a", "score_b", F.explode(F.array(*[F.lit(k * 0.25) for k in range(5)])).alias("w"))
    score = F.col("score_a") * F.col("w") + F.col("score_b") * (1 - F.col("w"))
    reached = sum(((score >= F.lit(k) * 0.1).cast("int") for k in range(1, 10)), F.lit(0))
    binned = weighted.groupBy("task", "w", reached.alias("step")).agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    # a task and weight have ten steps at most
    at = binned.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9))))
    over = F.col("step") >= F.col("k")
    sums = at.groupBy("task", "w", "k").agg(*[F.sum(F.when(c, v).otherwise(0)).alias(name) for name, c, v in (("tp", over, F.col("p")), ("fp", over, F.col("n") - F.col("p")), ("fn", ~over, F.col("p")))])
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    best = sums.withColumn("f1", f1).withColumn("rn", F.row_number().over(W.partitionBy("task").orderBy(F.desc(F.round("f1", 9)), "w", "k")))
    return best.where("rn = 1").select("task", F.round("w", 3).alias("w"), F.round(F.col("k") * 0.1, 3).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(
    "agg_slice_metrics",
    with_views(
        f"with c as ({_CONFUSION.format(keys='city, task', hit='score_a >= 0.5e0', src='prediction')}), m as (select *, {_METRICS} from c) "
        "select city, sum(tp + fp + tn + fn)::bigint as n, round(avg(f1), 6) as macro_f1, avg(f1) < 0.1e0 as weak from m group by city having sum(tp + fp + tn + fn) >= 20"
    ),
)
def agg_slice_metrics(spark, sf_dir):
    """Mean F1 over tasks by city, for cities with at least twenty rows."""
    by_task = confusion(predictions(spark, sf_dir), ["city", "task"], F.col("score_a"), F.lit(0.5), F.col("target"))
    n = F.sum(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return by_task.groupBy("city").agg(n.alias("n"), F.round(F.avg("f1"), 6).alias("macro_f1"), (F.avg("f1") < 0.1).alias("weak")).where("n >= 20")


def class_weights(rows: DataFrame) -> DataFrame:
    """task, total, positives, pos_weight, loss_weight from rows with task and target.

    A positive row counts as a negative of every other task (weakly), so a task's total is its negatives and all positives. Weights:
    negatives by positives, and mean total by total, each count at least 1.
    """
    positive = F.col("target") >= 0.5
    by_task = rows.groupBy("task").agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("own"))
    both = by_task.crossJoin(F.broadcast(by_task.agg(F.sum("positives").alias("everywhere"), F.count("*").alias("tasks"))))  # one row
    both = both.withColumn("total", F.col("own") + F.col("everywhere"))
    mass = F.broadcast(both.agg(F.sum(F.greatest(F.lit(1), F.col("total"))).alias("mass")))
    weight = F.greatest(F.lit(1), F.col("total") - F.col("positives")) / F.greatest(F.lit(1), F.col("positives"))
    return both.crossJoin(mass).select("task", "total", "positives", weight.alias("pos_weight"), (F.col("mass") / (F.col("tasks") * F.greatest(F.lit(1), F.col("total")))).alias("loss_weight"))


@query("agg_class_weights", with_views("""with t as (select task, count(*) filter (where target >= 0.5) as p, count(*) filter (where target < 0.5) as q from prediction group by task),
u as (select task, p, q + (select sum(p) from t) as total, (select count(*) from t) as k from t)
select task, total::bigint as total, p as positives, round(greatest(1, total - p) / greatest(1, p), 6) as pos_weight, round((select sum(greatest(1, total)) from u) / (k * greatest(1, total)), 6) as loss_weight from u"""))
def agg_class_weights(spark, sf_dir):
    out = class_weights(predictions(spark, sf_dir))
    return out.select("task", "total", "positives", F.round("pos_weight", 6).alias("pos_weight"), F.round("loss_weight", 6).alias("loss_weight"))


def greedy_matches(found: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """id, truth_id: detections take, by falling score (ties: smaller id), the nearest free truth of their image within ``radius`` (ties: smaller truth_id).

    ``found``: image, id, score, x; ``truth``: image, truth_id, tx. Pairs meet by cells of an image. A round settles every
    detection that, among the open ones, comes first for the truth it is nearest to: nothing before it can take that truth,
    and nothing nearer is free. So rounds are as many as the longest chain of detections that wait for each other.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    spread = found.withColumn("cell", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)))
    pairs = spread.join(truth.withColumn("cell", cell("tx")), ["image", "cell"]).withColumn("gap", F.abs(F.col("x") - F.col("tx"))).where(F.col("gap") <= radius)
    open_ = stored(pairs.select("id", "score", "truth_id", "gap"), "pairs")
    out = stored(open_.where("false").select("id", "truth_id"), "matches")
    while not open_.isEmpty():
        nearest = open_.groupBy("id").agg(F.min(F.struct("gap", "truth_id")).alias("m")).select("id", "m.truth_id")
        first = open_.groupBy("truth_id").agg(F.min(F.struct((-F.col("score")).alias("down"), "id")).alias("m")).select("truth_id", "m.id")
        settled = stored(nearest.join(first, ["id", "truth_id"]), "matches")
        rest = open_.join(settled.select("id"), "id", "left_anti").join(settled.select("truth_id"), "truth_id", "left_anti").select("id", "score", "truth_id", "gap")
        out = out.unionByName(settled)
        before, open_ = open_, stored(rest, "pairs")
        discard(before)
    return out


#: Documents in a row that stand for one image.
PER_IMAGE = 40


@query("join_detection_greedy")
def join_detection_greedy(spark, sf_dir):
    """Score-descending one-to-one matches within a radius, image by image of a city; every detection with whether it has a match."""
    df = predictions(spark, sf_dir).select("city", "id", F.struct("city", F.floor(F.col("id") / PER_IMAGE).alias("n")).alias("image"), F.round("score_a", 6).alias("score"), ((F.col("id") * 13) % 100).cast("double").alias("x"), "target")
    truth = df.where("target = 1").select("image", F.col("id").alias("truth_id"), F.col("x").alias("tx"))
    matches = greedy_matches(df.select("image", "id", "score", "x"), truth, 5.0)
    return df.select("city", "id").join(matches, "id", "left").select("city", "id", F.col("truth_id").isNotNull().alias("matched"))


@query("agg_detection_ap")
def agg_detection_ap(spark, sf_dir):
    """Area under the precision envelope of the greedy matches, by city."""
    matched = join_detection_greedy(spark, sf_dir).join(predictions(spark, sf_dir).select("id", "score_a", "target"), "id")
    down = W.partitionBy("city").orderBy(F.desc("score_a"), "id")
    c = matched.withColumn("tp", F.sum(F.col("matched").cast("int")).over(down.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.row_number().over(down))
    c = c.withColumn("envelope", F.max(F.col("tp") / F.col("n")).over(down.rowsBetween(0, W.unboundedFollowing)))
    return c.groupBy("city").agg(F.round(F.sum(F.when(F.col("matched"), F.col("envelope")).otherwise(0.0)) / F.greatest(F.sum("target"), F.lit(1)), 6).alias("ap"))


@query("agg_temperature_fit")
def agg_temperature_fit(spark, sf_dir):
    """Temperature that minimises the log loss by task: partial sums over a grid of 60 temperatures, no row leaves its task."""

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = np.linspace(0.1, 6.0, 60)
        for b in batches:
            p = np.clip(b["score_a"].to_numpy(), 1e-6, 1 - 1e-6)
            z = np.log(p / (1 - p))[:, None] / grid[None, :]
            y = b["target"].to_numpy()[:, None]
            loss = np.logaddexp(0, z) - y * z
            for task, rows in b.groupby("task").indices.items():
                yield pd.DataFrame({"task": task, "temperature": grid, "loss": loss[rows].sum(0)})

    sums = predictions(spark, sf_dir).select("task", "score_a", "target").mapInPandas(losses, "task string, temperature double, loss double")
    total = sums.groupBy("task", "temperature").agg(F.sum("loss").alias("loss"))
    return total.groupBy("task").agg(F.round(F.min_by("temperature", F.struct("loss", "temperature")), 4).alias("temperature"))
