"""Repair and prove it: score, split, model, repair on train, model again, decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on, materialize
from tablefit.functions.lookups import CLASSIFICATION, CLUSTERING, TIME_SERIES, ImbalancePolicy, canonical_task
from tablefit.functions.stats import missing
from tablefit.operators.audit import immutability, split_receipt
from tablefit.operators.columns import identifier_columns
from tablefit.operators.compare import combined_fitness, gain_comparison, with_change, with_decision
from tablefit.operators.dimensions import duplicate_timestamps
from tablefit.operators.models import observed_metric
from tablefit.operators.remediate import Fitted, action_log, repair_split, sort_timestamps
from tablefit.operators.select import with_tile
from tablefit.operators.splits import MIN_ROWS, random_split, stratified_split
from tablefit.plans.evaluate import Evaluation, evaluate
from tablefit.sources.writers import cleansed

SEQUENCE = "__sequence"
METRIC_NAMES = {CLASSIFICATION: "F1", CLUSTERING: "Silhouette Score"}


@dataclass
class ClosedLoop:
    before: Evaluation
    after: Evaluation
    result: DataFrame
    log: list[Fitted]
    train: DataFrame
    test: DataFrame
    receipt: DataFrame
    unchanged_test: DataFrame

    def action_log(self) -> DataFrame:
        return action_log(self.result.sparkSession, self.log)

    def cleansed(self) -> DataFrame:
        return cleansed(self.train, self.test).drop("part", SEQUENCE)


def split_for(df: DataFrame, task: str, key: str, target: str | None, train_share: float = 0.7,
              seed: int = 42) -> DataFrame:
    """The task's split: arrival order for series, by class for classes, else random."""
    if task == TIME_SERIES:
        tiled = with_tile(df, [key], [lambda n: F.floor(n * F.lit(train_share))], name="__tile")
        return tiled.withColumn("part", F.when(F.col("__tile") == 0, "train").otherwise("test")).drop("__tile")
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        return df.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("test"))))
    share = 1 - train_share
    if task == CLASSIFICATION:
        return stratified_split(df, key, target, share, seed)
    return random_split(df, key, share, seed)


def remediate_and_validate(df: DataFrame, task: str, target: str | None, row_order: str, time: str | None = None,
                           actions: Sequence[str] | None = None, train_share: float = 0.7, seed: int = 42,
                           policy: ImbalancePolicy = ImbalancePolicy(), anomaly: str = "contamination",
                           without: Sequence[str] = (), before: Evaluation | None = None) -> ClosedLoop:
    """Before and after a repair, judged on test rows that the repair never touched.

    ``row_order`` is a unique integer key: arrival order and identity of a row.
    Without ``actions`` the three most useful ones are taken. ``before`` takes
    an evaluation of the same table that is already there.
    """
    task = canonical_task(task)
    hidden = [*without, "part", row_order]
    options = dict(policy=policy, anomaly=anomaly, without=hidden, row_order=row_order)
    before = before or evaluate(df, task, target, time, **options)
    target = before.roles.target
    ranked = before.actions().filter("rank <= 3").collect()
    predicted = {r["action"]: r["gain"] for r in ranked}
    actions = list(predicted) if actions is None else list(actions)

    labelled = df.filter(~missing(df, target)) if target in df.columns else df
    # Both parts are read by every later step, so they are written once.
    parts = materialize(split_for(labelled, task, row_order, target, train_share, seed), "split")
    raw_train, raw_test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    metric_before = observed_metric(parts, task, target, time, row_order, hidden)

    train, test, log = repair_split(raw_train, raw_test, actions, task, target, time, row_order,
                                    written=True)
    train, test = in_sequence(train, test, row_order, time if log[0].executed else None)
    train, test = materialize(train, "train"), materialize(test, "test")
    both = cleansed(train, test)
    hidden.append(SEQUENCE)
    metric_after = observed_metric(both, task, target, time, SEQUENCE, hidden)

    # Train, test and the whole are three segments of one evaluation.
    options.update(without=[c for c in hidden if c != "part"], row_order=SEQUENCE)
    marked = both.withColumn("part", F.explode(F.array(F.col("part"), F.lit("all"))))
    keys = identifier_columns(both, [c for c in both.columns if c not in hidden])
    scored = evaluate(marked, task, target, time, by=["part"], observed=metric_after, identifiers=keys, **options)
    after = replace(scored, rows=scored.rows.filter("part = 'all'").drop("part"), keys=["task"])
    by_part = {r["part"]: r for r in scored.rows.select("part", "n", "fitness", "tier").collect()}
    start = before.rows.select("fitness", "tier", "n").first()

    spark = df.sparkSession
    sizes = {p: by_part[p] for p in ("train", "test", "all")}
    run = spark.createDataFrame([(
        task, METRIC_NAMES.get(task, "RMSE"), start["fitness"], metric_before, metric_after,
        float(sum(predicted.get(a, 0.0) for a in actions)),
        sizes["train"]["n"], sizes["test"]["n"], sizes["train"]["fitness"], sizes["test"]["fitness"],
        sizes["all"]["fitness"], sizes["train"]["tier"], sizes["test"]["tier"], sizes["all"]["tier"],
    )], "task string, metric_name string, fitness_before double, metric_before double, metric_after double, "
        "predicted_gain double, train_rows long, test_rows long, train_fitness double, test_fitness double, "
        "full_fitness double, train_tier string, test_tier string, full_tier string")
    result = gain_comparison(with_decision(with_change(combined_fitness(run))))
    if time:
        for name, table in (("before", df), ("after", both)):
            stamps = duplicate_timestamps(table, time).select(
                F.col("duplicate_timestamps").alias(f"duplicate_timestamps_{name}"),
                F.col("duplicate_groups").alias(f"duplicate_groups_{name}"),
                F.col("duplicate_rate").alias(f"duplicate_rate_{name}"))
            result = result.crossJoin(stamps)
    features = [c for c in before.roles.numeric if c != target]
    by_rows = {p: parts.filter(F.col("part") == p).count() for p in ("train", "test")}
    result_row = result.first()
    # Too few rows to split: they are all in both parts.
    few = task != TIME_SERIES and by_rows["train"] == by_rows["test"] < MIN_ROWS
    kind = "all rows in both parts" if few else {TIME_SERIES: "arrival order", CLASSIFICATION: "by class"}.get(task, "random")
    metrics = {k: result_row[k] for k in ("fitness_before", "fitness_after", "metric_before", "metric_after")}
    parameters = {"task": task, "split": kind, "train_share": train_share, "seed": seed, "row_order": row_order,
                  "time": time, "actions": ",".join(actions), "anomaly": anomaly}
    audit = split_receipt(parts, row_order, features, target, parameters, [f.action for f in log if f.executed], metrics)
    return ClosedLoop(before, after, result, log, train, test, audit, immutability(raw_test, test, row_order))


def in_sequence(train: DataFrame, test: DataFrame, row_order: str,
                sorted_by: str | None) -> tuple[DataFrame, DataFrame]:
    """Add the arrival key after a repair: sorted training rows first, then the test rows as they came."""
    if sorted_by is None:
        return tuple(d.withColumn(SEQUENCE, F.col(row_order).cast("long")) for d in (train, test))
    train = train.withColumn(SEQUENCE, F.unix_micros(F.col(sorted_by).cast("timestamp")))
    last = train.agg(F.max(SEQUENCE)).first()[0] or 0
    first = test.agg(F.min(F.col(row_order).cast("long"))).first()[0] or 0
    return train, test.withColumn(SEQUENCE, F.col(row_order).cast("long") - first + last + 1)


SWEEP = "__share"


def sweep_split(df: DataFrame, shares: Sequence[float], row_order: str) -> DataFrame:
    """Every row once for each share, in its train or test part; the shares' cuts are found together."""
    cuts = [lambda n, s=s: F.floor(n * F.lit(s)) for s in shares]
    tiled = with_tile(df, [row_order], cuts, name="__tile")
    each = tiled.withColumn(SWEEP, F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))
    return each.withColumn("part", F.when(F.col("__tile") <= F.col(SWEEP), "train").otherwise("test")).drop("__tile")


def fraction_sweep(df: DataFrame, target: str, time: str, row_order: str,
                   shares: Sequence[float] = (0.50, 0.60, 0.70, 0.80, 0.85), without: Sequence[str] = (),
                   anomaly: str = "contamination") -> DataFrame:
    """Sort repair of a series under several train shares: predicted against observed gain.

    The shares are segments: one split, one repair and one evaluation serve them all. Only the reference models are
    trained share by share.
    """
    shares, spark = sorted(shares), df.sparkSession
    hidden = [*without, "part", row_order]
    before = evaluate(df, TIME_SERIES, target, time, row_order=row_order, without=hidden, anomaly=anomaly)
    start = before.rows.select("fitness").first()["fitness"]
    parts = materialize(sweep_split(df.filter(~missing(df, target)), shares, row_order), "sweep", [SWEEP])
    parsed = Fitted("sort_timestamps", time=time)
    train = sort_timestamps(parts.filter("part = 'train'"), time, row_order, [SWEEP])
    test = parsed.apply(parts.filter("part = 'test'"))
    arrival = F.unix_micros(F.col(time).cast("timestamp"))
    train = train.withColumn(SEQUENCE, arrival)
    # Sorted training rows first, then the test rows as they came, in each share.
    place = F.col(row_order).cast("long")
    moved = join_on(test.groupBy(SWEEP).agg(F.min(place).alias("__first")),
                    parsed.apply(parts.filter("part = 'train'")).groupBy(SWEEP).agg(F.max(arrival).alias("__last")), [SWEEP])
    test = join_on(test, moved, [SWEEP], small=True).withColumn(
        SEQUENCE, place - F.col("__first") + F.coalesce("__last", F.lit(0)) + 1).drop("__first", "__last")
    both = materialize(cleansed(train, test), "sweep-repaired", [SWEEP])

    marked = both.withColumn("part", F.explode(F.array(F.col("part"), F.lit("all"))))
    unused = [*(c for c in hidden if c != "part"), SEQUENCE]
    keys = identifier_columns(both.filter(F.col(SWEEP) == 0), [c for c in both.columns if c not in (*hidden, SEQUENCE, SWEEP)])
    scored = evaluate(marked, TIME_SERIES, target, time, SEQUENCE, [SWEEP, "part"], identifiers=keys, without=unused,
                      anomaly=anomaly)
    found = {(r[SWEEP], r["part"]): r for r in scored.rows.select(SWEEP, "part", "n", "fitness", "tier").collect()}
    gains = [before.actions(train_share=share).filter("action = 'sort_timestamps'").select(F.lit(i).alias("i"), "gain")
             for i, share in enumerate(shares)]
    gain = {r["i"]: r["gain"] for r in reduce(DataFrame.unionByName, gains).collect()}
    rows = []
    for i, share in enumerate(shares):
        one = F.col(SWEEP) == i
        metrics = [observed_metric(d.filter(one).drop(SWEEP), TIME_SERIES, target, time, key, [*hidden, SEQUENCE])
                   for d, key in ((parts, row_order), (both, SEQUENCE))]
        a, b, whole = (found[i, part] for part in ("train", "test", "all"))
        rows.append((share, a["n"], b["n"], a["fitness"], b["fitness"], whole["fitness"], a["tier"], b["tier"], whole["tier"],
                     start, float(gain.get(i, 0.0)), *metrics))
    table = combined_fitness(spark.createDataFrame(rows, (
        "train_share double, train_rows long, test_rows long, train_fitness double, test_fitness double, full_fitness double, "
        "train_tier string, test_tier string, full_tier string, fitness_before double, predicted_gain double, "
        "metric_before double, metric_after double")))
    improved = F.col("metric_after") < F.col("metric_before")
    decision = (
        F.when(F.col("train_tier") == "RED", "BLOCKED")
        .when(F.col("test_tier") == "RED", F.when(improved, "REVIEW_REQUIRED").otherwise("BLOCKED"))
        .when(improved, "ACCEPTED").otherwise("NO_IMPROVEMENT")
    )
    compared = gain_comparison(table.withColumn("fitness_gain", F.round(F.col("partition_fitness") - F.col("fitness_before"), 1)))
    return compared.select(
        "train_share", "train_rows", "test_rows", "train_fitness", "test_fitness", F.col("partition_fitness").alias("fitness_after"),
        "predicted_gain", "fitness_gain", "metric_before", "metric_after", "train_tier", "test_tier", "gain_gap",
        "within_10_points", decision.alias("decision"))
