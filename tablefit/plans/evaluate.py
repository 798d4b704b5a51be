"""One evaluation: metrics, scores, weights, policy, calibration, actions, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on, materialize
from tablefit.functions.lookups import CLASSIFICATION, CLUSTERING, CODES, TIME_SERIES, ImbalancePolicy, canonical_task
from tablefit.operators.actions import counterfactuals, ranked_actions, scenarios
from tablefit.operators.anomaly import forest_anomaly
from tablefit.operators.audit import content_hash
from tablefit.operators.columns import Roles, column_roles, numeric_columns, normalize_missing
from tablefit.operators.dimensions import quality_metrics, score_dimensions
from tablefit.operators.discover import infer_task
from tablefit.operators.order import with_chunk, with_file_order
from tablefit.operators.scoring import (
    defects_long,
    factor_attribution,
    raw_fitness,
    recommendations,
    status_tier,
    weights_long,
    with_adaptive_weights,
    with_calibration,
    with_defects,
    with_interval,
    with_tier,
)
from tablefit.sources.readers import require_rows

SYNTHETIC_ORDER = "__row_order"


@dataclass
class Evaluation:
    """The scored rows (one per segment and task) and the tables derived from them."""

    rows: DataFrame
    keys: list[str]
    roles: Roles
    policy: ImbalancePolicy

    def scores(self) -> DataFrame:
        return weights_long(self.rows, self.keys)

    def defects(self) -> DataFrame:
        return defects_long(self.rows, self.keys)

    def attribution(self) -> DataFrame:
        return factor_attribution(self.rows, self.keys, "final_fitness")

    def recommendations(self, compat: bool = True) -> DataFrame:
        return recommendations(self.rows, self.keys, compat)

    def actions(self, compat: bool = True, **options) -> DataFrame:
        return ranked_actions(self.rows, self.keys, "final_fitness", compat=compat, **options)

    def scenarios(self) -> DataFrame:
        return scenarios(self.actions(), self.keys)

    def counterfactuals(self) -> DataFrame:
        return counterfactuals(self.actions(), self.keys)

    def fitness(self) -> DataFrame:
        return self.rows.select(
            *self.keys, "n", "raw_fitness", "tier", "cap", "fitness", "final_fitness", "status", "interval_low",
            "interval_high")

    def report(self, df: DataFrame | None = None, run_id: str | None = None) -> dict[str, DataFrame]:
        """Long tables keyed by segment and task, ready for ``write_report``.

        ``df`` (the table that was evaluated) and ``run_id`` add the receipt.
        """
        tables = {
            "fitness": self.fitness(), "scores": self.scores(), "defects": self.defects(),
            "attribution": self.attribution(), "recommendations": self.recommendations(), "actions": self.actions(),
            "scenarios": self.scenarios(), "counterfactuals": self.counterfactuals(),
            "metrics": self.rows.drop("defects"),
        }
        if df is not None and run_id is not None:
            # The folder names the run.
            tables["receipt"] = receipt(self, df, run_id).drop("run_id")
        return tables


def ordered(df: DataFrame, row_order: str | None) -> tuple[DataFrame, str, list[str]]:
    """The table with an arrival key; files provide one, other sources must name it."""
    if row_order is not None:
        return df, row_order, []
    if not df.inputFiles():
        raise ValueError("row_order is required: the table does not come from files")
    return with_file_order(df, SYNTHETIC_ORDER), SYNTHETIC_ORDER, [SYNTHETIC_ORDER]


def score_rows(df: DataFrame, roles: Roles, tasks: Sequence[str], row_order: str, by: Sequence[str] = (),
               policy: ImbalancePolicy = ImbalancePolicy(), anomaly: str = "contamination", compat: bool = True) -> DataFrame:
    """Metrics, eight scores, weights, raw fitness and policy per segment and task.

    ``anomaly``: ``contamination`` and ``threshold`` grow an isolation forest in
    each segment and count the rows beyond the segment's own score quantile, or
    above a fixed score; ``extreme_ratio`` is the share above that score in both.
    ``pinned`` reads no cell and takes the share that the contamination implies.
    """
    metrics = quality_metrics(df, roles, row_order, by, tasks)
    if anomaly != "pinned" and roles.measures:
        found = forest_anomaly(df, roles.measures, by, anomaly, keys=[row_order]).select(
            *by, F.col("anomaly_ratio").alias("__share"), "extreme_ratio")
        metrics = materialize(join_on(metrics, found, by).withColumn(
            "anomaly_ratio", F.when(F.col("n") < 15, 0.0).otherwise(F.col("__share"))).drop("__share"), "metrics")
    scored = with_adaptive_weights(score_dimensions(metrics, tasks, policy), compat)
    scored = scored.withColumn("raw_fitness", raw_fitness())
    # Scored rows are few and every later table starts from them.
    return materialize(with_tier(with_defects(scored, policy)), "scores")


def evaluate(df: DataFrame, tasks: str | Sequence[str], target: str | None = None, time: str | None = None,
             row_order: str | None = None, by: Sequence[str] = (), observed: float | None = None,
             policy: ImbalancePolicy = ImbalancePolicy(), anomaly: str = "contamination", compat: bool = True,
             confidence: float = 1.0, without: Sequence[str] = (), clean: bool = True,
             identifiers: Sequence[str] | None = None) -> Evaluation:
    """Fitness of a table, or of each of its segments, for one or several tasks.

    ``observed`` is the metric a reference model reached; given, it calibrates
    the weights of every row that no hard defect rules out. ``identifiers``
    names the key columns, where they should not be found by their values.
    """
    tasks = [canonical_task(t) for t in ([tasks] if isinstance(tasks, str) else tasks)]
    df, order, hidden = ordered(df, row_order)
    if clean:
        df = normalize_missing(df)
    if target is None and TIME_SERIES in tasks:
        numbers = numeric_columns(df, [*by, *hidden, *without, *([time] if time else [])])
        target = numbers[0] if numbers else None
    roles = column_roles(df, target, time, by, [*hidden, *without], identifiers, sniff=False)
    rows = score_rows(df, roles, tasks, order, by, policy, anomaly, compat)
    spread = F.when(F.col("task").isin(CLASSIFICATION, CLUSTERING), 1.0).when(
        F.col("target_std") > 0, F.col("target_std")).otherwise(10.0)
    rows = rows.withColumns({"observed": F.lit(observed).cast("double"), "target_spread": spread})
    rows = with_calibration(rows)
    rows = rows.withColumn("final_fitness", F.when(F.col("observed").isNotNull(), F.col("calibrated_fitness"))
                           .otherwise(F.col("fitness")))
    rows = rows.withColumn("status", status_tier(F.col("tier"), F.col("final_fitness")))
    rows = with_interval(rows, "final_fitness", F.lit(float(confidence)), F.col("residual_before"))
    return Evaluation(materialize(rows, "evaluation"), [*by, "task"], roles, policy)


def infer_and_evaluate(df: DataFrame, dataset: str = "table", row_order: str | None = None, target: str | None = None,
                       time: str | None = None, override: str | None = None, **options) -> Evaluation:
    """Find task, target and time axis first, then evaluate."""
    df, order, hidden = ordered(require_rows(df), row_order)
    found = infer_task(df, dataset, order, target, time, override, without=hidden).first()
    task = found["task"]
    needs_target = task != CLUSTERING or override is None
    target = target or (found["target"] if needs_target else None)
    needs_time = task == TIME_SERIES or override is None
    time = time or (found["time"] if needs_time else None)
    return evaluate(df, task, target, time, order, confidence=found["confidence"],
                    without=[*options.pop("without", []), *hidden], **options)


def cohort_fitness(df: DataFrame, chunks: int, tasks: str | Sequence[str], row_order: str, by: Sequence[str] = (),
                   **options) -> Evaluation:
    """Fitness of each of ``chunks`` contiguous parts of the table (or of each segment) in arrival order.

    The cohorts, 1 and up in the column ``cohort``, are segments of one evaluation.
    """
    return evaluate(with_chunk(df, chunks, [row_order], by, "cohort"), tasks, row_order=row_order, by=[*by, "cohort"],
                    **options)


def receipt(evaluation: Evaluation, df: DataFrame, run_id: str) -> DataFrame:
    """One row per segment and task: table hash, roles and options, the weights before and after calibration, fitness,
    metric, residual and time of the run."""
    roles = evaluation.roles
    hashed = content_hash(df, list(roles.columns)).select(
        F.col("digest").alias("dataset_hash"), F.col("rows").alias("dataset_rows"))
    parameters = {"target": roles.target, "time": roles.time, "identifiers": ",".join(roles.identifiers),
                  "numeric": ",".join(roles.numeric), **{f"policy_{k}": v for k, v in vars(evaluation.policy).items()}}
    rows = evaluation.rows.select(
        *evaluation.keys, "n", "raw_fitness", "final_fitness", "tier", "cap", "interval_low", "interval_high", "predicted",
        "observed", "residual_before", "loss_after",
        F.create_map(*[x for c in CODES for x in (F.lit(c), F.col(f"w_{c}"))]).alias("weights"),
        F.create_map(*[F.lit(x) for k, v in parameters.items() for x in (k, None if v is None else str(v))]).alias("parameters"))
    return rows.crossJoin(F.broadcast(hashed)).withColumns(
        {"run_id": F.lit(run_id), "evaluated_at": F.current_timestamp()})
