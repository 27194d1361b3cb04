"""K-fold experiment: every fold's model is measured on the same outer test part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain
from tonelab.operators import runs, stratified
from tonelab.plans.experiment import DEFAULT_SETTINGS, Experiment, Setting, run_experiment
from tonelab.sources.tables import write_table

# The K values of the protocol (1 means a single holdout).
K_LIST = (1, 3)
EVAL_METRICS = ("accuracy", "f1_macro", "precision_macro", "recall_macro")
TIMINGS = ("train_seconds", "test_seconds")
EVAL_BATCH = 64


def kfold_experiment(
    prepared: DataFrame,
    domain: LabelDomain,
    ks: Sequence[int] = K_LIST,
    settings: Sequence[Setting] = DEFAULT_SETTINGS,
    *,
    seed: int = 42,
    extra: Mapping[str, str] | None = None,
) -> Experiment:
    return run_experiment(
        prepared, domain, stratified.fold_layouts(ks), stratified.fold_runs(ks), settings, seed=seed, extra=extra
    )


def fold_results(e: Experiment, timings: bool = False) -> DataFrame:
    """One row per (K, fold): part sizes and test metrics of the chosen setting.

    All folds share one training and one evaluation job, so with ``timings``
    every row shows the seconds of the shared job, and rates are test rows over those
    seconds. ``epoch`` is 1: the count model reads its training rows once.
    """
    out = e.chosen().selectExpr(
        "K",
        "fold",
        *[f"{sql} AS {name}" for name, sql in _sizes(e).items()],
        "loss AS eval_loss",
        *[f"`{m}` AS `eval_{m}`" for m in (*EVAL_METRICS, *e.extra)],
        "setting",
    )
    if timings:
        seconds = e.stopwatch.seconds
        out = out.withColumns(
            {
                "eval_runtime": F.lit(seconds["evaluation"]),
                "train_seconds": F.lit(seconds["training"]),
                "test_seconds": F.lit(seconds["evaluation"]),
                "epoch": F.lit(1.0),
            }
        )
        out = runs.throughput(out, "test_n", "eval_runtime", EVAL_BATCH).drop("seconds_per_row")
        out = out.withColumnsRenamed({f"{c}_per_second": f"eval_{new}_per_second" for c, new in (("rows", "samples"), ("steps", "steps"))})
    return out


def _sizes(e: Experiment) -> dict[str, str]:
    """SQL for the part sizes of a run; they are known from the fitted split."""
    sizes = [(run, run.sizes(e.cuts)) for run in e.runs]
    return {
        part: "CASE" + "".join(f" WHEN K = {r.k} AND fold = {r.fold} THEN {n[part]}L" for r, n in sizes) + " END"
        for part in ("train_n", "val_n", "test_n")
    }


def fold_summary(results: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation per K of the metrics present in ``results``; ``extra``: names of the user's."""
    wanted = [f"eval_{m}" for m in (*EVAL_METRICS, *extra)] + list(TIMINGS)
    return runs.fold_summary(results, [m for m in wanted if m in results.columns])


def write_results(e: Experiment, path: str, fmt: str = "parquet") -> None:
    """Write fold results, their summary and the runtime table below ``path``."""
    results = fold_results(e, timings=True)
    write_table(results, f"{path}/fold_results", fmt)
    write_table(fold_summary(results, tuple(e.extra)), f"{path}/fold_summary", fmt)
    write_table(e.stopwatch.table(e.rows.sparkSession), f"{path}/runtime", fmt)
