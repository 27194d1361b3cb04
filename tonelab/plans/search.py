"""Hyperparameter search: draw settings, validate all of them, keep the best, report on test."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tonelab.functions.labels import LabelDomain
from tonelab.operators import stratified
from tonelab.operators.stratified import Run
from tonelab.operators.trials import COUNT_MODEL_SPACE, TEXT_TRIALS, draw_settings
from tonelab.plans.experiment import Experiment, Setting, run_experiment

SEARCH = Run(1, 1, "search")


def search_experiment(
    prepared: DataFrame,
    domain: LabelDomain,
    n_trials: int = TEXT_TRIALS,
    *,
    space=COUNT_MODEL_SPACE,
    search: str = "count_model",
    seed: int = 42,
) -> Experiment:
    """64/16/20 split; all trials are counted and scored in the same two jobs.

    The best trial needs no second fit: a count model fitted again on the same
    rows with the same setting is the same model.
    """
    drawn = draw_settings(search, space, n_trials, seed)
    settings = [Setting(**{k: v for k, v in row.items() if k != "trial"}) for row in drawn]
    return run_experiment(prepared, domain, {"search": stratified.nested()}, [SEARCH], settings, seed=seed)


def trial_results(e: Experiment) -> DataFrame:
    """One row per trial: its setting and its validation metrics."""
    values = {
        name: "CASE setting"
        + "".join(f" WHEN {i} THEN {_literal(getattr(s, name))}" for i, s in enumerate(e.settings))
        + " END"
        for name in ("smoothing", "prior_weight")
    }
    return e.measured().filter("role = 'val'").selectExpr(
        "setting + 1 AS trial",
        *[f"{sql} AS {name}" for name, sql in values.items()],
        "loss",
        "accuracy",
        "f1_macro",
    )


def _literal(value: float | int | None) -> str:
    if value is None:
        return "CAST(NULL AS INT)"
    return f"{value!r}D" if isinstance(value, float) else str(value)
