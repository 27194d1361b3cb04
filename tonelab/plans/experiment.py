"""Core of all experiments: fit every run and setting, score once, measure once.

The jobs over the data are: write the prepared rows, fit the split bounds (keys
and labels only), count tokens, score. Runs, folds, trials and settings are
columns of those jobs, never a loop over them.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain
from tonelab.functions.scores import argmax, cross_entropy, probability_columns, softmax
from tonelab.operators import metrics, naive_bayes, runs, stratified
from tonelab.operators.naive_bayes import Candidate, CountModel, Fit
from tonelab.operators.stratified import Cuts, Layout, Run
from tonelab.sources.scratch import materialize, remove, scope

KEY = "row_key"
HASH = "row_hash"
BY = ("K", "fold", "setting", "role")


@dataclass(frozen=True)
class Setting:
    """Tuned values of the count model, which reads whole texts."""

    smoothing: float = 1.0
    prior_weight: float = 1.0


# Settings from which validation picks, in order of preference on ties.
DEFAULT_SETTINGS = (Setting(1.0), Setting(0.1), Setting(0.01))


@dataclass
class Stopwatch:
    """Wall-clock seconds per stage."""

    seconds: dict[str, float] = field(default_factory=dict)
    started: float = field(default_factory=time.time)

    def start(self) -> None:
        self.started = time.time()

    def lap(self, stage: str) -> None:
        """Book the time since the start or the last lap on a stage."""
        now = time.time()
        self.seconds[stage] = self.seconds.get(stage, 0.0) + now - self.started
        self.started = now

    def table(self, spark: SparkSession) -> DataFrame:
        timings = spark.createDataFrame(list(self.seconds.items()), "stage string, seconds double")
        return runs.runtime_summary(timings)


@dataclass(frozen=True)
class Experiment:
    """Fitted and measured runs. ``pairs`` holds a few rows per run and setting.

    ``extra``: the user's own metrics (see ``metrics.overall``). ``folder`` holds the written rows,
    counts and pairs until the experiment is closed.
    """

    rows: DataFrame
    domain: LabelDomain
    cuts: Cuts
    runs: tuple[Run, ...]
    settings: tuple[Setting, ...]
    model: CountModel
    pairs: DataFrame
    leaky: bool
    stopwatch: Stopwatch
    extra: Mapping[str, str] = field(default_factory=dict)
    folder: str | None = None

    def close(self) -> None:
        """Remove what the experiment has written, the copy of the texts above all."""
        if self.folder:
            remove(self.rows.sparkSession, self.folder)

    def __enter__(self) -> Experiment:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def measured(self) -> DataFrame:
        """Loss and overall metrics per run, setting and role."""
        return metrics.overall(self.pairs, BY, means=["loss"], extra=self.extra)

    def chosen(self, metric: str = "f1_macro", maximise: bool = True) -> DataFrame:
        """Per run: the setting with the best validation metric, and its test metrics.

        The first setting wins ties. One aggregation per step over a few rows.
        """
        m = self.measured()
        names = [c for c in m.columns if c not in BY]
        both = m.groupBy("K", "fold", "setting").agg(
            F.expr(f"max(`{metric}`) FILTER (WHERE role = 'val')").alias(f"val_{metric}"),
            *[F.expr(f"max(`{c}`) FILTER (WHERE role = 'test')").alias(c) for c in names],
        )
        return runs.best_trial(both, ["K", "fold"], f"val_{metric}", names, trial="setting", maximise=maximise)

    def test_pairs(self) -> DataFrame:
        """Pair counts on the test rows for the chosen setting of each run."""
        test = self.pairs.filter("role = 'test'")
        return test.join(F.broadcast(self.chosen().select("K", "fold", "setting")), ["K", "fold", "setting"])

    def chosen_candidate(self, run: Run) -> Candidate:
        row = self.chosen().filter((F.col("K") == run.k) & (F.col("fold") == run.fold)).first()
        return self.candidate(run, row["setting"] if row else 0)

    def candidate(self, run: Run, index: int) -> Candidate:
        s = self.settings[index]
        return Candidate(f"{run.name}_s{index}", _fit_name(run), s.smoothing, s.prior_weight)


def _fit_name(run: Run) -> str:
    return f"{run.name}_all"


def _role_column(layout: str) -> str:
    return f"role_{layout}"


def require_keys(rows: DataFrame) -> None:
    """Refuse null and repeated keys."""
    per_key = rows.groupBy(KEY).agg(F.count("*").alias("n"))
    if per_key.filter(f"n > 1 OR {KEY} IS NULL").limit(1).count():
        raise ValueError(f"{KEY} is null or repeats; see operators.keys.with_occurrence_key")


def run_experiment(
    prepared: DataFrame,
    domain: LabelDomain,
    layouts: Mapping[str, Layout],
    all_runs: Sequence[Run],
    settings: Sequence[Setting] = DEFAULT_SETTINGS,
    *,
    seed: int = 42,
    validate_on_test: bool = False,
    extra: Mapping[str, str] | None = None,
) -> Experiment:
    """``prepared`` holds ``row_key, id, text, sentiment, label`` with unique keys.

    ``validate_on_test`` uses the test part for validation too, for protocols
    without a validation part; results are then marked as leaky.
    """
    with scope(prepared.sparkSession, "experiment") as folder:
        watch = Stopwatch()
        labels = domain.ids
        order = F.expr(stratified.order_hash(KEY, seed))
        rows = materialize(prepared.withColumn(HASH, order), "rows")
        require_keys(rows)
        watch.lap("preparation")

        cuts = stratified.fit_cuts(rows, layouts, labels, hash_column=HASH)
        rows = cuts.assign(rows, {name: _role_column(name) for name in layouts})
        fits = [Fit(_fit_name(run), run.trains(_role_column(run.layout))) for run in all_runs]
        model = naive_bayes.fit(rows, fits, labels)
        watch.lap("training")

        experiment = Experiment(
            rows, domain, cuts, tuple(all_runs), tuple(settings), model, rows, validate_on_test, watch, dict(extra or {}), folder
        )
        # A few rows per run and setting: in one partition the metrics need no shuffle.
        pairs = materialize(_score_held_out(experiment), "pairs").coalesce(1)
        watch.lap("evaluation")
        return replace(experiment, pairs=pairs)


def _role(run: Run) -> str:
    return run.role(_role_column(run.layout))


def _score_held_out(e: Experiment) -> DataFrame:
    """Pair counts and summed loss per run, setting and role over val and test rows."""
    slots = [(run, i, e.candidate(run, i)) for run in e.runs for i in range(len(e.settings))]
    carry = ["label", *dict.fromkeys(_role_column(run.layout) for run in e.runs)]
    scored = naive_bayes.score(_held_out_rows(e), e.model, [c for _, _, c in slots], key=KEY, carry=carry)
    entries = ", ".join(
        f"named_struct('K', {run.k}, 'fold', {run.fold}, 'setting', {i}, 'role', {role}, 'logits', logits_{c.name})"
        for run, i, c in slots
        for role in _measured_as(run, e.leaky)
    )
    long = scored.selectExpr("label", f"inline(array({entries}))").filter("role IN ('val', 'test')")
    loss = cross_entropy("logits", "label", len(e.domain.names))
    measured = long.withColumns({"y_pred": argmax(F.col("logits")), "loss": loss})
    return measured.groupBy(*BY, F.col("label").alias("y_true"), "y_pred").agg(
        F.count("*").alias("n"), F.sum("loss").alias("loss")
    )


def _held_out_rows(e: Experiment) -> DataFrame:
    """Rows that are val or test in some run; with folds that is every row."""
    if any(run.k > 1 for run in e.runs):
        return e.rows
    return e.rows.filter(" OR ".join(f"{_role(run)} <> 'train'" for run in e.runs))


def _measured_as(run: Run, leaky: bool) -> list[str]:
    """A test row counts as validation row too when validating on the test part."""
    return [_role(run), f"CASE WHEN {_role(run)} = 'test' THEN 'val' END"] if leaky else [_role(run)]


def predict_rows(
    e: Experiment, candidate: Candidate, rows: DataFrame | None = None, lookup_bytes: int = naive_bayes.LOOKUP_BYTES
) -> DataFrame:
    """Score rows and put the predictions next to them: the prediction export.

    With weights that a task can hold the rows are scored where they are, and nothing is shuffled.
    With a larger model only the words that no task holds are joined, and the scores of a
    text meet its rows in one equi-join.
    """
    rows = e.rows if rows is None else rows
    name = f"logits_{candidate.name}"
    held = naive_bayes.can_look_up(e.model, [candidate], lookup_bytes)
    scored = (naive_bayes.with_logits if held else naive_bayes.with_joined_logits)(rows, e.model, [candidate])
    return with_prediction(scored, name, e.domain).select("id", "text", "sentiment", "label", *prediction_columns(e.domain))


def prediction_columns(domain: LabelDomain) -> list[str]:
    return ["pred_id", "pred_sentiment", *(f"prob_{name}" for name in domain.names)]


def with_prediction(scored: DataFrame, logits: str, domain: LabelDomain) -> DataFrame:
    """Predicted id and name and one probability column per class in the place of the logits."""
    out = scored.withColumns({"pred_id": argmax(F.col(logits)), "_p": softmax(F.col(logits))})
    columns = {"pred_sentiment": domain.decode(F.col("pred_id")), **probability_columns(F.col("_p"), domain)}
    return out.withColumns(columns).drop(logits, "_p")
