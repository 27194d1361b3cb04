"""One folder that scores raw rows elsewhere: cleaning rules, label domain, chosen setting and counts.

The folder is written beside its place and renamed when it is whole. Scoring is a map over the
rows if the model's weights fit into a task, else a join on the rare words; both take streams.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tonelab.functions.labels import LabelDomain
from tonelab.operators import clean, naive_bayes
from tonelab.operators.naive_bayes import Candidate, CountModel
from tonelab.operators.stratified import Run
from tonelab.plans.experiment import Experiment, prediction_columns, with_prediction
from tonelab.plans.holdout import HOLDOUT
from tonelab.sources.scratch import publish

FORMAT = 1
FIT = "model"


@dataclass(frozen=True)
class Artefact:
    """A count model with its front end; ``required`` columns must not be null, ``drop_empty`` texts go."""

    model: CountModel
    candidate: Candidate
    domain: LabelDomain
    required: tuple[str, ...]
    drop_empty: bool

    def prepare(self, raw: DataFrame) -> DataFrame:
        """Raw ``id, text`` rows cleaned as for the fit. With a column ``sentiment`` its normal form is kept, and
        rows whose label is outside the domain go; without one no label is needed."""
        if "sentiment" in raw.columns:
            return clean.prepare_reviews(raw, self.domain, required=self.required, drop_empty=self.drop_empty)
        out = clean.with_clean_text(clean.drop_null_subset(raw, self.required))
        return clean.drop_empty_text(out) if self.drop_empty else out

    def predict(self, raw: DataFrame) -> DataFrame:
        """``id, text``, ``sentiment`` if given, and the prediction of each row that ``prepare`` keeps.

        Rows may be a stream and ids may repeat, whatever the size of the model.
        """
        rows = self.prepare(raw)
        add = naive_bayes.with_logits if naive_bayes.can_look_up(self.model, [self.candidate]) else naive_bayes.with_joined_logits
        scored = add(rows, self.model, [self.candidate])
        labels = [c for c in ("sentiment",) if c in raw.columns]
        return with_prediction(scored, f"logits_{FIT}", self.domain).select("id", "text", *labels, *prediction_columns(self.domain))


def save(e: Experiment, path: str, run: Run = HOLDOUT, *, required: tuple[str, ...] = ("id", "text"), drop_empty: bool = True) -> None:
    """Write the chosen setting of ``run`` and its counts; fails if ``path`` exists. Words of other runs alone are left out."""
    spark = e.rows.sparkSession
    candidate = e.chosen_candidate(run)
    kept = naive_bayes.one_fit(e.model, candidate.fit, FIT)
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    naive_bayes.save(kept, part)
    manifest = {
        "format": FORMAT, "labels": list(e.domain.names), "smoothing": candidate.smoothing, "prior_weight": candidate.prior_weight,
        "required": list(required), "drop_empty": drop_empty,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{part}/manifest")
    publish(spark, part, path)


def load(spark: SparkSession, path: str) -> Artefact:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']} of {path}; this library reads {FORMAT}")
    candidate = Candidate(FIT, FIT, manifest["smoothing"], manifest["prior_weight"])
    domain = LabelDomain(tuple(manifest["labels"]))
    return Artefact(naive_bayes.load(spark, path), candidate, domain, tuple(manifest["required"]), manifest["drop_empty"])
