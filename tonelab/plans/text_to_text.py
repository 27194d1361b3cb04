"""Text-to-text experiment: prompt, generated text, label, metrics per part, export.

The model is the user's own and is not trained here. Each prompt is generated once; the
answers are written next to their texts, so metrics and export read them without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.functions.generated import FALLBACKS, FallbackPolicy
from tonelab.functions.prompts import sentiment_prompt
from tonelab.operators import batch_scorer, metrics, stratified
from tonelab.operators.batch_scorer import TEXT_BATCH, MakeModel
from tonelab.plans.experiment import KEY, require_keys
from tonelab.sources.scratch import materialize
from tonelab.sources.tables import write_table


@dataclass(frozen=True)
class TextExperiment:
    """Answered rows: the prepared columns with ``role`` and the columns of the answer."""

    rows: DataFrame
    policy: FallbackPolicy

    def measured(self) -> DataFrame:
        """Overall metrics per part."""
        return metrics.overall(self._pairs("role"), ["role"])

    def report(self, role: str = "test") -> DataFrame:
        pairs = self._pairs("role").filter(F.col("role") == role).drop("role")
        return metrics.classification_report(pairs, self.policy.domain)

    def predictions(self) -> DataFrame:
        """All rows with the generated text and its label."""
        return self.rows.select("id", "text", "sentiment", "pred_text_raw", "pred_sentiment")

    def export(self, path: str, fmt: str = "parquet") -> None:
        write_table(self.predictions(), path, fmt)

    def _pairs(self, *by: str) -> DataFrame:
        return metrics.pair_counts(self.rows, by, "label", "pred_id")


def text_experiment(
    prepared: DataFrame,
    make_model: MakeModel,
    policy: FallbackPolicy = FALLBACKS["three_class"],
    prompt: str = "three_class",
    *,
    layout: stratified.Layout | None = None,
    seed: int = 42,
    batch_size: int = TEXT_BATCH,
) -> TextExperiment:
    """``prepared`` holds ``row_key, id, text, sentiment, label`` with unique keys; 80/10/10 by default.

    ``make_model`` answers a batch of prompts; ``policy`` gives the label of each answer.
    """
    keys = materialize(prepared.select(KEY, "label"), "keys")
    require_keys(keys)
    layouts = {"split": layout or stratified.train_val_test()}
    cuts = stratified.fit_cuts(keys, layouts, policy.domain.ids, seed=seed)
    answer = batch_scorer.generated_column(make_model, sentiment_prompt(F.col("text"), prompt), batch_size=batch_size)
    answered = batch_scorer.label_generated(cuts.assign(prepared, {"split": "role"}), answer, policy)
    return TextExperiment(materialize(answered, "answers"), policy)
