"""Batch inference over prompts and rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchmark.operators.vectors import knn_exact

# The classes of the reference's prompt.
CLASSES = ("Premium", "Standard", "Budget")


def batch_infer(
    df: DataFrame,
    infer_fn: Callable[..., list],
    *,
    prompt: str = "prompt",
    max_output_tokens: int = 256,
    temperature: float = 0.2,
) -> DataFrame:
    """Adds ``result`` and ``status``: ``infer_fn(prompts, max_output_tokens=, temperature=)``.

    ``infer_fn`` maps a batch of prompts, none of them null, to as many answers. A batch that fails is
    asked again row by row; a row that fails alone keeps its error text in ``status`` and has no
    result, and the job goes on. A null prompt has no result and is never asked.
    """
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def ask(texts: pd.Series) -> list:
        answers = list(infer_fn(texts, max_output_tokens=max_output_tokens, temperature=temperature))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
        return answers

    def ask_alone(text: str) -> tuple[str | None, str]:
        try:
            return ask(pd.Series([text]))[0], ""
        except Exception as error:  # noqa: BLE001
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[prompt][batch[prompt].notna()]
            try:
                found = [(a, "") for a in ask(texts)] if len(texts) else []
            except Exception:  # noqa: BLE001
                found = [ask_alone(text) for text in texts]
            answers = dict(zip(texts.index, found))
            rows = [answers.get(i, (None, "no prompt")) for i in batch.index]
            yield batch.assign(result=[a for a, _ in rows], status=[s for _, s in rows])

    return df.mapInPandas(run, f"{names}, result string, status string")


def train_classifier(
    labelled: DataFrame, *, text: str, label: str, dimensions: int = 4096
) -> PipelineModel:
    """Hashed word counts and logistic regression; ``label`` is an index into ``CLASSES``."""
    pipeline = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
            LogisticRegression(
                featuresCol="_tf", labelCol=label, predictionCol="_class", maxIter=20,
                regParam=0.01, family="multinomial",
            ),
        ]
    )
    return pipeline.fit(labelled.select(text, label))


def classify(df: DataFrame, model: PipelineModel, *, name: str = "classification") -> DataFrame:
    names = F.array(*[F.lit(c) for c in CLASSES])
    chosen = F.get(names, F.col("_class").cast("int"))
    return model.transform(df).select(*df.columns, chosen.alias(name))


def recommend_themes(segments: DataFrame, themes: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` themes nearest to each segment; both sides carry an ``embedding``."""
    return knn_exact(themes, segments, k, base_id="theme", query_id="audience_id")
