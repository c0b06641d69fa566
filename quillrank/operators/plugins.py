"""Places where users put in their own tokeniser, encoder, scorer or dataset steps. All run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import PluginTokenizer
from quillrank.operators import text_rows

Step = Callable[..., DataFrame]


def tokenizer(encode_batch: Callable[[Sequence[str]], list[list[str]]]) -> PluginTokenizer:
    return PluginTokenizer(encode_batch)


def vector_encoder(df: DataFrame, encode_batch: Callable[[list[str]], Sequence[Sequence[float]]], id_col: str = "id", text: str = "text") -> DataFrame:
    """Texts to dense vectors (id, embedding), a batch at a time. A null text reaches the encoder as an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [list(map(float, v)) for v in encode_batch(batch["text"].tolist())]
            yield pd.DataFrame({"id": batch["id"], "embedding": vectors})

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id string, embedding array<float>")


def pair_scorer(score_batch: Callable[[list[str], list[str]], Sequence[float]]) -> Callable[[Column, Column], Column]:
    """(query, passage) to a score column."""

    @F.pandas_udf("double")
    def score(query: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(list(score_batch(query.fillna("").tolist(), passage.fillna("").tolist())), dtype="float64")

    return score


@dataclass(frozen=True)
class Steps:
    """Train, query and corpus steps of a dataset; None leaves rows as they are."""

    train: Step | None = text_rows.train_rows
    query: Step | None = text_rows.query_rows
    corpus: Step | None = text_rows.corpus_rows


DEFAULT_STEPS = Steps()
CONTRASTIVE_STEPS = Steps(train=text_rows.contrastive_rows)
READY_STEPS = Steps(None, None, None)


@dataclass
class DatasetSteps:
    """Steps by dataset name. `json` rows are tokenised already; unknown names get the defaults."""

    known: dict[str, Steps] = field(default_factory=lambda: {"json": READY_STEPS})

    def register(self, name: str, steps: Steps) -> None:
        self.known[name] = steps

    def steps_for(self, name: str, corpus: bool = False) -> Steps:
        """A corpus is found under its dataset's name, with or without the ending `-corpus`."""
        base = name.removesuffix("-corpus") if corpus else name
        return self.known.get(base, DEFAULT_STEPS)

    def apply(self, name: str, kind: str, df: DataFrame, **options) -> DataFrame:
        step = getattr(self.steps_for(name, kind == "corpus"), kind)
        return df if step is None else df.transform(step, **options)
