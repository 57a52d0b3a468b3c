"""Models over text columns, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def embedder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 10):
    """A column function text -> vector.  ``load`` runs once for each task and gives
    a function from a list of at most ``batch`` texts to their vectors."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = []
            texts = part.fillna("").tolist()
            for i in range(0, len(texts), batch):
                out += [[float(x) for x in v] for v in model(texts[i : i + batch])]
            yield pd.Series(out)

    return embed
