"""What embeds texts: a small protocol, so that any model can be plugged in, and the column function over it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.udfs import mock_vector


class Backend(Protocol):
    """A model: its names, the length of its vectors, and ``encode`` from texts to one vector each.

    Objects are sent to the executors; what is heavy should be loaded at the first ``encode``.
    """

    model_name: str
    backend_name: str
    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class MockBackend:
    """Unit vectors from the text's checksum, for tests: the same text, the same vector."""

    backend_name = "mock"

    def __init__(self, dimension: int = 64, model_name: str = "mock"):
        self.dimension, self.model_name = dimension, model_name

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [mock_vector(t, self.dimension).tolist() for t in texts]


def embed(backend: Backend, batch: int = 64):
    """A column function from text to a vector of length 1; texts go to the model ``batch`` at a time.

    Null and blank texts have no vector. A vector of another length, of zeros or not finite raises an error.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[np.ndarray | None] = [None] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for at in range(0, len(wanted), batch):
                some = wanted[at : at + batch]
                found = np.asarray(backend.encode([texts.iloc[i] for i in some]), np.float64)
                if found.shape != (len(some), backend.dimension) or not np.isfinite(found).all() or not found.any(axis=1).all():
                    raise ValueError(f"{backend.model_name}: not {len(some)} vectors of {backend.dimension} finite components")
                unit = (found / np.linalg.norm(found, axis=1, keepdims=True)).astype(np.float32)
                for i, v in zip(some, unit):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return run
