"""Pluggable runners: a registry of voices and models, each a function over an Arrow batch of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOICES: dict[str, Callable[[list[str]], list[int]]] = {}
MODELS: dict[str, Callable[[list[str]], list[str]]] = {}


def voice(name: str):  # noqa: ANN201
    """Register a voice: texts to numbers of samples."""

    def add(f):  # noqa: ANN001, ANN202
        VOICES[name] = f
        return f

    return add


@voice("stub")
def _stub(texts: list[str]) -> list[int]:
    return [1600 * len(t) for t in texts]


def first_usable(names: list[str], registry: dict) -> str | None:
    """The first name of a list of preference that is registered."""
    return next((n for n in names if n in registry), None)


def run_voice(units: DataFrame, name: str, batch: int = 8, attempts: int = 4) -> DataFrame:
    """(doc_id, pos, samples): texts in batches through a voice; empty texts are silent and never sent.

    A batch that fails by transport is tried again; Spark tries the task again beyond that. Order comes from pos.
    """
    run_one = VOICES[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.Series(0, index=f.index, dtype="int64")
            speak = f.index[f["text"].fillna("") != ""]
            for i in range(0, len(speak), batch):
                part = speak[i : i + batch]
                for k in range(attempts):
                    try:
                        out[part] = run_one(list(f.loc[part, "text"]))
                        break
                    except ConnectionError:
                        if k + 1 == attempts:
                            raise
            yield pd.DataFrame({"doc_id": f["doc_id"], "pos": f["pos"], "samples": out})

    return units.mapInPandas(run, "doc_id string, pos int, samples bigint")
