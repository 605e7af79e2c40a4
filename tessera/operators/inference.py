"""Model inference over columns: pluggable encoders in Arrow batches, a status for each row."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "_row_id string, _source string, _model string, _status string, _error string, _latency_ms float"
# The task columns that follow the prefix.
TASKS = {"embedding": "vector array<float>", "classification": "label string, confidence float, all_scores_json string", "ner": "entities string", "regression": "predicted_mean double, predicted_std double"}


@dataclass(frozen=True)
class Model:
    """A named model: ``apply`` takes texts and gives one value or tuple for each."""

    id: str
    task: str
    apply: Callable[[list[str]], list]


class OutOfMemory(RuntimeError):
    """Raised by a model whose batch is too large; the batch is halved from then on."""


def hashing_encoder(dims: int = 32) -> Callable[[list[str]], list]:
    """A deterministic toy encoder: signed word hashes, unit length."""

    def apply(texts: list[str]) -> list:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % dims] += 1 if h >> 63 else -1
        length = np.sqrt((out**2).sum(1, keepdims=True))
        return (out / np.where(length == 0, 1, length)).tolist()

    return apply


def infer(rows: DataFrame, model: Model, columns: list[str], key: str, source: str, batch: int = 32) -> DataFrame:
    """Prefix columns and the task's columns for each row; empty content is an error row before the model runs."""
    task = TASKS[model.task]
    fields = [x.split()[0] for x in task.split(", ")]
    names = [x.split()[0] for x in PREFIX.split(", ")] + fields

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = batch
        for frame in frames:
            out, at, good = [], 0, [i for i, c in enumerate(frame["content"]) if c is not None and c.strip()]
            values: dict[int, tuple] = {}
            while at < len(good):
                chosen, began = good[at : at + size], time.perf_counter()
                try:
                    made = model.apply([frame["content"].iloc[i] for i in chosen])
                except OutOfMemory:
                    if size == 1:
                        raise
                    size //= 2
                    continue
                each = (time.perf_counter() - began) * 1000 / len(chosen)
                for i, value in zip(chosen, made, strict=True):
                    values[i] = (*(value if isinstance(value, tuple) and len(fields) > 1 else (value,)), each)
                at += len(chosen)
            for i, key_value in enumerate(frame["key"]):
                if i in values:
                    *got, each = values[i]
                    out.append((key_value, source, model.id, "ok", None, each, *got))
                else:
                    out.append((key_value, source, model.id, "error", "empty content", 0.0, *[None] * len(fields)))
            yield pd.DataFrame(out, columns=names)

    content = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    return rows.select(F.col(key).cast("string").alias("key"), content.alias("content")).mapInPandas(run, f"{PREFIX}, {task}")


def generate_embeddings(rows: DataFrame, model: Model, columns: list[str], key: str, source: str) -> DataFrame:
    """An embedding table of the rows that the model took."""
    made = infer(rows, model, columns, key, source).filter("_status = 'ok'")
    return made.select("_row_id", F.col("_source").alias("_source_id"), F.col("_model").alias("_model_id"), "vector")


def scores_json(labels: list[str], scores: list[float]) -> tuple[str, float, str]:
    """A classification value: the best label, its score and all scores."""
    best = max(range(len(labels)), key=lambda i: scores[i])
    return labels[best], float(scores[best]), json.dumps(dict(zip(labels, map(float, scores), strict=True)))
