"""Vectors of texts by a model that is plugged in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model: texts to the states of their tokens, (texts, tokens, numbers), and a mask of the tokens that are there.
Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean state of each text's own tokens; zeros for a text without any."""
    weight = mask[:, :, None].astype(states.dtype)
    return (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


def embed(df: DataFrame, item: str, text: Column, load: Callable[[], Model], batch: int = 64) -> DataFrame:
    """(item, embedding): the mean-pooled state of each row's text; null texts are empty.

    `load` makes the model once in each task, from what it finds on the executor; it is the one place where
    Python sees rows, in Arrow batches cut into `batch` texts. A model that isn't installed raises there.
    """
    rows = df.select(F.col(item), F.coalesce(text, F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            texts = b["_text"].to_pylist()
            for at in range(0, len(texts), batch):
                model = model or load()
                v = mean_pooled(*model(texts[at : at + batch])).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b[item].slice(at, len(v)), lists], [item, "embedding"])

    return rows.mapInArrow(run, f"`{item}` {rows.schema[item].dataType.simpleString()}, embedding array<float>")


def transformer(name: str, max_length: int = 64) -> Callable[[], Model]:
    """The hidden states of a pretrained transformer; needs torch and transformers on the executors."""

    def load() -> Model:
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as e:
            raise ImportError("transformer() needs torch and transformers on every executor; pass another model") from e
        tokenizer, net = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).eval()

        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            given = tokenizer(texts, padding=True, truncation=True, max_length=max_length, return_tensors="pt")
            with torch.no_grad():
                return net(**given).last_hidden_state.numpy(), given["attention_mask"].numpy()

        return run

    return load


def hashed_terms(dims: int = 8, max_length: int = 64) -> Callable[[], Model]:
    """A model without weights: a term's state is read off its hash, so texts that share terms are near."""

    def load() -> Model:
        known: dict[str, np.ndarray] = {}

        def state(term: str) -> np.ndarray:
            if term not in known:
                known[term] = np.frombuffer(hashlib.md5(term.encode()).digest()[:dims], np.uint8) / 255 - 0.5
            return known[term]

        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [re.findall(r"[^\W\d_]+", t.lower())[:max_length] for t in texts]
            states = np.zeros((len(texts), max(1, *map(len, lists)), dims))
            mask = np.zeros(states.shape[:2], bool)
            for i, terms in enumerate(lists):
                for j, t in enumerate(terms):
                    states[i, j], mask[i, j] = state(t), True
            return states, mask

        return run

    return load
