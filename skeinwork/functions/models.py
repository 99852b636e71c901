"""Hooks for encoders and generators, run in batches on the executors, and stand-ins for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Encode = Callable[[list[str]], np.ndarray]
Generate = Callable[[list[dict[str, str]]], str]


def encoder(make: Callable[[], Encode], batch: int = 32, unit: bool = True) -> Callable[[Column], Column]:
    """Column of texts -> array<float>; `make` builds the encoder once for each task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in parts:
            values = [encode(list(texts[at : at + batch])) for at in range(0, len(texts), batch)]
            m = np.concatenate(values) if values else np.zeros((0, 1))
            if unit:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(n == 0, 1, n)
            yield pd.Series(list(m.astype("float32")))

    return run


def pool(hidden: np.ndarray, mask: np.ndarray, how: str = "cls") -> np.ndarray:
    """One vector a text of token states (texts x tokens x width): the first token's, or the mean over the tokens of the mask."""
    if how == "cls":
        return hidden[:, 0, :]
    if how == "mean":
        weight = mask[:, :, None].astype(hidden.dtype)
        return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    raise ValueError(f"pooling must be 'cls' or 'mean', not {how!r}")


def pooled(states: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], how: str = "cls") -> Encode:
    """An encoder out of a function that gives token states and mask."""
    return lambda texts: pool(*states(texts), how)


def generator(make: Callable[[], Callable[..., str]], **options) -> Callable[[Column], Column]:
    """Column of array<struct<role, content>> -> reply; `make` builds the model once for each task, options go to every call."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = make()
        for chats in parts:
            yield chats.map(lambda chat: generate([{"role": m["role"], "content": m["content"]} for m in chat], **options))

    return run


def batched(make: Callable[[], Callable[..., list[str]]], batch: int = 32, **options) -> Callable[[Column], Column]:
    """As `generator`, for a model that answers several chats in one call: it gets lists of up to `batch` chats."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = make()
        for chats in parts:
            turns = [[{"role": m["role"], "content": m["content"]} for m in chat] for chat in chats]
            yield pd.Series([r for at in range(0, len(turns), batch) for r in generate(turns[at : at + batch], **options)], dtype=object)

    return run


def attempts(make: Callable[[], Callable[..., str]], **options) -> Callable[[Column], Column]:
    """As `generator`, but a call that fails costs only its own row: struct<value, error>, one of which is null."""

    @F.pandas_udf("struct<value:string,error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = make()
        for chats in parts:
            rows = []
            for chat in chats:
                try:
                    rows.append((generate([{"role": m["role"], "content": m["content"]} for m in chat], **options), None))
                except Exception as e:  # whatever the model raises is this row's result
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    return run


def cutter(make: Callable[[], Callable[[str], list[tuple[int, int]]]], budget: int) -> Callable[[Column], Column]:
    """Column of texts -> each text up to the end of its `budget`-th token, otherwise unchanged. `make` builds, once a task, what gives the
    places (start, end; in characters) of a text's tokens; a token that ends inside a character takes the character."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = make()
        for texts in parts:
            yield texts.map(lambda t: None if t is None else t[: max((e for _, e in places(t)[:budget]), default=0)] if len(t) else t)

    return run


def told(df: DataFrame, name: str, reply: Column) -> DataFrame:
    """df with the reply of a model, and its error under the name with `_error`; a model that gives plain text has none."""
    got = df.withColumn(name, reply)
    if isinstance(got.schema[name].dataType, StringType):
        return got.withColumn(f"{name}_error", F.lit(None).cast("string"))
    return got.withColumns({name: F.col(f"{name}.value"), f"{name}_error": F.col(f"{name}.error")})


def hashing_encoder(dim: int = 64) -> Encode:
    """Deterministic stand-in: signed counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return out

    return encode
