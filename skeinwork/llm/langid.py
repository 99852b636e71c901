"""Language identification with a string kernel.

The kernel counts the character n-grams of one to three letters (a blended spectrum) that two texts
have both, each once, over the n-grams of the landmark texts, and is normalised to 1 for equal
texts. Landmarks, training texts stratified by language, give Nyström features; kernel ridge
regression on them, one language against the rest, gives each language's score. Prediction is a
product of the presence matrix of a batch with the landmarks' and another with the weights.

The classifier is fitted on a bounded sample of distinct texts: at most ``per_class`` texts of each language, of longer ones a stretch of
``max_chars`` characters (where it begins follows from a hash of the text), the first ``landmarks`` of them (by a hash of the text) being landmarks, and
at most ``vocabulary`` n-grams, those of the most landmarks. With many languages each has fewer texts, so that they
are about ``sample`` and ``marks`` in all; every language keeps one at least, so none is left out. Everything predicted
uses whole texts.

Cases: texts that are null or have no letter: `und`, score 0; no labelled row at all: `und`, score 0;
a language with a single text is learned, however often its row is repeated, however long it is and however large the others are; ties in score: the first language by name; repeated rows are
predicted alike; very long texts are read in runs; an empty table gives an empty result; other columns pass through,
but columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm._shared import discard, maybe_broadcast, spare_name, stage

UNKNOWN = "und"
TABLE = 1 << 20


@dataclass(frozen=True)
class Bounds:
    """Fixed sizes of the sample that is fitted."""

    per_class: int = 300
    landmarks: int = 48  # of each language
    sample: int = 20_000
    marks: int = 4096
    max_chars: int = 20_000
    vocabulary: int = 8192
    ridge: float = 1e-3


def _codes(text: str) -> list[np.ndarray]:
    """Hashed codes of the n-grams of one to three characters."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        h = (h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append((h >> np.uint64(44)).astype(np.int64))
    return out


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # by code: the n-gram's column, or the count of columns if it is no landmark's
    landmarks: np.ndarray  # columns x landmarks, scaled to unit length
    weights: np.ndarray  # landmarks x languages

    def presence(self, texts: list[str]) -> np.ndarray:
        width = self.landmarks.shape[0] + 1
        seen = np.zeros((len(texts), width), np.uint8)
        for row, text in zip(seen, texts):
            for at in range(0, max(1, len(text)), 1 << 18):  # overlaps by two, so no n-gram is missed
                for codes in _codes(text[max(0, at - 2) : at + (1 << 18)]):
                    row[self.column[codes]] = 1
        return seen[:, :-1].astype(np.float32)

    def features(self, texts: list[str]) -> np.ndarray:
        p = self.presence(texts)
        return (p @ self.landmarks) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.features(texts) @ self.weights


def fit_texts(samples: dict[str, list[str]], bounds: Bounds = Bounds()) -> Model:
    """Fit on texts by language."""
    languages = sorted(samples)
    marks = [t for lang in languages for t in samples[lang][: bounds.landmarks]]
    held = np.zeros(TABLE, np.int32)
    for t in marks:
        held[np.unique(np.concatenate(_codes(t)))] += 1
    chosen = np.argsort(-held, kind="stable")[: min(bounds.vocabulary, int((held > 0).sum()))]
    column = np.full(TABLE, len(chosen), np.int32)
    column[chosen] = np.arange(len(chosen))
    model = Model(languages, column, np.zeros((len(chosen), 0), np.float32), np.zeros((0, len(languages)), np.float32))
    p = model.presence(marks)
    model.landmarks = np.ascontiguousarray((p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))).T)
    values, vectors = np.linalg.eigh(model.features(marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    texts = [t for lang in languages for t in samples[lang]]
    target = np.concatenate([np.where(np.array(languages) == lang, 1.0, -1.0)[None].repeat(len(samples[lang]), 0) for lang in languages])
    sizes = np.array([len(samples[lang]) for lang in languages for _ in samples[lang]], float)
    nystroem = np.concatenate([model.features(texts[at : at + 256]) for at in range(0, len(texts), 256)]).astype(np.float64) @ root
    weighted = nystroem / sizes[:, None]  # each language weighs the same
    solved = np.linalg.solve(weighted.T @ nystroem + bounds.ridge * np.eye(root.shape[1]), weighted.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def stretch(text: Column, most: int) -> Column:
    """The text, or of a longer one `most` characters from a place given by its hash; from its first letter on if none is there."""
    at = F.pmod(F.xxhash64(text), (F.length(text) - most + 1).cast("long")).cast("int") + 1
    part = F.substring(text, at, F.lit(most))
    return F.when(F.length(text) <= most, text).when(part.rlike(r"\p{L}"), part).otherwise(F.substring(text, F.regexp_instr(text, F.lit(r"(\p{L})")), F.lit(most)))


def fit(training: DataFrame, text: str, lang: str, bounds: Bounds = Bounds()) -> Model | None:
    """Fit on a sample of the distinct texts of each language, chosen by a hash of the text alone."""
    rows = training.select(stretch(F.col(text), bounds.max_chars).alias("t"), F.col(lang).alias("l")).filter(F.col("t").rlike(r"\p{L}") & F.col("l").isNotNull())
    counts = stage(rows.select("l", F.xxhash64("t").alias("h")).distinct().groupBy("l").count(), "langid-counts")  # a row a language, of distinct texts
    n = counts.count()
    if not n:
        return None
    bounds = replace(bounds, per_class=max(1, min(bounds.per_class, bounds.sample // n)), landmarks=max(1, min(bounds.landmarks, bounds.marks // n)))
    spread = 1 << 30
    # a share of each language's hash range that holds about twice the texts wanted and 50 more; all of a small language's
    share = F.least(F.lit(1.0), (2 * bounds.per_class + 50) / F.col("count")) * spread
    place = F.pmod(F.xxhash64("t"), F.lit(spread))
    some = rows.withColumn("p", place).join(maybe_broadcast(counts, 64), "l").filter(F.col("p") < share)
    ordered = Window.partitionBy("l").orderBy("p", "t")
    taken = some.select("l", "t", "p").distinct().withColumn("n", F.row_number().over(ordered)).filter(F.col("n") <= bounds.per_class)
    samples: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["p"], r["l"], r["t"])):  # about `sample` rows at most
        samples.setdefault(r["l"], []).append(r["t"])
    discard(counts)
    return fit_texts(samples, bounds)


def predict(df: DataFrame, model: Model | None, text: str = "text", batch: int = 128) -> DataFrame:
    """Append lang_pred and score to every row, from the text alone; columns of these names are replaced."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)  # TABLE + vocabulary x landmarks numbers, whatever the input

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def classify(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for known, texts in parts:
            names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = np.flatnonzero(known.to_numpy())
            values = texts.to_numpy()
            for at in range(0, len(rows), batch):
                some = rows[at : at + batch]
                s = m.scores([values[i] for i in some])
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                best = s.argmax(axis=1)
                for i, b in zip(some, best):
                    names[i] = m.languages[b]
                sure[some] = e[np.arange(len(some)), best] / e.sum(axis=1)
            yield pd.DataFrame({"lang_pred": names, "score": sure})

    got = classify(letters, F.col(text))
    held = spare_name(df.columns, "lang")
    return df.withColumn(held, got).select(*(F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")), f"{held}.lang_pred", f"{held}.score")


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3
