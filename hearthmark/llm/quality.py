"""Quality classifier: a regularised quadratic discriminant on transformed statistics of whole documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import held_out, stored

NAMES = ["words", "word_len", "word_len_sd", "upper", "digit", "symbol", "stop_comma", "pipe", "other", "bare_symbols", "distinct", "top_word", "top_tail", "upper_words", "lines", "repeat_lines", "line_end", "capital_lines", "pairs"]
SHRINK, THRESHOLD = 0.1, 0.3
UPPER, LOWER, DIGIT, SPACE, STOP, PIPE, SYMBOL, OTHER = range(8)


@cache
def classes() -> np.ndarray:
    """Code point to character class."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        table[c] = UPPER if s.isupper() else LOWER if s.isalpha() else DIGIT if s.isnumeric() else SPACE if s.isspace() else STOP if s in ".,;:!?'\"()-" else PIPE if s == "|" else SYMBOL
    return table


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, logged where they are counts or shares; zeros stand for an empty text's shares."""
    text = text or ""
    n = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=8)
    words, lines = text.split(), [x for x in map(str.strip, text.split("\n")) if x]
    count, size = max(1, len(words)), max(1, len(text))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    common = Counter(words)
    tails = Counter(w[-2:] for w in words if not w[-1].isalnum())
    share = lambda x, of: np.log(x / of + 0.003)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return np.array([
        np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), share(n[UPPER], size), share(n[DIGIT], size), share(n[SYMBOL], size), share(n[STOP], size), share(n[PIPE], size), share(n[OTHER], size),
        share(sum(not any(map(str.isalnum, w)) for w in common), max(1, len(common))), len(common) / count, share(max(common.values(), default=0), count), share(max(tails.values(), default=0), count),
        share(sum(c for w, c in common.items() if w.isupper() and len(w) > 1), count), np.log1p(len(words) / max(1, len(lines))), share(len(lines) - len(set(lines)), max(1, len(lines))), share(sum(x[-1] in ".!?" for x in lines), max(1, len(lines))), share(sum(x[0].isupper() for x in lines), max(1, len(lines))), pairs / max(1, len(words) - 1),
    ])


def features(docs: DataFrame, text_col: str = "text", out_col: str = "x") -> DataFrame:
    """Adds the statistics of each whole text as an array of doubles."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.withColumn(out_col, run(F.col(text_col)))


def fit(rows: DataFrame, label_col: str = "label", x_col: str = "x", shrink: float = SHRINK) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For labels 0 and 1: mean, inverse Cholesky factor of the shrunk covariance, and log prior less half log determinant.

    Tasks sum counts, first and second moments, Spark adds those up, and two small matrices reach the driver. Class
    covariances shrink towards their pooled diagonal. Without rows of both labels the result is empty.
    """
    d = len(NAMES)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, d + 1, d + 1))
        for frame in frames:
            x = np.column_stack([np.ones(len(frame)), np.stack(frame["x"])]) if len(frame) else np.zeros((0, d + 1))
            for label in (0, 1):
                own = x[frame["label"].to_numpy() == label]
                sums[label] += own.T @ own
        yield pd.DataFrame({"i": np.arange(2 * (d + 1) ** 2), "v": sums.ravel()})

    parts = rows.filter(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), F.col(x_col).alias("x")).mapInPandas(partial, "i int, v double")
    sums = np.zeros((2, d + 1, d + 1))
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # 2 (d + 1)^2 numbers
        sums.ravel()[r["i"]] = r["v"]
    n = sums[:, 0, 0]
    if not n.all():
        return []
    means = sums[:, 0, 1:] / n[:, None]
    covs = [sums[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag((n[0] * covs[0] + n[1] * covs[1]) / n.sum())
    pooled = np.maximum(pooled, 1e-4)
    out = []
    for k in (0, 1):
        low = min(1.0, shrink + d / (d + n[k]))
        factor = np.linalg.cholesky((1 - low) * covs[k] + low * np.diag(pooled))
        out.append((means[k], np.linalg.inv(factor), float(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())))
    return out


def score(rows: DataFrame, model: list, x_col: str = "x", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, the posterior of label 1 from the difference of Mahalanobis log densities, and predicted.

    The Cholesky factors are computed once and travel with the function. Without a model every score is 0.5.
    """

    @F.pandas_udf("double")
    def run(xs: pd.Series) -> pd.Series:
        if not model:
            return pd.Series(0.5, index=xs.index)
        x = np.stack(xs) if len(xs) else np.zeros((0, len(NAMES)))
        logs = [c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, c in model]
        return pd.Series(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), index=xs.index)

    return rows.withColumn("score", run(F.col(x_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns only from labelled rows that are not held out.

    A null text counts as empty; null labels and labels other than 0 and 1 are left out, and a document with several
    labels counts once with each distinct one; repeated documents give repeated rows; no rows give no rows. Labels,
    language, source and id are no inputs of a score.
    """
    rows = stored(features(docs.select(F.col(id_col).alias("doc_id"), "text")).select("doc_id", held_out().alias("held_out"), "x"), "features")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("label")).filter("label in (0, 1)").distinct()
    train = rows.filter("not held_out").join(marks, "doc_id")
    return score(rows, fit(train)).select("doc_id", "held_out", "score", "predicted")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score; null texts count as empty, null labels are left out."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
