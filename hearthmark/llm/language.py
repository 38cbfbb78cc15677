"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from its code point. A three-letter window binds its letters' vectors,
permuted by their place, into one product; a document bundles (sums) its windows, and a language's prototype bundles its
documents' unit vectors. The mean prototype, common to all languages, is taken off before documents and prototypes are
compared by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import held_out, stored

WIDTH, SYMBOLS, SHARP = 384, 4096, 24.0


@cache
def symbols() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter; letters below U+0250 keep one each, later ones share by remainder."""
    table = np.zeros(0x110000, np.int16)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c if c < 0x250 else 0x250 + c % (SYMBOLS - 0x250)
    return table


@cache
def letters(width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter vectors, permuted twice, once and not at all."""
    base = (np.random.default_rng(7).integers(0, 2, (SYMBOLS, width)) * 2 - 1).astype(np.int8)
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def bundle(text: str | None, width: int = WIDTH) -> np.ndarray | None:
    """The unit vector of a text; None if it is null or has no letter."""
    if not text:
        return None
    own = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not own.any():
        return None
    own = np.concatenate([[0], own, [0]]).astype(np.int64)
    own = own[(own != 0) | (np.concatenate([[1], own[:-1]]) != 0)]  # what is no letter becomes one gap
    codes, times = np.unique((own[:-2] * SYMBOLS + own[1:-1]) * SYMBOLS + own[2:], return_counts=True)
    a, b, c = letters(width)
    out = np.zeros(width, np.float32)
    for i in range(0, len(codes), 4096):
        part = codes[i : i + 4096]
        bound = a[part // SYMBOLS**2] * b[part // SYMBOLS % SYMBOLS] * c[part % SYMBOLS]
        out += times[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
    norm = math.sqrt(float(out @ out))
    return out / np.float32(norm) if norm else out


def profiles(docs: DataFrame, text_col: str = "text", out_col: str = "hv") -> DataFrame:
    """Adds each document's unit vector as float16 bytes, null where there is no letter."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := bundle(t)) is None else v.astype("<f2").tobytes())

    return docs.withColumn(out_col, run(F.col(text_col)))


def fit(train: DataFrame, lang_col: str = "lang", hv_col: str = "hv") -> dict[str, np.ndarray]:
    """Prototypes by language from all rows with a language and a vector.

    Every task sums its own documents to one vector a language, and Spark adds those up: one vector a language reaches
    the driver.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, hv in zip(frame["lang"], frame["hv"], strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(hv, "<f2").astype(np.float64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "pos": range(len(v)), "v": v})

    rows = train.filter(F.col(lang_col).isNotNull() & F.col(hv_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(hv_col).alias("hv"))
    parts = rows.mapInPandas(partial, "lang string, pos int, v double")
    protos: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "pos").agg(F.sum("v").alias("v")).collect():  # languages times the vectors' width
        protos.setdefault(r["lang"], np.zeros(WIDTH))[r["pos"]] = r["v"]
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(protos.items())}


def predict(rows: DataFrame, prototypes: dict[str, np.ndarray], hv_col: str = "hv") -> DataFrame:
    """Adds lang_pred and score: the nearest prototype by cosine, and its share of a softmax over the cosines.

    Equal cosines go to the first language by name. Without a vector, or without any prototype: und with score 0.
    """
    names = list(prototypes)
    mean = np.mean([*prototypes.values()], axis=0) if len(names) > 1 else np.zeros(WIDTH)
    table = np.array([(v - mean) / (np.linalg.norm(v - mean) or 1) for v in prototypes.values()])

    @F.pandas_udf("lang_pred string, score double")
    def run(hvs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": "und", "score": 0.0}, index=hvs.index)
        there = hvs.notna()
        if names and there.any():
            x = np.stack([np.frombuffer(h, "<f2") for h in hvs[there]]).astype(np.float64) - mean
            cos = (x @ table.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            p = np.exp(SHARP * (cos - cos.max(axis=1, keepdims=True)))
            out.loc[there, "lang_pred"] = np.array(names, object)[cos.argmax(axis=1)]
            out.loc[there, "score"] = 1 / p.sum(axis=1)
        return out

    return rows.withColumn("_p", run(F.col(hv_col))).select("*", "_p.*").drop("_p")


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learns only from rows that are not held out.

    Repeated rows give repeated rows; no rows give no rows; other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), "lang", "text")
    rows = stored(profiles(slim).select("doc_id", "lang", held_out().alias("held_out"), "hv"), "profiles")
    return predict(rows, fit(rows.filter("not held_out"))).select("doc_id", "held_out", "lang_pred", "score")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language; und where the text is null or has no letter."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
