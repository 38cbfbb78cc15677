"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph hashes to a wide vector: EXACT lanes of 64 random bits, and LANES small counters into which its character
windows are thrown with random signs. A document is the sum of its paragraphs' vectors, lane by lane modulo 2^64 and
2^32. Sums commute, so paragraph order does not matter, and a paragraph is inserted or deleted by adding or subtracting
its vector. The squared distance of two counter parts estimates how many windows differ, which gives a likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import partitions, range_bucket

EXACT, LANES, WINDOW = 4, 128, 16
DIGITS = 16 * EXACT + 8 * LANES
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def paragraphs(text: str) -> list[str]:
    """Lines without outer white space; blank lines do not count."""
    return [p for p in map(str.strip, text.split("\n")) if p]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The exact lanes (uint64) and counters (uint32) of a text: the sum over its paragraphs; zeros for an empty text."""
    parts = paragraphs(text or "")
    exact, counters = np.zeros(EXACT, np.uint64), np.zeros(LANES, np.uint32)
    if not parts:
        return exact, counters
    digests = b"".join(hashlib.blake2b(p.encode(), digest_size=8 * EXACT).digest() for p in parts)
    exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    # all paragraphs in one row of code points, each followed by a gap as long as a window, so that windows never cross
    joined = np.frombuffer(("".join(p + "\0" * WINDOW for p in parts)).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum([0] + [len(p) + WINDOW for p in parts[:-1]])
    h = np.zeros(len(joined) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = h * _ODD + joined[i : len(joined) - WINDOW + 1 + i]
    lengths = np.array([len(p) for p in parts])
    windows = np.maximum(lengths - WINDOW + 1, 1)  # a short paragraph is one window
    ends = np.cumsum(windows)
    h = _mix(h[np.repeat(starts - (ends - windows), windows) + np.arange(ends[-1])])
    lane, sign = (h & np.uint64(LANES - 1)).astype(np.int64), ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    sums = 2 * np.bincount(lane, weights=sign, minlength=LANES).astype(np.int64) - np.bincount(lane, minlength=LANES)
    return exact, (sums & 0xFFFFFFFF).astype(np.uint32)


def to_hex(v: tuple[np.ndarray, np.ndarray]) -> str:
    return v[0].astype("<u8").tobytes().hex() + v[1].astype("<u4").tobytes().hex()


def from_hex(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw, "<u8", EXACT), np.frombuffer(raw, "<u4", LANES, 8 * EXACT)


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint after inserting (sign 1) or deleting (sign -1) the paragraphs that b fingerprints."""
    (x, u), (y, v) = from_hex(a), from_hex(b)
    return to_hex((x + y, u + v) if sign > 0 else (x - y, u - v))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else 1 less the squared distance of the counters over the sum of their squares, 0 to 1."""
    if all(map(np.array_equal, a, b)):
        return 1.0
    u, v = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    apart = (a[1] - b[1]).view(np.int32).astype(np.float64)
    both = u @ u + v @ v
    return float(min(1.0, max(0.0, 1 - apart @ apart / both))) if both else 0.0


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a hex string; a null text counts as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_hex(vector(t)))

    return run(F.coalesce(text, F.lit("")))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (bucket, tail, doc_id descending); each is compared with the row that follows in its bucket."""
    held = None
    for frame in frames:
        out = []
        for bucket, tail, doc_id, text in zip(frame["bucket"], frame["tail"], frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
            now = (bucket, doc_id, text, vector(text))
            if held and held[0] == bucket:
                _, key, own, v = held
                cut = len(own) // 3
                edited = own[: len(own) - cut] + text[:cut]
                e = vector(edited)
                out.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_hex(v), to_hex(e), likeness(v, e), likeness(v, now[3])))
            held = None if tail else now
        rows = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield rows.assign(doc_id=rows["doc_id"].astype("Int64"))


def compare_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document.

    The next document follows in descending id, rows of equal id in order of text, rows without an id after all others;
    after the last comes the first. A null text counts as empty; other columns are left out. A lone document is its own
    next. No rows give no rows. Documents are range-partitioned by id; only the first row of each range is copied, to
    the range before it.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(spark)
    bucketed = slim.withColumn("bucket", range_bucket(slim, "doc_id", n))
    # the first document of each range, in the order of the walk: n rows at most
    firsts = [r for r in bucketed.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()]
    order = sorted((r["bucket"] for r in firsts), reverse=True)
    lead = {r["bucket"]: r["first"] for r in firsts}
    heads = [(b, lead[b], order[i - 1]) for i, b in enumerate(order)]  # a range's first row is the tail of the range before it
    if not heads:
        return spark.createDataFrame([], OUT)
    heads = F.broadcast(spark.createDataFrame(heads, "own int, head long, bucket int"))
    copies = bucketed.withColumnRenamed("bucket", "own").join(heads, "own").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    # of rows with the same first id only the least text is the tail
    tails = copies.groupBy("bucket", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "bucket", F.lit(1).alias("tail"))
    rows = bucketed.select("doc_id", "text", "bucket", F.lit(0).alias("tail")).unionByName(tails)
    placed = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")
    return placed.mapInPandas(_compare, OUT)


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses along descending ids; null texts count as empty."""
    return compare_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
