"""Token streams: typed tokens, fixed-length records, segments and key-value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.fold import folded


def tokens(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, token) by white space."""
    return rows.select(F.col(doc).alias("doc"), F.posexplode(F.filter(F.split(text, r"\s+"), lambda t: t != "")).alias("pos", "token"))


def kind(token: Column) -> Column:
    return F.when(token.rlike(r"^[0-9]+$"), "int").when(token.rlike(r"^[A-Z][a-z]+$"), "capital").when(token.rlike(r"[.!?]$"), "end").when(token.rlike(r"^[a-z]+$"), "word").otherwise("other")


def classify(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", kind(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))


class _Runs:
    """Takes matches of a pattern of kinds from left to right; holds no more tokens than the pattern is long."""

    def __init__(self, pattern: list[str]):
        self.pattern, self.held = pattern, []

    def step(self, row: dict) -> list[dict]:
        self.held.append(row)
        if len(self.held) < len(self.pattern):
            return []
        if [r["k"] for r in self.held] != self.pattern:
            self.held.pop(0)
            return []
        found, self.held = self.held, []
        return [{"doc": found[0]["doc"], "pos": found[0]["pos"], "record": " ".join(r["token"] for r in found)}]

    def end(self) -> list[dict]:
        return []


def records(rows: DataFrame, pattern: list[str]) -> DataFrame:
    """Runs of consecutive tokens whose kinds match a pattern, from left to right, none overlapping one that was taken."""
    typed = rows.select("doc", "pos", "token", kind(F.col("token")).alias("k"))
    return folded(typed, ["doc"], ["pos"], lambda: _Runs(pattern), "doc long, pos int, record string")


def segments(rows: DataFrame) -> DataFrame:
    """Variable-length segments, each opened by a capitalised token: running count of openings, then first matches."""
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    typed = rows.withColumn("k", kind(F.col("token"))).withColumn("segment", F.sum(F.when(F.col("k") == "capital", 1).otherwise(0)).over(order)).filter("segment > 0")
    return typed.groupBy("doc", "segment").agg(F.count("*").alias("n"), F.min_by("token", "pos").alias("head"), F.min(F.when(F.col("k") == "end", F.col("pos"))).alias("end_pos"))


def kv_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The token after the first of each key, one column a key."""
    nxt = F.lead("token").over(Window.partitionBy("doc").orderBy("pos"))
    return rows.withColumn("next", nxt).filter(F.col("token").isin(keys)).groupBy("doc").agg(*(F.min_by("next", F.when(F.col("token") == k, F.col("pos"))).alias(f"v_{k}") for k in keys))


def doc_guard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc").agg(F.count("*").alias("n"), (F.sum(F.when(kind(F.col("token")) == "end", 1).otherwise(0)) > 0).alias("has_end"))
