"""Preference formatting of chosen and rejected conversations, in DataFrame operations alone.

The longest common turn prefix is rendered once as the prompt; what follows on each side is a completion whose trained
spans are the assistant's turns, while the rest of it is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n<|end|>\n"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """Turns as text, their texts verbatim."""
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(END))), "")


def spans(turns: Column) -> Column:
    """Character ranges [start, end) of the assistant's text and end marks in the rendered turns."""
    span = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(header(t))
        end = start + F.length(t["text"]) + len(END)
        own = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(span))
        return F.struct(end.alias("at"), F.concat(done["spans"], own).alias("spans"))

    return F.aggregate(turns, begin, step, lambda done: done["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(places, lambda i: (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"])), F.lit(0)), n)


def conversations(turns: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>): turns by number, then role, then text, nulls first.

    A null role counts as unknown and a null text as empty; rows without an id are one conversation of a null id.
    """
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    clean = F.transform(rows, lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return turns.select(F.col(id_col).alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(clean.alias("turns"))


def preferences(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Turns chosen and rejected (arrays of role and text) into prompt, completions and their trained spans.

    Equal conversations give empty completions; an empty side gives an empty prompt; a null side counts as empty. Other
    columns are kept whatever their names, but for those of the result, which replaces them; repeated rows stay.
    """
    made = ("prefix_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")
    rest = [c for c in pairs.columns if c not in (chosen_col, rejected_col, *made)]
    side = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>"))
    rows = pairs.select(F.struct(F.lit(0).alias("_"), *rest).alias("rest"), side(chosen_col).alias("c"), side(rejected_col).alias("r"))
    rows = rows.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    after = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    rows = rows.select("rest", "n", F.slice("c", 1, F.col("n")).alias("p"), after(F.col("c")).alias("c"), after(F.col("r")).alias("r"))
    out = (F.col("n"), render(F.col("p")), render(F.col("c")), spans(F.col("c")), render(F.col("r")), spans(F.col("r")))
    return rows.select(*(F.col("rest")[c].alias(c) for c in rest), *(x.alias(name) for x, name in zip(out, made, strict=True)))


def swapped_pairs(convs: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: a conversation is chosen over itself up to its last assistant turn,
    with that turn's text taken from the partner (conv_id with its last bit turned).

    Without a partner's text the rejected side ends before the last assistant turn; without an assistant turn both sides
    are equal. A null id has no partner.
    """
    places = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))
    rows = convs.withColumn("last", F.coalesce(F.array_max(places), F.lit(0)))
    answers = rows.filter("last > 0").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("last"))["text"].alias("answer"))
    both = rows.join(answers, "conv_id", "left")
    swap = F.when(F.col("answer").isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    rejected = F.when(F.col("last") > 0, F.concat(F.slice("turns", 1, F.col("last") - 1), swap)).otherwise(F.col("turns"))
    return both.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op3_preferences(spark, sf_dir: str) -> DataFrame:
    """Conversations as preference pairs against their partner's last answer; null roles and texts have defined values."""
    rows = preferences(swapped_pairs(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("conv_id", "prefix_turns", "prompt", "chosen", text(F.col("chosen_spans")).alias("chosen_spans"), "rejected", text(F.col("rejected_spans")).alias("rejected_spans"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN p ELSE 0 END) AS last, max(p) AS n FROM t GROUP BY conv_id),
a AS (SELECT t.conv_id, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.p = l.last),
k AS (
  SELECT l.conv_id, l.last, l.n, o.text AS other,
    CASE WHEN l.last = 0 THEN l.n WHEN o.text = a.text THEN l.last ELSE l.last - 1 END AS prefix
  FROM l LEFT JOIN a ON a.conv_id = l.conv_id LEFT JOIN a AS o ON o.conv_id = xor(l.conv_id, 1)
), r AS (
  SELECT t.conv_id, t.p, t.role, k.prefix, '<|' || t.role || '|>' || chr(10) AS head, t.text || chr(10) || '<|end|>' || chr(10) AS body
  FROM t JOIN k ON t.conv_id = k.conv_id
), s AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, p > prefix ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r
), c AS (
  SELECT conv_id, coalesce(string_agg(CASE WHEN p <= prefix THEN head || body END, '' ORDER BY p), '') AS prompt,
    coalesce(string_agg(CASE WHEN p > prefix THEN head || body END, '' ORDER BY p), '') AS chosen,
    coalesce(string_agg(CASE WHEN p > prefix AND role = 'assistant' THEN CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT) END, ',' ORDER BY p), '') AS chosen_spans
  FROM s GROUP BY conv_id
)
SELECT k.conv_id, CAST(k.prefix AS INTEGER) AS prefix_turns, c.prompt, c.chosen, c.chosen_spans,
  CASE WHEN k.last > 0 AND k.other IS NOT NULL AND k.prefix < k.last THEN '<|assistant|>' || chr(10) || k.other || chr(10) || '<|end|>' || chr(10) ELSE '' END AS rejected,
  CASE WHEN k.last > 0 AND k.other IS NOT NULL AND k.prefix < k.last THEN '14-' || (14 + length(k.other) + 9) ELSE '' END AS rejected_spans
FROM k JOIN c ON k.conv_id = c.conv_id
"""
