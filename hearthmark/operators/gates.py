"""Gates of finished records: what a record must hold before it is shown, each as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.columns import bsd

# fixed values: how texts cite the estimate, the duty and the instalment, broken encodings, and marks of first-hand rows
PRICE_CITED, PSF_CITED = r"点估[（(]?[^0-9$]{0,8}S[$]([0-9,]{7,})", r"点估[^0-9$]{0,6}~?S?[$]?([0-9,]{4,5}) psf"
DUTY = r"BSD（点估 S[$]([0-9,]+)）≈ S[$]([0-9,]+)"
LOAN = r"75% LTV @([0-9.]+)% 固定 ≈ S[$]([0-9,]+)/mo"
BROKEN = ("�", "â€", "锘", "ï¼")
FIRST_HAND = ("Investment Suite", "URA", "caveat", "Tower View", "Profitability", "Sale", "卖出腿", "REALIS")
FIELDS = ["name", "size_sqft", "estimate_psf", "estimate_price", "low_psf", "high_psf", "params_note", "asof", "summary"]


def cited(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: F.regexp_replace(s, ",", "").try_cast("long"))


def quality_gates(records: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, gate, ok) of records (id, FIELDS, cost_stack, allowed_psf array) and their comparables (id, price, psf, size_sqft, note).

    A gate whose figures are not there gives no row: price and range without an estimate, duty and instalment where the costs do not cite them.
    allowed_psf are the figures that may stand next to the estimate besides itself and its band. Comparables are counted per record first.
    """
    off = F.abs(F.col("price") - F.col("psf") * F.col("size_sqft")) / F.col("price") > 0.02
    marked = F.exists(F.array(*map(F.lit, FIRST_HAND)), lambda w: F.coalesce("note", F.lit("")).contains(w))
    counts = comps.groupBy("id").agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"), F.count_if(~marked).alias("n_unmarked"))
    rows = records.join(counts, "id", "left").fillna(0, ["n", "n_off", "n_unmarked"])
    texts = F.concat_ws("\n", "name", "summary", "params_note", "cost_stack")
    psf, price = F.col("estimate_psf"), F.col("estimate_price")
    low, high = F.coalesce("low_psf", F.lit(0.0)), F.coalesce("high_psf", F.lit(1e9))
    whole = lambda c: F.floor(F.coalesce(c, F.lit(0.0))).cast("long")
    allowed = F.concat(F.array(whole(psf), whole(F.col("low_psf")), whole(F.col("high_psf"))), F.transform(F.coalesce("allowed_psf", F.array().cast("array<double>")), whole))
    stale = F.exists(cited(texts, PRICE_CITED), lambda n: (n >= 100_000) & (n != whole(price))) | ((whole(psf) != 0) & F.exists(cited(texts, PSF_CITED), lambda n: n.between(500, 20_000) & ~F.array_contains(allowed, n)))
    costs = F.coalesce("cost_stack", F.lit(""))
    figure = lambda pattern, i: F.nullif(F.regexp_replace(F.regexp_extract(costs, pattern, i), ",", ""), F.lit("")).try_cast("double")
    base, duty, rate, paid = figure(DUTY, 1), figure(DUTY, 2), figure(LOAN, 1) / 1200, figure(LOAN, 2)
    both = psf.isNotNull() & price.isNotNull()
    gates = {
        "fields": F.forall(F.array(*(F.col(c).isNotNull() for c in FIELDS)), lambda f: f),
        "price_is_psf_by_size": F.when(both & (F.col("size_sqft") != 0), F.abs(price - psf * F.col("size_sqft")) <= 2000),
        "point_in_range": F.when(both & (F.col("size_sqft") != 0), psf.between(low, high)),
        "one_estimate": F.when(price.isNotNull(), ~stale),
        "duty": F.when(price.isNotNull() & base.isNotNull(), (base == whole(price)) & (F.abs(duty - F.round(bsd(base))) <= 1)),
        "instalment": F.when(price.isNotNull() & paid.isNotNull(), F.abs(paid - price * 0.75 * rate / (1 - F.pow(1 + rate, F.lit(-360)))) <= 2),
        "count_in_note": F.coalesce(F.col("params_note").contains(F.concat(F.col("n").cast("string"), F.lit(" 笔"))), F.lit(False)),
        "encoding": ~F.exists(F.array(*map(F.lit, BROKEN)), lambda w: texts.contains(w)),
        "asterisks": ~texts.contains("**"),
        "placeholders": ~texts.contains("TODO"),
        "rows_arithmetic": F.col("n_off") == 0,
        "provenance": F.col("n_unmarked") == 0,
    }
    long = rows.select("id", F.explode(F.array(*(F.struct(F.lit(name).alias("gate"), ok.alias("ok")) for name, ok in gates.items()))).alias("g"))
    return long.select("id", "g.gate", "g.ok").filter("ok IS NOT NULL")
