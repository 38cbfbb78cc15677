"""Portal cards to listings, listings into a kept table, panels merged from several sources, and items of two authors merged."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.fold import folded

# fixed values: names of kinds of houses, and the forms of areas, house numbers and years
KINDS = {
    "terrace house": "terrace", "terraced house": "terrace", "corner terrace": "terrace", "semi-detached house": "semi_d", "semi detached house": "semi_d", "detached house": "detached",
    "bungalow": "bungalow", "good class bungalow": "gcb", "cluster house": "cluster", "land only": "land", "landed": "terrace",
}
AREA = r"(?i)([0-9,.]+)\s*sqft(?:\s*\((land|floor|built[\s-]?up)\))?"
HOUSE, YEAR = r"^[0-9]+[A-Z]?\s+", r"((?:19|20)[0-9]{2})"


def number(text: Column) -> Column:
    """What digits and points a text holds, as a double; null if they make none."""
    return F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit("")).try_cast("double")


def tenure_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("freehold"), "freehold").when(low.contains("999"), "999").when(low.contains("99"), "99").otherwise("unknown")


def card_normalize(cards: DataFrame) -> DataFrame:
    """One row a card, with reject: not_listing or rent, else null and the listing's fields.

    Only an area marked as land is land and gives a price a square foot of land; any other is built-up, and the listing warns that its land is
    unconfirmed. warns: area_unconfirmed or no_area, tenure_unknown, joined by commas."""
    reject = F.when(F.coalesce(F.col("card_kind"), F.lit("listing")) != "listing", "not_listing").when(F.coalesce("price", F.lit("")).contains("/mo"), "rent")
    size = F.nullif(F.regexp_extract("area", AREA, 1), F.lit(""))
    marked = F.nullif(F.regexp_replace(F.lower(F.regexp_extract("area", AREA, 2)), "[ -]", ""), F.lit(""))
    low = F.lower(F.trim(F.coalesce("property_type", F.lit(""))))
    kind = F.nullif(low, F.lit(""))
    for name, code in KINDS.items():
        kind = F.when(low == name, code).otherwise(kind)
    rows = cards.withColumn("reject", reject).withColumn("size", number(size)).withColumn("area_kind", marked).withColumn("asked", number(F.col("price")))
    land, held = F.col("area_kind").eqNullSafe("land"), F.coalesce(F.col("size") != 0, F.lit(False))
    street = F.coalesce(F.nullif(F.regexp_replace(F.trim(F.coalesce("address", F.lit(""))), HOUSE, ""), F.lit("")), F.col("title"))
    fields = {
        "street": street, "type": kind, "price": F.col("asked"), "tenure": tenure_of(F.col("tenure")), "beds": F.when(F.col("bedrooms").rlike("^[0-9]+$"), F.col("bedrooms").try_cast("int")), "built_year": F.nullif(F.regexp_extract("completion_year", YEAR, 1), F.lit("")).try_cast("int"),
        "land_sqft": F.when(land, F.col("size")), "land_psf": F.when(land & held & (F.col("asked") != 0), F.round(F.col("asked") / F.col("size"))), "builtup_sqft": F.when(~land & held, F.col("size")), "floor_psf": F.when(~land & held, F.nullif(number(F.col("price_psf")), F.lit(0.0))),
        "warns": F.concat_ws(",", F.when(~land, F.when(held, "area_unconfirmed").otherwise("no_area")), F.when(tenure_of(F.col("tenure")) == "unknown", "tenure_unknown")),
    }
    return rows.select(F.col("listing_id").alias("id"), "reject", *(F.when(F.col("reject").isNull(), c).alias(n) for n, c in fields.items()))


def import_listings(kept: DataFrame, pulled: DataFrame, judged: list[str], areas: list[str]) -> DataFrame:
    """The kept table after a pull, with status new, updated or missing. What people have judged stays as it is where it is set, an area that they
    have set stays where the pull has none, all else is the pull's. A listing that the pull lacks stays whole: whether it is stale is for people.
    Both tables have one row an id; a pull may lack judged columns."""
    names = [c for c in dict.fromkeys(kept.columns + pulled.columns) if c != "id"]
    rows = kept.select("id", F.struct(*(c for c in kept.columns if c != "id")).alias("k")).join(pulled.select("id", F.struct(*(c for c in pulled.columns if c != "id")).alias("p")), "id", "full")

    def pick(c: str) -> Column:
        old = F.col("k")[c] if c in kept.columns else F.lit(None)
        new = F.col("p")[c] if c in pulled.columns else F.lit(None)
        merged = F.coalesce(old, new) if c in judged else F.coalesce(new, old) if c in areas or c not in pulled.columns else new
        return F.when(F.col("p").isNull(), old).otherwise(merged).alias(c)

    status = F.when(F.col("k").isNull(), "new").when(F.col("p").isNull(), "missing").otherwise("updated")
    return rows.select("id", status.alias("status"), *map(pick, names))


def import_counts(cards: DataFrame, merged: DataFrame) -> DataFrame:
    """(what, n): rejects by reason, warnings by code, listings by status."""
    rejects = cards.filter("reject IS NOT NULL").select(F.concat(F.lit("reject:"), "reject").alias("what"))
    warns = cards.filter("reject IS NULL").select(F.explode(F.split("warns", ",")).alias("w")).filter("w <> ''").select(F.concat(F.lit("warn:"), "w").alias("what"))
    return rejects.unionAll(warns).unionAll(merged.select(F.concat(F.lit("status:"), "status").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


def panel_merge(sources: list[DataFrame], name: str = "project", order: str = "seq") -> DataFrame:
    """One row a name without case and outer blanks: in each column the last value that is not null, by source, then by order.

    A source that must only fill gaps stands before those that it must not overrule. One aggregation with map-side combine; a source
    lacks the columns that it does not know. Equal orders within a source go to the greater value. sources counts those that knew the name."""
    columns = [c for c in dict.fromkeys(c for s in sources for c in s.columns) if c not in (name, order)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)))
    rows = rows.withColumn("_key", F.lower(F.trim(F.col(name)))).filter("_key <> ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_rank", order, c))).alias(c)
    shown = F.min_by(F.trim(F.col(name)), F.struct("_rank", order, name)).alias(name)
    return rows.groupBy("_key").agg(shown, *map(last, columns), F.count_distinct("_rank").alias("sources")).drop("_key")


def street_base(name: Column, areas: list[str]) -> Column:
    """A street without its area in brackets and with its kind: two spellings of one street are equal. Names that hold "nearby" are scopes, not streets, and stay."""
    low = F.lower(F.trim(F.regexp_replace(name, r"\s*\((" + "|".join(map(re.escape, areas)) + r")\)$", "")))
    return F.when(F.lower(name).contains("nearby"), F.lower(F.trim(name))).when(low.endswith("road") | low.endswith("avenue"), low).otherwise(F.concat(low, F.lit(" road")))


def street_panel(rows: DataFrame, areas: list[str]) -> DataFrame:
    """One row a street of rows (street, kind pp or txn, address, date, price, psf, seq): the name seen first, distinct rows by address, date
    and price of each kind, and the span of the panel's prices. Of equal rows the first by seq counts."""
    rows = rows.withColumn("base", street_base(F.col("street"), areas))
    names = rows.groupBy("base").agg(F.min_by("street", F.struct("seq", "street")).alias("street"))
    kept = rows.groupBy("base", "kind", "address", "date", "price").agg(F.min_by("psf", F.struct("seq", "psf")).alias("psf"))
    pp = (F.col("kind") == "pp") & F.col("psf").isNotNull() & (F.col("psf") != 0)
    out = kept.groupBy("base").agg(F.count_if(pp).alias("n_pp"), F.count_if(F.col("kind") == "txn").alias("n_txn"), F.min(F.when(pp, F.col("psf"))).alias("psf_low"), F.max(F.when(pp, F.col("psf"))).alias("psf_high"))
    return names.join(out, "base")


class Items:
    """One subject's items: generated ones in order, each taken over by the first unused authored one on its topic."""

    def __init__(self, rules: list[tuple[str, str]], superseded: dict[str, str]):
        self.rules, self.superseded, self.tool, self.authored, self.subject = rules, superseded, [], [], None

    def step(self, row: dict) -> list[dict]:
        self.subject = row["subject"]
        (self.tool if row["origin"] == "tool" else self.authored).append(row["item"] or "")
        return []

    def over(self, text: str) -> str | None:
        return next((why for head, why in self.superseded.items() if text.startswith(head)), None)

    def topics(self, text: str, side: int) -> set[int]:
        return {i for i, rule in enumerate(self.rules) if rule[side].lower() in text.lower()}

    def end(self) -> list[dict]:
        out, used = [], set()
        about = [set() if self.over(a) else self.topics(a, 0) for a in self.authored]
        for t in self.tool:
            mine = self.topics(t, 1)
            hit = next((i for i, a in enumerate(about) if i not in used and a & mine), None)
            used |= {hit} - {None}
            out.append((t, "tool", None) if hit is None else (self.authored[hit], "authored", None))
        for i, a in enumerate(self.authored):
            if i not in used:
                out.append((a, "superseded" if self.over(a) else "authored", self.over(a)))
        return [{"subject": self.subject, "n": i + 1, "item": item, "source": source, "note": note} for i, (item, source, note) in enumerate(out)]


def merge_items(items: DataFrame, rules: list[tuple[str, str]], superseded: dict[str, str]) -> DataFrame:
    """(subject, n, item, source, note) of items (subject, origin tool or authored, pos, item): generated items with those on one topic replaced
    by what a person wrote, then what only people wrote, superseded ones marked by a note and never used as a replacement.

    rules pairs a word of an authored item with one of a generated item. A subject's items stay in memory of one task."""
    ordered = items.withColumn("origin", F.when(F.col("origin") == "tool", "tool").otherwise("written"))
    return folded(ordered, ["subject"], ["origin", "pos", "item"], lambda: Items(rules, superseded), "subject long, n int, item string, source string, note string")


def digest_rows(rows: DataFrame, by: str, k: int = 12) -> DataFrame:
    """The k newest rows of each subject with amounts as text, rank from 1; ties by the greatest amount, then by id."""
    order = Window.partitionBy(by).orderBy(F.desc("date"), F.desc("amount"), "id")
    text = F.concat(F.when(F.col("amount") < 0, "-").otherwise(""), F.lit("S$"), F.format_number(F.abs("amount"), 0))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(by, "rank", "date", text.alias("shown"))
