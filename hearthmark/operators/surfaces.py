"""One set of sales from several renderings of it: stale copies, imputed attributes, conflicts and near-date duplicates.

Rows are (id, surface, project, block, floor, stack, day, price, psf, area, beds). A null block matches any block: equi joins get that by
exploding a row's block into the tags it can meet under, in place of a join on OR.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.fold import folded

# fixed values
SURFACES = ["sale", "profitability", "towerview"]  # in order of trust
UNKNOWN_BLOCKS = ["", "(single)", "?"]
LEAST_SQFT_A_BED = 200
NEAR_SIZE = 1.15
PRICE_TOLERANCE = 0.02
SAME_SALE_DAYS = 31
UNIT = ["project", "floor", "stack"]


def block_norm(block: Column) -> Column:
    """A block's name, null where it is not known."""
    name = F.trim(block)
    return F.when(~name.isin(UNKNOWN_BLOCKS), name)


def blocks_match(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def bed_count(kind: Column) -> Column:
    """The number of a type such as 3BR, null for all else."""
    return F.regexp_extract(F.upper(F.coalesce(kind, F.lit(""))), r"^([0-9])BR$", 1).try_cast("int")


def strip_stale(rows: DataFrame, least: int = 3, of: Column | None = None) -> DataFrame:
    """Rows that stand identically under several blocks come from a stale screen: one copy stays, with its block unknown.

    With of only the rows for which it holds are looked at. Rows dealt out by project stay where they are.
    """
    of = F.coalesce(of, F.lit(False)) if of is not None else F.lit(True)
    same = Window.partitionBy(*UNIT, "area", "day", "price", "of")
    both = rows.withColumn("of", of)
    both = both.withColumns({"copies": F.count("*").over(same), "blocks": F.size(F.collect_set(F.coalesce("block", F.lit(""))).over(same)), "first": F.min("id").over(same)})
    both = both.withColumn("stale", F.col("of") & (F.col("copies") >= least) & (F.col("blocks") >= least))
    kept = both.filter(~F.col("stale") | (F.col("id") == F.col("first")))
    return kept.withColumn("block", F.when(~F.col("stale"), F.col("block"))).select(rows.columns)


def impute_beds(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """Rows with beds filled in and where from, by the typed rows of another table; see imputed."""
    names = [c for c in rows.columns if c != "beds"]
    told = typed.select(*(F.col(c).cast(rows.schema[c].dataType) if c in (*UNIT, "block", "area") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names), "beds", F.lit(True).alias("typed"))
    both = rows.select(*names, "beds", F.lit(False).alias("typed")).unionByName(told)
    return imputed(both, "typed", keep=("typed",)).filter("NOT typed").drop("typed")


def imputed(rows: DataFrame, typed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with beds filled in and where from: given, unit, size, near or unresolved; typed names the column that says whose beds a unit trusts.

    A count that the area cannot hold is void first. Then comes the count of the same unit among typed rows, if they agree;
    that of the same area in the project, if all rows agree; that of the nearest such area within 15 % either way, of equally near ones
    the smaller. All windows lie within a project: rows dealt out by it are sorted where they are and not moved again.
    """
    columns = [c for c in rows.columns if c not in ("beds", typed)] + list(keep)
    void = F.coalesce(F.col("area") < LEAST_SQFT_A_BED * F.col("beds"), F.lit(False))
    unit, size, project = Window.partitionBy(*UNIT), Window.partitionBy("project", "area"), Window.partitionBy("project")
    # what typed rows say of a unit: the few pairs of block and count
    rows = rows.withColumn("told", F.collect_set(F.when(F.col(typed) & F.col("beds").isNotNull(), F.struct("block", "beds"))).over(unit))
    fits = F.transform(F.filter("told", lambda k: blocks_match(k["block"], F.col("block"))), lambda k: k["beds"])
    known = (F.array_min(fits) == F.array_max(fits)) & F.col("project").isNotNull() & F.col("floor").isNotNull() & F.col("stack").isNotNull()
    rows = rows.withColumn("unit_beds", F.when(known, F.array_min(fits))).drop("told")
    sized = F.col("project").isNotNull() & F.col("area").isNotNull()
    rows = rows.withColumn("size_beds", F.when(sized & (F.min("beds").over(size) == F.max("beds").over(size)), F.min("beds").over(size)))
    spot = F.when(F.col("size_beds").isNotNull(), F.struct("area", "size_beds"))
    # both windows run on from the first row, as a frame to the last row is read anew for every row
    rows = rows.withColumn("below", F.last(spot, ignorenulls=True).over(project.orderBy("area").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("above", F.last(spot, ignorenulls=True).over(project.orderBy(F.desc("area")).rowsBetween(Window.unboundedPreceding, 0)))
    down, up = F.col("area") / F.col("below.area"), F.col("above.area") / F.col("area")
    pick = F.when(up.isNull() | (down <= up), F.struct(down.alias("ratio"), F.col("below.size_beds").alias("beds"))).otherwise(F.struct(up.alias("ratio"), F.col("above.size_beds").alias("beds")))
    rows = rows.withColumn("pick", pick).withColumn("near_beds", F.when(sized & (F.col("pick.ratio") <= NEAR_SIZE), F.col("pick.beds"))).withColumn("given", F.when(~void, F.col("beds")))
    found = [("given", "given"), ("unit_beds", "unit"), ("size_beds", "size"), ("near_beds", "near")]
    source = F.lit("unresolved")
    for column, name in reversed(found):
        source = F.when(F.col(column).isNotNull(), name).otherwise(source)
    return rows.withColumn("beds", F.coalesce(*(c for c, _ in found))).withColumn("beds_from", source).select(*columns, "beds", "beds_from")


class _Unit:
    """The sales kept so far of one floor and stack, all blocks; a row meets those of its day and those of its price."""

    def __init__(self):
        self.kept, self.by_day, self.by_price = [], {}, {}

    def _first(self, places: list[int], row: dict, fits: Callable) -> dict | None:
        return next((k for k in (self.kept[i] for i in places) if (k["block"] is None or row["block"] is None or k["block"] == row["block"]) and fits(k)), None)

    def step(self, row: dict) -> Iterator[dict]:
        clash = self._first(self.by_day.get(row["day"], []), row, lambda k: k["price"] != row["price"])
        if clash:  # the row of the more trusted surface came first
            clash["clashes"] += 1
            yield row | {"status": "conflict", "into": clash["id"]}
            return
        near = timedelta(days=SAME_SALE_DAYS)
        same = self._first(self.by_price.get(row["price"], []), row, lambda k: abs(k["day"] - row["day"]) <= near)
        if same:
            same["block"] = same["block"] if same["block"] is not None else row["block"]
            same["beds"] = same["beds"] if same["beds"] is not None else row["beds"]
            same["seen"] += 1
            yield row | {"status": "merged", "into": same["id"]}
            return
        for index, value in ((self.by_day, row["day"]), (self.by_price, row["price"])):
            index.setdefault(value, []).append(len(self.kept))
        self.kept.append(row | {"status": "kept", "seen": 1, "clashes": 0})

    def end(self) -> list[dict]:
        return self.kept


FOLDED = "id string, block string, beds int, status string, into string, seen int, clashes int"


def reconstruct(rows: DataFrame, asof: str, years: int, subject: Column) -> DataFrame:
    """Every row with its status: kept, merged or conflict (into names the sale that took it), quarantined, subject or outside.

    Quarantined rows have a price that is not area times price a square foot; the subject's own sales and those outside the years before asof are
    set apart. The rest is read in order of trust, day and id: a sale of the unit's day at another price loses, one at the
    same price within 31 days is the same sale and may lend it its block and beds. The comparison is with what is kept, so a
    chain of near days does not run on. Kept rows carry how many rows they stand for and how many they beat.
    """
    start = F.date_sub(F.lit(asof).cast("date"), round(years * 365.25))
    odd = F.abs(F.col("price") - F.col("psf") * F.col("area")) / F.col("price") > PRICE_TOLERANCE
    outside = ~F.col("day").between(start, F.lit(asof).cast("date"))
    rows = rows.withColumn("status", F.when(odd, "quarantined").when(subject, "subject").when(outside, "outside"))
    trust = F.array_position(F.array(*map(F.lit, SURFACES)), F.col("surface")).alias("trust")
    asked = rows.filter("status IS NULL").select("id", *UNIT, "block", "day", "price", "beds", trust)
    found = folded(asked, UNIT, ["trust", "day", "id"], _Unit, FOLDED)
    apart = rows.filter("status IS NOT NULL").select("id", "block", "beds", "status", F.lit(None).cast("string").alias("into"), F.lit(None).cast("int").alias("seen"), F.lit(None).cast("int").alias("clashes"))
    return found.unionByName(apart)


class _Pool:
    """The right rows of one key, from which each left row takes the nearest left over."""

    def __init__(self):
        self.pool = []  # (measure, place in order, id), sorted

    def step(self, row: dict) -> Iterator[dict]:
        from bisect import bisect_left, insort

        at = row["measure"]
        if row["side"] == 0:
            insort(self.pool, (at, row["place"]))
            return
        if not self.pool:
            yield {"left_id": row["place"], "right_id": None, "gap": None}
            return
        i = bisect_left(self.pool, (at, ""))
        best = [self.pool[i]] if i < len(self.pool) else []
        if i:  # of equal measures below, the first in order
            low = bisect_left(self.pool, (self.pool[i - 1][0], ""))
            best.append(self.pool[low])
        taken = min(best, key=lambda c: (abs(c[0] - at), c[1]))
        self.pool.remove(taken)
        yield {"left_id": row["place"], "right_id": taken[1], "gap": abs(taken[0] - at)}

    def end(self) -> list[dict]:
        return [{"left_id": None, "right_id": place, "gap": None} for _, place in self.pool]


def nearest_matches(left: DataFrame, right: DataFrame, keys: list[str], measure: str, tolerance: float) -> DataFrame:
    """(left_id, right_id, status): one-to-one matches of rows of equal keys, each left row, by id, with the nearest measure not yet taken.

    Equally near ones go by id. A match further apart than the tolerance differs; what is left is left_only or right_only. Rows with a null
    key or measure match nothing.
    """
    side = lambda df, n: df.select(*keys, F.lit(n).alias("side"), F.col(measure).cast("double").alias("measure"), F.col("id").cast("string").alias("place"))
    both = side(right, 0).unionByName(side(left, 1))
    whole = F.lit(True)
    for c in (*keys, "measure"):
        whole = whole & F.col(c).isNotNull()
    found = folded(both.filter(whole), keys, ["side", "place"], _Pool, "left_id string, right_id string, gap double")
    alone = both.filter(~whole).select(F.when(F.col("side") == 1, F.col("place")).alias("left_id"), F.when(F.col("side") == 0, F.col("place")).alias("right_id"), F.lit(None).cast("double").alias("gap"))
    status = F.when(F.col("right_id").isNull(), "left_only").when(F.col("left_id").isNull(), "right_only").when(F.col("gap") > tolerance, "differs").otherwise("matched")
    return found.unionByName(alone).select("left_id", "right_id", status.alias("status"))
