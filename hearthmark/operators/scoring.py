"""Scorecards, screening and record gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: points by category code, and the points of a missing code
LANDED = {"catchment": ({"1km": 14, "2km": 7, "outside": 0}, 7), "estate_tier": ({"gcb": 16, "prime": 13, "good": 9, "average": 4}, 9), "plot_shape": ({"rectangular": 9, "slightly_irregular": 6, "irregular": 2, "triangular": 0}, 6), "topography": ({"above": 6, "level": 4, "below": 0}, 4), "zoning_risk": ({"none": 10, "high_plot_ratio_neighbour": 5, "adjacent_nonlanded": 3, "reserve_or_institution": 1}, 7), "flood_risk": ({"none": 8, "low": 4, "high": 0}, 4), "future_risk": ({"none": 5, "some": 3, "material": 0}, 3), "rebuild_status": ({"rebuilt_recent": 9, "rebuilt_old": 6, "original_good": 4, "original_poor": 1}, 4)}
LAUNCH = {"amenities_tier": ({"excellent": 5, "good": 4, "average": 2}, 3), "developer_tier": ({"top": 8, "established": 6, "mid": 4, "new": 2}, 5), "price_vs_comps": ({"discount": 22, "par": 16, "premium": 9, "steep_premium": 3}, 12), "unit_efficiency": ({"efficient": 6, "average": 4, "inefficient": 2}, 4), "facilities": ({"full": 4, "adequate": 3, "basic": 1}, 3), "rental_demand": ({"strong": 12, "moderate": 8, "weak": 4}, 8), "supply_risk": ({"low": 10, "moderate": 6, "high": 2}, 6)}


def points(code: Column, table: tuple[dict[str, int], int]) -> Column:
    out = F.lit(table[1])
    for k, v in table[0].items():
        out = F.when(code == k, v).otherwise(out)
    return out


def steps(value: Column, cuts: list[tuple[float, int]], rest: int, missing: int) -> Column:
    """Points of the first cut that the value reaches."""
    out = F.lit(rest)
    for cut, p in reversed(cuts):
        out = F.when(value >= cut, p).otherwise(out)
    return F.when(value.isNull(), missing).otherwise(out)


def score_landed(c: dict[str, Column]) -> Column:
    """Of 100: codes by table, frontage, the length-width ratio, corner, water and hazards."""
    ratio = c["lw_ratio"]
    by_ratio = F.when(ratio.isNull() | ratio.between(1.2, 1.5) & (ratio < 1.5) | ((ratio > 2.5) & (ratio <= 3.5)), 3).when(ratio.between(1.5, 2.5), 5).otherwise(1)
    hazards = c["hazards"]
    by_hazard = F.when(hazards == 0, 8).when(hazards == 1, 5).when(hazards == 2, 2).otherwise(0)
    total = steps(c["frontage_m"], [(10, 6), (8, 5), (6, 3)], 1, 3) + by_ratio + by_hazard + F.when(c["corner"], 2).otherwise(0) + F.when(c["near_water"], 0).otherwise(2)
    for k, table in LANDED.items():
        total = total + points(c[k], table)
    return total


def verdict(total: Column) -> Column:
    return F.when(total >= 80, "STRONG").when(total >= 65, "CONSIDER").when(total >= 50, "MARGINAL").otherwise("PASS")


def score_launch(c: dict[str, Column]) -> Column:
    walk, lease, n = c["mrt_walk_min"], c["lease_remaining"], c["catalysts"]
    total = F.when(walk.isNull(), 6).when(walk <= 5, 10).when(walk <= 10, 8).when(walk <= 15, 5).otherwise(2) + F.when(c["expressway"], 2).otherwise(0) + F.when(c["nature"], 3).otherwise(0)
    total = total + F.when(c["freehold"], 10).otherwise(steps(lease, [(99, 8), (90, 7), (80, 5)], 3, 8)) + F.when(n == 0, 2).when(n == 1, 4).when(n == 2, 6).otherwise(8)
    for k, table in LAUNCH.items():
        total = total + points(c[k], table)
    return total


def stance(total: Column, price_code: Column) -> Column:
    """A steep premium caps the stance."""
    own = F.when(total >= 80, "BUY").when(total >= 68, "SELECTIVE").when(total >= 55, "WAIT").otherwise("AVOID")
    return F.when((price_code == "steep_premium") & (own == "BUY"), "SELECTIVE").otherwise(own)


def value_flag(psf: Column, low: Column, high: Column) -> Column:
    return F.when(psf.isNull() | low.isNull(), "?").when(psf < low, "VALUE").when(psf <= high, "FAIR").when(psf <= high * 1.25, "RICH").otherwise("BUILD-PRICED")
