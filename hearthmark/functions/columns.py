"""Column expressions: dates, bands, leases, sizes, distances and duties. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the rules
LAG_DAYS, INDEX_LAG_DAYS, EARTH_KM = 56, 35, 6371.0088
SIZE_BANDS = [(1000.0, 3000.0, -0.51), (3000.0, 5000.0, -0.64), (5000.0, 8000.0, -0.56), (8000.0, 1e9, -0.20)]
BIG_PLOT, QUASI_FREEHOLD, LEASE_GAP = 8000.0, 800.0, 25.0
BSD_TIERS = [(0.0, 180_000.0, 0.01), (180_000.0, 360_000.0, 0.02), (360_000.0, 1_000_000.0, 0.03), (1_000_000.0, 1_500_000.0, 0.04), (1_500_000.0, 3_000_000.0, 0.05), (3_000_000.0, None, 0.06)]
ABSD_RATES = {"SC": (0.0, 0.20, 0.30), "PR": (0.05, 0.30, 0.35), "FOREIGNER": (0.60, 0.60, 0.60), "ENTITY": (0.65, 0.65, 0.65), "TRUSTEE": (0.65, 0.65, 0.65)}
SSD_BANDS = [(1, 0.16), (2, 0.12), (3, 0.08), (4, 0.04)]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_idx(date: Column | str) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def quarter_idx(date: Column | str) -> Column:
    return F.year(date) * 4 + F.quarter(date) - 1


def visible(month: Column | str, t: Column | str, lag: int = LAG_DAYS) -> Column:
    """A month's rows are known at t once its last day plus the lag has passed."""
    return F.date_add(F.last_day(month), lag) <= col(t)


def asof_date(month: Column | str) -> Column:
    """The valuation date of a subject: the end of the month before its own."""
    return F.last_day(F.add_months(month, -1))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def size_level(area: Column | str) -> Column:
    """The integral of the size elasticity over log area from 1000 square feet; continuous across bands."""
    a, total = F.greatest(col(area), F.lit(1000.0)), F.lit(0.0)
    for low, high, e in SIZE_BANDS:
        total = total + F.when(a > low, e * (F.log(F.least(a, F.lit(high))) - F.log(F.lit(low)))).otherwise(0.0)
    return total


def size_factor(a: Column | str, b: Column | str) -> Column:
    return F.when((col(a) > 0) & (col(b) > 0), F.exp(size_level(b) - size_level(a))).otherwise(1.0)


def lease_end(tenure_type: Column | str, tenure_raw: Column | str, lease_start: Column | str) -> Column:
    """The year a lease ends; null for freehold, unknown starts and leases of 800 years or more. The raw text is read from its start."""
    years = F.coalesce(F.regexp_extract(F.lower(F.coalesce(col(tenure_raw), F.lit(""))), r"^\s*(\d+)\s*yr", 1).try_cast("double"), F.lit(99.0))
    quasi = col(tenure_type).isin("freehold", "freehold_equiv") | F.coalesce(col(lease_start), F.lit(0)).eqNullSafe(0) | (years >= QUASI_FREEHOLD)
    return F.when(quasi, F.lit(None)).otherwise(col(lease_start) + years)


def years_left(end: Column | str, year: Column) -> Column:
    """Of a lease that ends so; without an end it counts as 800."""
    return F.when(col(end).isNull(), QUASI_FREEHOLD).otherwise(F.greatest(F.lit(0.0), col(end) - year))


def remaining_lease(tenure_type: Column | str, tenure_raw: Column | str, lease_start: Column | str, year: Column) -> Column:
    """Years left; freehold, unknown starts and leases of 800 years or more count as 800."""
    return years_left(lease_end(tenure_type, tenure_raw, lease_start), year)


def lease_compatible(a: Column | str, b: Column | str) -> Column:
    """Both quasi-freehold, or neither and within 25 years of each other."""
    a, b = col(a), col(b)
    fa, fb = a >= QUASI_FREEHOLD, b >= QUASI_FREEHOLD
    return (fa & fb) | (~fa & ~fb & (F.abs(a - b) <= LEASE_GAP))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def bsd(price: Column | str) -> Column:
    total = F.lit(0.0)
    for low, high, rate in BSD_TIERS:
        top = F.least(col(price), F.lit(high)) if high else col(price)
        total = total + F.greatest(F.lit(0.0), top - low) * rate
    return total


def absd_rate(profile: Column | str, count: Column | str) -> Column:
    """The rate by buyer profile and count; null for an unknown profile, which the caller rejects."""
    rates = F.lit(None).cast("double")
    for name, r in ABSD_RATES.items():
        rates = F.when(F.upper(F.coalesce(col(profile), F.lit("SC"))) == name, F.element_at(F.array(*map(F.lit, r)), clamp(col(count), 1, 3).cast("int"))).otherwise(rates)
    return rates


def ssd_rate(years: Column | str) -> Column:
    out = F.lit(0.0)
    for y, rate in reversed(SSD_BANDS):
        out = F.when(col(years) <= y, rate).otherwise(out)
    return out


def breakeven_gain(price: Column, entry: Column, years: Column, agent: float = 0.02) -> Column:
    return (price + entry) / (1 - ssd_rate(years) - agent) / price - 1


def liquidity(n: Column | str) -> Column:
    n = col(n)
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 15, "6-15").otherwise("16+")


def confidence(n: Column, fallback: Column, band_rel: Column, spread: Column) -> Column:
    """90 - 45 exp(-n/6), less a penalty on the spread of methods, capped on wide bands, never below 20."""
    base = F.when(fallback, 45.0).otherwise(90 - 45 * F.exp(-n / 6))
    base = base - F.coalesce(clamp((spread - 0.05) * 160, 0.0, 35.0), F.lit(0.0))
    return F.greatest(F.lit(20.0), F.when(band_rel > 0.30, F.least(base, F.lit(65.0))).otherwise(base))


def confidence_landed(n: Column, fallback: Column, spread: Column, big: Column) -> Column:
    base = F.when(fallback, 40.0).otherwise(78 - 30 * F.exp(-n / 5))
    base = base - F.coalesce(clamp((spread - 0.06) * 140, 0.0, 30.0), F.lit(0.0))
    return F.greatest(F.lit(20.0), F.when(big, F.least(base, F.lit(45.0))).otherwise(base))
