"""The registered queries of the library and their SQL."""

from hearthmark.plans import amenities, analytics, appraisals, captures, crosschecks, diligence, engines, factors, listings, places, records, screens, search, surfaces, valuation

PARTS = (valuation, analytics, engines, records, factors, surfaces, screens, captures, places, search, appraisals, listings, amenities, crosschecks, diligence)
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
