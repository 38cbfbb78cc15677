"""Tables rebuilt from captured screens: nodes of a tree with box centres, rows by height, columns by place or by format.

Nodes are (screen, ord, x, y, text). A row is anchored by its date cell in the frozen column on the left; cells within Y_TOL of its height
belong to it. Anchors see the cells around them in one ordered pass over a screen, a window as high as the tolerance, so
nothing is joined and a screen of any length costs a multiple of its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
Y_TOL, DATE_X_MAX = 30, 240
PSF_MAX = 20_000  # money up to here is a price a square foot, beyond it a price
DATE = "^[0-9]{2} [A-Za-z0-9_]{3} [0-9]{4}$"
HEADERS = {"street": 367, "level": 609, "unit": 886, "unit_type": 1201, "area_sqft": 1462, "psf": 1737, "price": 2028, "sale_type": 2311}
#: In order: a tenure also looks like an address.
FORMATS = {
    "tenure": "^([0-9]+ yrs? from .+|freehold.*|999.*)$",
    "type": "^(terrace|semi-?detached|detached|cluster).*house$",
    "sale_type": "^(resale|new sale|sub[- ]sale)$",
    "completion": "^(19|20)[0-9][0-9]$",
    "address": "^[0-9]+[a-z]? [a-z].*$",
    "area_sqft": "^[0-9]{1,3}(,[0-9]{3})*([.][0-9]+)?$",
}
MONEY = "^[$][0-9,]+$"
TITLE, FOREIGN = "Street Transactions", "Realtime Agency Data"


def xml_nodes(captures: DataFrame, xml: str = "xml") -> DataFrame:
    """The nodes of a capture in order, with the centre of their box; nodes without a box have none."""
    part = lambda name: F.regexp_extract("node", f'{name}="([^"]*)"', 1)
    box = [F.regexp_extract("node", r'bounds="\[([0-9-]+),([0-9-]+)\]\[([0-9-]+),([0-9-]+)\]"', i).try_cast("int") for i in (1, 2, 3, 4)]
    nodes = captures.select("*", F.posexplode(F.regexp_extract_all(xml, F.lit("<node [^>]*>"), F.lit(0))).alias("ord", "node"))
    middle = lambda a, b: F.floor((a + b) / 2).cast("int")
    text = F.replace(F.replace(F.replace(F.replace(part("text"), F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    # a generated row is computed once, however many filters and columns look at it
    read = F.struct(middle(box[0], box[2]).alias("x"), middle(box[1], box[3]).alias("y"), text.alias("text"))
    return nodes.select(*[c for c in captures.columns if c != xml], "ord", F.inline(F.array(read)))


def by_place(x: Column) -> Column:
    """The column whose header is nearest; of equally near ones the first."""
    spots = F.array(*(F.struct(F.abs(x - F.lit(at)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, at) in enumerate(HEADERS.items())))
    return F.array_min(spots)["name"]


def by_format(cell: Column) -> Column:
    """The column that a cell's format names; money is told apart by size. Null for what has no known format."""
    text = F.lower(F.trim(cell))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FORMATS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    amount = F.regexp_replace(text, "[$,]", "").try_cast("long")
    return F.when(text.rlike(MONEY), F.when(amount <= PSF_MAX, "psf").otherwise("price")).otherwise(out)


def rebuilt(nodes: DataFrame, by: list[str], column: Column, columns: list[str]) -> DataFrame:
    """(by, y, date and the columns) of every anchored row; a column takes the first of its cells, null if it has none."""
    placed = nodes.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("text") != ""))
    anchor = (F.col("x") <= DATE_X_MAX) & F.col("text").rlike(DATE)
    cell = F.when(F.col("x") > DATE_X_MAX, column)
    placed = placed.select(*by, "y", F.when(anchor, F.col("text")).alias("date"), F.struct("ord", F.trim("text").alias("text"), cell.alias("column")).alias("cell"))
    held = F.col("cell.column").isin(columns)
    placed = placed.filter(F.col("date").isNotNull() | held)
    near = Window.partitionBy(*by).orderBy("y").rangeBetween(-Y_TOL, Y_TOL)
    met = placed.withColumn("near", F.collect_list(F.when(held, F.col("cell"))).over(near)).filter("date IS NOT NULL")
    # anchors of one height have the same cells
    rows = met.groupBy(*by, "y").agg(F.min(F.struct("date", "near")).alias("a"))
    first = lambda c: F.array_min(F.filter("a.near", lambda s: s["column"] == c))["text"]
    return rows.select(*by, "y", "a.date", *(first(c).alias(c) for c in columns))


def snapped_table(nodes: DataFrame, by: list[str]) -> DataFrame:
    return rebuilt(nodes, by, by_place(F.col("x")), list(HEADERS))


def halves_joined(left: DataFrame, right: DataFrame, by: list[str], left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """Rows of two passes over one table, joined on the height of the frozen column, which a sideways move leaves as it is.

    complete tells whether a row is in both passes under one date and has every column; others are for the next pass.
    """
    a = rebuilt(left, by, by_format(F.col("text")), left_columns)
    b = rebuilt(right, by, by_format(F.col("text")), right_columns).withColumnRenamed("date", "date_right")
    both = a.join(b, [*by, "y"], "full")
    whole = F.col("date") == F.col("date_right")
    for c in (*left_columns, *right_columns):
        whole = whole & F.col(c).isNotNull()
    return both.select(*by, "y", F.coalesce("date", "date_right").alias("date"), *left_columns, *right_columns, F.coalesce(whole, F.lit(False)).alias("complete"))


def panel_guard(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Whether a screen is the table that is wanted: ok, no_title, foreign_panel, or no_tenure where dashes stand for the tenures."""
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    text = F.col("text")
    told = nodes.groupBy(*by).agg(has(text.contains(TITLE)).alias("title"), has(text.contains(FOREIGN)).alias("foreign"), has(text.rlike("^([0-9]+ yrs from|Freehold)")).alias("tenure"), has((text == "-") & (F.col("x") > 900)).alias("dash"))
    status = F.when(~F.col("title"), "no_title").when(F.col("foreign"), "foreign_panel").when(~F.col("tenure") & F.col("dash"), "no_tenure").otherwise("ok")
    return told.select(*by, status.alias("status"))
