"""The lattice adapter: the engine's abstractions as views of the synthetic tables.

A 50 x 50 grid of cells; yearly layers (lights, built fraction, population) and a terrain from lineitem, dense in the middle and thin at the rim; points of interest from events; road ways
from orders; articles from documents and events; districts from nation and customer. SQL holds the same views as common table
expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = COLS = 50
YEARS = tuple(range(1995, 2002))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid(spark: SparkSession, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(row, col) of every cell of a frame."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))


def grid_years(spark: SparkSession) -> DataFrame:
    return grid(spark).select("row", "col", F.explode(F.array(*[F.lit(y).cast("long") for y in YEARS])).alias("year"))


def place(key: str) -> Column:
    """Row or column of a key: the mean of two of its remainders, so that a frame's middle is dense and its rim thin at every table size."""
    return F.expr(f"({key} % 50 + {key} * 37 div 11 % 50) div 2")


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        place("l_partkey").alias("row"), place("l_orderkey").alias("col"), F.year("l_shipdate").cast("long").alias("year"), "l_quantity", "l_extendedprice"
    )


def lights(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, year, value): night lights, 0 where nothing shines."""
    seen = _line(spark, d).groupBy("row", "col", "year").agg(F.sum("l_quantity").alias("value"))
    return grid_years(spark).join(seen, ["row", "col", "year"], "left").select("row", "col", "year", F.coalesce("value", F.lit(0.0)).alias("value"))


def cumulative(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, year, price, n): sums up to and with the year."""
    seen = _line(spark, d).groupBy("row", "col", "year").agg(F.sum("l_extendedprice").alias("p"), F.count("*").alias("k"))
    w = Window.partitionBy("row", "col").orderBy("year")
    full = grid_years(spark).join(seen, ["row", "col", "year"], "left")
    return full.select("row", "col", "year", F.sum(F.coalesce("p", F.lit(0.0))).over(w).alias("price"), F.sum(F.coalesce("k", F.lit(0))).over(w).alias("n"))


def built(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, year, frac): built fraction, cumulative price over the largest of any cell."""
    c = cumulative(spark, d)
    top = c.agg(F.max("price").alias("top"))
    return c.join(F.broadcast(top)).select("row", "col", "year", F.try_divide("price", "top").alias("frac"))


def population(spark: SparkSession, d: str) -> DataFrame:
    return cumulative(spark, d).select("row", "col", "year", F.col("n").cast("double").alias("people"))


def poi(spark: SparkSession, d: str) -> DataFrame:
    """(group, row, col) of points of interest."""
    return table(spark, d, "events").select(F.col("event_type").alias("group"), (F.col("user_id") % ROWS).alias("row"), (F.col("event_id") % COLS).alias("col"), "value")


def road(spark: SparkSession, d: str) -> DataFrame:
    """(way_id, class, seq, x, y): vertices of road ways in metres."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("way_id"), F.substring("o_orderpriority", 1, 1).alias("class"), F.row_number().over(w).cast("long").alias("seq"),
        ((F.col("o_orderkey") * 37) % 5000).cast("double").alias("x"), ((F.col("o_orderkey") * 91) % 5000).cast("double").alias("y"),
    )


def article(spark: SparkSession, d: str, **of_text: Column) -> DataFrame:
    """(id, title, source, body, published, kind, value, user_id), and columns made of title, source and body before articles meet their events."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.slice(F.split("text", "[ \n]+"), 1, 8)).alias("title"), "source", F.col("text").alias("body")).withColumns(of_text)
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published"), F.col("event_type").alias("kind"), "value", "user_id")
    return docs.join(ev, "id")


def surface(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, score): a terrain's suitability in [0, 1), from the cents of a cell's prices."""
    cents = _line(spark, d).groupBy("row", "col").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    x = grid(spark).join(cents, ["row", "col"], "left")
    return x.select("row", "col", ((F.col("row") * 7919 + F.col("col") * 104729 + F.col("row") * F.col("col") * 31 + F.coalesce("cents", F.lit(0))) % 10007 / F.lit(10007.0)).alias("score"))


SQL = """
WITH cells AS (SELECT (i // 50)::BIGINT AS row, (i % 50)::BIGINT AS col FROM range(2500) t(i)),
years AS (SELECT unnest(range(1995, 2002))::BIGINT AS year),
line AS (SELECT (l_partkey % 50 + l_partkey * 37 // 11 % 50) // 2 AS row, (l_orderkey % 50 + l_orderkey * 37 // 11 % 50) // 2 AS col, year(l_shipdate)::BIGINT AS year, sum(l_quantity) AS q, sum(l_extendedprice) AS p, count(*) AS k, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1, 2, 3),
cy AS (SELECT c.row, c.col, y.year, coalesce(q, 0) AS q, coalesce(p, 0) AS p, coalesce(k, 0) AS k FROM cells c CROSS JOIN years y LEFT JOIN line l ON l.row = c.row AND l.col = c.col AND l.year = y.year),
lights AS (SELECT row, col, year, q AS value FROM cy),
cum AS (SELECT row, col, year, sum(p) OVER w AS price, sum(k) OVER w AS n FROM cy WINDOW w AS (PARTITION BY row, col ORDER BY year)),
built AS (SELECT row, col, year, price / nullif((SELECT max(price) FROM cum), 0) AS frac FROM cum),
population AS (SELECT row, col, year, n::DOUBLE AS people FROM cum),
poi AS (SELECT event_type AS grp, user_id % 50 AS row, event_id % 50 AS col, value FROM events),
road AS (SELECT o_custkey AS way_id, substr(o_orderpriority, 1, 1) AS class, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
         ((o_orderkey * 37) % 5000)::DOUBLE AS x, ((o_orderkey * 91) % 5000)::DOUBLE AS y FROM orders),
article AS (SELECT doc_id AS id, array_to_string(list_slice(string_split_regex(text, '[ \\n]+'), 1, 8), ' ') AS title, source, text AS body,
            strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, event_type AS kind, value, user_id FROM documents JOIN events ON event_id = doc_id),
surface AS (SELECT row, col, ((row * 7919 + col * 104729 + row * col * 31 + coalesce(t.cents, 0)) % 10007) / 10007.0::DOUBLE AS score FROM cells LEFT JOIN (SELECT row, col, sum(cents)::BIGINT AS cents FROM line GROUP BY 1, 2) t USING (row, col)),
disk3 AS (SELECT a.i AS dr, b.j AS dc FROM range(-3, 4) a(i) CROSS JOIN range(-3, 4) b(j) WHERE a.i * a.i + b.j * b.j <= 9)
"""
