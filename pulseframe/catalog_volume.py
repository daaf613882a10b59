"""Operators over one very large group, as queries over lineitem and orders with a single key, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Tables, query
from .operators import intervals, rolling, scans
from .operators.quantiles import exact_quantiles


def one():
    """The single key."""
    return F.lit(1).alias("one")


@query("one_key_islands", """WITH s AS (SELECT l_shipdate + to_minutes((l_orderkey * 7 + l_linenumber * 131) % 1440) AS a, l_shipdate + to_minutes((l_orderkey * 7 + l_linenumber * 131) % 1440 + CAST(l_quantity AS BIGINT)) AS b FROM lineitem),
m AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), n AS (SELECT a, b, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT CAST(epoch(min(a)) AS BIGINT) AS first_second, CAST(epoch(max(b)) AS BIGINT) AS last_second FROM n GROUP BY i""")
def one_key_islands(t: Tables) -> DataFrame:
    """WN-07, WN-08, WN-09 over one history: a block of islands for each month, joined where they touch."""
    begin = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1440
    span = t.table("lineitem").select(one(), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("day"), begin.alias("m"), F.col("l_quantity").cast("long").alias("q"))
    span = span.select("one", F.timestamp_seconds(F.col("day") + F.col("m") * 60).alias("a"), F.timestamp_seconds(F.col("day") + (F.col("m") + F.col("q")) * 60).alias("b"))
    found = intervals.islands(span, ["one"], "a", "b", F.date_trunc("month", "a"))
    return found.select(F.unix_seconds("island_start").alias("first_second"), F.unix_seconds("island_end").alias("last_second"))


@query("one_key_running", """WITH o AS (SELECT l_orderkey, l_linenumber, l_shipdate, sum(l_quantity) AS q, max(l_extendedprice) AS p, max(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS t FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS VARCHAR)[1:10] AS day, sum(q) OVER w AS quantity, max(p) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dearest_before, last_value(t IGNORE NULLS) OVER w AS last_tax
FROM o WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)""")
def one_key_running(t: Tables) -> DataFrame:
    """WN-07, WN-08: running sum, earlier maximum and last value of all lines, by months."""
    lines = t.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_shipdate").agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("t"))
    runs = {"quantity": scans.Scan("sum", F.col("q")), "dearest_before": scans.Scan("max", F.col("p"), before=True), "last_tax": scans.Scan("last", F.col("t"))}
    out = scans.running(lines.withColumn("one", one()), ["one"], ["l_shipdate", "l_orderkey", "l_linenumber"], F.date_trunc("month", "l_shipdate"), runs)
    return out.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), *runs)


@query("one_key_as_of", """WITH f AS (SELECT l_shipdate AS d, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT o_orderkey, coalesce(p, -1.0) AS price FROM orders ASOF LEFT JOIN f ON o_orderdate >= d""")
def one_key_as_of(t: Tables) -> DataFrame:
    """JN-10 over one history: the dearest returned line of the latest day up to each order's."""
    facts = t.table("lineitem").filter("l_returnflag = 'R'").select(one(), F.col("l_shipdate").alias("d"), F.col("l_extendedprice").alias("price"))
    probes = t.table("orders").select(one(), "o_orderkey", F.col("o_orderdate").alias("d"))
    return rolling.as_of(probes, facts, ["one"], "d", "price", -1.0, F.date_trunc("month", "d")).select("o_orderkey", "price")


@query("one_key_quantiles", """SELECT count(*) AS n, """ + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 6) AS q{q:02}" for q in (1, 25, 50, 95, 99)) + " FROM lineitem")
def one_key_quantiles(t: Tables) -> DataFrame:
    """AG-09, AG-10, AG-24 over one group: quantiles of all lines by selection."""
    shares = {f"q{q:02}": q / 100 for q in (1, 25, 50, 95, 99)}
    found = exact_quantiles(t.table("lineitem").select(one(), "l_extendedprice"), ["one"], "l_extendedprice", shares)
    return found.select("n", *(F.round(c, 6).alias(c) for c in shares))


@query("supplier_quantiles", "SELECT l_returnflag, l_suppkey % 7 AS part, count(*) AS n, round(quantile_cont(l_quantity * l_discount, 0.5), 6) AS middle, round(quantile_cont(l_quantity * l_discount, 0.9), 6) AS high FROM lineitem GROUP BY ALL")
def supplier_quantiles(t: Tables) -> DataFrame:
    """AG-09 of uneven groups with many ties."""
    lines = t.table("lineitem").select("l_returnflag", (F.col("l_suppkey") % 7).alias("part"), (F.col("l_quantity") * F.col("l_discount")).alias("v"))
    found = exact_quantiles(lines, ["l_returnflag", "part"], "v", {"middle": 0.5, "high": 0.9}, small=500)
    return found.select("l_returnflag", "part", "n", F.round("middle", 6).alias("middle"), F.round("high", 6).alias("high"))
