"""Queries that price work from rule tables; the facts are aggregates of orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import workitems as W
from quarry.operators.workitems import Part
from quarry.plans.registry import query

BOUNDS = [(10, "xs"), (20, "s"), (30, "m"), (40, "l")]
PARTS = [
    Part("build", "B1", "projects", "projects", 2, 4), Part("build", "B1", "rush orders", "rush", 0.5, 1.25), Part("build", "B2", "harness", "1", 8, 16, "projects > 3"),
    *[Part("port", "P1", f"{name} lines", f"n_{name}", low, high) for name, low, high in (("xs", 0.5, 1), ("s", 1, 2.5), ("m", 2, 4), ("l", 4, 7.5), ("xl", 8, 12))],
    Part("port", "P2", "returned lines", "returned / 2", 1, 3, "returned >= 10"), Part("ship", "S1", "environments", "least(projects, 3)", 6, 10, "rush = 0"),
]
_FACTS = """f AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS projects, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS rush, count(*) FILTER (l_returnflag = 'R') AS returned,
count(*) FILTER (l_quantity <= 10) AS n_xs, count(*) FILTER (l_quantity > 10 AND l_quantity <= 20) AS n_s, count(*) FILTER (l_quantity > 20 AND l_quantity <= 30) AS n_m, count(*) FILTER (l_quantity > 30 AND l_quantity <= 40) AS n_l, count(*) FILTER (l_quantity > 40) AS n_xl FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""
_ITEMS = " UNION ALL ".join(f"SELECT o_custkey, '{p.stage}' AS stage, '{p.item}' AS item, '{p.unit}' AS unit, CAST({p.quantity} AS DOUBLE) AS quantity, {p.quantity} * {float(p.low)}::DOUBLE AS low, {p.quantity} * {float(p.high)}::DOUBLE AS high FROM f WHERE ({p.when}) AND {p.quantity} > 0" for p in PARTS)


def _items(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    facts = rows.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("projects"), F.countDistinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).alias("rush"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    sizes = W.size_counts(rows, "o_custkey", "l_quantity", BOUNDS, "xl")
    return W.work_items(facts.join(sizes, "o_custkey"), "o_custkey", PARTS)


@query(f"WITH {_FACTS} {_ITEMS}")
def work_items(t):
    return _items(t)


@query(f"WITH {_FACTS}, i AS ({_ITEMS}) SELECT o_custkey, stage, count(DISTINCT item) AS items, round(sum(low * CASE stage WHEN 'port' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 2) AS low, round(sum(high * CASE stage WHEN 'port' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 2) AS high FROM i GROUP BY ROLLUP (o_custkey, stage) HAVING grouping(o_custkey) = 0")
def phase_hours(t):
    return W.totals(_items(t), "o_custkey", {"port": 0.6})


#: Price lists: (kind, rate, fixed and markup hours low and high, kind of the rest, redesign).
RATES = [("ECONOMY", 10.0, 20.0, 2.0, 4.0, 1.0, 2.0, "unknown", False), ("STANDARD", 6.0, 12.0, 1.0, 2.0, 0.0, 0.0, None, True), ("unknown", 4.0, 8.0, 1.0, 1.5, 0.5, 1.0, None, False)]
_RATES = ", ".join(f"({', '.join('NULL' if x is None else repr(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f'{x}::DOUBLE' for x in r)})" for r in RATES)


@query(f"""WITH r(kind, rl, rh, fl, fh, ml, mh, rest, redesign) AS (VALUES {_RATES}), p AS (SELECT p_partkey, CASE WHEN p_type IN (SELECT kind FROM r) THEN p_type ELSE 'unknown' END AS kind, p_partkey / 1000.0::DOUBLE AS code, p_size / 1000.0::DOUBLE AS mark, CASE WHEN p_partkey % 3 = 0 THEN p_size * 20 / 1000.0::DOUBLE END AS ui, 1 + p_size / 100.0::DOUBLE AS cf FROM part),
j AS (SELECT p.*, r.*, q.rl AS ql, q.rh AS qh, q.rl IS NOT NULL AND ui IS NOT NULL AS split FROM p JOIN r ON p.kind = r.kind LEFT JOIN r q ON q.kind = r.rest), s AS (SELECT *, CASE WHEN split THEN least(ui, code) ELSE code END AS shown FROM j),
h AS (SELECT *, (rl * shown + ml * mark) * cf AS a, (rh * shown + mh * mark) * cf AS b, (fl + CASE WHEN split THEN ql * (code - shown) ELSE 0 END) * cf AS c, (fh + CASE WHEN split THEN qh * (code - shown) ELSE 0 END) * cf AS d FROM s)
SELECT p_partkey, round(a + c, 1) AS low, round(b + d, 1) AS high, round(CASE WHEN split THEN a WHEN redesign THEN a + c ELSE 0 END, 1) AS redesign_low, round(CASE WHEN split THEN b WHEN redesign THEN b + d ELSE 0 END, 1) AS redesign_high FROM h""")
def conversion_hours(t):
    rates = t.spark.createDataFrame(RATES, "kind string, rate_low double, rate_high double, fixed_low double, fixed_high double, markup_low double, markup_high double, rest_kind string, redesign boolean")
    rows = t.part.select("p_partkey", F.col("p_type").alias("kind"), F.col("p_partkey").alias("code"), F.col("p_size").alias("markup"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 20).alias("ui"), (1 + F.col("p_size") / 100).alias("factor"))
    return W.conversion_hours(rows, rates, "p_partkey", "kind", "code", "markup", "ui", "factor")


@query("""WITH o AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 300 <= 50 THEN 1 WHEN o_orderkey % 300 <= 200 THEN 2 ELSE 4 END WHEN o_orderstatus = 'O' THEN 0.5 ELSE 0.25 END::DOUBLE) AS ol, sum(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 300 <= 50 THEN 2 WHEN o_orderkey % 300 <= 200 THEN 5 ELSE 9 END WHEN o_orderstatus = 'O' THEN 1 ELSE 0.75 END::DOUBLE) AS oh FROM orders GROUP BY 1),
c AS (SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0 END::DOUBLE) AS cl, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 6 WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END::DOUBLE) AS ch, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END::DOUBLE) AS rl, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 6 ELSE 0 END::DOUBLE) AS rh FROM orders GROUP BY 1)
SELECT o_custkey, ol AS objects_low, oh AS objects_high, cl AS constructs_low, ch AS constructs_high, rl AS redesign_low, rh AS redesign_high, round((ol + cl - rl) * 0.5::DOUBLE + rl * 0.75::DOUBLE, 1) AS low, round((oh + ch - rh) * 0.5::DOUBLE + rh * 0.75::DOUBLE, 1) AS high FROM o JOIN c USING (o_custkey)""")
def database_hours(t):
    objects = t.orders.select("o_custkey", F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 300).alias("lines"))
    constructs = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("construct")).agg(F.count("*").alias("n"))
    prices = t.spark.createDataFrame([("F", "small", 1.0, 2.0), ("F", "medium", 2.0, 5.0), ("F", "large", 4.0, 9.0), ("O", None, 0.5, 1.0)], "kind string, size string, low double, high double")
    levels = t.spark.createDataFrame([("1-URGENT", "redesign", 3.0, 6.0), ("5-LOW", "auto", 0.5, 1.0)], "construct string, level string, low double, high double")
    return W.database_hours(objects, constructs, prices, levels, "o_custkey", 0.5, 0.75)
