"""Model queries whose coefficients SQL can repeat (M1, M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import newton
from ..session import write_table
from ..sources import fixtures as fx
from .common import r6, register, sql

FEATURES = ["1.0", "x1", "x2", "x3", "x4"]
STEPS = 8  # Newton steps of the SQL form: far more than convergence takes
ALPHA = 0.001

CELL = """x AS MATERIALIZED (SELECT l_orderkey AS entry, avg(l_quantity) / 50 AS x1, avg(l_discount) * 10 AS x2, avg(l_tax) * 10 AS x3,
    avg(l_extendedprice) / 50000 AS x4 FROM lineitem GROUP BY l_orderkey),
label AS (SELECT DISTINCT l_returnflag || l_linestatus AS label_id FROM lineitem),
used AS (SELECT DISTINCT l_orderkey AS entry, l_returnflag || l_linestatus AS label_id FROM lineitem),
cell AS MATERIALIZED (SELECT x.*, m.label_id, CAST(CASE WHEN u.entry IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS y
  FROM x CROSS JOIN label m LEFT JOIN used u ON u.entry = x.entry AND u.label_id = m.label_id
  JOIN orders o ON o.o_orderkey = x.entry WHERE u.entry IS NOT NULL OR o.o_orderstatus <> 'P')"""


def newton_sql() -> str:
    """CTEs of ``STEPS`` Newton steps from zero: sums per label, then Gauss-Jordan elimination column by column."""
    n = len(FEATURES)
    out = ["w0 AS (SELECT label_id, " + ", ".join(f"CAST(0 AS DOUBLE) AS c{i}" for i in range(n)) + " FROM label)"]
    for t in range(1, STEPS + 1):
        z = " + ".join(f"c{i} * {FEATURES[i]}" for i in range(n))
        out.append(f"p{t} AS (SELECT cell.*, 1 / (1 + exp(-({z}))) AS p FROM cell JOIN w{t - 1} USING (label_id))")
        sums = [f"avg((p - y) * {FEATURES[i]}) AS g{i}" for i in range(n)]
        sums += [f"avg(p * (1 - p) * {FEATURES[i]} * {FEATURES[j]}) AS h{i}{j}" for i in range(n) for j in range(n)]
        out.append(f"s{t} AS MATERIALIZED (SELECT label_id, {', '.join(sums)} FROM p{t} GROUP BY label_id)")
        add = [f"g{i} + {ALPHA} * c{i} AS g{i}" for i in range(n)] + [f"h{i}{j}" + (f" + {ALPHA}" if i == j else "") + f" AS h{i}{j}" for i in range(n) for j in range(n)]
        out.append(f"e{t}_0 AS MATERIALIZED (SELECT label_id, {', '.join(add)} FROM s{t} JOIN w{t - 1} USING (label_id))")
        for k in range(n):
            cols = [f"g{i}" if i == k else f"g{i} - h{i}{k} / h{k}{k} * g{k} AS g{i}" for i in range(n)]
            cols += [f"h{i}{j}" if i == k else f"h{i}{j} - h{i}{k} / h{k}{k} * h{k}{j} AS h{i}{j}" for i in range(n) for j in range(n)]
            out.append(f"e{t}_{k + 1} AS MATERIALIZED (SELECT label_id, {', '.join(cols)} FROM e{t}_{k})")
        step = ", ".join(f"c{i} - g{i} / h{i}{i} AS c{i}" for i in range(n))
        out.append(f"w{t} AS MATERIALIZED (SELECT label_id, {step} FROM w{t - 1} JOIN e{t}_{n} USING (label_id))")
    return ",\n".join(out)


def _orders(s, d):
    """Order features, and cells (order, flag and status): 1 where a line has it; where not, 0, or unknown while the order is open."""
    line = fx.table(s, d, "lineitem")
    x = line.groupBy(F.col("l_orderkey").alias("entry")).agg(F.array(
        F.avg("l_quantity") / 50, F.avg("l_discount") * 10, F.avg("l_tax") * 10, F.avg("l_extendedprice") / 50000).alias("vec"))
    labels = line.groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("labels"))
    used = line.groupBy(F.col("l_orderkey").alias("entry")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("used"))
    cells = (used.withColumn("_one", F.lit(1)).join(F.broadcast(labels), "_one").select("entry", "used", F.explode("labels").alias("label_id"))
             .join(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("entry"), "o_orderstatus"), "entry"))
    y = F.when(F.array_contains("used", F.col("label_id")), 1).when(F.col("o_orderstatus") != "P", 0)
    return write_table(x), cells.select("entry", "label_id", y.alias("y"))


@register("m1_newton_coefficients", sql(CELL, newton_sql(), body=f"""
, n AS (SELECT label_id, count(*) AS n FROM cell GROUP BY label_id)
SELECT label_id, CAST(f AS INTEGER) AS feature, n, round([c0, c1, c2, c3, c4][f + 1], 6) AS coefficient
FROM w{STEPS} JOIN n USING (label_id), generate_series(0, 4) t(f)""".replace("\n, n AS", ",\nn AS", 1)))
def m1_newton_coefficients(s, d):
    fitted = newton.fit_newton(*_orders(s, d), alpha=ALPHA, tol=1e-16)
    return newton.coefficients(fitted).join(fitted.select("label_id", "n"), "label_id").select("label_id", "feature", "n", r6("coefficient").alias("coefficient"))


@register("m3_newton_scores", sql(CELL, newton_sql(), body=f"""
SELECT x.entry, label_id, round(1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2 + c3 * x3 + c4 * x4))), 6) AS prob FROM x, w{STEPS}"""))
def m3_newton_scores(s, d):
    x, cells = _orders(s, d)
    fitted = newton.fit_newton(x, cells, alpha=ALPHA, tol=1e-16)
    return newton.score_newton(fitted, x).select("entry", "label_id", r6("prob").alias("prob"))
