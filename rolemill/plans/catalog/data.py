"""Nominal tables and label pairs shared by the queries."""

from pyspark.sql import functions as F

from rolemill.plans.corpus import table

NOMINAL = ["status", "line", "qty", "disc", "tax"]


def nominal(spark, sf):
    """lineitem as text categories; class ``flag``, key ``part_key``."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"),
        whole(F.col("l_quantity")).alias("qty"), F.nullif(whole(F.col("l_discount") * 100), F.lit("7")).alias("disc"),
        whole(F.col("l_tax") * 100).alias("tax"), F.col("l_returnflag").alias("flag"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("part_key"),
    )


NOMINAL_SQL = """nominal AS (SELECT l_linestatus AS status, CAST(l_linenumber AS VARCHAR) AS line,
  CAST(CAST(round(l_quantity) AS BIGINT) AS VARCHAR) AS qty, nullif(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), '7') AS disc,
  CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS tax, l_returnflag AS flag, 's' || (l_suppkey % 7) AS part_key FROM lineitem)"""


def long_sql(cols, keep=(), source="nominal"):
    """Unpivoted rows, NULLs included."""
    kept = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(f"SELECT {kept}'{c}' AS col, CAST({c} AS VARCHAR) AS val FROM {source}" for c in cols)


def measures_sql(cols, target, keys=(), source="nominal"):
    """CTEs up to ``measures``: textbook definitions over the full value x class grid."""
    ks = "".join(f"{k}, " for k in keys)
    using = ", ".join([*keys, "col"])
    rows = long_sql(cols, [*keys, f"{target} AS tgt"], source)
    return f"""rows_ AS ({rows}),
cells AS (SELECT {ks}col, coalesce(val, '~null') AS val, tgt, CAST(count(*) AS DOUBLE) AS n FROM rows_ GROUP BY ALL),
vs AS (SELECT {ks}col, val, sum(n) AS nv FROM cells GROUP BY ALL),
cs AS (SELECT {ks}col, tgt, sum(n) AS nc FROM cells GROUP BY ALL),
ns AS (SELECT {ks}col, sum(nc) AS t, count(*) AS k_c FROM cs GROUP BY ALL),
kv AS (SELECT {ks}col, count(*) AS k_v FROM vs GROUP BY ALL),
grid AS (SELECT {', '.join('vs.' + k for k in [*keys, 'col'])}, vs.val, cs.tgt, nv, nc, t, k_c, k_v, coalesce(n, 0) AS n
  FROM vs JOIN cs USING ({using}) JOIN ns USING ({using}) JOIN kv USING ({using})
  LEFT JOIN cells ON {' AND '.join(f'cells.{k} = vs.{k}' for k in [*keys, 'col'])} AND cells.val = vs.val AND cells.tgt = cs.tgt),
measures AS (SELECT {ks}col,
  sum(CASE WHEN n > 0 THEN n / t * log2(n * t / (nv * nc)) ELSE 0 END) AS mi,
  sum((n - nv * nc / t) * (n - nv * nc / t) / (nv * nc / t)) AS chi2,
  -sum(CASE WHEN n > 0 THEN n / t * log2(nv / t) ELSE 0 END) - sum(CASE WHEN n > 0 THEN n / t * log2(nc / t) ELSE 0 END) AS h_sum,
  (sum(greatest(n / nv, CASE WHEN t > nv THEN (nc - n) / (t - nv) ELSE 0 END)) / any_value(k_v) - 1
   + sum(greatest(n / nc, CASE WHEN t > nc THEN (nv - n) / (t - nc) ELSE 0 END)) / any_value(k_c) - 1) / 2 AS significance
  FROM grid GROUP BY ALL)"""


def labels(spark, sf):
    """Gold and guessed return flags of lineitem; ``N`` counts as no label."""
    guess = (
        F.when(F.col("l_quantity") < 10, "_").when(F.col("l_tax") > 0.05, "A").when(F.col("l_linestatus") == "F", "R").otherwise("_")
    )
    gold = F.when(F.col("l_returnflag") == "N", "_").otherwise(F.col("l_returnflag"))
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("part_key"), gold.alias("gold"), guess.alias("pred"), (F.col("l_suppkey") % 5).alias("model")
    )


LABELS_SQL = """labelled AS (SELECT l_linenumber AS part_key, CASE WHEN l_returnflag = 'N' THEN '_' ELSE l_returnflag END AS gold,
  CASE WHEN l_quantity < 10 THEN '_' WHEN l_tax > 0.05 THEN 'A' WHEN l_linestatus = 'F' THEN 'R' ELSE '_' END AS pred,
  l_suppkey % 5 AS model FROM lineitem)"""


def stats_sql(keys=(), labeled=True, source="labelled"):
    ks = "".join(f"{k}, " for k in keys)
    same = "gold = pred" if labeled else "true"
    return f"""SELECT {ks}count(*) AS n,
  count(*) FILTER (gold <> '_' AND pred <> '_' AND {same}) AS tp,
  count(*) FILTER (pred <> '_' AND NOT (gold <> '_' AND {same})) AS fp,
  count(*) FILTER (gold = '_' AND pred = '_') AS tn,
  count(*) FILTER (gold <> '_' AND NOT (pred <> '_' AND {same})) AS fn FROM {source} GROUP BY ALL"""


def scores_sql(inner, keys=()):
    ks = "".join(f"{k}, " for k in keys)
    return f"""SELECT {ks}n, tp, fp, tn, fn, round((tp + tn) / n, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM ({inner}) AS s0) AS s1"""


def rounded(df, cols=("accuracy", "precision", "recall", "f1")):
    return df.withColumns({c: F.round(c, 9) for c in cols})
