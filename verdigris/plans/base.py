"""Stand-ins that turn the star schema's tables into samples, records, scored cells and grids, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import arrays as A
from verdigris.functions import text as T

M = 10
METHODS = ["naive_sample_entropy", "surface_entropy", "discrete_semantic_entropy", "naive_entropy", "semantic_entropy_full"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Ten consecutive events of a user are one record's samples, a user's last ones perhaps fewer: (user_id, rec, i, k, lp, raw, norm)."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int").alias("k"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    t, m = F.col("event_type"), F.col("event_id") % 4
    raw = F.when(m == 0, t).when(m == 1, F.concat(F.lit("The "), F.upper(t))).when(m == 2, F.concat(t, F.lit("."))).otherwise(F.concat(F.lit("  a  "), t, F.lit(" ")))
    s = e.select("user_id", rn.alias("rn"), "k", (-F.col("value") / 100).alias("lp"), raw.alias("raw"))
    s = s.select("user_id", F.floor(F.col("rn") / M).cast("long").alias("rec"), (F.col("rn") % M).alias("i"), "k", "lp", "raw")
    return s.select("user_id", "rec", "i", "k", "lp", "raw", T.normalize_qa(F.col("raw")).alias("norm"))


def keyed(df: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return df.withColumns({"dataset": F.concat(F.lit("d"), u % 3), "model": F.concat(F.lit("m"), F.floor(u / 9) % 3), "seed": (F.floor(u / 3) % 3).cast("int")})


def records(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, rec, dataset, model, seed, raw, norm, lp, k: arrays of ten or fewer, correct)."""
    s = samples(spark, d).groupBy("user_id", "rec").agg(F.array_sort(F.collect_list(F.struct("i", "raw", "norm", "lp", "k"))).alias("s"))
    r = keyed(s).select("user_id", "rec", "dataset", "model", "seed", *[F.col(f"s.{n}").alias(n) for n in ("raw", "norm", "lp", "k")])
    return r.withColumn("correct", F.get("k", 0) % 2 == 0)


def codes(k: Column) -> Column:
    """Entailment codes between answers: 0 contradiction, 1 entailment, 2 neutral."""
    return T.let(k, lambda v: F.transform(v, lambda a: F.transform(v, lambda b: F.when(F.abs(a - b) > 60, 0).when(a <= b + 15, 1).otherwise(2))))


def entails(k: Column) -> Column:
    return T.let(codes(k), lambda c: F.transform(c, lambda row: F.transform(row, lambda x: x == 1)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """records with ids (anchor clusters) and the five scores, rounded to nine places so that ties are exact."""
    r = records(spark, d).withColumn("ids", A.anchor_scan(A.mutual(entails(F.col("k")))))
    scores = [A.entropy(F.col("raw")), A.entropy(F.col("norm")), A.entropy(F.col("ids")), A.naive_entropy(F.col("lp")), A.semantic_entropy_full(F.col("ids"), F.col("lp"))]
    return r.withColumns({m: F.round(s, 9) for m, s in zip(METHODS, scores, strict=True)})


def long_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per record and method: (user_id, rec, dataset, model, seed, correct, method, score)."""
    s = scored(spark, d).select("user_id", "rec", "dataset", "model", "seed", "correct", *METHODS)
    return s.unpivot(["user_id", "rec", "dataset", "model", "seed", "correct"], METHODS, "method", "score")


def order_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a factorial grid: (dataset, model, seed, method, value, accuracy, n) from orders, customers and regions."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    g = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = g.groupBy(F.col("r_name").alias("dataset"), F.col("c_mktsegment").alias("model"), (F.year("o_orderdate") % 3).alias("seed"), F.col("o_orderpriority").alias("method"))
    return cells.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1e6).alias("value"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def sql_entropy(x: str) -> str:
    p = f"(len(list_filter({x}, lambda q: q = v)) / len({x}))"
    return f"list_sum(list_transform(list_distinct({x}), lambda v: -{p} * ln({p})))"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


SAMPLES = f"""
numbered AS (SELECT user_id, event_id, event_type, value, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
samples AS (
  SELECT *, {sql_norm('raw')} AS norm FROM (
    SELECT user_id, rn // 10 AS rec, CAST(rn % 10 AS INTEGER) AS i, k, -value / 100 AS lp,
      CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'The ' || upper(event_type) WHEN 2 THEN event_type || '.' ELSE '  a  ' || event_type || ' ' END AS raw
    FROM numbered))"""
RECORDS = SAMPLES + """,
records AS (
  SELECT user_id, rec, 'd' || (user_id % 3) AS dataset, 'm' || (user_id // 9 % 3) AS model, CAST(user_id // 3 % 3 AS INTEGER) AS seed,
    list(raw ORDER BY i) AS raw, list(norm ORDER BY i) AS norm, list(lp ORDER BY i) AS lp, list(k ORDER BY i) AS k, arg_min(k, i) % 2 = 0 AS correct
  FROM samples GROUP BY user_id, rec)"""
MATRIX = RECORDS + """,
matrices AS (SELECT user_id, rec, list_transform(k, lambda a: list_transform(k, lambda b: CASE WHEN abs(a - b) > 60 THEN 0 WHEN a <= b + 15 THEN 1 ELSE 2 END)) AS c FROM records)"""
STRICT = "list_transform(range(1, len(c) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda j: i = j OR (c[i][j] = 1 AND c[j][i] = 1)))"
LOOSE = "list_transform(range(1, len(c) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda j: i = j OR ((c[i][j] = 1 OR c[j][i] = 1) AND c[i][j] <> 0 AND c[j][i] <> 0)))"


def sql_anchor(related: str) -> str:
    """WITH RECURSIVE parts that give anchored(user_id, rec, ids)."""
    return f"""
scan(user_id, rec, e, i, a, n) AS (
  SELECT user_id, rec, e, 1, list_transform(e, lambda x: -1), 0 FROM (SELECT user_id, rec, {related} AS e FROM matrices)
  UNION ALL
  SELECT user_id, rec, e, i + 1, CASE WHEN a[i] <> -1 THEN a ELSE list_transform(range(1, len(e) + 1), lambda j: CASE WHEN j = i OR (j > i AND e[i][j]) THEN n ELSE a[j] END) END, CASE WHEN a[i] <> -1 THEN n ELSE n + 1 END
  FROM scan WHERE i <= len(e)),
anchored AS (SELECT user_id, rec, list_transform(a, lambda x: CAST(x AS INTEGER)) AS ids FROM scan WHERE i = len(e) + 1)"""


def sql_components(related: str) -> str:
    parts = [f"r0 AS (SELECT user_id, rec, {related} AS r FROM matrices)"]
    for n in range(4):
        parts.append(f"r{n + 1} AS (SELECT user_id, rec, list_transform(range(1, len(r) + 1), lambda i: list_transform(range(1, len(r) + 1), lambda j: len(list_filter(range(1, len(r) + 1), lambda q: r[i][q] AND r[q][j])) > 0)) AS r FROM r{n})")
    parts.append("roots AS (SELECT user_id, rec, list_transform(r, lambda row: list_position(row, true)) AS t FROM r4)")
    parts.append("joined AS (SELECT user_id, rec, list_transform(t, lambda x: CAST(len(list_distinct(t[1:list_position(t, x)])) - 1 AS INTEGER)) AS ids FROM roots)")
    return ",\n".join(parts)


SCORED = MATRIX + "," + sql_anchor(STRICT) + f""",
scored AS (
  SELECT r.*, ids, round({sql_entropy('raw')}, 9) AS naive_sample_entropy, round({sql_entropy('norm')}, 9) AS surface_entropy, round({sql_entropy('ids')}, 9) AS discrete_semantic_entropy,
    round(-list_sum(lp) / len(lp), 9) AS naive_entropy,
    round(list_sum(list_transform(list_distinct(ids), lambda v: -(list_sum(list_transform(list_filter(range(1, len(ids) + 1), lambda j: ids[j] = v), lambda j: exp(lp[j]))) / list_sum(list_transform(lp, lambda x: exp(x)))) * ln(list_sum(list_transform(list_filter(range(1, len(ids) + 1), lambda j: ids[j] = v), lambda j: exp(lp[j]))) / list_sum(list_transform(lp, lambda x: exp(x)))))), 9) AS semantic_entropy_full
  FROM records r JOIN anchored USING (user_id, rec))"""
LONG = SCORED + """,
long AS (SELECT user_id, rec, dataset, model, seed, correct, method, score FROM scored UNPIVOT (score FOR method IN (naive_sample_entropy, surface_entropy, discrete_semantic_entropy, naive_entropy, semantic_entropy_full)))"""
GRID = """
grid AS (
  SELECT r_name AS dataset, c_mktsegment AS model, CAST(year(o_orderdate) % 3 AS INTEGER) AS seed, o_orderpriority AS method,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e6 AS value, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
