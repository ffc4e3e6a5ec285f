"""Registered queries against their SQL on tables that the generated data doesn't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdigris.functions import arrays as A
from verdigris.operators import metrics


def both(spark, name, folder, table):
    """A query's rows from Spark and from DuckDB, as text that tells -0.0 from 0.0, sorted."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{x}"' for x in columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect()), sorted(repr(r) for r in want)


V = [x / 100 for x in range(64)]
VECTORS = {
    "null": [(0, V, 1), (1, None, 1), (2, None, 2)],
    "empty": [(0, V, 1), (1, [], 1), (2, [], 2)],
    "short": [(0, V, 1), (1, V[:3], 1), (2, V[:3], 2)],
    "long": [(0, [*V, 5.0, 6.0], 1), (1, V, 1)],
    "null components": [(0, [None] * 64, 1), (1, [None, *V[1:]], 2)],
    "nan": [(0, [float("nan"), *V[1:]], 1), (1, [float("-inf"), *V[1:]], 2)],
    "null label": [(0, V, None), (1, V, 1)],
    "negative zero": [(0, [-1e-7] * 64, 1), (1, [1e-7] * 64, 2)],
    "none": [],
}


@pytest.mark.parametrize("case", VECTORS)
def test_pool_hidden_mean(spark, tmp_path, case):
    spark.createDataFrame(VECTORS[case], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, "pool_hidden_mean", tmp_path, "embeddings")
    assert got == want


def test_a_permuted_matrix_is_computed_once(spark):
    """Random matrices and labels show how often they are computed: once, all picks of one cell are equal."""
    matrix = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda _: F.array(F.rand(), F.rand()))
    order = F.array(F.lit(1), F.lit(1), F.lit(1))
    got = spark.range(1).select(A.submatrix(matrix, order).alias("m"), A.restored(F.array_repeat(F.rand(), 3), F.array(F.lit(2), F.lit(0), F.lit(1))).alias("r")).first()
    assert len({x for row in got.m for x in row}) == 1
    assert len(set(got.r)) == 1


def test_partition_changed_computes_its_relation_once(spark):
    plan = entry.queries()["partition_changed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("abs(") == 1


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_retained_accuracies_are_a_running_mean(spark):
    """A frame from each row to the group's end would be summed anew for every row."""
    rows = [(g, x, (x * 7 + g) % 3 == 0, None if x % 11 == 0 else float(x % 5)) for g in range(2) for x in range(40)]
    df = spark.createDataFrame(rows, "g int, x int, ok boolean, s double")
    curve = metrics.rejection_curve(df, ["g"], "ok", "s", ["x"])
    assert "currentrow$(), unboundedfollowing" not in plan_of(curve)
    got = {(r.g, r.rejected): (r.retained, r.accuracy) for r in curve.collect()}
    means = {}
    for g in range(2):
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))
        for k in range(40):
            left = [r[2] for r in ordered[k:]]
            assert got.pop((g, k)) == (len(left), pytest.approx(sum(left) / len(left)))
            means[g] = means.get(g, 0) + sum(left) / len(left) / 40
    assert not got
    step = {r.g: r.aurac for r in metrics.aurac_step(df, ["g"], "ok", "s", ["x"]).collect()}
    assert step == pytest.approx(means)


def test_metric_summary_uses_a_running_mean(spark):
    df = spark.createDataFrame([(0, 1, True, 0.5), (0, 2, False, 0.7)], "g int, x int, correct boolean, score double")
    found = metrics.metric_summary(df, ["g"], order=["x"])
    assert "currentrow$(), unboundedfollowing" not in plan_of(found)
    assert found.first().aurac == pytest.approx(0.75)
