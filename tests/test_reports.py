"""Feature rules, the clustering experiment against loops, and lookups that must be total."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.operators import experiments, quality, reports
from verdigris.sources.schema import FEATURE


def feature(**changed):
    sha = "a" * 40
    row = dict(quality.FEATURE_PROTOCOL) | {
        "sampling_max_new_tokens": 64, "model_id": "m", "model_revision": sha, "tokenizer_id": "t", "tokenizer_revision": sha, "hidden_layer": 31, "hidden_dimension": 2, "base_seed": 7, "prompt_seed": 8,
        "greedy_degenerate_excluded": False, "feature_token_basis": None, "feature_backfill": None, "termination_token_ids": [1, 2], "terminating_special_token_id": 2,
        "generated_content_token_index": 3, "full_sequence_token_index": 40, "sampled_eos_or_eot_count": 9, "sampled_max_new_tokens_count": 1,
    }
    return row | changed


BACK = {"method": "stop", "token_selection": "last", "model_id": "m", "model_revision": "b" * 40, "hidden_layer": 31}
GONE = {"greedy_degenerate_excluded": True, "hidden_dimension": None, "terminating_special_token_id": None, "generated_content_token_index": None, "full_sequence_token_index": None}


@pytest.mark.parametrize(("metadata", "hidden", "want"), [
    (feature(), [0.5, 1.0], []),
    (feature(feature_token_basis="stop_truncated", terminating_special_token_id=None), [0.5, 1.0], []),
    (feature(**GONE), None, []),
    (feature(**GONE, feature_backfill=BACK) | {"hidden_dimension": 2}, [0.5, 1.0], []),
    (feature(**GONE), [0.5, 1.0], ["hidden state: finite vector, or none if excluded"]),
    (feature(**GONE, feature_backfill=BACK | {"model_revision": "b"}) | {"hidden_dimension": 2}, [0.5, 1.0], ["feature_backfill: named and revised"]),
    (feature(protocol="other"), [0.5, 1.0], ["feature.protocol: admitted value"]),
    (feature(termination_token_ids=[2, 1]), [0.5, 1.0], ["feature.termination_token_ids: sorted, distinct, not empty"]),
    (feature(terminating_special_token_id=9), [0.5, 1.0], ["feature: terminator"]),
    (feature(generated_content_token_index=256), [0.5, 1.0], ["feature: position within the budget"]),
    (feature(sampled_eos_or_eot_count=10), [0.5, 1.0], ["feature: termination counts"]),
    (feature(base_seed=6), [0.5, 1.0], ["decoding.seed: as in the feature"]),
    (feature(), [0.5, float("nan")], ["hidden state: finite vector, or none if excluded"]),
    (feature(hidden_dimension=3), [0.5, 1.0], ["feature.hidden_dimension: the vector's length"]),
    (feature(model_revision="xyz"), [0.5, 1.0], ["feature.model_revision: full revision"]),
])
def test_feature_rules(spark, metadata, hidden, want):
    decoding = {"num_samples": 10, "temperature": 1.0, "top_p": 0.9, "top_k": 50, "max_new_tokens": 64, "seed": 7}
    schema = f"m struct<{FEATURE.replace(' string', ': string').replace(' double', ': double').replace(' int', ': int').replace(' long', ': long').replace(' boolean', ': boolean').replace(' array<', ': array<').replace(' struct<', ': struct<').replace(':: ', ': ')}>, h array<double>, g string, d struct<num_samples: int, temperature: double, top_p: double, top_k: int, max_new_tokens: int, seed: int>"
    df = spark.createDataFrame([(metadata, hidden, "answer", decoding)], schema.replace(":: ", ": "))
    checks = quality.feature_checks(F.col("m"), F.col("h"), F.col("g"), F.col("d"))
    assert df.select(quality.rules(checks).alias("v")).first().v == want


def scan(related, order):
    ids, k = {}, 0
    for at, i in enumerate(order):
        if i in ids:
            continue
        for j in order[at:]:
            if j == i or related[i][j]:
                ids[j] = k
        k += 1
    return ids


def entropy(labels):
    n = len(labels)
    return sum(-v / n * math.log(v / n) for v in sorted(Counter(labels).values()))


def same_parts(a, b, n):
    return all((a[i] == a[j]) == (b[i] == b[j]) for i in range(n) for j in range(n))


def test_clustering_experiment_against_loops(spark):
    n, orders, sizes, subsets, seed = 5, 4, (2, 4), 3, 11
    data = []
    for q in range(6):
        near = [[i == j or (i * j + i + j + q) % 3 == 0 for j in range(n)] for i in range(n)]
        data.append((q, q % 3 == 0, near, [str((q * i) % 3) for i in range(n)]))
    df = spark.createDataFrame(data, "q int, incorrect boolean, near array<array<boolean>>, norm array<string>")
    rows = experiments.replicates(df, ["q", "incorrect"], ["q"], {"near": F.col("near")}, F.col("norm"), n, orders, sizes, subsets, seed)
    got = {(r.q, r.experiment, r.samples, r.repeat, r.method): (r.score, r.changed) for r in rows.collect()}
    want = {}
    for q, _, near, norm in data:
        plain = scan(near, range(n))
        for e, m, rep in [("order", n, r) for r in range(orders)] + [("samples", m, r) for m in sizes for r in range(subsets)] + [("samples", n, 0)]:
            order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{e}:{m}:{rep}:{q}:{i}".encode()).hexdigest())  # noqa: B023
            order = order if e == "order" else sorted(order[:m])
            ids = scan(near, order)
            want[q, e, m, rep, "near"] = (entropy(list(ids.values())), not same_parts(ids, plain, n) if e == "order" else None)
            if e == "samples":
                want[q, e, m, rep, "surface"] = (entropy([norm[i] for i in order]), None)
    assert got.keys() == want.keys()
    for k, (score, changed) in want.items():
        assert got[k][0] == pytest.approx(score, abs=1e-12) and got[k][1] == changed, k
    moved = {r.q: r for r in experiments.order_diagnostics(rows, ["q"], n).collect()}
    for q in range(6):
        own = want[q, "samples", n, 0, "near"][0]
        scores = [want[q, "order", n, r, "near"][0] for r in range(orders)]
        assert moved[q].entropy_change == pytest.approx(sum(abs(s - own) > 1e-12 for s in scores) / orders)
        assert moved[q].entropy_range == pytest.approx(max([*scores, own]) - min([*scores, own]))
        assert moved[q].partition_change == pytest.approx(sum(want[q, "order", n, r, "near"][1] for r in range(orders)) / orders)
    out = {(r.experiment, r.samples, r.method): (r.repeats, r.valid_cells) for r in experiments.summary(experiments.cell_aurocs(rows, [], [], "incorrect"), []).collect()}
    assert out == {("order", 5, "near"): (4, 1), ("samples", 2, "near"): (3, 1), ("samples", 4, "near"): (3, 1), ("samples", 5, "near"): (1, 1), ("samples", 2, "surface"): (3, 1), ("samples", 4, "surface"): (3, 1), ("samples", 5, "surface"): (1, 1)}


def test_total_lookups_and_gates(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "k string, lo double")
    assert sorted(map(tuple, reports.exactly_one(left, right, ["k"], ["lo"]).collect()), key=str) == [("a", 1, 1.0), ("b", 2, None), ("c", 0, None)]
    cells = spark.createDataFrame([("x", 1, 0.5), ("x", 1, 0.5), ("y", 1, float("nan")), ("y", 2, 1.5)], "m string, s int, v double")
    want = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "m string, n_expected long")
    assert {r.m: r.problem for r in quality.grid_coverage(cells, ["m"], ["s"], want).collect()} == {"x": "repeated", "z": "missing"}
    bad = cells.select("m", "s", quality.rules(quality.range_checks(["v"])).alias("bad")).where(F.size("bad") > 0)
    assert sorted(map(tuple, bad.select("m", "s").collect())) == [("y", 1), ("y", 2)]
    n = spark.createDataFrame([("svamp", 300), ("bio", 1), ("other", 5)], "d string, n int")
    assert [r.d for r in n.where(F.size(quality.rules(quality.count_checks(F.col("d"), F.col("n")))) > 0).orderBy("d").collect()] == ["bio", "other"]
    empty = cells.where("false")
    assert quality.spread_gate(empty, ["m"], "v", 3).count() == 0 and {r.measure: r.value for r in quality.split_audit(empty.withColumn("p", F.lit("l")), "p", "m", ["s"], "l", "r").collect()} == {"n_left": 0, "n_right": 0, "shared_keys": 0, "shared_content": 0}


def test_registered_bootstraps_run_the_operators_draws(spark, monkeypatch):
    import __spark_entry__ as entry
    from verdigris.operators import bootstrap

    seen = []
    monkeypatch.setattr(bootstrap, "paired_draws", lambda *a, draws=bootstrap.DRAWS, **b: seen.append(draws) or spark.createDataFrame([("all", 0, 0.5)], "slice string, draw long, delta double"))
    for name in ("bootstrap_records", "bootstrap_hier", "bootstrap_linked", "bootstrap_crossed"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [2000] * 4


def test_gap_intervals_are_those_of_the_mean(spark):
    rows = [(x, "m", seed, method, float(u) if method == "a" else 0.0) for u in range(10) for x in [f"d{u}"] for seed in (0, 1) for method in "ab"]
    cells = spark.createDataFrame([("all", *r) for r in rows], "slice string, dataset string, model string, seed int, method string, value double")
    got = reports.gap_intervals(cells, ["slice"], "method", "a", "b", "value").first()
    # The mean of ten draws from 0 to 9 has a deviation of 0.908; the units' own percentiles are 0.225 and 8.775.
    assert (got.n_units, got.gap) == (10, 4.5)
    assert got.lo == pytest.approx(4.5 - 1.96 * 0.908, abs=0.25) and got.hi == pytest.approx(4.5 + 1.96 * 0.908, abs=0.25)


def test_schemes_and_generators_resample(spark):
    import __spark_entry__ as entry

    known, data = entry.queries(), "/root/testdata/sf0.001"
    schemes = {r.scheme: r for r in known["resampling_schemes"](spark, data).collect()}
    assert set(schemes) == {"records", "units", "hier"} and len({r.mean_width for r in schemes.values()}) == 3
    assert any(r.lower < r.upper for r in known["report_longform_by_generator"](spark, data).collect())
    assert sum(r.n_left + r.n_right + r.n_neither for r in known["report_all_slices"](spark, data).collect()) > 0


def test_registered_clustering_runs_all_replicates(spark):
    from verdigris.plans import reports as plans

    rows, keep = plans._replicates(spark, "/root/testdata/sf0.001")
    first = rows.where("method = 'strict'").groupBy(*keep).agg(F.countDistinct("experiment", "samples", "repeat").alias("n")).select("n").distinct().collect()
    assert [r.n for r in first] == [251]
