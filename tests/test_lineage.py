"""Bootstraps against loops, components of long chains, grading, lineage and alignment of runs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import arrays as A
from verdigris.functions import text as T
from verdigris.operators import bootstrap, kernels, lifecycle, lineage, metrics, pairs, quality
from verdigris.sources import writers


def test_components_of_a_chain_of_any_length(spark):
    for n in (1, 2, 17, 40):
        related = [[abs(i - j) <= 1 for j in range(n)] for i in range(n)]
        cut = [[x and (i < n - 1) == (j < n - 1) for j, x in enumerate(row)] for i, row in enumerate(related)]
        df = spark.createDataFrame([(related, cut)], "a array<array<boolean>>, b array<array<boolean>>")
        row = df.select(A.components(F.col("a")).alias("a"), A.components(F.col("b")).alias("b")).first()
        assert row.a == [0] * n and row.b == [0] * (n - 1) + [min(n - 1, 1)]


def test_a_single_answer_needs_no_matrix(spark):
    prompts = spark.createDataFrame([("p1", "bio", "eval", "x?", ["y"])], "prompt_id string, dataset string, split string, prompt string, reference_answers array<string>")
    r = lifecycle.run_pipeline(prompts, lambda p, n: ["one"], run_id="r", model="m", tier="small", num_samples=1, seed=1)
    none = pairs.matrices(pairs.ordered_pairs(r, ["prompt_id"], "normalized_answers").withColumn("label", F.lit("neutral")), ["prompt_id"])
    assert lifecycle.recluster(r, none, ["prompt_id"], closure="components").first().semantic_clusters == [0]


def loop_hier(cells, draws, rng):
    """The definition: units drawn, and for each drawn slot the records of each of its seeds anew."""
    units = sorted({(c[0], c[1]) for c in cells})
    out = []
    for _ in range(draws):
        values = []
        for i in rng.integers(0, len(units), len(units)):
            deltas = []
            for d, m, left, right, bad in cells:
                if (d, m) == units[i]:
                    at = rng.integers(0, len(bad), len(bad))
                    one = np.ones((1, len(bad)))
                    x = kernels.weighted_auroc(left[at], bad[at], one)[0] - kernels.weighted_auroc(right[at], bad[at], one)[0]
                    if np.isfinite(x):
                        deltas.append(x)
            if deltas:
                values.append(np.mean(deltas))
        out.append(np.mean(values))
    return np.array(out)


def test_hier_draws_records_anew_for_each_slot(spark):
    rng = np.random.default_rng(3)
    cells, rows = [], []
    for d in "ab":
        for m in "cd":
            for s in (1, 2):
                bad = rng.random(60) < 0.5
                left, right = bad + rng.normal(size=60) * (1 + (d == "a")), rng.normal(size=60)
                cells.append((d, m, left, right, bad))
                rows += [("x", d, m, s, str(q), bool(b), float(x), float(y)) for q, (b, x, y) in enumerate(zip(bad, left, right))]
    df = spark.createDataFrame(rows, "slice string, dataset string, model string, seed int, qid string, incorrect boolean, l double, r double")
    got = np.array([r.delta for r in bootstrap.paired_draws(df, ["slice"], "l", "r", "hier", draws=1500).collect()])
    want = loop_hier(cells, 1500, np.random.default_rng(4))
    assert len(got) == 1500 and got.mean() == pytest.approx(want.mean(), abs=0.01) and got.std() == pytest.approx(want.std(), rel=0.08)
    slots = bootstrap.cell_draws(df, ["slice"], "l", "r", "hier", draws=50)
    assert slots.groupBy("draw", "seed").count().select("count").distinct().collect()[0][0] == 4
    twice = slots.groupBy("draw", "dataset", "model", "seed").agg(F.count("*").alias("n"), F.countDistinct("delta").alias("d")).where("n > 1")
    assert twice.count() > 0 and twice.where("d < n").count() < twice.count() / 10
    told = bootstrap.omissions(slots, ["slice"]).first()
    assert (told.invalid_cell_fraction, told.undefined_draw_fraction, told.mean_valid_unit_weight) == (0, 0, 4)


def test_linked_schemes_want_the_same_questions(spark):
    rows = [("x", "d", m, 1, str(q), q % 3 == 0, float(q * 7 % 11), float(q * 5 % 13)) for m in "ab" for q in range(30)]
    schema = "slice string, dataset string, model string, seed int, qid string, incorrect boolean, l double, r double"
    df = spark.createDataFrame(rows, schema)
    cells = bootstrap.cell_draws(df, ["slice"], "l", "r", "linked", draws=40)
    # Both models have the same records, so the same draws of questions give the same deltas.
    assert cells.groupBy("draw").agg(F.countDistinct("delta").alias("n")).where("n <> 1").count() == 0
    assert bootstrap.paired_draws(df, ["slice"], "l", "r", "crossed", draws=40).count() == 40
    for bad in (rows[:-1] + [("x", "d", "b", 1, "other", True, 1.0, 2.0)], rows[:-1], rows + rows[-1:]):
        with pytest.raises(quality.DataQualityError, match="different questions"):
            bootstrap.paired_draws(spark.createDataFrame(bad, schema), ["slice"], "l", "r", "linked", draws=5)


def test_weighted_auroc_in_blocks_of_any_size(spark, monkeypatch):
    rows = [("x", "d", "m", 1, str(q), q % 3 == 0, float(q * 7 % 11), float(q * 5 % 13)) for q in range(40)]
    df = spark.createDataFrame(rows, "slice string, dataset string, model string, seed int, qid string, incorrect boolean, l double, r double")
    first = sorted(r.delta for r in bootstrap.paired_draws(df, ["slice"], "l", "r", "records", draws=30).collect())
    monkeypatch.setattr(bootstrap, "HELD", 100)
    assert first == pytest.approx(sorted(r.delta for r in bootstrap.paired_draws(df, ["slice"], "l", "r", "records", draws=30).collect()))


def test_kernel_language_entropy_by_hand():
    """Two vectors: the kernel is [[1, e], [e, 1]] with e = exp(-1/2), its eigenvalues over the trace (1 +- e) / 2."""
    e = np.exp(-0.5)
    p = np.array([(1 + e) / 2, (1 - e) / 2])
    assert kernels.von_neumann_entropy(kernels.kernel_of(np.array([[0.0, 0.0], [3.0, 4.0]]), "rbf")) == pytest.approx(float(-(p * np.log(p)).sum()))


def test_models_with_logprobs_states_and_shuffles(spark):
    prompts = spark.createDataFrame([("p1", "bio", "eval", "x?", ["y"])], "prompt_id string, dataset string, split string, prompt string, reference_answers array<string>")
    pre = lifecycle.presample(prompts, run_id="r", model="m", tier="small", num_samples=2, seed=1)
    assert lifecycle.sample(pre, lambda p, n: ([p] * n, [-0.5] * n)).first().sequence_logprobs == [-0.5, -0.5]
    assert lifecycle.sample(pre, lambda p, n: [p] * n).first().sequence_logprobs is None
    with pytest.raises(Exception, match="instead of 2"):
        lifecycle.sample(pre, lambda p, n: [p]).collect()
    row = lifecycle.sample_with_states(pre, lambda p, n: {"answers": ["a"] * n, "greedy_answer": "g", "hidden_state": [1.0, 2.0], "metadata": {"b": 1, "a": None}}).first()
    assert (row.sampled_answers, row.sequence_logprobs, row.sep_greedy_answer, row.sep_hidden_state, json.loads(row.sep_feature_metadata)) == (["a", "a"], None, "g", [1.0, 2.0], {"a": None, "b": 1})
    pool = list("abcde")
    shuffled = list(pool)
    random.Random(3).shuffle(shuffled)
    assert spark.range(1).select(lifecycle.synthetic_samples(pool, 7, 3).alias("x")).first().x == [*shuffled, *shuffled[:2]]


def test_answer_token_count(spark):
    words = {1: " Paris", 2: " is", 3: "\n", 4: "Question:", 5: "</s>", 6: " "}
    decode = lambda ids: "".join(words[i] for i in ids)
    cases = [([1, 2, 1], 3), ([1, 2, 3, 4, 1], 2), ([3, 4], 1), ([], 1), ([5, 1], 1), ([1, 5, 2, 2], 1), ([1, 6, 6, 3, 1], 1), ([1, 2, 4, 1, 1], 2)]
    df = spark.createDataFrame([(i, ids) for i, (ids, _) in enumerate(cases)], "i int, ids array<int>")
    got = {r.i: r.n for r in df.select("i", lifecycle.answer_token_count("ids", decode, T.STOP_SEQUENCES, [5]).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, n in cases]


PROVENANCE = {"source": quality.AUTOMATED[0], "scope": quality.AUTOMATED[1], "judge_model": "j", "target": "t", "representative_policy": None}


def graded_rows(spark, human=False):
    own = PROVENANCE | ({"source": quality.HUMAN[0], "scope": quality.HUMAN[1]} if human else {})
    rows = [
        ("a", "bio", "q", ["r"], ["x", "y", "y"], None, False, None, {"s": 1.0}),
        ("b", "bio", "q", ["r"], ["x", "y", "y"], " z ", True, own, {"s": 1.0, "correctness_score": 0.1}),
        ("c", "svamp", "q", ["r"], ["x"], None, False, None, None),
        ("d", "bio", "q", ["r"], [], None, False, None, None),
    ]
    return spark.createDataFrame(rows, f"prompt_id string, dataset string, question string, reference_answers array<string>, sampled_answers array<string>, most_likely_answer string, correctness_label boolean, correctness_label_provenance {quality.PROVENANCE}, scores map<string,double>")


def test_grading_leaves_what_is_graded(spark):
    judge = lambda q, refs, samples, best: (best in ("y", "z"), 0.75)
    got = {r.prompt_id: r for r in lifecycle.graded_by(graded_rows(spark), judge, "judge", "bio").collect()}
    assert got["a"].correctness_label and got["a"].scores == {"s": 1.0, "correctness_score": 0.75} and got["a"].correctness_label_provenance.judge_model == "judge"
    assert got["a"].correctness_label_provenance.representative_policy == "exact_surface_mode_first_tie"
    assert got["b"].scores["correctness_score"] == 0.1 and got["b"].correctness_label_provenance.judge_model == "j"
    assert not got["c"].correctness_label and got["c"].correctness_label_provenance is None and not got["d"].correctness_label
    again = {r.prompt_id: r for r in lifecycle.graded_by(graded_rows(spark), judge, "judge", "bio", regrade=True).collect()}
    assert again["b"].scores["correctness_score"] == 0.75 and again["b"].correctness_label_provenance.representative_policy == "most_likely_answer"
    with pytest.raises(Exception, match="human"):
        lifecycle.graded_by(graded_rows(spark, True), judge, "judge", "bio", regrade=True).collect()
    assert lifecycle.graded_by(graded_rows(spark, True), judge, "judge").count() == 4


def test_scores_are_never_dropped_unseen(spark):
    rows = [("a", True, {"f": 0.5}, False), ("b", False, {}, True)]
    schema = "prompt_id string, correctness_label boolean, scores map<string,double>, gone boolean"
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in metrics.score_pairs(df, ["prompt_id"], "f", F.col("gone")).collect()] == [("a", True, 0.5)]
    assert [tuple(r) for r in metrics.score_coverage(df, [], ["f"], F.col("gone")).collect()] == [("f", 1, 1)]
    for bad, say in (({}, "missing"), ({"f": float("inf")}, "finite")):
        with pytest.raises(Exception, match=say):
            metrics.score_pairs(spark.createDataFrame([*rows, ("c", True, bad, False)], schema), ["prompt_id"], "f", F.col("gone")).collect()


def test_length_diagnostics(spark):
    rows = [("k", i % 2 == 0, i, 2 * i, None if i == 0 else i % 3, i / 10) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, bad boolean, g int, s int, caps int, score double")
    got = metrics.length_diagnostics(df, ["k"], "bad", "g", "s", "caps", ["score"]).first()
    assert (got.records, got.graded_mean, got.graded_median, got.cap_records, got.any_cap_share) == (8, 3.5, 3.5, 7, pytest.approx(5 / 7))

    def area(keep):
        pos, neg = [r[5] for r in rows if r[1] and keep(r)], [r[5] for r in rows if not r[1] and keep(r)]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)

    strata = {"all": lambda r: True, "shorter": lambda r: r[2] <= 3.5, "longer": lambda r: r[2] > 3.5, "no_cap": lambda r: r[4] == 0, "any_cap": lambda r: bool(r[4])}
    assert {k: got.aurocs[f"{k}:score"] for k in strata} == pytest.approx({k: area(f) for k, f in strata.items()})


def test_probe_artifacts(spark):
    good = {"coef": [0.5, -1.0], "intercept": 0.1, "hidden_dim": 2, "label_source": "semantic_entropy_threshold", "probe_kind": "semantic_entropy_probe", "label_threshold": 0.7, "source_score_field": "discrete_semantic_entropy", "train_size": 9, "positive_rate": 0.4, "metadata": {"threshold_fit_scope": "training_records_only", "train_prompt_content_sha256": "a" * 64, "eval_prompt_content_sha256": "b" * 64, "sampled_truncated": 1, "sampled_total": 10, "sampled_truncation_limit": 0.2}}
    assert lineage.artifact_problems(good) == []
    for change, problem in (({"coef": [0.5]}, "hidden_dim: the coefficients' number"), ({"intercept": float("nan")}, "intercept: finite number"), ({"probe_kind": None}, "probe_kind: the target's"), ({"label_threshold": None}, "label_threshold: finite number"), ({"pooling": "max"}, "pooling: known"), ({"train_size": 0}, "train_size: positive"), ({"metadata": good["metadata"] | {"sampled_truncated": 5}}, "metadata: truncation within its limit"), ({"metadata": good["metadata"] | {"eval_prompt_content_sha256": "a" * 64}}, "metadata: training and evaluation prompts differ"), ({"metadata": good["metadata"] | {"x_sha256": "zz"}}, "metadata.x_sha256: SHA-256")):
        assert lineage.artifact_problems(good | change) == [problem]
    fit = {"threshold": 0.7, "entropy_target_provenance": {"eval_source_artifact_sha256": "h"}}
    told = {"label_source": "semantic_entropy_threshold", "threshold_fit_scope": "training_records_only", "label_threshold": 0.7, "entropy_target_provenance": fit["entropy_target_provenance"], "source_score_field": "e"}
    records = spark.createDataFrame([("h", {"e": 0.7}), ("h", {"e": 0.6})], "source_artifact_sha256 string, scores map<string,double>")
    assert [r.target for r in lineage.probe_targets(records, told, fit).collect()] == [True, False]
    with pytest.raises(quality.DataQualityError, match="label_threshold"):
        lineage.probe_targets(records, told | {"label_threshold": 0.8}, fit)
    with pytest.raises(Exception, match="another artifact"):
        lineage.probe_targets(records.withColumn("source_artifact_sha256", F.lit("i")), told, fit).collect()
    fits = spark.createDataFrame([("s1", 0.1), ("s2", 0.2)], "sha256 string, threshold double")
    probes = spark.createDataFrame([("p", "s1"), ("q", "s2")], "name string, fit_sha256 string")
    assert {r.name: r.threshold for r in lineage.probe_fits(probes, fits).collect()} == {"p": 0.1, "q": 0.2}
    with pytest.raises(quality.DataQualityError):
        lineage.probe_fits(probes, fits.where("sha256 = 's1'"))
    rows = spark.createDataFrame([("m", 1), ("m", 1)], "model string, layer int")
    assert lineage.common_identity(rows, ["model", "layer"], "train") == {"model": "m", "layer": 1}
    with pytest.raises(quality.DataQualityError, match="layer"):
        lineage.common_identity(rows.union(spark.createDataFrame([("m", 2)], "model string, layer int")), ["model", "layer"], "train")
    assert lineage.content_digest(rows, ["model"]).first() == lineage.content_digest(rows.limit(1), ["model"]).first()


def runs(spark, **changed):
    rows = [(run, f"p{i}", "prompt", "m", i % 3 == 0, "j") for run in ("r1", "r2") for i in range(9)]
    grades = spark.createDataFrame(rows, "run_id string, prompt_id string, prompt string, model string, correctness_label boolean, judge_model string")
    backends = [(*r[:5], b, float((i * 7 + len(b)) % 5)) for b in ("nli", "judge") for i, r in enumerate(rows)]
    return grades, spark.createDataFrame(backends, "run_id string, prompt_id string, prompt string, model string, correctness_label boolean, entailment_backend string, se double")


def test_runs_are_aligned(spark):
    grades, backends = runs(spark)
    generations = grades.drop("judge_model")
    published = metrics.auroc(backends.withColumn("bad", ~F.col("correctness_label")), ["run_id", "entailment_backend"], "bad", "se").withColumn("method", F.lit("se"))
    check = lambda g=grades, a=generations, b=backends, p=published, n=9, j="j": lineage.validate_snapshot(g, a, b, p, ["se"], n, j).count()
    assert check() == 4
    first = (F.col("prompt_id") == "p1") & (F.col("run_id") == "r1")
    for wrong, say in ((dict(n=8), "size"), (dict(j="k"), "judge"), (dict(g=grades.where(~first)), "size"), (dict(a=generations.where(~first)), "different rows"), (dict(b=backends.where(~(first & (F.col("entailment_backend") == "nli")))), "lost or repeated"), (dict(b=backends.withColumn("model", F.when(first, "other").otherwise(F.col("model")))), "differ"), (dict(b=backends.withColumn("se", F.when(first, float("nan")).otherwise(F.col("se")))), "finite"), (dict(p=published.withColumn("auroc", F.col("auroc") + 0.001)), "published"), (dict(p=published.limit(3)), "published")):
        with pytest.raises(quality.DataQualityError, match=say):
            check(**wrong)


def test_reclustered_records_say_how(spark):
    row = spark.createDataFrame([("bidirectional", "anchor_scan", "sampled_answers", "question_answer_paper", True), ("non_defeating", "anchor_scan", "sampled_answers", "question_answer_paper", True)], "clustering_rule string, clustering_closure string, cluster_input string, entailment_input_format string, question_conditioned boolean")
    assert [r.v for r in row.select(quality.rules(lineage.recluster_checks(row)).alias("v")).collect()] == [[], ["clustering_rule: as expected"]]
    assert "question_conditioned: as expected" in row.select(quality.rules(lineage.recluster_checks(row.drop("question_conditioned"))).alias("v")).first().v
    df = spark.createDataFrame([(["a"], [" b"]), (["c"], [])], "sampled_answers array<string>, normalized_answers array<string>")
    assert lifecycle.cluster_input(df.where("size(normalized_answers) > 0")).first().cluster_answers == [" b"] and lifecycle.cluster_input(df, "raw").count() == 2
    with pytest.raises(Exception, match="no normalized answers"):
        lifecycle.cluster_input(df).collect()
    told = spark.createDataFrame([('"x y"',), ('{"response": "z", "n": 1}',)], "a string")
    assert [r.x for r in told.select(T.answer_of(F.col("a")).alias("x")).collect()] == ["x y", "z"]
    with pytest.raises(Exception, match="blank"):
        spark.range(1).select(T.question_answer_input(F.lit("  "), F.lit("a"))).collect()
    cells = lifecycle.as_cells(spark.createDataFrame([("c", "q2", True, 1, 2), ("c", "q1", False, 3, 4)], "c string, q string, ok boolean, a int, b int"), ["c"], "q", "ok", "a", "b").first()
    assert tuple(cells) == ("c", ["q1", "q2"], [True, False], [3.0, 1.0], [4.0, 2.0])


def test_replication_splits(spark, tmp_path):
    rows = [(i, f"q{i}", None, ["a"] if i % 10 else []) for i in range(60)]
    train = spark.createDataFrame(rows, "source_index long, question string, context string, answers array<string>")
    told = writers.write_replication(train, train, str(tmp_path / "out"), num_samples=12, few_shot=3, ptrue=4)
    assert told == json.loads("".join(p.read_text() for p in (tmp_path / "out/manifest").glob("part*")))
    assert not told["train_overlap_with_prompts"] and len(set(told["train_selected"])) == 12 and len(told["validation_selected"]) == 12
    lines = lambda name: [json.loads(x) for p in sorted((tmp_path / "out" / name).glob("part*")) for x in p.read_text().splitlines()]
    assert [r["source_index"] for r in lines("train")] == told["train_selected"] and [r["source_index"] for r in lines("fewshot")] == told["prompt_indices"]
    assert lines("fewshot")[0]["context"] == "" and all(r["source_index"] % 10 for r in lines("train") + lines("ptrue_examples"))
    again = writers.write_replication(train, train, str(tmp_path / "again"), num_samples=12, few_shot=3, ptrue=4)
    assert again == told
    writers.write_summary(train.limit(1).select("source_index", "question"), str(tmp_path / "sum"))
    assert "".join(p.read_text() for p in (tmp_path / "sum/json").glob("part*")) == '{"question":"q0","source_index":0}\n'
    sources = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    writers.write_export(train.select("question"), str(tmp_path / "exp"), sources)
    assert "".join(p.read_text() for p in sorted((tmp_path / "exp/manifest").glob("part*"))) == '{"path":"a","sha256":"1"}\n{"path":"b","sha256":"2"}\n'


def test_prompts_digests_and_gates(spark):
    import hashlib

    body = "Question: q\nBrainstormed Answers: \na\nb\np\nPossible answer: p\nIs the possible answer:\nA) True\nB) False\nThe possible answer is:"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = F.array(F.lit(" a"), F.lit("b "))
    example = lambda ok: F.struct(F.lit("q").alias("question"), arr.alias("answers"), F.lit("p").alias("proposed"), F.lit(ok).alias("correct"))
    prefix = one(T.ptrue_prefix(F.array(example(True), example(False))))
    assert prefix == f"{T.PTRUE_BRIEF}\n\n{body} A\n\n{body} B"
    assert one(T.ptrue_prompt(F.lit("q"), arr, F.lit("p"), F.lit(prefix + " \n"))) == f"{prefix}\n{body}"
    assert one(T.ptrue_prompt(F.lit("q"), arr, F.lit("p"), F.lit(""))) == body == one(T.ptrue_prompt(F.lit("q"), arr, F.lit("p")))
    want = hashlib.sha256(json.dumps(["7", 'é "x"'], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(T.claim_identity(F.lit(7), F.lit(' é "x" '))) == want
    with pytest.raises(Exception, match="proposition"):
        one(T.claim_identity(F.lit(7), F.lit(" ")))
    rows = [["b", "d", "s", 'q "é"\n', ["x", "y\\"]], ["a", "d", "s", "p", []]]
    df = spark.createDataFrame(rows, "prompt_id string, dataset string, split string, prompt string, reference_answers array<string>")
    payload = json.dumps(sorted(rows, key=lambda r: r[0]), ensure_ascii=False, separators=(",", ":"))
    assert lineage.prompt_content_digest(df).first().digest == hashlib.sha256(payload.encode()).hexdigest()
    for bad in (df.union(df), df.withColumn("prompt", F.lit(" "))):
        with pytest.raises(quality.DataQualityError):
            lineage.prompt_content_digest(bad)
    answers = spark.createDataFrame([("x" * 90, "yes"), ("x" * 100, "no")], "a string, v string")
    assert quality.require_answer_length(answers, "a", "chat") == 95 and quality.require_verdicts(answers, "v") == {"no": 1, "yes": 1}
    with pytest.raises(quality.DataQualityError):
        quality.require_answer_length(answers, "a", "default")
    with pytest.raises(quality.DataQualityError):
        quality.require_verdicts(answers.limit(1), "v")
