"""Golden vectors, readers and writers, lifecycle, quality rules, bootstrap and probe kernels."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import arrays as A
from verdigris.functions import text as T
from verdigris.operators import bootstrap, kernels, lifecycle, metrics, pairs, probes, quality
from verdigris.sources import readers, writers
from verdigris.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs))


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.normalize_qa, "Shakespeare's", "shakespeares"), (T.normalize_qa, "the Eiffel  Tower", "eiffel tower"), (T.normalize_qa, "a aé an", "aé"),
    (T.normalize_numeric, "1,000", "1000"), (T.normalize_numeric, "the answer is 7 apples", "7"), (T.normalize_numeric, "3 + 5 = 8", "8"), (T.normalize_numeric, "7.0", "7"), (T.normalize_numeric, "3.5", "3.5"),
    (T.normalize_numeric, " Eighty ", "80"), (T.normalize_numeric, "x = y", "x = y"), (T.normalize_numeric, "-0.50", "-0.5"), (T.normalize_numeric, "twenty-one", "twenty-one"),
    (T.normalize_basic, " Seven  ", "7"), (T.normalize_basic, "seven apples", "seven apples"), (T.normalize_freeform, " 'Hi there . ", "hi there "),
    (T.extract_entity, "Tell me a bio of Marie Curie.", "Marie Curie"), (T.extract_answer, "<A>Davis</A>\n\n<s>[INST] more", "Davis"), (T.extract_answer, " \n [OUT] Paris <b>\nLyon", "Paris"),
    (T.extract_answer, "a b", "a"), (T.truncate_at_stop, "Paris\nQuestion: x", "Paris"), (T.truncate_at_stop, "Paris", "Paris"), (T.parse_yes_no, ' "Yes', "entailment"), (T.canonical_label, "not entailed", "entailment"),
])
def test_golden_text(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_prompts_and_keys(spark):
    import hashlib

    assert one(spark, T.prompt_seed(F.lit(42), F.lit("hé"))) == int.from_bytes(hashlib.sha256("42\0hé".encode()).digest()[:8], "big") % (2**63 - 1)
    assert one(spark, T.grading_prompt(F.lit("q"), arr("a", "it's"), F.lit("p"))).split("question: ")[2].startswith("['a', \"it's\"].")
    with pytest.raises(Exception, match="conflicting"):
        one(spark, T.resolve_question(F.lit("a"), F.lit("b")))
    with pytest.raises(Exception, match="unrecognized"):
        one(spark, T.parse_verdict(F.lit("perhaps")))


def test_token_f1(spark):
    for a, b, want in (("", "", 1.0), ("x", "", 0.0), ("a b b", "b b c", 2 / 3), ("x y", "y z", 0.5)):
        assert one(spark, T.token_f1(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert one(spark, T.best_answer_correct(F.lit("x y"), arr("y z"), F.lit("nqopen"))) is True
    assert one(spark, T.best_answer_correct(F.lit("x"), F.array().cast("array<string>"), F.lit("nqopen"))) is False


def test_golden_clusters_and_entropies(spark):
    assert one(spark, A.first_ids(arr("paris", "paris", "lyon", "paris"))) == [0, 0, 1, 0]
    assert one(spark, A.first_ids(arr("7", "seven", "7"))) == [0, 1, 0]
    chain = F.array(arr(True, False, True), arr(False, True, True), arr(True, True, True))
    assert one(spark, A.anchor_scan(chain)) == [0, 1, 1]
    assert one(spark, A.components(chain)) == [0, 0, 0]
    assert one(spark, A.entropy(arr(1, 1, 1, 3, 4))) == pytest.approx(0.9502705)
    assert one(spark, A.entropy(arr("a", "b", "c", "d", "d"))) == pytest.approx(1.3321790)
    ids, lp = arr(0, 0, 1, 2, 0), arr(-1.5, -1.5, -1.5, -1.5, -1.5)
    assert one(spark, A.semantic_entropy_full(ids, lp)) == pytest.approx(one(spark, A.entropy(ids)))
    assert one(spark, A.logsumexp(arr(-math.inf, -math.inf))) == -math.inf
    assert one(spark, A.most_frequent(arr("b", "a", "a", "b"))) == "b"
    assert one(spark, A.majority_representative(arr(1, 0, 0, 1), arr("p", "q", "r", "s"))) == "q"


def test_random_matrices_against_loops(spark):
    rng = random.Random(0)
    rows = [[[int(rng.random() < 0.35) for _ in range(7)] for _ in range(7)] for _ in range(40)]
    df = spark.createDataFrame([(i, [[x == 1 for x in r] for r in m]) for i, m in enumerate(rows)], "i int, m array<array<boolean>>")
    got = {r.i: r for r in df.select("i", A.anchor_scan(A.mutual(F.col("m"))).alias("a"), A.components(A.mutual(F.col("m"))).alias("c")).collect()}
    for i, m in enumerate(rows):
        both = lambda a, b, m=m: a == b or (m[a][b] and m[b][a])
        ids, k = [-1] * 7, 0
        for a in range(7):
            if ids[a] == -1:
                for b in range(a, 7):
                    if both(a, b):
                        ids[b] = k
                k += 1
        root = list(range(7))
        for _ in range(7):
            root = [min(root[b] for b in range(7) if both(a, b)) for a in range(7)]
        order = list(dict.fromkeys(root))
        assert got[i].a == ids and got[i].c == [order.index(x) for x in root]
        assert max(got[i].c) <= max(got[i].a)


def test_auroc_variants_agree(spark):
    rng = random.Random(1)
    data = [("k", rng.random() < 0.4, rng.randrange(5) / 4, rng.randrange(3)) for _ in range(200)] + [("one", True, 0.5, 1)]
    df = spark.createDataFrame(data, "k string, y boolean, s double, w int")
    pos, neg = [s for k, y, s, _ in data if k == "k" and y], [s for k, y, s, _ in data if k == "k" and not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    for got in (metrics.auroc(df, ["k"], "y", "s"), metrics.auroc_by_ranks(df, ["k"], "y", "s")):
        found = {r.k: r.auroc for r in got.collect()}
        assert found["k"] == pytest.approx(want) and found["one"] is None
    expanded = df.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w")))).where("x > 0")
    a, b = (({r.k: r.auroc for r in d.collect()})["k"] for d in (metrics.auroc(df, ["k"], "y", "s", "w"), metrics.auroc(expanded, ["k"], "y", "s")))
    assert a == pytest.approx(b)
    s, y = np.array([x[2] for x in data[:-1]]), np.array([x[1] for x in data[:-1]])
    assert kernels.weighted_auroc(s, y, np.array([[x[3] for x in data[:-1]]]))[0] == pytest.approx(a)
    perfect = spark.createDataFrame([("c", True, i / 10) for i in range(30)], "k string, correct boolean, s double")
    assert metrics.aurac_quantiles(perfect, ["k"], "correct", "s").first().aurac_paper == pytest.approx(20 * 0.9 / 19)


def test_best_split_threshold(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.0, 0.1, 2.0, 2.2)] + [("tie", x) for x in (0.0, 1.0, 2.0)], "k string, v double")
    got = {r.k: r.threshold for r in metrics.best_split_threshold(df, ["k"], "v").collect()}
    assert got == {"a": pytest.approx(1.05), "tie": pytest.approx(0.5)}


def test_kernel_language_entropy():
    same = np.ones((4, 3))
    assert kernels.von_neumann_entropy(kernels.kernel_of(same, "rbf")) == pytest.approx(0, abs=1e-6)
    far = np.eye(4) * 1e3
    assert kernels.von_neumann_entropy(np.eye(4)) == pytest.approx(math.log(4))
    assert kernels.kernel_of(far, "rbf")[0, 1] == pytest.approx(math.exp(-1 / 2))


def test_bootstrap_intervals(spark):
    rng = random.Random(2)
    rows = [("x", d, m, s, str(q), rng.random() < 0.5) for d in "ab" for m in "cd" for s in (1, 2) for q in range(40)]
    df = spark.createDataFrame([(*r, r[-1] + rng.random() * 1.2, rng.random()) for r in rows], "slice string, dataset string, model string, seed int, qid string, incorrect boolean, l double, r double")
    for scheme in ("records", "units", "hier", "linked", "crossed"):
        draws = bootstrap.paired_draws(df, ["slice"], "l", "r", scheme, draws=60, block=25)
        told = bootstrap.interval(draws, ["slice"]).first()
        assert draws.count() == 60 and told.lower <= told.upper and told.lower > 0 and told.p < 0.1
        assert told == bootstrap.interval(bootstrap.paired_draws(df.repartition(5), ["slice"], "l", "r", scheme, draws=60, block=25), ["slice"]).first()


def test_probe(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(v.tolist(), bool(v @ [2, -1, 0.5] > 0)) for v in x], "h array<double>, y boolean")
    probe = probes.train_probe(df, "h", "y")
    probes.save_probe(probe, str(tmp_path / "p.json"))
    scored = probes.score_probe(df, probes.load_probe(str(tmp_path / "p.json")), "h")
    assert scored.where((F.col("probe_uncertainty") > 0.5) == F.col("y")).count() > 185
    with pytest.raises(ValueError, match="both classes"):
        probes.train_probe(df.where("y"), "h", "y")
    with pytest.raises(Exception, match="width"):
        probes.score_probe(df.withColumn("h", F.slice("h", 1, 2)), probe, "h").collect()
    states = F.array(arr(1.0, 2.0), arr(3.0, 4.0), arr(5.0, 6.0))
    assert [one(spark, A.pooled(states, how, 2)) for how in ("last", "mean", "mean_last_k")] == [[5.0, 6.0], [3.0, 4.0], [4.0, 5.0]]


def test_readers(spark, tmp_path):
    q = tmp_path / "q.jsonl"
    q.write_text("\n".join(json.dumps(x) for x in [{"QuestionId": "1", "Question": "Capital?", "Answer": {"Value": "Paris", "Aliases": ["", "paree"]}}, {"QuestionId": "2", "Question": "x", "Answer": {"Value": "y"}}]) + "\n")
    assert [r.reference_answers for r in readers.read_questions(spark, str(q), "eval").orderBy("prompt_id").collect()] == [["paree"], ["y"]]
    assert [r.reference_answers for r in readers.read_questions(spark, str(q), "eval", both=True).orderBy("prompt_id").collect()] == [["Paris", "paree"], ["y"]]
    assert [r.prompt_id for r in readers.union_sources(readers.read_questions(spark, str(q), "eval").where("prompt_id = '2'"), readers.read_questions(spark, str(q), "eval"), limit=2).collect()] == ["2", "1"]
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as out:
        out.write(json.dumps({"ID": "a", "Body": "B.", "Question": "Q?", "Answer": 7.0}) + "\n" + json.dumps({"ID": "b", "Body": "B.", "Question": "Q?", "Answer": 2.5}) + "\n")
    assert readers.read_stub(spark, "all", {"triviaqa": str(q), "svamp": str(tmp_path / "s.jsonl.gz")}).count() == 4
    got = readers.read_arithmetic(spark, str(tmp_path / "s.jsonl.gz"), "eval").orderBy("prompt_id").collect()
    assert [(r.prompt, r.reference_answers) for r in got] == [("B. Q?", ["7"]), ("B. Q?", ["2.5"])]
    blank = tmp_path / "blank.jsonl"
    blank.write_text('{"prompt_id": "1"}\n\n')
    assert readers.read_records(spark, str(blank), strict=False).count() == 1
    with pytest.raises(Exception, match="blank line"):
        readers.read_records(spark, str(blank)).collect()
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="not a valid object"):
        readers.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(Exception, match="not a valid object"):
        readers.read_records(spark, str(tmp_path / "bad.jsonl"), strict=False).collect()
    (tmp_path / "lines.jsonl").write_text('{"id": "a"}\n\n[1]\n{"id": 3}\n{nope\n{"id": true}\n{"x": 1}\n')
    assert [n for n, _ in readers.bad_lines(spark, str(tmp_path / "lines.jsonl"), {"id": str}, limit=9)] == [2, 3, 4, 5, 6, 7]
    assert [n for n, _ in readers.bad_lines(spark, str(tmp_path / "lines.jsonl"), {"id": str}, blanks=False)][0] == 3
    cell = tmp_path / "cells" / "repl-chat-eval-triviaqa-Some-Model-7B-s42-123"
    cell.mkdir(parents=True)
    (cell / "r.jsonl").write_text('{"prompt_id": "1"}\n')
    r = readers.read_cells(spark, str(tmp_path / "cells/*/*.jsonl")).first()
    assert (r.regime, r.split_role, r.dataset_key, r.model_key, r.seed_key) == ("chat", "eval", "triviaqa", "Some-Model-7B", 42)
    (tmp_path / "t.json").write_text(json.dumps([{"entity": e, "wikipedia_title": t, "frequency_bin": "rare"} for e, t in (("a", "A"), ("b", "A"), ("c", "C"))]))
    topics = readers.read_topics(spark, str(tmp_path / "t.json"))
    assert sorted(r.entity for r in topics.collect()) == ["a", "c"]
    pages = readers.fetch_pages(topics.select("wikipedia_title"), lambda t: None if t == "C" else "x" * 300)
    assert [r.wikipedia_title for r in readers.intro_in_band(pages).collect()] == ["A"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.1234567)], "b int, a string, c double")
    writers.write_jsonl(df, str(tmp_path / "o"))
    line = "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert line == '{"a":null,"b":1,"c":0.1234567}\n'
    with pytest.raises(quality.DataQualityError):
        writers.write_jsonl(df, str(tmp_path / "o"), source=str(tmp_path / "o"))
    writers.write_csv(df, str(tmp_path / "c"), 6)
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part*")) == "b,a,c\n1,,0.123457\n"
    cache = spark.createDataFrame([("k1", "neutral"), ("k1", "neutral"), ("k2", "entailment")], "key string, label string")
    for _ in range(2):
        writers.grow_cache(cache, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_lifecycle_and_quality(spark, tmp_path):
    prompts = spark.createDataFrame([("p1", "triviaqa", "eval", "Capital?", ["Paris"]), ("p2", "svamp", "eval", "3+4?", ["7"])], "prompt_id string, dataset string, split string, prompt string, reference_answers array<string>")
    model = lambda p, n: [["<A>Paris</A>", "the paris!", "Lyon"] if p == "Capital?" else ["seven", "it is 7", "8"]][0][:n]
    r = lifecycle.run_pipeline(prompts, model, run_id="r", model="m", tier="small", num_samples=3, seed=1)
    got = {x.prompt_id: x for x in r.collect()}
    assert got["p1"].semantic_clusters == [0, 0, 1] and got["p1"].cluster_representatives == ["paris", "lyon"] and got["p1"].correctness_label
    assert got["p2"].normalized_answers == ["7", "7", "8"] and got["p2"].scores["surface_entropy"] == pytest.approx(0.6365142)
    checked = r.withColumn("violations", quality.rules(quality.record_checks(r) | quality.cluster_checks(F.col("semantic_clusters"), F.col("cluster_representatives"), F.col("normalized_answers"))))
    assert quality.require(checked).count() == 2
    broken = checked.withColumn("scores", F.map_concat("scores", F.create_map(F.lit("bad"), F.lit(float("nan"))))).withColumn("model_tier", F.lit("huge")).drop("violations")
    names = broken.select(quality.rules(quality.record_checks(broken)).alias("v")).first().v
    assert names == ["model_tier: closed vocabulary", "scores: finite, not negative"]
    with pytest.raises(quality.DataQualityError):
        quality.require(broken.withColumn("violations", quality.rules(quality.record_checks(broken))))
    asked = []
    p = pairs.ordered_pairs(r, ["prompt_id"], "normalized_answers")
    done, cache = pairs.labelled(p, spark.createDataFrame([], "key string, label string"), lambda m: m.withColumn("label", F.lit("entailment")))
    again, _ = pairs.labelled(p, cache, lambda m: asked.append(m.count()) or m.withColumn("label", F.lit("neutral")))
    assert asked == [0]
    m = pairs.matrices(again, ["prompt_id"])
    new = lifecycle.recluster(r, m, ["prompt_id"])
    assert {x.prompt_id: x.semantic_clusters for x in new.collect()} == {"p1": [0, 0, 0], "p2": [0, 0, 0]}
    paper = {x.prompt_id: x.correctness_label for x in lifecycle.graded(r.drop("most_likely_answer"), paper=True).collect()}
    assert paper == {"p1": True, "p2": True}
    writers.write_jsonl(r.select("prompt_id", "dataset", "sampled_answers", "scores"), str(tmp_path / "in"))
    incremental.write_scores(incremental.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert lifecycle.seeded_positions(100, 5, 10) == random.Random(10).sample(range(100), 5)
    split = lifecycle.seeded_split(spark.range(10).selectExpr("id"), "id", {"train": 6, "eval": 3}, 7)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 6, "eval": 3}


def test_seeded_split_refuses_more_ids_than_it_shuffles(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "MOST_IDS", 5)
    assert lifecycle.seeded_split(spark.range(5), "id", {"a": 2, "b": 3}, 1).count() == 5
    with pytest.raises(ValueError):
        lifecycle.seeded_split(spark.range(6), "id", {"a": 2, "b": 3}, 1)
