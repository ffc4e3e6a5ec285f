"""The report tables on the order grid (regions stand for backends, segments for generators), audits, and the clustering experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import bootstrap, experiments, grid, reports
from verdigris.operators import quality as Q
from verdigris.plans import base as B
from verdigris.plans.catalogue import query
from verdigris.plans.grids import HIGH, LOW
from verdigris.plans.pairs import loose, strict

c = F.col
W = f"WITH {B.GRID}"
MODELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEEDS = [0, 1, 2]
OWN = dict(zip(PRIORITIES, REGIONS, strict=True))
PAIRED = f"paired AS (SELECT a.dataset, a.model, a.seed, a.value AS l, b.value AS r, a.accuracy AS la, b.accuracy AS ra, a.n AS ln, b.n AS rn FROM grid a JOIN grid b USING (dataset, model, seed) WHERE a.method = '{HIGH}' AND b.method = '{LOW}')"
UNITS = f"{PAIRED}, units AS (SELECT dataset, model, avg(l) AS l, avg(r) AS r, avg(la) AS la, avg(ra) AS ra, avg(ln) AS ln, avg(rn) AS rn FROM paired GROUP BY ALL)"


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _name(level) -> str:
    return str(level).lower().replace(" ", "_").replace("-", "_") if not isinstance(level, int) else f"seed_{level}"


def _named(df, keys, levels):
    return df.select(*keys, *[F.round(c(f"`{x}`"), 6).alias("m_" + _name(x)) for x in levels])


def _cases(column, levels, value="m"):
    return ", ".join(f"round(avg(CASE WHEN {column} = {x!r} THEN {value} END), 6) AS m_{_name(x)}" for x in levels)


def _gaps(s, d, keys, value="value"):
    return reports.gap_table(B.order_grid(s, d), keys, "method", HIGH, LOW, value)


@query(f"{W}, own(method, dataset) AS (VALUES {', '.join(map(str, OWN.items()))}), u AS (SELECT method, dataset, model, avg(value) AS m FROM grid JOIN own USING (method, dataset) GROUP BY ALL) SELECT method, dataset, round(avg(m), 6) AS unit_mean, count(*) AS n_units, count(*) = 5 AS complete FROM u GROUP BY method, dataset")
def report_sentence_length(s, d):
    own = reports.own_backend(B.order_grid(s, d), OWN, "dataset")
    return _r(grid.unit_mean(own, ["method", "dataset"], "value", ("model",)).withColumn("complete", c("n_units") == 5), "unit_mean")


@query(f"{W}, g AS (SELECT dataset, model, method, seed, 'value' AS grader, value AS v FROM grid UNION ALL SELECT dataset, model, method, seed, 'accuracy', accuracy FROM grid), u AS (SELECT dataset, model, method, grader, avg(v) AS m FROM g GROUP BY ALL) SELECT grader, {_cases('method', PRIORITIES)} FROM u GROUP BY grader")
def report_short_phrase(s, d):
    long = B.order_grid(s, d).unpivot(["dataset", "model", "seed", "method"], ["value", "accuracy"], "grader", "v")
    return _named(reports.side_by_side(long, ["grader"], "method", PRIORITIES, "v"), ["grader"], PRIORITIES)


GAP_COLUMNS = "round(avg(l), 6) AS left_mean, round(avg(r), 6) AS right_mean, round(avg(l - r), 6) AS gap, round(quantile_cont(l - r, 0.025), 6) AS lo, round(quantile_cont(l - r, 0.975), 6) AS hi, count(*) AS n_units"


@query(f"{W}, {UNITS} SELECT dataset, {GAP_COLUMNS} FROM units GROUP BY dataset")
def report_backend_spread(s, d):
    return _r(_gaps(s, d, ["dataset"]), "left_mean", "right_mean", "gap", "lo", "hi")


@query(f"{W}, {PAIRED}, ci AS (SELECT dataset, model, quantile_cont(l - r, 0.025) AS lo, quantile_cont(l - r, 0.975) AS hi FROM paired GROUP BY ALL) SELECT dataset, sum(CASE WHEN lo > 0 THEN 1 ELSE 0 END)::BIGINT AS n_left, sum(CASE WHEN hi < 0 THEN 1 ELSE 0 END)::BIGINT AS n_right, sum(CASE WHEN lo <= 0 AND hi >= 0 THEN 1 ELSE 0 END)::BIGINT AS n_neither FROM ci GROUP BY dataset")
def report_all_slices_spread(s, d):
    delta = grid.paired_delta(B.order_grid(s, d), ["dataset", "model", "seed"], "method", HIGH, LOW, "value")
    ci = delta.groupBy("dataset", "model").agg(F.percentile("delta", F.lit(0.025)).alias("lo"), F.percentile("delta", F.lit(0.975)).alias("hi"))
    side = ci.select("dataset", grid.direction(c("lo"), c("hi")).alias("side"))
    return side.groupBy("dataset").agg(*[F.count_if(c("side") == x).alias(f"n_{x}") for x in ("left", "right", "neither")])


@query(f"{W}, {UNITS}, t AS (SELECT dataset, {GAP_COLUMNS} FROM units GROUP BY dataset), b AS (SELECT r_name AS dataset, min(n_nationkey) AS first_nation, count(*) AS k FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL) SELECT dataset, gap, k AS n_matches, CASE WHEN k = 1 THEN first_nation END AS n_nationkey FROM t JOIN b USING (dataset) UNION ALL SELECT 'NOWHERE', NULL, 0, NULL")
def report_interval_lookup(s, d):
    nations = B.table(s, d, "nation").join(F.broadcast(B.table(s, d, "region")), c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("dataset"), "n_nationkey")
    gaps = _r(_gaps(s, d, ["dataset"]), "gap").select("dataset", "gap").unionByName(s.createDataFrame([("NOWHERE", None)], "dataset string, gap double"))
    return reports.exactly_one(gaps, nations, ["dataset"], ["n_nationkey"])


@query(f"{W}, {UNITS} SELECT dataset, round(avg(l - r), 6) AS value_gap, round(avg(la - ra), 6) AS accuracy_gap FROM units GROUP BY dataset")
def report_grader_check(s, d):
    cells = B.order_grid(s, d)
    long = cells.unpivot(["dataset", "model", "seed", "method"], ["value", "accuracy"], "grader", "v")
    wide = reports.gap_table(long, ["dataset", "grader"], "method", HIGH, LOW, "v").groupBy("dataset").pivot("grader", ["value", "accuracy"]).agg(F.first("gap"))
    return _r(wide.select("dataset", c("value").alias("value_gap"), c("accuracy").alias("accuracy_gap")), "value_gap", "accuracy_gap")


@query(f"{W}, {UNITS} SELECT model, {_cases('dataset', REGIONS, 'l - r')} FROM units GROUP BY model")
def report_backend_by_model(s, d):
    return _named(_gaps(s, d, ["model", "dataset"]).groupBy("model").pivot("dataset", REGIONS).agg(F.first("gap")), ["model"], REGIONS)


@query(f"{W}, u AS (SELECT dataset, model, method, avg(accuracy) AS m FROM grid GROUP BY ALL) SELECT dataset, method, {_cases('model', MODELS)} FROM u GROUP BY dataset, method")
def report_correctness(s, d):
    return _named(reports.side_by_side(B.order_grid(s, d), ["dataset", "method"], "model", MODELS, "accuracy"), ["dataset", "method"], MODELS)


@query(f"{W}, u AS (SELECT dataset, model, method, avg(value) AS m FROM grid GROUP BY ALL) SELECT dataset, method, {_cases('model', MODELS)} FROM u GROUP BY dataset, method")
def report_complete_t1(s, d):
    return _named(reports.side_by_side(B.order_grid(s, d), ["dataset", "method"], "model", MODELS, "value"), ["dataset", "method"], MODELS)


@query(f"{W}, u AS (SELECT dataset, model, method, seed, avg(value) AS m FROM grid GROUP BY ALL) SELECT dataset, method, {_cases('seed', SEEDS)} FROM u GROUP BY dataset, method")
def report_complete_temperature(s, d):
    return _named(reports.side_by_side(B.order_grid(s, d), ["dataset", "method"], "seed", SEEDS, "value"), ["dataset", "method"], SEEDS)


@query(f"{W}, {UNITS} SELECT model, dataset, {GAP_COLUMNS} FROM units GROUP BY model, dataset")
def report_longform_by_generator_spread(s, d):
    return _r(_gaps(s, d, ["model", "dataset"]), "left_mean", "right_mean", "gap", "lo", "hi")


@query(f"{W}, {UNITS} SELECT dataset, round(avg(ln), 6) AS left_mean, round(avg(rn), 6) AS right_mean, round(avg(ln - rn), 6) AS gap FROM units GROUP BY dataset")
def report_answer_length(s, d):
    return _r(_gaps(s, d, ["dataset"], "n"), "left_mean", "right_mean", "gap").select("dataset", "left_mean", "right_mean", "gap")


@query(f"{W}, spans AS (SELECT method, dataset, model, max(value) - min(value) AS r FROM grid GROUP BY ALL HAVING count(*) > 1), m AS (SELECT method, dataset, avg(r) AS a, max(r) AS b FROM spans GROUP BY ALL) SELECT method, round(avg(a), 6) AS mean_range, round(max(b), 6) AS max_range FROM m GROUP BY method")
def report_seed_noise(s, d):
    return _r(reports.seed_noise(B.order_grid(s, d), ["method"], ["dataset"], "value"), "mean_range", "max_range")


@query(f"{W}, seen AS (SELECT method, dataset, count(*) AS k FROM grid GROUP BY ALL), want(method, dataset, n_expected) AS (SELECT m, g, 15 FROM (SELECT unnest({PRIORITIES[:4]}) AS m), (SELECT unnest({REGIONS + ['NOWHERE']}) AS g)) SELECT method, dataset, coalesce(k, 0) AS n_cells, 0::BIGINT AS n_repeated, CASE WHEN k IS NULL THEN 'missing' WHEN n_expected IS NULL THEN 'unexpected' ELSE 'incomplete' END AS problem FROM seen FULL JOIN want USING (method, dataset) WHERE k IS NULL OR n_expected IS NULL OR k <> n_expected")
def measurement_coverage(s, d):
    want = s.createDataFrame([(m, g, 15) for m in PRIORITIES[:4] for g in [*REGIONS, "NOWHERE"]], "method string, dataset string, n_expected long")
    return Q.grid_coverage(B.order_grid(s, d), ["method", "dataset"], ["model", "seed"], want)


def _intervals(s, d, keys, unit=reports.UNIT):
    return reports.gap_intervals(B.order_grid(s, d), keys, "method", HIGH, LOW, "value", unit)


@query()
def report_backend(s, d):
    return _r(_intervals(s, d, ["dataset"]), "left_mean", "right_mean", "gap", "lo", "hi")


@query()
def ci_direction_label(s, d):
    return _r(_intervals(s, d, ["model"]).select("model", "lo", "hi", grid.direction(c("lo"), c("hi")).alias("side")), "lo", "hi")


@query()
def report_all_slices(s, d):
    """The slices of a dataset are its seeds; a slice's units are its models."""
    side = _intervals(s, d, ["dataset", "seed"], ("model",)).select("dataset", grid.direction(c("lo"), c("hi")).alias("side"))
    return side.groupBy("dataset").agg(*[F.count_if(c("side") == x).alias(f"n_{x}") for x in ("left", "right", "neither")])


def _scored(s, d, *more):
    return B.scored(s, d).select(*more, "dataset", "model", "seed", F.concat_ws("/", "user_id", "rec").alias("qid"), (~c("correct")).alias("incorrect"), *B.METHODS)


@query()
def report_longform_by_generator(s, d):
    """Per generator and backend (model and dataset of the scored records), records drawn within cells."""
    keys = ["generator", "backend"]
    r = _scored(s, d, c("model").alias("generator"), c("dataset").alias("backend"))
    return _r(bootstrap.interval(bootstrap.paired_draws(r, keys, "discrete_semantic_entropy", "surface_entropy", "records"), keys), "lower", "upper", "p")


@query()
def resampling_schemes(s, d):
    """Per scheme: discrete semantic entropy against each other score, intervals right of zero, left of it, and their mean width."""
    others = [m for m in B.METHODS if m != "discrete_semantic_entropy"]
    r = _scored(s, d).unpivot(["dataset", "model", "seed", "qid", "incorrect", "discrete_semantic_entropy"], others, "slice", "other")
    out = []
    for scheme in ("records", "units", "hier"):
        ci = bootstrap.interval(bootstrap.paired_draws(r, ["slice"], "discrete_semantic_entropy", "other", scheme), ["slice"])
        out.append(ci.agg(F.lit(scheme).alias("scheme"), F.count("*").alias("n"), F.count_if(c("lower") > 0).alias("n_left"), F.count_if(c("upper") < 0).alias("n_right"), F.avg(c("upper") - c("lower")).alias("mean_width")))
    return _r(out[0].unionByName(out[1]).unionByName(out[2]), "mean_width")


@query(f"{W}, u AS (SELECT model, avg(value) AS v, min(value) AS a, max(value) AS b, avg(accuracy) AS p FROM grid GROUP BY ALL), x AS (SELECT model, v + CASE WHEN model = 'BUILDING' THEN 1 ELSE 0 END AS delta, v, CASE WHEN model = 'FURNITURE' THEN b ELSE a END AS lo, CASE WHEN model = 'FURNITURE' THEN a ELSE b END AS hi, CASE WHEN model = 'MACHINERY' THEN p + 1 ELSE p END AS p FROM u) SELECT model, list_filter([CASE WHEN abs(delta - v) > 2e-6 THEN 'delta: as measured' END, CASE WHEN lo > hi THEN 'interval: in order' END, CASE WHEN p NOT BETWEEN 0 AND 1 THEN 'p: within [0, 1]' END], lambda x: x IS NOT NULL) AS violations FROM x")
def interval_consistency(s, d):
    u = B.order_grid(s, d).groupBy("model").agg(F.avg("value").alias("v"), F.min("value").alias("a"), F.max("value").alias("b"), F.avg("accuracy").alias("p"))
    swapped = c("model") == "FURNITURE"
    lo, hi = F.when(swapped, c("b")).otherwise(c("a")), F.when(swapped, c("a")).otherwise(c("b"))
    delta = c("v") + F.when(c("model") == "BUILDING", 1).otherwise(0)
    return u.select("model", Q.rules(Q.interval_checks(delta, c("v"), lo, hi, F.when(c("model") == "MACHINERY", c("p") + 1).otherwise(c("p")))).alias("violations"))


@query("WITH d AS (SELECT *, CASE WHEN crc % 3 = 0 THEN 'eval' ELSE 'train' END AS split FROM (SELECT doc_id, lang, text, doc_id % 7 AS crc FROM documents)), k AS (SELECT bool_or(split = 'train') AND bool_or(split = 'eval') AS both_sides FROM d GROUP BY doc_id), t AS (SELECT bool_or(split = 'train') AND bool_or(split = 'eval') AS both_sides FROM d GROUP BY lang, text) SELECT 'n_left' AS measure, count(*) FILTER (split = 'train') AS value FROM d UNION ALL SELECT 'n_right', count(*) FILTER (split = 'eval') FROM d UNION ALL SELECT 'shared_keys', count(*) FILTER (both_sides) FROM k UNION ALL SELECT 'shared_content', count(*) FILTER (both_sides) FROM t")
def split_audit(s, d):
    docs = B.table(s, d, "documents").select("doc_id", "lang", "text", F.when(c("doc_id") % 7 % 3 == 0, "eval").otherwise("train").alias("split"))
    return Q.split_audit(docs, "split", "doc_id", ["lang", "text"], "train", "eval")


@query("SELECT doc_id, max(toxic) AS toxic, CASE WHEN bool_or(l.toxic IS NULL) THEN 'right' END AS side FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY doc_id")
def label_propagation(s, d):
    graded = B.table(s, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return Q.propagated_labels(graded, B.table(s, d, "documents").select("doc_id").distinct(), [], "doc_id", "toxic")


@query("SELECT source, count(*) AS n, quantile_cont(length(text), 0.5) AS median_length FROM documents GROUP BY source HAVING quantile_cont(length(text), 0.5) < 3000")
def median_length_gate(s, d):
    return Q.median_gate(B.table(s, d, "documents"), ["source"], "text", 3000)


@query("SELECT user_id, count(DISTINCT round(value / 100, 0)) AS n_values, min(round(value / 100, 0)) = max(round(value / 100, 0)) AS constant FROM events GROUP BY user_id HAVING count(DISTINCT round(value / 100, 0)) < 4")
def distinct_value_gate(s, d):
    return Q.spread_gate(B.table(s, d, "events").select("user_id", (c("value") / 100).alias("v")), ["user_id"], "v", 0, 4)


@query("SELECT user_id, round(avg(value) FILTER (event_id % 5 > 1), 6) AS mean_value FROM events GROUP BY user_id")
def finite_mean(s, d):
    v = F.when(c("event_id") % 5 == 0, F.lit(float("nan"))).when(c("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(c("value"))
    return _r(B.table(s, d, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(Q.finite_mean(c("v")).alias("mean_value")), "mean_value")


@query(f"WITH RECURSIVE {B.SCORED} SELECT dataset, model, count(*) AS records, count(*) FILTER (NOT correct) AS incorrect, count(*) FILTER (NOT correct) BETWEEN 1 AND count(*) - 1 AS eligible FROM scored GROUP BY dataset, model")
def clustering_eligibility(s, d):
    r = B.records(s, d).withColumn("incorrect", ~c("correct"))
    return experiments.eligibility(r, ["dataset", "model"], "incorrect")


def _replicates(s, d):
    r = B.records(s, d).withColumn("incorrect", ~c("correct"))
    keep = ["user_id", "rec", "dataset", "model", "incorrect"]
    return experiments.replicates(r, keep, ["user_id", "rec"], {"strict": strict(), "loose": loose()}, c("norm")), keep


@query()
def clustering_experiment(s, d):
    rows, _ = _replicates(s, d)
    aurocs = experiments.cell_aurocs(rows.withColumn("score", F.round("score", 9)), [], ["dataset", "model"], "incorrect")
    return _r(experiments.summary(aurocs, []), "mean_auroc", "minimum", "maximum")


@query()
def clustering_order_diagnostics(s, d):
    rows, keep = _replicates(s, d)
    return _r(experiments.order_diagnostics(rows, keep), "partition_change", "entropy_change", "entropy_range")
