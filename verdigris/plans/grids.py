"""Grid and bootstrap queries, and the report tables' queries on an order grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.operators import bootstrap, grid
from verdigris.plans import base as B
from verdigris.plans.catalogue import query

c = F.col
W = f"WITH {B.GRID}"
HIGH, LOW = "1-URGENT", "5-LOW"


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _delta(s, d):
    return grid.paired_delta(B.order_grid(s, d), ["dataset", "model", "seed"], "method", HIGH, LOW, "value")


DELTA = f"delta AS (SELECT a.dataset, a.model, a.seed, a.value - b.value AS delta FROM grid a JOIN grid b USING (dataset, model, seed) WHERE a.method = '{HIGH}' AND b.method = '{LOW}')"


@query(f"{W}, u AS (SELECT method, dataset, model, avg(value) AS m FROM grid GROUP BY ALL) SELECT method, round(avg(m), 6) AS unit_mean, count(*) AS n_units FROM u GROUP BY method")
def unit_mean(s, d):
    return _r(grid.unit_mean(B.order_grid(s, d), ["method"], "value"), "unit_mean")


@query(f"{W}, {DELTA} SELECT dataset, model, seed, round(delta, 6) AS delta FROM delta")
def paired_delta_pivot(s, d):
    return _r(_delta(s, d), "delta")


@query(f"{W}, {DELTA}, levels AS (SELECT 'dataset' AS omitted_factor, dataset AS omitted, delta FROM delta UNION ALL SELECT 'model', model, delta FROM delta), t AS (SELECT sum(delta) AS s, count(*) AS n FROM delta) SELECT omitted_factor, omitted, round(any_value(s / n), 6) AS full_delta, round((any_value(s) - sum(delta)) / (any_value(n) - count(*)), 6) AS retained_delta, round((any_value(s) - sum(delta)) / (any_value(n) - count(*)) - any_value(s / n), 6) AS change FROM levels, t GROUP BY omitted_factor, omitted")
def leave_one_out(s, d):
    return _r(grid.leave_one_out(_delta(s, d), ["dataset", "model"]), "full_delta", "retained_delta", "change")


@query(f"{W}, spans AS (SELECT method, max(value) - min(value) AS r FROM grid GROUP BY method, dataset, model HAVING count(*) > 1) SELECT method, count(*) AS n_configurations, round(avg(r), 6) AS mean_seed_range, round(max(r), 6) AS max_seed_range FROM spans GROUP BY method")
def seed_range(s, d):
    return _r(grid.seed_range(B.order_grid(s, d), ["method"], ["dataset", "model"], "value"), "mean_seed_range", "max_seed_range")


@query(f"{W} SELECT method, model, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd FROM grid GROUP BY ALL")
def mean_sd_by_seed(s, d):
    return _r(B.order_grid(s, d).groupBy("method", "model").agg(F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("sd")), "mean_value", "sd")


STEPS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "4-NOT SPECIFIED"), ("4-NOT SPECIFIED", "5-LOW")]


@query(f"{W}, steps(a, b) AS (VALUES {', '.join(map(str, STEPS))}), x AS (SELECT steps.a AS step_from, steps.b AS step_to, l.dataset, avg(r.value - l.value) AS m FROM steps JOIN grid l ON l.method = a JOIN grid r ON r.method = b AND r.dataset = l.dataset AND r.model = l.model AND r.seed = l.seed GROUP BY ALL) SELECT step_from, step_to, round(avg(m), 6) AS mean_delta, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END)::BIGINT AS n_positive, count(*) AS n_slices FROM x GROUP BY ALL")
def ladder_steps(s, d):
    wide = B.order_grid(s, d).groupBy("dataset", "model", "seed").pivot("method", [STEPS[0][0], *[b for _, b in STEPS]]).agg(F.first("value"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("step_from"), F.lit(b).alias("step_to"), (c(f"`{b}`") - c(f"`{a}`")).alias("x")) for a, b in STEPS]))
    slices = wide.select("dataset", steps.alias("t")).where("t.x is not null").groupBy("t.step_from", "t.step_to", "dataset").agg(F.avg("t.x").alias("m"))
    return _r(slices.groupBy("step_from", "step_to").agg(F.avg("m").alias("mean_delta"), F.count_if(c("m") > 0).alias("n_positive"), F.count("*").alias("n_slices")), "mean_delta")


@query(f"{W} SELECT method, coalesce(model, 'all') AS level, round(avg(value), 6) AS mean_value, count(*) AS n FROM grid GROUP BY GROUPING SETS ((method, model), (method))")
def model_and_all_levels(s, d):
    return _r(grid.model_and_all_levels(B.order_grid(s, d), ["method"], "model", "value"), "mean_value")


@query(f"{W}, {DELTA}, ci AS (SELECT model, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM delta GROUP BY model) SELECT model, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 THEN 'left' WHEN hi < 0 THEN 'right' ELSE 'neither' END AS side FROM ci")
def ci_direction_spread(s, d):
    ci = _delta(s, d).groupBy("model").agg(F.percentile("delta", F.lit(0.025)).alias("lo"), F.percentile("delta", F.lit(0.975)).alias("hi"))
    return _r(ci.withColumn("side", grid.direction(c("lo"), c("hi"))), "lo", "hi")


@query(f"{W}, {DELTA}, ci AS (SELECT model, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM delta GROUP BY model) SELECT sum(CASE WHEN lo > 0 THEN 1 ELSE 0 END)::BIGINT AS n_left, sum(CASE WHEN hi < 0 THEN 1 ELSE 0 END)::BIGINT AS n_right, round(avg(hi - lo), 6) AS mean_width FROM ci")
def resampling_schemes_spread(s, d):
    ci = _delta(s, d).groupBy("model").agg(F.percentile("delta", F.lit(0.025)).alias("lo"), F.percentile("delta", F.lit(0.975)).alias("hi"))
    return _r(ci.agg(F.count_if(c("lo") > 0).alias("n_left"), F.count_if(c("hi") < 0).alias("n_right"), F.avg(c("hi") - c("lo")).alias("mean_width")), "mean_width")


@query(f"{W}, u AS (SELECT method, seed, avg(value) AS v FROM grid GROUP BY ALL) SELECT method, arg_max(seed, v) AS best_seed, round(max(v), 6) AS best FROM u GROUP BY method")
def temperature_argmax(s, d):
    u = B.order_grid(s, d).groupBy("method", "seed").agg(F.avg("value").alias("v"))
    return _r(u.groupBy("method").agg(F.max_by("seed", "v").alias("best_seed"), F.max("v").alias("best")), "best")


@query(f"{W}, u AS (SELECT dataset, model, method, avg(value) AS v FROM grid GROUP BY ALL), m AS (SELECT dataset, model, sum(CASE WHEN method = '{HIGH}' THEN v END) - sum(CASE WHEN method = '{LOW}' THEN v END) AS margin FROM u GROUP BY ALL) SELECT dataset, count(*) AS n, round(avg(margin), 6) AS mean_margin, round(min(margin), 6) AS least, round(max(margin), 6) AS most FROM m GROUP BY dataset")
def paper_baselines(s, d):
    u = B.order_grid(s, d).groupBy("dataset", "model", "method").agg(F.avg("value").alias("v"))
    m = grid.paired_delta(u, ["dataset", "model"], "method", HIGH, LOW, "v")
    return _r(m.groupBy("dataset").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_margin"), F.min("delta").alias("least"), F.max("delta").alias("most")), "mean_margin", "least", "most")


@query(f"{W} SELECT method, round(avg(CASE WHEN model = 'BUILDING' THEN value END), 6) AS building, round(avg(CASE WHEN model = 'MACHINERY' THEN value END), 6) AS machinery FROM grid GROUP BY method")
def score_by_model_pivot(s, d):
    p = B.order_grid(s, d).groupBy("method").pivot("model", ["BUILDING", "MACHINERY"]).agg(F.avg("value"))
    return _r(p.select("method", c("BUILDING").alias("building"), c("MACHINERY").alias("machinery")), "building", "machinery")


@query(f"{W} SELECT dataset, model, seed, method, round(accuracy, 6) AS accuracy, CAST(round_even(accuracy * n, 0) AS BIGINT) AS n_correct, n FROM grid WHERE accuracy < 0.45")
def degenerate_cells(s, d):
    g = B.order_grid(s, d).where("accuracy < 0.45")
    return _r(g.select("dataset", "model", "seed", "method", "accuracy", F.bround(c("accuracy") * c("n")).cast("long").alias("n_correct"), "n"), "accuracy")


@query(f"{W}, u AS (SELECT dataset, method, model, avg(value) AS m, avg(accuracy) AS a FROM grid GROUP BY ALL) SELECT dataset, method, round(avg(m), 6) AS value, round(avg(a), 6) AS accuracy, count(*) AS n_models FROM u GROUP BY dataset, method")
def factorial(s, d):
    u = B.order_grid(s, d).groupBy("dataset", "method", "model").agg(F.avg("value").alias("m"), F.avg("accuracy").alias("a"))
    return _r(u.groupBy("dataset", "method").agg(F.avg("m").alias("value"), F.avg("a").alias("accuracy"), F.count("*").alias("n_models")), "value", "accuracy")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('20260911:' || doc_id), doc_id) <= 30")
def hash_topk_selection(s, d):
    return grid.hash_top(B.table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", "20260911:", 30)


@query("WITH e AS (SELECT * FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), (SELECT unnest(['src0', 'src1', 'nowhere']) AS source)) SELECT lang, source FROM e WHERE lang IN ('de', 'en', 'es', 'fr') EXCEPT SELECT lang, source FROM documents")
def grid_missing(s, d):
    return grid.grid_gaps(B.table(s, d, "documents"), {"lang": ["de", "en", "es", "fr"], "source": ["src0", "src1", "nowhere"]})


@query(f"{W} SELECT method, count(*) AS n_cells, round(avg(value), 6) AS mean_value, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, sum(CASE WHEN accuracy > 0 AND accuracy < 1 THEN 1 ELSE 0 END)::BIGINT AS valid_cells FROM grid GROUP BY method")
def clustering_summary(s, d):
    g = B.order_grid(s, d).groupBy("method")
    return _r(g.agg(F.count("*").alias("n_cells"), F.avg("value").alias("mean_value"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.count_if((c("accuracy") > 0) & (c("accuracy") < 1)).alias("valid_cells")), "mean_value", "minimum", "maximum")


@query()
def bootstrap_units(s, d):
    units = _delta(s, d).withColumn("unit", F.concat_ws("/", "dataset", "model")).groupBy("unit", F.lit("all").alias("slice")).agg(F.avg("delta").alias("delta"))
    return _r(bootstrap.bootstrap_units(units, ["slice"], "delta"), "mean", "lower", "upper")


def paired_records(s, d, matched: bool):
    """Scored records as cells. matched: a record's place in its cell stands for its question, and a dataset's questions
    are those that all its cells hold."""
    r = B.scored(s, d).select(F.lit("all").alias("slice"), "dataset", "model", "seed", "user_id", "rec", (~c("correct")).alias("incorrect"), "discrete_semantic_entropy", "surface_entropy")
    if not matched:
        return r.withColumn("qid", F.concat_ws("/", "user_id", "rec"))
    cell = ["dataset", "model", "seed"]
    r = r.withColumn("qid", F.row_number().over(Window.partitionBy(*cell).orderBy("user_id", "rec")))
    common = r.groupBy(*cell).count().groupBy("dataset").agg(F.min("count").alias("common"))  # one row per dataset
    return r.join(F.broadcast(common), "dataset").where("qid <= common")


def _paired(scheme: str):
    def run(s, d):
        r = paired_records(s, d, scheme in ("linked", "crossed"))
        draws = bootstrap.paired_draws(r, ["slice"], "discrete_semantic_entropy", "surface_entropy", scheme)
        return _r(bootstrap.interval(draws, ["slice"]), "lower", "upper", "p")

    return run


for _s in ("records", "hier", "linked", "crossed"):
    query(None, f"bootstrap_{_s}")(_paired(_s))


@query()
def bootstrap_omissions(s, d):
    cells = bootstrap.cell_draws(paired_records(s, d, False), ["slice"], "discrete_semantic_entropy", "surface_entropy", "hier")
    return _r(bootstrap.omissions(cells, ["slice"]), "invalid_cell_fraction", "any_invalid_cell_draw_fraction", "undefined_draw_fraction", "mean_valid_unit_weight")
