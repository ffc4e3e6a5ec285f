"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import arrays as A
from verdigris.operators import quality as Q
from verdigris.plans import base as B
from verdigris.plans.catalogue import query

c = F.col


FAULTS = ("model_tier: closed vocabulary", "scores: finite, not negative", "correctness_label: boolean", "reference_answers: not empty", "sampled_answers: num_samples entries")


@query(f"WITH RECURSIVE {B.SCORED} SELECT user_id, rec, CASE rec % 6 {' '.join(f'WHEN {i} THEN [{x!r}]' for i, x in enumerate(FAULTS, 1))} ELSE CAST([] AS VARCHAR[]) END AS violations FROM scored")
def schema_violations(s, d):
    """Every sixth record is sound, each of the others breaks one rule of a scored record."""
    fault = lambda i, bad, good: F.when(c("rec") % 6 == i, bad).otherwise(good)
    r = B.scored(s, d).withColumns({"sampled_answers": c("raw"), "normalized_answers": c("norm"), "semantic_clusters": c("ids"), "cluster_representatives": A.representatives(c("ids"), c("norm"))})
    r = r.withColumns({x: F.lit("x") for x in Q.STRINGS} | {"phase": F.lit("phase1"), "cluster": F.lit("local")} | {
        "model_tier": fault(1, F.lit("huge"), F.lit("small")),
        "scores": F.create_map(F.lit("surface_entropy"), F.abs("surface_entropy"), F.lit("discrete_semantic_entropy"), F.abs("discrete_semantic_entropy"), F.lit("own"), fault(2, F.lit(float("nan")), F.lit(1.0))),
        "correctness_label": fault(3, F.lit(None), c("correct")),
        "reference_answers": fault(4, F.array().cast("array<string>"), F.array(F.lit("x"))),
        "decoding": F.struct(F.size("raw").alias("num_samples"), F.lit(50).alias("max_new_tokens")),
    })
    r = r.withColumn("sampled_answers", fault(5, F.concat("sampled_answers", F.array(F.lit("more"))), c("sampled_answers")))
    return r.select("user_id", "rec", Q.rules(Q.record_checks(r)).alias("violations"))


@query(f"WITH RECURSIVE {B.SCORED} SELECT user_id, rec, CASE WHEN rec % 2 = 1 AND len(list_distinct(ids)) > 0 THEN ['clusters: contiguous', 'representatives: members'] ELSE CAST([] AS VARCHAR[]) END AS violations FROM scored")
def cluster_consistency(s, d):
    r = B.scored(s, d).withColumn("reps", A.representatives(c("ids"), c("norm")))
    broken = F.when(c("rec") % 2 == 1, F.transform("ids", lambda x: x + 1)).otherwise(c("ids"))
    r = r.withColumn("ids", broken).withColumn("reps", F.when(c("rec") % 2 == 1, F.transform("reps", lambda x: F.concat(x, F.lit("?")))).otherwise(c("reps")))
    return r.select("user_id", "rec", Q.rules(Q.cluster_checks(c("ids"), c("reps"), c("norm"))).alias("violations"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) NOT BETWEEN 1000 AND 2000")
def coverage_check(s, d):
    return B.table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).where(~c("n").between(1000, 2000))


@query("SELECT source, count(*) AS n, count(DISTINCT toxic) AS n_labels FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(DISTINCT toxic) < 2")
def degenerate_labels(s, d):
    t = B.table(s, d, "documents").select("doc_id", "source").join(B.table(s, d, "labels"), "doc_id")
    return Q.degenerate_groups(t, ["source"], "toxic")


MODELS = "WITH m AS (SELECT user_id % 50 AS job, CASE WHEN user_id % 50 = 7 AND event_id % 97 = 0 THEN 'other' WHEN user_id % 50 = 8 THEN 'wrong' ELSE 'model' END AS model, 'model' AS judge FROM events)"


@query(f"{MODELS} SELECT job, count(DISTINCT model) AS n_models FROM m GROUP BY job HAVING count(DISTINCT model) <> 1 OR bool_or(model <> judge)")
def single_model_gate(s, d):
    job = c("user_id") % 50
    model = F.when((job == 7) & (c("event_id") % 97 == 0), "other").when(job == 8, "wrong").otherwise("model")
    return Q.single_model(B.table(s, d, "events").select(job.alias("job"), model.alias("model"), F.lit("model").alias("judge")), ["job"], "model", "judge")


@query("SELECT doc_id, list_filter([CASE doc_id % 5 WHEN 1 THEN 'source: supported' END, CASE WHEN doc_id % 5 IN (1, 2) THEN 'scope: the source''s' END, CASE doc_id % 5 WHEN 3 THEN 'target: not empty' END, CASE doc_id % 5 WHEN 4 THEN 'judge_model: named' END], lambda x: x IS NOT NULL) AS violations FROM labels")
def provenance_violations(s, d):
    k = c("doc_id") % 5
    p = F.struct(F.when(k == 1, "none").otherwise(Q.AUTOMATED[0]).alias("source"), F.when(k == 2, Q.HUMAN[1]).otherwise(Q.AUTOMATED[1]).alias("scope"), F.when(k == 4, " ").otherwise("judge").alias("judge_model"), F.when(k == 3, F.lit(None)).otherwise("t").alias("target"))
    return B.table(s, d, "labels").select("doc_id", Q.rules(Q.provenance_checks(p)).alias("violations"))


@query("(SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def key_set_equality(s, d):
    return Q.same_keys(B.table(s, d, "documents"), B.table(s, d, "labels"), ["doc_id"])


@query("SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM (SELECT DISTINCT n_name FROM nation)")
def id_set_digest(s, d):
    return Q.set_digest(B.table(s, d, "nation"), "n_name")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_yes, count(*) FILTER (event_type = 'view') AS n_no, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_other FROM events GROUP BY user_id")
def verdict_histogram(s, d):
    t = c("event_type")
    return B.table(s, d, "events").groupBy("user_id").agg(F.count_if(t == "click").alias("n_yes"), F.count_if(t == "view").alias("n_no"), F.count_if(~t.isin("click", "view")).alias("n_other"))


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, quantile_cont(length(text), 0.5) AS median_chars, avg(length(text)) BETWEEN 95.6 - 69.6 AND 95.6 + 69.6 AS in_band FROM documents GROUP BY lang")
def answer_length_band(s, d):
    n = F.length("text")
    out = B.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg(n).alias("m"), F.percentile(n, F.lit(0.5)).alias("median_chars"))
    return out.select("lang", "n", F.round("m", 6).alias("mean_chars"), "median_chars", c("m").between(95.6 - 69.6, 95.6 + 69.6).alias("in_band"))
