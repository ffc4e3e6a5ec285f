"""Entropy, clustering, pair and join queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verdigris.functions import arrays as A
from verdigris.functions import text as T
from verdigris.operators import grid, kernels, pairs
from verdigris.plans import base as B
from verdigris.plans.catalogue import query

c = F.col


def _score(method: str):
    return lambda s, d: B.scored(s, d).select("user_id", "rec", F.round(method, 6).alias("score"))


for _m in B.METHODS:
    query(f"WITH RECURSIVE {B.SCORED} SELECT user_id, rec, round({_m}, 6) AS score FROM scored", _m)(_score(_m))


@query(f"WITH RECURSIVE {B.SCORED} SELECT user_id, rec, round(naive_sample_entropy, 6) AS naive, round(surface_entropy, 6) AS surface, round(discrete_semantic_entropy, 6) AS discrete, round(naive_entropy, 6) AS predictive, round(semantic_entropy_full, 6) AS full_se FROM scored")
def score_bundle(s, d):
    r = B.scored(s, d).select("user_id", "rec", F.create_map(*[x for m in B.METHODS for x in (F.lit(m), c(m))]).alias("scores"))
    return r.select("user_id", "rec", *[F.round(c("scores")[m], 6).alias(n) for m, n in zip(B.METHODS, ("naive", "surface", "discrete", "predictive", "full_se"), strict=True)])


FIRST = "list_transform({x}, lambda v: CAST(len(list_distinct({x}[1:list_position({x}, v)])) - 1 AS INTEGER))"


@query(f"WITH {B.RECORDS} SELECT user_id, rec, {FIRST.format(x='norm')} AS ids FROM records")
def cluster_exact(s, d):
    return B.records(s, d).select("user_id", "rec", A.first_ids(c("norm")).alias("ids"))


def _clusters(relation, closure):
    return lambda s, d: B.records(s, d).select("user_id", "rec", closure(relation()).alias("ids"))


def strict():
    return A.mutual(B.entails(c("k")))


def loose():
    return A.nondefeating(B.codes(c("k")))


query(f"WITH RECURSIVE {B.MATRIX}, {B.sql_anchor(B.STRICT)} SELECT user_id, rec, ids FROM anchored", "cluster_anchor_strict")(_clusters(strict, A.anchor_scan))
query(f"WITH RECURSIVE {B.MATRIX}, {B.sql_anchor(B.LOOSE)} SELECT user_id, rec, ids FROM anchored", "cluster_anchor_nondefeating")(_clusters(loose, A.anchor_scan))
query(f"WITH {B.MATRIX}, {B.sql_components(B.STRICT)} SELECT user_id, rec, ids FROM joined", "cluster_components_strict")(_clusters(strict, A.components))
query(f"WITH {B.MATRIX}, {B.sql_components(B.LOOSE)} SELECT user_id, rec, ids FROM joined", "cluster_components_nondefeating")(_clusters(loose, A.components))


@query(f"WITH RECURSIVE {B.SCORED} SELECT user_id, rec, list_transform(list_sort(list_distinct(ids)), lambda v: norm[list_position(ids, v)]) AS reps FROM scored")
def cluster_representatives(s, d):
    return B.scored(s, d).select("user_id", "rec", A.representatives(c("ids"), c("norm")).alias("reps"))


ORDER = [9, 2, 5, 0, 7, 1, 8, 3, 6, 4]
SQL_ORDER = f"list_filter({[i + 1 for i in ORDER]}, lambda x: x <= len(c))"


def _permuted(related):
    order = F.filter(F.array(*map(F.lit, ORDER)), lambda i: i < F.size("k"))
    return A.restored(A.anchor_scan(A.submatrix(related, order)), order)


PERMUTED = f"""{B.MATRIX},
permuted AS (SELECT user_id, rec, list_transform({SQL_ORDER}, lambda i: list_transform({SQL_ORDER}, lambda j: c[i][j])) AS c FROM matrices),
{B.sql_anchor(B.STRICT).replace('matrices', 'permuted')},
back AS (SELECT user_id, rec, list_transform(range(1, len(ids) + 1), lambda i: ids[list_position({SQL_ORDER.replace("len(c)", "len(ids)")}, i)]) AS ids FROM anchored)"""


@query(f"WITH RECURSIVE {PERMUTED} SELECT user_id, rec, ids FROM back")
def cluster_subset_order(s, d):
    return B.records(s, d).select("user_id", "rec", _permuted(strict()).alias("ids"))


@query(f"WITH RECURSIVE {PERMUTED}, {B.sql_anchor(B.STRICT).replace('scan', 'scan2').replace('anchored', 'plain')} SELECT a.user_id, a.rec, {FIRST.format(x='a.ids')} <> {FIRST.format(x='p.ids')} AS changed FROM back a JOIN plain p USING (user_id, rec)")
def partition_changed(s, d):
    changed = T.let(strict(), lambda r: A.first_ids(_permuted(r)) != A.first_ids(A.anchor_scan(r)))
    return B.records(s, d).select("user_id", "rec", changed.alias("changed"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, (SELECT norm[min(j)] FROM (SELECT j, len(list_filter(norm, lambda x: x = norm[j])) AS n FROM (SELECT unnest(range(1, len(norm) + 1)) AS j) QUALIFY n = max(n) OVER ())) AS modal FROM records")
def modal_answer(s, d):
    return B.records(s, d).select("user_id", "rec", A.most_frequent(c("norm")).alias("modal"))


@query(f"WITH RECURSIVE {B.SCORED} SELECT user_id, rec, (SELECT raw[list_position(ids, min(v))] FROM (SELECT v, len(list_filter(ids, lambda x: x = v)) AS n FROM (SELECT DISTINCT unnest(ids) AS v) QUALIFY n = max(n) OVER ())) AS rep FROM scored")
def majority_cluster_rep(s, d):
    return B.scored(s, d).select("user_id", "rec", A.majority_representative(c("ids"), c("raw")).alias("rep"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, CASE WHEN user_id % 2 = 0 THEN 'fixed' ELSE (SELECT raw[min(j)] FROM (SELECT j, len(list_filter(raw, lambda x: x = raw[j])) AS n FROM (SELECT unnest(range(1, len(raw) + 1)) AS j) QUALIFY n = max(n) OVER ())) END AS rep FROM records")
def fixed_representative(s, d):
    return B.records(s, d).select("user_id", "rec", A.fixed_representative(F.when(c("user_id") % 2 == 0, " fixed ").otherwise("  "), c("raw")).alias("rep"))


PAIRS = f"{B.RECORDS}, pairs AS (SELECT user_id, rec, i, j, raw[i] AS premise, raw[j] AS hypothesis, k[i] AS ka, k[j] AS kb FROM records, (SELECT unnest(range(1, 11)) AS i), (SELECT unnest(range(1, 11)) AS j) WHERE i <> j AND i <= len(raw) AND j <= len(raw))"


@query(f"WITH {PAIRS} SELECT DISTINCT premise, hypothesis FROM pairs WHERE premise <> hypothesis")
def pair_tasks_distinct(s, d):
    return pairs.distinct_tasks(pairs.ordered_pairs(B.records(s, d), ["user_id", "rec"], "raw"))


@query(f"WITH {PAIRS} SELECT user_id, rec, round(avg(CASE WHEN premise = hypothesis THEN 1.0 ELSE 0.0 END), 6) AS identical FROM pairs GROUP BY ALL")
def pair_identity_rate(s, d):
    p = pairs.ordered_pairs(B.records(s, d), ["user_id", "rec"], "raw")
    return p.groupBy("user_id", "rec").agg(F.round(F.avg((c("premise") == c("hypothesis")).cast("double")), 6).alias("identical"))


@query(f"WITH {PAIRS}, tasks AS (SELECT DISTINCT premise, hypothesis FROM pairs WHERE premise <> hypothesis), keyed AS (SELECT md5('m' || chr(0) || 'strict' || chr(0) || premise || chr(0) || hypothesis || chr(0)) AS key FROM tasks) SELECT key, key < '8' AS hit FROM keyed")
def pair_cache_hit_miss(s, d):
    tasks = pairs.with_keys(pairs.distinct_tasks(pairs.ordered_pairs(B.records(s, d), ["user_id", "rec"], "raw")), "m", "strict")
    cache = tasks.where("key < '8'").select("key", F.lit("neutral").alias("label"))
    hits, misses = pairs.cache_split(tasks, cache)
    return hits.select("key", F.lit(True).alias("hit")).unionByName(misses.select("key", F.lit(False).alias("hit")))


@query(f"WITH {B.MATRIX} SELECT user_id, rec, c AS matrix FROM matrices")
def entailment_matrix(s, d):
    return B.records(s, d).select("user_id", "rec", B.codes(c("k")).alias("matrix"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, list_transform(norm, lambda a: list_transform(norm, lambda b: CASE WHEN a = b THEN 1 WHEN left(a, 1) = left(b, 1) THEN 0 ELSE 2 END)) AS matrix FROM records WHERE len(norm) > 1")
def pair_pipeline_matrix(s, d):
    def predict(misses):
        return misses.withColumn("label", F.when(F.left("premise", F.lit(1)) == F.left("hypothesis", F.lit(1)), "contradiction").otherwise("neutral"))

    p = pairs.ordered_pairs(B.records(s, d), ["user_id", "rec"], "norm")
    empty = s.createDataFrame([], "key string, label string")
    return pairs.matrices(pairs.labelled(p, empty, predict)[0], ["user_id", "rec"])


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def label_join(s, d):
    return B.table(s, d, "documents").select("doc_id", "lang").join(B.table(s, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY text HAVING count(*) > 1)")
def dedup_antijoin(s, d):
    t = B.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.join(t.groupBy("h").count().where("count > 1").select("h"), "h", "left_anti").select("doc_id")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text")
def dedup_first_wins(s, d):
    t = B.table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return t.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("SELECT source, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM documents JOIN labels USING (doc_id) GROUP BY source")
def grader_agreement(s, d):
    t = B.table(s, d, "documents").select("doc_id", "source").join(B.table(s, d, "labels"), "doc_id")
    left, right = t.select("doc_id", "source", c("quality").alias("v")), t.select("doc_id", "source", c("toxic").alias("v"))
    return grid.agreement(left, right, ["doc_id", "source"], ["source"], "v").withColumn("agreement", F.round("agreement", 6))


@query(f"WITH RECURSIVE {B.LONG}, x AS (SELECT user_id, rec, method, CAST(round(score * 2) AS INTEGER) AS v FROM long) SELECT a.method AS \"left\", b.method AS \"right\", count(*) AS n, round(avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM x a JOIN x b ON a.user_id = b.user_id AND a.rec = b.rec AND a.method < b.method GROUP BY ALL")
def backend_agreement(s, d):
    long = B.long_scores(s, d).withColumn("v", F.round(c("score") * 2).cast("int"))
    return grid.backend_agreement(long, ["user_id", "rec"], "method", "v").withColumn("agreement", F.round("agreement", 6))


@query("SELECT count(DISTINCT l.text) AS n_shared FROM conversations l JOIN conversations r ON l.text = r.text AND l.conv_id % 2 = 0 AND r.conv_id % 2 = 1")
def split_leakage(s, d):
    t = B.table(s, d, "conversations")
    shared = t.where("conv_id % 2 = 0").select("text").intersect(t.where("conv_id % 2 = 1").select("text"))
    return shared.agg(F.count("*").alias("n_shared"))


@query("SELECT user_id FROM events WHERE event_type = 'click' GROUP BY user_id UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def branches_union(s, d):
    e = B.table(s, d, "events")
    return e.where("event_type = 'click'").select("user_id").distinct().unionByName(e.where("event_type = 'purchase'").select("user_id").distinct())


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)")
def common_score_fields(s, d):
    e = B.table(s, d, "events").select("user_id", "event_type").distinct()
    total = e.select(F.countDistinct("user_id").alias("t"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_users")).join(F.broadcast(total), c("n_users") == c("t")).select("event_type", "n_users")


@query("SELECT conv_id, turn, coalesce(arg_max(l.quality, l.doc_id), -1) AS context FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id % 500 GROUP BY conv_id, turn")
def context_index_lookup(s, d):
    # The last of several entries of a key wins.
    index = B.table(s, d, "labels").groupBy((c("doc_id") % 500).alias("conv_id")).agg(F.max_by("quality", "doc_id").alias("q"))
    return B.table(s, d, "conversations").select("conv_id", "turn").join(index, "conv_id", "left").select("conv_id", "turn", F.coalesce("q", F.lit(-1)).alias("context"))


@query("WITH h AS (SELECT c_mktsegment AS root, c_nationkey * 10 + c_custkey % 10 AS cell FROM customer GROUP BY ALL), o AS (SELECT s_suppkey % 4 AS grader, s_nationkey * 10 + s_suppkey % 10 AS cell FROM supplier GROUP BY ALL) SELECT grader, root, count(*) AS overlap FROM h JOIN o USING (cell) GROUP BY grader, root QUALIFY row_number() OVER (PARTITION BY grader ORDER BY count(*) DESC, root) = 1")
def tree_binding(s, d):
    h = B.table(s, d, "customer").select(c("c_mktsegment").alias("root"), (c("c_nationkey") * 10 + c("c_custkey") % 10).alias("cell"))
    o = B.table(s, d, "supplier").select((c("s_suppkey") % 4).alias("grader"), (c("s_nationkey") * 10 + c("s_suppkey") % 10).alias("cell"))
    return grid.best_overlap(h, o, "root", "cell", "grader")


def _embedded(s, d):
    e = B.table(s, d, "embeddings").select("vec_id", "embedding", F.floor(c("vec_id") / 10).alias("rec"))
    return e.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("m"))


query(None, "kle_rbf")(lambda s, d: _embedded(s, d).select("rec", F.round(kernels.kle("rbf")(c("m")), 6).alias("kle")))
query(None, "kle_cosine")(lambda s, d: _embedded(s, d).select("rec", F.round(kernels.kle("cosine")(c("m")), 6).alias("kle")))
