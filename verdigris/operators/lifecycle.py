"""Record lifecycle: presample, sample, normalise, cluster, grade, score; recluster with another relation; seeded sampling."""

from __future__ import annotations

import json
import random
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import arrays as A
from verdigris.functions import text as T
from verdigris.operators import quality

ModelFn = Callable[[str, int], Sequence[str]]


def presample(prompts: DataFrame, run_id: str, model: str, tier: str, num_samples: int, seed: int, phase: str = "phase1", cluster: str = "local", backend: str = "exact-match", max_new_tokens: int = 50, temperature: float = 1.0, top_p: float = 0.9, top_k: int = 50) -> DataFrame:
    """Records before sampling: identity and decoding filled, results empty."""
    decoding = F.struct(F.lit(num_samples).alias("num_samples"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(top_k).alias("top_k"), F.lit(max_new_tokens).alias("max_new_tokens"), F.lit(seed).alias("seed"))
    none = lambda kind: F.lit(None).cast(kind)
    fixed = {"run_id": run_id, "phase": phase, "cluster": cluster, "model": model, "model_tier": tier, "entailment_backend": backend}
    empty = {"sampled_answers": F.array().cast("array<string>"), "normalized_answers": F.array().cast("array<string>"), "semantic_clusters": F.array().cast("array<int>"), "cluster_representatives": F.array().cast("array<string>"), "scores": F.create_map().cast("map<string,double>"), "correctness_label": none("boolean")}
    return prompts.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"decoding": decoding} | empty)


def synthetic_samples(pool: Sequence[str], n: int, seed: int | None = None) -> Column:
    """A deterministic model: answers of a pool in turn, with a seed in a shuffled order."""
    pool = list(pool)
    if seed is not None:
        random.Random(seed).shuffle(pool)
    options = F.array(*map(F.lit, pool))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(options, i % len(pool)))


def sample(records: DataFrame, model: ModelFn) -> DataFrame:
    """sampled_answers from a model callable: (prompt, n) -> n answers, or (answers, log-probabilities); Arrow batches on executors.

    A model that gives log-probabilities fills sequence_logprobs; another number of answers or log-probabilities than asked
    for is an error.
    """

    @F.pandas_udf("struct<answers: array<string>, logprobs: array<double>>")
    def ask(prompt: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for p, k in zip(prompt, n, strict=True):
            found = model(p, int(k))
            answers, logprobs = found if isinstance(found, tuple) else (found, None)
            if len(answers) != k or (logprobs is not None and len(logprobs) != k):
                raise ValueError(f"{len(answers)} answers instead of {k}")
            rows.append((list(answers), None if logprobs is None else [float(x) for x in logprobs]))
        return pd.DataFrame(rows, columns=["answers", "logprobs"])

    told = records.withColumn("_asked", ask("prompt", "decoding.num_samples"))
    return told.withColumns({"sampled_answers": F.col("_asked.answers"), "sequence_logprobs": F.col("_asked.logprobs")}).drop("_asked")


GENERATION = "sampled_answers array<string>, sequence_logprobs array<double>, sep_greedy_answer string, sep_hidden_state array<double>, sep_feature_metadata string"


def sample_with_states(records: DataFrame, model: Callable[[str, int], dict]) -> DataFrame:
    """records with GENERATION from a model that also gives a greedy answer, its hidden state and the feature's metadata.

    model: (prompt, n) -> a mapping of answers, logprobs, greedy_answer, hidden_state and metadata (JSON-ready).
    """
    names = [x.split(" ")[0] for x in GENERATION.split(", ")]
    rest = records.drop(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            prompts, decoding = batch.column("prompt").to_pylist(), batch.column("decoding").to_pylist()
            out: list[list] = [[] for _ in names]
            for prompt, told in zip(prompts, decoding, strict=True):
                g = model(prompt, told["num_samples"])
                if len(g["answers"]) != told["num_samples"]:
                    raise ValueError(f"{len(g['answers'])} answers instead of {told['num_samples']}")
                row = (list(g["answers"]), g.get("logprobs"), g.get("greedy_answer"), g.get("hidden_state"), None if g.get("metadata") is None else json.dumps(g["metadata"], sort_keys=True))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.list_(pa.string()), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*batch.schema.names, *names])

    return rest.mapInArrow(run, f"{kinds}, {GENERATION}")


def answer_token_count(tokens: str, decode: Callable[[Sequence[int]], str], stops: Sequence[str] | None = T.STOP_SEQUENCES, ends: Sequence[int] = ()) -> Column:
    """How many generated tokens the answer itself has: the fewest that spell it up to its first stop sequence.

    Tokens from the first terminator on don't count; the least is one. Decoded length grows with the number of tokens, so
    the place is found by bisection.
    """
    terminators = set(ends)

    def count(ids: Sequence[int]) -> int:
        ids = [int(x) for x in ids]
        limit = next((i for i, x in enumerate(ids) if x in terminators), len(ids))
        if not limit:
            return 1
        whole = decode(ids[:limit])
        cut = min((at for x in stops or () if (at := whole.find(x)) >= 0), default=len(whole))
        target = len(whole[:cut].strip())
        if target == len(whole.strip()):
            return limit
        return 1 + bisect_left(range(1, limit), target, key=lambda n: len(decode(ids[:n]).strip())) if target else 1

    @F.pandas_udf("int")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(count)

    return run(tokens)


def cluster_input(records: DataFrame, source: str = "normalized") -> DataFrame:
    """records with cluster_answers: what is clustered, the answers as sampled (raw) or normalised; none is an error."""
    answers = F.col("sampled_answers" if source == "raw" else "normalized_answers")
    none = F.raise_error(F.lit(f"a record has no {source} answers")).cast("array<string>")
    return records.withColumn("cluster_answers", F.when(F.size(F.coalesce(answers, F.array().cast("array<string>"))) > 0, answers).otherwise(none))


def graded_by(records: DataFrame, grade: Callable[[str, list, list, str], tuple[bool, float | None]], judge: str, dataset: str | None = None, regrade: bool = False) -> DataFrame:
    """records with correctness_label, its provenance and scores.correctness_score from a grading callable.

    grade: (question, references, samples, representative) -> (label, score or None), in Arrow batches. Records of other
    data sets, those without samples, and (unless regrade) those that have a label with provenance pass as they are; a
    published human label is never graded anew. All rows keep their place: they're graded in their own row.
    """
    told = [c for c in ("question", "prompt") if c in records.columns]
    asked = T.resolve_question(*(F.col(c) for c in told)) if len(told) == 2 else T.strip(F.col(told[0]))
    likely = F.col("most_likely_answer") if "most_likely_answer" in records.columns else F.lit(None).cast("string")
    own = F.col("correctness_label_provenance") if "correctness_label_provenance" in records.columns else F.lit(None).cast(quality.PROVENANCE)
    known = F.col("correctness_label").isNotNull() & own.isNotNull()
    due = F.size(F.coalesce("sampled_answers", F.array().cast("array<string>"))) > 0
    if dataset is not None:
        due = due & (F.col("dataset") == dataset)
    valid = F.when(own.isNotNull() & ~F.coalesce(quality.provenance_ok(own), F.lit(False)), F.raise_error(F.lit("a label's provenance isn't valid")).cast("boolean")).otherwise(True)
    if regrade:
        human = F.raise_error(F.lit("published human labels can't be graded anew")).cast("boolean")
        due = due & F.when(F.coalesce(own["scope"] == quality.HUMAN[1], F.lit(False)), human).otherwise(valid)
    else:
        due = due & ~(known & valid)

    policy = F.when(F.coalesce(T.strip(likely), F.lit("")) != "", "most_likely_answer").otherwise("exact_surface_mode_first_tie")
    fresh = quality.automated_provenance(judge, "selected_biography_response_against_reference", policy)
    none = F.array().cast("array<string>")
    out = records.withColumns({"_due": F.coalesce(due, F.lit(False)), "_q": asked, "_refs": F.coalesce("reference_answers", F.array(F.lit(""))), "_samples": F.coalesce("sampled_answers", none), "_best": A.fixed_representative(likely, F.coalesce("sampled_answers", none))})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            told = zip(*(batch.column(c).to_pylist() for c in ("_due", "_q", "_refs", "_samples", "_best")), strict=True)
            found = [grade(q, refs, samples, best) if d else (None, None) for d, q, refs, samples, best in told]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.float64())], [*batch.schema.names, "_label", "_score"])

    out = out.mapInArrow(run, f"{kinds}, _label boolean, _score double")
    scores = F.coalesce("scores", F.create_map().cast("map<string,double>"))
    rest = F.map_filter(scores, lambda k, _: k != "correctness_score")
    return out.withColumns({
        "correctness_label": F.when(F.col("_due"), F.col("_label")).otherwise(F.col("correctness_label")),
        "correctness_label_provenance": F.when(F.col("_due"), fresh).otherwise(own),
        "scores": F.when(F.col("_due") & F.col("_score").isNotNull(), F.map_concat(rest, F.create_map(F.lit("correctness_score"), F.col("_score")))).otherwise(scores),
    }).drop("_due", "_q", "_refs", "_samples", "_best", "_label", "_score")


def as_cells(records: DataFrame, cell: list[str], qid: str, label: str, left: str, right: str) -> DataFrame:
    """(cell, qids, incorrect, left, right): a cell's records as arrays in order of qid; a cell's records are its own bound."""
    row = F.struct(F.col(qid).alias("qid"), (~F.col(label)).alias("incorrect"), F.col(left).cast("double").alias("left"), F.col(right).cast("double").alias("right"))
    told = records.groupBy(*cell).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return told.select(*cell, F.col("r.qid").alias("qids"), *[F.col(f"r.{x}").alias(x) for x in ("incorrect", "left", "right")])


def text_udf(f: Callable[[str], object], kind: str) -> Callable[..., Column]:
    """A plug point (judge, embedding, probe): one text -> kind, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return run


def normalized(records: DataFrame, extract: bool = True) -> DataFrame:
    answers = F.transform("sampled_answers", lambda a: T.extract_answer(a)) if extract else F.col("sampled_answers")
    out = records.withColumn("sampled_answers", answers)
    return out.withColumn("normalized_answers", F.transform("sampled_answers", lambda a: T.normalize_for(F.col("dataset"), a)))


def clustered(records: DataFrame, ids: Column) -> DataFrame:
    """New ids, representatives from the normalised answers, and scores anew; foreign scores stay."""
    out = records.withColumn("semantic_clusters", ids).withColumn("cluster_representatives", A.representatives(F.col("semantic_clusters"), F.col("normalized_answers")))
    return scored(out)


def scored(records: DataFrame) -> DataFrame:
    """The three count entropies, and with logprobs the two that weigh them; empty logprobs are none."""
    own = {"naive_sample_entropy": A.entropy(F.col("sampled_answers")), "surface_entropy": A.entropy(F.col("normalized_answers")), "discrete_semantic_entropy": A.entropy(F.col("semantic_clusters"))}
    if "sequence_logprobs" in records.columns:
        lp = F.col("sequence_logprobs")
        own |= {"naive_entropy": A.naive_entropy(lp), "semantic_entropy_full": A.semantic_entropy_full(F.col("semantic_clusters"), lp)}
    fresh = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    foreign = F.map_filter(F.coalesce("scores", F.create_map().cast("map<string,double>")), lambda k, _: ~k.isin(*own))
    return records.withColumn("scores", F.map_concat(foreign, fresh))


def graded(records: DataFrame, paper: bool = False) -> DataFrame:
    """Any sample matches a reference, or with paper the point estimate's token F1."""
    if not paper:
        label = T.any_match_correct(F.col("normalized_answers"), F.col("reference_answers"), F.col("dataset"))
        return records.withColumn("correctness_label", label)
    recorded = [F.col(c) for c in ("sep_greedy_answer", "most_likely_answer") if c in records.columns]
    best = records.withColumn("most_likely_answer", F.coalesce(*recorded, A.most_frequent(F.col("sampled_answers"))))
    return best.withColumn("correctness_label", T.best_answer_correct(F.col("most_likely_answer"), F.col("reference_answers"), F.col("dataset")))


def run_pipeline(prompts: DataFrame, model_fn: ModelFn, **config: object) -> DataFrame:
    """Prompts to scored records with exact-match clusters."""
    r = normalized(sample(presample(prompts, **config), model_fn))
    return graded(clustered(r, A.first_ids(F.col("normalized_answers"))))


def recluster(records: DataFrame, matrices: DataFrame, keys: list[str], closure: str = "anchor", relation: str = "strict") -> DataFrame:
    """Scored records with clusters from an entailment matrix (codes) joined on keys."""
    # A record of one answer has no pairs and so no matrix.
    met = records.join(matrices, keys, "left")
    own = F.when(F.size("sampled_answers") == 1, F.array(F.array(F.lit(1))))
    met = met.withColumn("matrix", F.coalesce("matrix", own, F.raise_error(F.lit("a record has no entailment matrix")).cast(met.schema["matrix"].dataType)))
    related = A.mutual(F.transform("matrix", lambda row: F.transform(row, lambda x: x == 1))) if relation == "strict" else A.nondefeating(F.col("matrix"))
    ids = A.anchor_scan(related) if closure == "anchor" else A.components(related)
    return clustered(met, ids).drop("matrix").withColumns({"clustering_closure": F.lit(closure), "clustering_rule": F.lit(relation)})


def seeded_positions(n: int, k: int, seed: int) -> list[int]:
    """k of n positions as Python's generator samples them; made on the driver, joined back by position."""
    return random.Random(seed).sample(range(n), k)


#: Ids that seeded_split shuffles on the driver; beyond, it raises.
MOST_IDS = 10_000_000


def seeded_split(df: DataFrame, order: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """df with split: positions in the given order are shuffled by Python's generator and dealt to the named sizes."""
    ids = [r[0] for r in df.select(order).distinct().orderBy(order).limit(MOST_IDS + 1).toLocalIterator()]
    if len(ids) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids to shuffle on the driver")
    random.Random(seed).shuffle(ids)
    rows, at = [], 0
    for name, size in sizes.items():
        if at + size > len(ids):
            raise ValueError(f"only {len(ids)} rows for splits of {sum(sizes.values())}")
        rows += [(i, name) for i in ids[at : at + size]]
        at += size
    kind = dict(df.dtypes)[order]
    return df.join(df.sparkSession.createDataFrame(rows, f"{order} {kind}, split string"), order)


def load_callable(spec: str):
    """module:name or file.py:name."""
    import importlib
    import importlib.util

    where, _, name = spec.rpartition(":")
    if where.endswith(".py"):
        found = importlib.util.spec_from_file_location("plugin", where)
        module = importlib.util.module_from_spec(found)
        found.loader.exec_module(module)
    else:
        module = importlib.import_module(where)
    return getattr(module, name)
