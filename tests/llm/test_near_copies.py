import random
from collections import Counter

from pyspark.sql import functions as F

from verdigris.llm import near_copies, simhash


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def roots_of(texts):
    sets = [brute(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def texts_at_similarity():
    """Copies with 1 to 8 of 300 words changed: Jaccard of about 0.97 to 0.76."""
    rng = random.Random(3)
    out = [None, "", "a b", "A  b", "lone text of five words"]
    for group in range(12):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(300)]
        out.append(" ".join(base))
        for changed in range(1, 9):
            copy = list(base)
            for at in rng.sample(range(300), changed):
                copy[at] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def test_groups_are_those_of_exact_jaccard(spark):
    texts = texts_at_similarity()
    roots = roots_of(texts)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(i, least.get(r, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for side in (4096, 2):
        got = {r.doc_id: r.component_id for r in near_copies.groups(docs, side=side).collect()}
        assert got == {i: least[r] for i, r in enumerate(roots)}
    # op9's radius of three bits leaves some of these copies apart.
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() > len(set(roots))


def test_the_pipeline_stage_keeps_one_of_each(spark):
    import corpus_pipeline

    texts = texts_at_similarity()
    roots = roots_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert Counter(roots[r.doc_id] for r in kept) == Counter(set(roots))
    assert near_copies.groups(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (None, base + " tail"), (5, base), (5, base), (7, "lone"), (None, "other"), (5, "not a copy"), (None, "other"), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, `a.b` int, _row string").repartition(3)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, base), (7, "lone"), (None, "other"), (5, "not a copy"), (8, "")])


def test_simhash_links_the_nearest_before_the_bands(spark):
    """Copies within 3 bits meet through op9's anchors, whatever the slices; bands are asked only where links are missing."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(base)] + [" ".join([*base, *[f"t{i}x{j}" for j in range(i % 3 + 1)]]) for i in range(40)] + ["lone text of six other words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    sets = near_copies.signatures(docs).drop("doc_id").localCheckpoint()
    assert sets.select("set").distinct().count() == len(texts)
    links = {r.node: r.root for r in simhash.linked(sets.select("fp").distinct()).collect()}
    group = Counter(links.get(r.fp, r.fp) for r in sets.collect())
    assert group.most_common(1)[0][1] > 20
    for side in (256, 4):
        members = near_copies.fingerprint_groups(sets.select("set", "n", "fp"), side)
        edges = near_copies.confirmed(members, sets, docs, 5, 0.8)
        joined = Counter(r.root for r in near_copies.connected_components(edges).collect())
        assert sorted(joined.values()) == sorted(n for n in group.values() if n > 1)
    assert near_copies.buckets(sets.withColumn("root", F.col("set"))).count() > 0
    assert near_copies.buckets(sets.withColumn("root", F.lit(1).cast("long"))).count() == 0
