"""The pipeline's stages, each against a loop over its own input."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from verdigris.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, original string, n_words int, `a.b` string, _row int"
STAGES = dict(corpus_pipeline.STAGES)
PASSAGE = " ".join(f"pass{i}" for i in range(60))
BODY = " ".join(f"body{i}" for i in range(120))
ITEM = "what is the capital city of the northern province in spring"


def fine(i):
    return " ".join(f"w{i}x{j}" for j in range(50))


HOLDERS = [f"first line\n\n{PASSAGE}\nlast  line {fine(300)}", f"other start {PASSAGE} other end {fine(301)}", f"{PASSAGE} third {fine(302)}"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = [(i, fine(i)) for i in range(40)]
    texts += [(100, "you stupid idiot, you scum " + fine(100)), (None, "moron and idiot, worthless trash " + fine(101)), (600, fine(600)), (600, "idiot idiot scum loser " + fine(102))]
    texts += [(200, BODY), (201, BODY), (202, BODY.replace("body7 ", "other ")), (None, BODY)]
    texts += list(zip((300, 301, None), HOLDERS))
    texts += [(400, f"{fine(400)} {ITEM.upper()}! {fine(401)}"), (None, f"{fine(402)} {ITEM}"), (401, "What is the capital city of somewhere else entirely in spring")]
    texts += [(500, None), (501, ""), (502, "  \n "), (503, "short")]
    rows = [(i, t, "en", "s", None if t is None else len(t), "mine", 7, "dotted", 1) for i, t in texts]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(40)] + [(100, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def own_columns(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "original", "n_words", "a.b", "_row"]
    assert {(r.original, r.n_words, r["a.b"], r["_row"], r.lang) for r in df.collect()} <= {("mine", 7, "dotted", 1, "en")}


def test_toxic_rows_go(spark, corpus):
    folder, texts = corpus
    out = STAGES["toxicity"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    own_columns(out)
    assert kept(out) == Counter((i, t) for i, t in texts if not ("idiot" in (t or "")))


def test_one_of_each_group_stays(spark, corpus):
    folder, texts = corpus
    out = STAGES["near_dedup"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    own_columns(out)
    gone = {(201, BODY), (202, BODY.replace("body7 ", "other ")), (None, BODY), (501, ""), (502, "  \n ")}
    assert kept(out) == Counter(x for x in texts if x not in gone)


def test_repeated_passages_are_cut(spark, corpus):
    folder, texts = corpus
    out = STAGES["substring_dedup"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    own_columns(out)
    left = [f"first line\nlast  line {fine(300)}", f"other start other end {fine(301)}", f"third {fine(302)}"]
    cut = dict(zip(HOLDERS, left)) | {BODY: "", BODY.replace("body7 ", "other "): " ".join(f"body{i}" if i != 7 else "other" for i in range(8))}
    want = Counter((i, cut.get(t, t)) for i, t in texts)
    # Of the near copy the words after the changed one repeat; those before it are too few for a window.
    assert kept(out) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_leaking_rows_go(spark, corpus):
    folder, texts = corpus
    out = STAGES["benchmark_decontamination"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    own_columns(out)
    assert kept(out) == Counter((i, t) for i, t in texts if ITEM not in (t or "").lower())


def test_packing_takes_every_row(spark, corpus):
    folder, texts = corpus
    out = STAGES["packing"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    tokens = defaultdict(int)
    for r in out:
        tokens[r.sequence_id] += r.length
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(i for i, _ in texts) and max(tokens.values()) <= 2048


def test_the_whole_pipeline(spark, corpus):
    folder, _ = corpus
    before = list(common.KEPT)
    tokens = []
    for _ in range(2):
        found = Counter()
        for r in corpus_pipeline.run(spark, folder).collect():
            found[str(r.doc_id)] += r.length
        tokens.append(found)
    assert tokens[0] == tokens[1]
    ids = set(tokens[0])
    assert not ids & {"100", "201", "202", "400"} and {"0", "39", "200", "300", "301", "401", "500", "503"} <= ids
    # Of a run's tables only the last stage's input is left.
    assert len(common.kept_since(before)) == 2


def test_empty_tables_pass(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_stages_want_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Session())
