"""Queries on whole texts against brute force."""

import re
import string
from collections import Counter

import pytest

import __spark_entry__ as entry


def normalized(text):
    bare = text.lower().translate(str.maketrans("", "", string.punctuation))
    return re.sub(r"\b(a|an|the)\b", " ", bare).split()


def f1(p, r):
    p, r = normalized(p), normalized(r)
    if not p or not r:
        return float(not p and not r)
    return 2 * sum((Counter(p) & Counter(r)).values()) / (len(p) + len(r))


def test_f1_and_correctness_are_over_whole_texts(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(200))
    turns = [long + " tail", "x " * 300 + "tail", "The Ünïcode café, 中文 a naïve day", "ünicode café 中文 naïve", "é a b", "é b!", "", "the"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    known = entry.queries()
    got = {r.turn: r.f1 for r in known["token_f1"](spark, str(tmp_path)).collect()}
    want = {i: f1(a, b) for i, (a, b) in enumerate(zip(turns, turns[1:]))}
    assert got == pytest.approx(want, abs=1e-6) and want[0] > 0
    correct = {r.turn: r.correct for r in known["best_answer_correct"](spark, str(tmp_path)).collect()}
    assert correct == {i: max(f1(a, b), f1(a, "")) >= 0.5 for i, (a, b) in enumerate(zip(turns, turns[1:]))}
