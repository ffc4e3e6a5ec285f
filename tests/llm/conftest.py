import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, host string, fp string, kmer string, c0 string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, repeats, odd characters, nulls, empty and long ones."""
    rng = random.Random(7)
    passage = words(rng, 60, 10**6)
    short = words(rng, 35, 10**6)
    texts = [words(rng, rng.choice([0, 1, 2, 3, 20, 34, 35, 36, 80, 200, 500])) for _ in range(60)]
    texts += [texts[40]] * 25 + [None, "", "   \t\n ", None]
    base = words(rng, 300, 10**6).split()
    for _ in range(20):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(300)] = f"x{rng.randrange(999)}"
        texts.append(" ".join(copy))
    texts += [words(rng, 10) + " " + passage + "\n" + words(rng, 10) for _ in range(8)] + [short, short + " tail", "head  " + short, " ".join([short, "mid", short])]
    texts += [" ".join(f"r{j} " * 50 for j in range(6)), " ".join([words(rng, 9, 10**6)] * 12), "same " * 120, "a b " * 100, "It's WE'LL <|endoftext|> café İstanbul ΟΔΟΣ 中文字 ½² x\u00a0y z\u2028q don't 12345 ¿qué? \u0085 e\u0301 😀👍 <|startoftext|>ok", "<|endoftext|>", words(rng, 30_000, 5000)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[40]), (None, "only once"), (3, texts[3]), (3, texts[3]), (-5, texts[41])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", f"s{k % 3}", None if t is None else len(t), "r", "h", "f", "k", "c") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
