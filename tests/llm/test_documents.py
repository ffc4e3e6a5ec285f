import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from verdigris.llm import packing, simhash, substrings, token_counts
from verdigris.llm.common import LATIN_END

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def test_packing_is_a_partition_of_the_ids(docs, rows, no_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, ids in ((i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows))
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.pack_documents(docs).collect()
    sequences = defaultdict(list)
    for p in got:
        ids = next(x for x in by_text[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32)
        assert ids
        sequences[p.sequence_id].append((p.offset, p.length))
    used = padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        used += at
        padded += at if at & (at - 1) == 0 else 2048
    assert used == sum(n * c for (_, _, n), c in want.items())
    assert padded - used <= 2048 * 5
    covered = Counter()
    for p in got:
        covered[p.doc_id] += p.length
    assert covered == Counter({i: sum(map(len, x)) for i, x in by_text.items()})
    unique = [i for i in by_text if len(by_text[i]) == 1]
    for i in unique:
        spans = sorted((p.start, p.start + p.length) for p in got if p.doc_id == i)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(by_text[i][0])
    assert packing.pack_documents(no_docs).count() == 0


def test_tiers_and_step_groups():
    """Windows are as long as their tier, but the last one; full step groups hold like numbers of tokens of a like mix of tiers."""
    rng = random.Random(12)
    batch = pa.record_batch([pa.array(range(4000), pa.int64()), pa.array(["x" * max(1, int(rng.paretovariate(0.9) * 60) % 6000) for _ in range(4000)])], ["doc_id", "text"])
    found = list(packing.pack_batches([batch], lambda t: list(range(len(t))), packing.TIERS, 1, 0))
    rows = [r for b in found for r in b.to_pylist()]
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"], r["tier"], r["step_group"]].append(r["length"])
    odd = [(k, sum(v)) for k, v in windows.items() if sum(v) != k[1]]
    assert len(odd) <= 1 and all(n < packing.TIERS[-1] and k[1] == packing.TIERS[-1] for k, n in odd)
    groups = defaultdict(Counter)
    for (_, tier, group), v in windows.items():
        groups[group][tier] += sum(v)
    # The last group, and the last before each pool's end, may be short or lack tiers that ran out.
    full = [g for g in groups.values() if sum(g.values()) >= packing.STEP_TOKENS]
    assert len(full) >= len(groups) - 1 and all(sum(g.values()) < packing.STEP_TOKENS + packing.TIERS[0] for g in full)
    assert {r["tier"] for r in rows} <= set(packing.TIERS) and len({r["tier"] for r in rows}) > 1
    share = [g[packing.TIERS[0]] / sum(g.values()) for g in full[:10]]
    assert max(share) - min(share) < 0.25


def test_fast_tokenizer_paths_agree_with_the_library_on_latin():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = token_counts.opened("word_bpe_49k.json")
    for c in map(chr, range(LATIN_END)):
        for text in (f"a{c}b", f" {c} ", f"{c}{c}x1{c}", f"A's{c}'LL 9{c}!", f"\n{c}\n {c}  z"):
            assert fast(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)
            counts, special = words.pre_tokens(text)
            assert sum(words.pieces(t) * n for t, n in counts.items()) + special == len(words.tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts(docs, rows, no_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    for head in (token_counts.frequent_pieces, lambda *_: {}):
        got = token_counts.token_counts(docs, head=head).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(no_docs).count() == 0


def test_token_counts_by_other_vocabularies_rules(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, "byte_bpe_50k.json").collect()) == want
    with pytest.raises(ValueError, match="pre-token"):
        token_counts.opened("piece_bpe_32k.model")


def test_no_pre_token_is_hot(spark, monkeypatch):
    """A pre-token of 60 characters in every document, and one too long to be remembered, cross the shuffle never or once a tally."""
    words = token_counts.opened("word_bpe_49k.json")
    monkeypatch.setattr(token_counts, "TALLY_ROWS", 50)
    texts = [f"{'z' * 60} {'y' * 5000} {chr(97 + i // 20)}lone{chr(97 + i % 20)}" for i in range(200)]
    tallies, crossed = token_counts.Tallies(words, {}), Counter()
    for at in range(0, 200, 50):
        for text, (total, rest) in zip(texts[at : at + 50], tallies.count(texts[at : at + 50])):
            crossed.update(t for t, _ in rest)
            assert total + sum(words.pieces(t) * n for t, n in rest) == len(words.tokenizer.encode(text, add_special_tokens=False).ids)
    assert max(crossed.values()) == 1 and "z" * 60 not in crossed and "y" * 5000 not in crossed
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_counts.token_counts(df, head=lambda *_: {})
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(words.tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def brute_fingerprint(text):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, rows, no_docs):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = components(fps)
    least = defaultdict(lambda: None)
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = i if least[r] is None else min(i, least[r])
    want = Counter((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len(set(roots)) < len(set(fps))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_covering_links_every_pair_within_three(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 64, 40, dtype=np.uint64)]
    fps = base + [b ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for b in base for _ in range(6)]
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components([x & (1 << 64) - 1 for x in signed])
    for side in (4096, 3):
        dealt = simhash.squares(simhash.anchored(df), side).repartition("anchor", "part").sortWithinPartitions("anchor", "part").select("anchor", "part", "fp", "home")
        edges = dealt.mapInArrow(lambda b: simhash.compare(b, 3), "a long, b long").collect()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
        found = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        mine = [found.get(x, x) for x in signed]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_components_along_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert len({found[i] for i in range(201)}) == 1 and found[1000] == found[1001] != found[0]


def brute_substrings(rows, window):
    texts = [SPLIT.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substrings(docs, rows, no_docs):
    for window, k in ((35, 12), (20, 12), (35, 35)):
        got = substrings.remove_repeated(docs, window=window, k=k)
        assert {"n_words", "lang", "_row", "kmer", "c0"} <= set(got.columns)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_substrings(rows, window)
    assert substrings.remove_repeated(no_docs).count() == 0


def test_hot_k_mers_and_long_runs(spark, monkeypatch):
    """A 12-gram in every document with differing contexts, a run far longer than a window in several, and equal rows."""
    monkeypatch.setattr(substrings, "HOT_SHARE", 1 / 16)
    rng = random.Random(8)
    word = lambda: f"q{rng.randrange(10**6)}"
    common = [word() for _ in range(12)]
    long = [word() for _ in range(700)]
    rows = [(i, " ".join([*(word() for _ in range(30)), *common, *(word() for _ in range(30))])) for i in range(150)]
    rows += [(200 + i, " ".join([word(), *long[: 700 - 90 * i], word()])) for i in range(4)] + [(300, " ".join(long[100:300] + long[90:140])), (None, " ".join(long)), (None, " ".join(long)), (None, None), (None, None)]
    rows += [(400 + i, " ".join([*(word() for _ in range(12 + i)), *common, *long[5:40]])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_substrings(rows, 35)
    seen = []
    plain = substrings.hot_kmers
    monkeypatch.setattr(substrings, "hot_kmers", lambda *a: seen.append(plain(*a)) or seen[-1])
    for least in (8, 10**6):
        if least > 8:
            monkeypatch.setattr(substrings, "HOT_KMERS", 0)
        got = substrings.remove_repeated(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert len(seen[0]) >= 1 and len(seen[1]) == 0
    docs = substrings.numbered(df, "_row").selectExpr("_row.f __f", "_row.r __r", "text __text")
    paths = substrings.branches(substrings.graph_edges(docs, 35, 12, seen[0]))
    edges, runs = paths.where("repeated").count(), substrings.compacted(substrings.stored(paths, "paths")).count()
    assert runs < edges / 4


def test_runs_that_loop_and_branch(spark):
    """Contraction of a chain, of a chain whose end is shared with another, and of one that comes back to itself."""
    docs = ["abcdefgh", "abcdefgh", "xcdy", "pqpqpq", "pqpq", "z"]
    steps = [(d, i, c, docs[d][i + 1] if i + 1 < len(docs[d]) else None) for d in range(len(docs)) for i, c in enumerate(docs[d])]
    got = {r.node: (r["head"], r.dist) for r in substrings.heads(spark.createDataFrame(steps, "d int, i int, node string, next string")).collect()}
    assert got == {"b": ("a", 1), "d": ("c", 1), "f": ("e", 1), "g": ("e", 2), "h": ("e", 3)} | {"q": ("p", 1)}


def test_cut_texts_keep_their_lines(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one  two\n{passage}\nthree\tfour\n", 7, "a"), (2, f"{passage} end", 8, None), (3, "as it\n is  ", 9, ""), (4, None, 1, "x"), (5, passage, 2, "y"), (6, f"x {passage} y", 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `original.x` string")
    got = substrings.cut_repeated(df)
    assert got.columns == df.columns
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {1: ("one  two\nthree\tfour", 7, "a"), 2: ("end", 8, None), 3: ("as it\n is  ", 9, ""), 4: (None, 1, "x"), 5: ("", 2, "y"), 6: ("x y", 2, "z")}
