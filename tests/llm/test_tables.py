import base64
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from verdigris.llm import bsi, chat, decontamination, toxicity, url_filters, warc
from verdigris.llm.common import new_path
from verdigris.llm.queries import URL_RULES


def test_topk(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    data += [(i, data[50][1]) for i in range(300, 330)] + [(50, data[50][1]), (100, data[7][1])]
    bad = [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (450, [0.5, -0.25]), (451, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data + bad], "vec_id long, embedding array<double>, block string, chunk int")
    rows = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in [*data, *bad[5:]]]
    want = set()
    for q, x in {i: min(v for j, v in rows if j == i) for i, _ in rows if i % 50 == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = Counter(tuple(r) for r in bsi.top_inner_products(df).collect())
    assert set(got) == want
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 9.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in bsi.top_inner_products(few).collect()] == [(0, 1, 3, 256 * 128)]
    assert bsi.top_inner_products(df.limit(0)).count() == 0


def test_sliced_scores_and_boundary_ties():
    rng = np.random.default_rng(1)
    m = rng.integers(-300, 300, (130, 9))
    bits, planes = bsi.slices_of(m)
    q = rng.integers(-300, 300, 9)
    score, offset = bsi.scores_sliced(planes, ~planes, q, bits)
    values = [sum(int(p[i >> 6] >> np.uint64(i & 63) & bsi.ONE) << b for b, p in enumerate(score)) - offset for i in range(130)]
    assert values == (m @ q).tolist()
    m[10:60] = m[5]
    bits, planes = bsi.slices_of(m)
    score, _ = bsi.scores_sliced(planes, ~planes, m[5], bits)
    exact = m @ m[5]
    assert sorted(bsi.top_rows(score, bsi.pack_bits(np.ones(130, bool)), 5).tolist()) == sorted(sorted(range(130), key=lambda i: (-exact[i], i))[:5])


def test_warc_round_trip(spark):
    big = "é<p>x\r\n\r\n" * 40_000
    rows = [(1, "http://a/\r\nX-Page-Id: 9", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/", None), (4, "http://c/", ""), (5, 'http://d/"ü"', big), (7, "u", big), (7, "u", "dup"), (7, "u", "dup"), (8, "u", "dup"), (None, "n", "<p>one</p>"), (None, "n", "lone")]
    pages = spark.createDataFrame([(*r, "z", 0) for r in rows], "page_id long, url string, html string, payload string, _first int").repartition(3)
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    back = warc.read_warc(spark, path, verify=True)
    least = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = i if least[h or ""] is None else min(i, least[h or ""])
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        again = least[h or ""] is not None and i != least[h or ""]
        want[(i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None, None if again else b)] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in back.collect()) == want
    only = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    # Taken from Spark: no filter is left above the scan.
    assert "Filter" not in only._jdf.queryExecution().optimizedPlan().toString()
    assert len(only.collect()) == sum(n for k, n in want.items() if k[4] == "revisit")
    assert {r.payload for r in only.collect()} == {None}
    assert warc.read_warc(spark, path).where("page_id = 5").collect()[0].payload == big.encode()
    empty = new_path(spark, "warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_filters_compare_decoded_values(spark):
    urls = ["http://a/é", 'http://a/"q"', "  blanks ", "http://a/\\u0041", "plain", None]
    pages = spark.createDataFrame([(i, u, f"body {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    back = warc.read_warc(spark, path)
    for i, u in enumerate(urls[:-1]):
        assert [r.page_id for r in back.where(back.url == u).collect()] == [i]
    assert sorted(r.page_id for r in back.where(back.url.isin("plain", "http://a/é")).collect()) == [0, 4]
    assert back.where("url is not null and page_id in (1, 5)").count() == 1


def test_warc_appends_add_up(spark):
    path = new_path(spark, "warc")
    for part in (range(3), range(3, 5), range(0)):
        warc.write_warc(spark.createDataFrame([(i, "u", f"b{i}") for i in part], "page_id long, url string, html string"), path)
    assert sorted(r.page_id for r in warc.read_warc(spark, path, verify=True).collect()) == list(range(5))


def test_foreign_archives(spark, tmp_path):
    records = [('http://a/"q\\u0041', b"\xff\xfe\x00"), ("http://b/é", "é".encode()), ("http://c/", b"")]
    body = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + u.encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(x) + x + b"\r\n\r\n" for u, x in records)
    (tmp_path / "f.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Page-Id: none\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + body)
    back = warc.read_warc(spark, f"file://{tmp_path}", verify=True)
    got = back.where("record_type = 'response'").collect()
    assert [(r.url, bytes(r.payload), r.page_id) for r in got] == [(u, x, None) for u, x in records]
    assert back.where(back.url == records[0][0]).count() == 1 and back.count() == 4


def test_warc_reader_pushes_filters_and_skips_payloads(monkeypatch, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader(str(tmp_path), True, False)
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    rows = [{"record_type": t, "payload": b"x" * 3_000_000, "payload_bytes": 3_000_000, "payload_digest": "D", "url": "u", "page_id": i, "refers_to": 1} for i, t in enumerate(["response", "revisit", "response"])]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(map(warc.record, rows)))
    fs, root = warc.open_fs(str(path))
    with fs.open_input_file(root) as src:
        assert [h["x-page-id"] for h, b in warc.records(src, 0, path.stat().st_size, lambda h: h["warc-type"] == "revisit", True)] == ["1"]
    plain = tmp_path / "foreign.warc"
    plain.write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3 + b"\r\n")
    with open(plain, "rb") as src:
        assert [b for _, b in warc.records(src, 0, plain.stat().st_size, lambda h: True, True)] == [b"abc"] * 3
    import gzip

    foreign = tmp_path / "foreign.warc.gz"
    foreign.write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n + b"y" * n + b"\r\n\r\n") for n in (0, 200_000, 5)))
    with open(foreign, "rb") as src:
        assert [len(b) for _, b in warc.records(src, 0, foreign.stat().st_size, lambda h: True, True)] == [0, 200_000, 5]


def words_in(text):
    import re

    return [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]


def shingle_set(text, n=5):
    w = words_in(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_contained_items(spark, docs, rows, no_docs):
    rng = random.Random(2)
    items = []
    for n, (_, t) in enumerate(r for r in rows if r[1] and len(r[1].split()) >= 35):
        w = t.split()[5 : 5 + rng.choice([5, 8, 20, 30, 120])]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        items.append((n, " ".join(w).upper()))
    items += [(900, None), (901, ""), (902, "w1"), (903, "same same same same same"), (None, "only once"), (904, "Only, once!"), (905, "r1 r1 r1"), (906, "r0 r1"), (907, "nowhere at all")]
    items += [(908, "w1 w2"), (908, "w3 w4 w5 w6")]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    lengths, told = {}, defaultdict(set)
    for i, t in items:
        if words_in(t):
            lengths[i] = min(lengths.get(i, 5), len(words_in(t)))
    for i, t in items:
        if i in lengths:
            told[i] |= shingle_set(t, lengths[i])
    have = defaultdict(set)
    for i, t in rows:
        for n in range(1, 6):
            have[i, n] |= shingle_set(t, n)
    ids = {i for i, _ in rows}
    want = {(d, i, len(s), len(s & have[d, lengths[i]])) for i, s in told.items() for d in ids if len(s & have[d, lengths[i]]) >= 0.8 * len(s) - 1e-9}
    got = decontamination.contained_items(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == want and len(got) == len(want)
    assert any(i == 905 for _, i, *_ in want) and any(i == 906 for _, i, *_ in want)
    by_row = [(i, t) for i, t in rows if not any(len(s & shingle_set(t, lengths[j])) >= 0.8 * len(s) - 1e-9 for j, s in told.items())]
    kept = decontamination.without_leaks(docs, bench)
    # Rows are judged one by one: those of a null or repeated id too.
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(by_row) and kept.columns == docs.columns
    assert decontamination.contained_items(no_docs, bench).count() == 0 == decontamination.contained_items(docs, bench.limit(0)).count()


def test_short_items_inside_long_documents(spark):
    docs = spark.createDataFrame([(1, "the secret answer is forty two, as everyone here has long known"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "forty two"), (2, "Secret answer is forty"), (3, "answer forty"), (4, "nothing here at")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect()} == {(1, 1), (1, 2)}


def test_only_sketches_meet_the_documents(spark):
    """Of an item of 40 shingles 13 are searched for; a document with only others of them is no candidate."""
    words = [f"v{i}" for i in range(44)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    listed = decontamination.sketches(items, "item_id", "text", 5, 0.8)
    row = listed.first()
    assert (row.n_shingles, len(row["_sketch"])) == (40, 13)
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 5])) for i in range(40)] + [(100, " ".join(words[:36]))], "doc_id long, text string")
    found = decontamination.candidates(docs, listed, "doc_id", "text").collect()
    assert len(found) == 13 + 1 and {r.doc_id for r in found} >= {100}
    assert {r.doc_id for r in decontamination.contained_items(docs, items).collect()} == {100}


def test_url_rules(spark):
    urls = ["http://Example.com/en/7?x", "https://a.B.com/en/", "x://com/en", "http://com/en/x#y", "http://notexample.com/en/7", "http://example.net/de/8", "http://q.net/de/", "http://example.net:80/de/8", "http://org", "org/es/", "", None, "http://a.org/es/?://b", "http://.com/en/", "://com/en/z", "http://x.example.com/en/75://q", "HTTP://İ.org/es/1", "http://a.org/es/1\nx"]
    pages = spark.createDataFrame([(k % 15, u, "mine", "h", 1, 2, 3) for k, u in enumerate(urls * 2)] + [(None, urls[0], "mine", "h", 1, 2, 3)], "page_id long, url string, rule string, host string, _m int, `a.b` int, u int")
    rules = spark.createDataFrame([*URL_RULES, ("allow", "org", "/es/"), ("block", None, "/")], url_filters.RULE_SCHEMA)

    def brute(u):
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            rest = rest[end:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in [*URL_RULES, ("allow", "org", "/es/")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    got = url_filters.judge_urls(pages, rules).collect()
    assert {(r["_m"], r["a.b"], r["u"]) for r in got} == {(1, 2, 3)}
    assert Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((p, u, *brute(u)) for p, u in [*((k % 15, u) for k, u in enumerate(urls * 2)), (None, urls[0])])
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


#: What may follow what, written out anew: an optional system turn, then user and assistant in turn, ending with assistant.
NEXT = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def legal(turns):
    return all(b in NEXT[a] for a, b in zip(("", *turns), turns)) and (not turns or turns[-1] == "assistant")


def outputs(n):
    """All legal sequences of at most n turns."""
    return [p for m in range(n + 1) for p in itertools.product(("system", "user", "assistant"), repeat=m) if legal(p)]


def brute_cost(roles):
    """Least (cost, turns) over every legal output and every way to give the turns to it, by enumeration.

    A way names for each turn the output turn that it goes to, in order: the first of an output turn opens it (2 if its role
    differs), others merge into it (1, or 3 if their role differs); an output turn that none opens is inserted (3).
    """
    best = (9**9, 0)
    for out in outputs(2 * len(roles) + 2):
        for way in itertools.combinations_with_replacement(range(len(out)), len(roles)):
            cost = 3 * (len(out) - len(set(way)))
            for k, (r, at) in enumerate(zip(roles, way)):
                again = k and way[k - 1] == at
                cost += (1 if r == out[at] else 3) if again else (0 if r == out[at] else 2)
            best = min(best, (cost, len(out)))
    return best


def fast_cost(roles):
    """The same by a shortest path, for conversations too long to enumerate; held against brute_cost below."""
    front = {"": (0, 0)}
    for r in roles:
        new = {}
        for s, (c, n) in front.items():
            ways = [(c + (1 if r == s else 3), n, s)] if s else []
            for a in NEXT[s]:
                ways += [(c + (0 if r == a else 2), n + 1, a)] + [(c + 3 + (0 if r == b else 2), n + 2, b) for b in NEXT[a]]
                ways += [(c + 6 + (0 if r == d else 2), n + 3, d) for b in NEXT[a] for d in NEXT[b]]
            for cc, nn, t in ways:
                new[t] = min(new.get(t, (9**9, 0)), (cc, nn))
        front = new
    end = {"": 0, "system": 2, "user": 1, "assistant": 0}
    return min((c + 3 * end[s], n + end[s]) for s, (c, n) in front.items())


def test_the_two_ways_to_the_least_cost_agree():
    for n in range(5):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            if n < 4 or sum(len(r or '') for r in roles) % 4 == 0:
                assert fast_cost(roles) == (brute_cost(roles) if n else (0, 0))


def test_chat_repair(spark, monkeypatch):
    rng = random.Random(4)
    convs = {i: [rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 9))] for i in range(150)}
    convs |= {1000 + k: list(p) for k, p in enumerate(itertools.product(["system", "user", "assistant"], repeat=3))}
    want = {c: fast_cost(r) for c, r in convs.items()}
    convs[5000] = ["user", "assistant"] * 800 + ["user", "user", "system"]
    convs[None] = ["user", "assistant"]
    want |= {c: fast_cost(convs[c]) for c in (5000, None)}
    data = [(c, t, r, rng.choice([None, "", f"text {c} {t}"]), "x") for c, roles in convs.items() for t, r in enumerate(roles)]
    data[0] = (*data[0][:3], "very long " * 300_000, "x")
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segment string").repartition(6)
    for segment in (512, 2):
        monkeypatch.setattr(chat, "SEGMENT", segment)
        got = defaultdict(list)
        for r in chat.format_chats(df).collect():
            got[r.conv_id].append(r)
        assert set(got) == set(convs)
        for c, roles in convs.items():
            rows = sorted(got[c], key=lambda r: (r.segment, r.pos))
            assert [r.role for r in rows] == roles and [r.turn for r in rows] == list(range(len(roles)))
            assert rows[0].repair_cost == want[c][0]
            text = "".join(r.rendered for r in rows)
            heads = [x.split("|>")[0] for x in text.split("<|")[1:]]
            turns = heads[::2]
            assert heads[1::2] == ["end"] * len(turns)
            state = ""
            for t in turns:
                assert t in NEXT[state]
                state = t
            assert state == "assistant" and len(turns) == want[c][1]
            for r in rows:
                assert turns[r.out_turn] == r.out_role
    assert chat.format_chats(df.limit(0)).count() == 0


def test_toxicity_learns_hidden_words_and_ignores_held_out_labels(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    data, labels = [], []
    for i in range(1500):
        y = int(rng.random() < 0.15)
        bad = rng.choice([f"zorp{rng.randrange(99)}", f"quix{rng.choice('abc')}", "Idiot"])
        data.append((i, text() + (f" {bad}, " if y else " ") + text(), "x"))
        labels.append((i, y))
    extra = [(2000, None, ""), (2001, "", ""), (None, "you idiot", ""), (7, data[7][1], ""), (2002, text() * 300 + " zorp1", "")]
    docs = spark.createDataFrame(data + extra, "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame([*labels, (7, labels[7][1]), (None, 1), (9999, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(data) + len(extra)
    import zlib

    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    assert all(by[i].predicted == y for i, y in truth.items() if by[i].held_out)
    assert by[2000].predicted == by[2001].predicted == 0 and by[None].predicted == by[2002].predicted == 1
    flipped = spark.createDataFrame([(i, 1 - y if by[i].held_out else y) for i, y in labels] + [(7, labels[7][1])], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(by[i].score, abs=1e-9) for i in again)
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    assert toxicity.toxicity(docs, lab.limit(0)).count() == len(got)


def em_by_hand(patterns, n, share, trusted, rounds):
    """Expectation maximisation with independent voters, voter by voter."""
    rate = {(y, v): min(max(trusted[1 - y][v], 1e-5 if y else 1e-6), 1 - 1e-5) for y in (0, 1) for v in range(n)}
    for _ in range(rounds):
        post = []
        for fired, m in patterns:
            odds = share / (1 - share)
            for v in fired:
                odds *= rate[1, v] / rate[0, v]
            post.append((fired, m, odds / (1 + odds)))
        weight = {1: sum(m * p for _, m, p in post) + 1e-9, 0: sum(m * (1 - p) for _, m, p in post) + 1e-9}
        for y in (0, 1):
            for v in range(n):
                seen = sum(m * (p if y else 1 - p) for fired, m, p in post if v in fired)
                rate[y, v] = min(max((seen + 50 * trusted[1 - y][v]) / (weight[y] + 50), 1e-5 if y else 1e-6), 1 - 1e-5)
        share = min(max(weight[1] / (weight[0] + weight[1]), 1e-3), 0.5)
    return rate, share


def vote_patterns(seed=6, n=6):
    rng = random.Random(seed)
    found = Counter()
    for _ in range(4000):
        y = rng.random() < 0.2
        fired = tuple(v for v in range(n - 1) if rng.random() < ((0.15 + 0.1 * v) if y else 0.01 * (v + 1)))
        found[fired or (n - 1,)] += 1
    trusted = np.array([[0.2 + 0.05 * v for v in range(n - 1)] + [0.2], [0.02] * (n - 1) + [0.9]])
    return found, trusted


def test_label_model_against_a_loop(spark, monkeypatch):
    found, trusted = vote_patterns()
    df = spark.createDataFrame([(list(k), v) for k, v in found.items()], "fired array<int>, n long").repartition(3)
    monkeypatch.setattr(toxicity, "DEPENDENT", 1e18)
    model = toxicity.label_model(df, 6, 0.1, trusted)
    rate, share = em_by_hand([(k, v) for k, v in found.items()], 6, 0.1, trusted, toxicity.ROUNDS + toxicity.TREE_ROUNDS)
    assert model.prior == pytest.approx(share, rel=1e-9)
    for y in (0, 1):
        assert model.rates[y, 0].tolist() == pytest.approx([rate[y, v] for v in range(6)], rel=1e-9)


def test_voters_that_repeat_another_say_nothing_new(spark):
    """Copies of voter 0 move no posterior: they're found to depend on it and their rates beside it are the same under both labels."""
    found, trusted = vote_patterns()
    plain = toxicity.label_model(spark.createDataFrame([(list(k), v) for k, v in found.items()], "fired array<int>, n long"), 6, 0.1, trusted)
    wide = np.concatenate((trusted, trusted[:, [0, 0]]), axis=1)
    copied = {k + ((6, 7) if 0 in k else ()): v for k, v in found.items()}
    model = toxicity.label_model(spark.createDataFrame([(list(k), v) for k, v in copied.items()], "fired array<int>, n long"), 8, 0.1, wide)
    assert sum(p >= 0 for p in model.parent) >= 2
    for fired in found:
        assert model.posterior([*fired, *((6, 7) if 0 in fired else ())]) == pytest.approx(plain.posterior(list(fired)), abs=0.03)
    naive = toxicity.LabelModel(model.prior, model.rates[:, [0, 0]], np.full(8, -1))
    assert naive.log_odds([0, 6, 7]) > model.log_odds([0, 6, 7]) + 5


def test_the_labelled_sample_is_bounded(spark):
    import zlib

    a, b, c, d = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = spark.createDataFrame([(a, f"t{i}") for i in range(50)] + [(b, "x"), (c, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (a, 0), (b, 0), (c, 0), (d, 1), (6, None)], "doc_id long, toxic int")
    picked = toxicity.picked_labels(labels, 2)
    assert picked.count() == 2 >= toxicity.labelled_sample(docs, picked).count()
    assert toxicity.labelled_sample(docs, toxicity.picked_labels(labels, 99)).count() <= 3


def test_toxic_rows_go_whatever_their_id(spark):
    docs = spark.createDataFrame([(i, f"fine text {i}", "k") for i in range(60)] + [(None, "you idiot, you scum", "k"), (4, "stupid moron", "k"), (None, "fine again", "k")], "doc_id long, text string, `a.b` string")
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted([f"fine text {i}" for i in range(60)] + ["fine again"])
