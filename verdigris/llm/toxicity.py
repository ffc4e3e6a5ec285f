"""Weak supervision for toxicity: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import free_name, lean, numbered, small_batches, stored, without_rows

#: Insults in common use, one voter each (fixed values).
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "imbecile", "filthy", "vermin", "bastard",
    "crétin", "imbécile", "connard", "salaud", "dummkopf", "arschloch", "abschaum", "vollidiot", "idiota", "estúpido", "imbécil", "cabrón",
)
#: Second-person attacks and calls to violence (fixed values).
PATTERNS = (r"you are (?:a|an|all|so) \w+", r"shut up", r"kill (?:your|them)\w*", r"i hate \w+", r"go to hell", r"(?:!|\?){4,}")

#: Labelled rows at most, taken by hash, from which voters are mined and the label model starts.
LABELLED = 30_000
#: Rows at most, taken by hash, on which the classifier is fitted to posteriors.
FITTED = 50_000
#: Mined voters at most, shortest and longest word beginning, and how likely chance may give a beginning its labels.
MINED, SHORTEST, LONGEST, CHANCE = 128, 3, 8, 1e-6
#: Rounds with independent voters, and then with their dependencies; prior counts of rates and of conditional rates.
ROUNDS, TREE_ROUNDS, STRENGTH, PAIR_STRENGTH = 6, 4, 50, 10
#: Partitions of small tables.
PARTS = 32
#: Twice the log-likelihood (chi squared) that a dependency must gain.
DEPENDENT = 25.0
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


@dataclass
class Voters:
    """Word beginnings, whole words and patterns, each a voter that fires or abstains."""

    words: dict[str, int] = field(default_factory=dict)
    begins: dict[str, int] = field(default_factory=dict)
    patterns: list[tuple[str, int]] = field(default_factory=list)

    def __len__(self) -> int:
        """With the last one, which votes where all others abstain."""
        return len(self.words) + len(self.begins) + len(self.patterns) + 1

    def fired(self, text: str, seen: set[str], patterns: list[tuple[re.Pattern, int]], leads: set[str]) -> list[int]:
        out = {self.words[w] for w in seen if w in self.words}
        if self.begins:
            for w in seen:
                if w[:SHORTEST] in leads:
                    out.update(i for n in range(SHORTEST, LONGEST + 1) if (i := self.begins.get(w[:n])) is not None)
        out.update(i for p, i in patterns if p.search(text))
        return sorted(out) or [len(self) - 1]


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, fired: list[int]) -> float:
        z = self.bias + float(self.weights[fired].sum()) if fired else self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def picked_labels(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, y) of at most bound labelled ids that aren't held out, those of least hash; conflicting labels count as 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_sample(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(text, y): one row of each picked id, so at most as many; of rows that repeat an id, the least text."""
    # Two numbers a row, bounded: sent to all executors.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def beginnings(text: str | None) -> set[str]:
    return {w[:n] for w in set(WORD.findall((text or "").lower())) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def mine(sample: DataFrame, most: int = MINED) -> tuple[list[str], float]:
    """(word beginnings that speak for label 1, share of label 1) in a bounded labelled sample.

    Counts documents per beginning and label and keeps those that are far commoner under label 1; of these it takes
    greedily what explains the most documents of label 1 not yet explained.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
                part = batch.slice(at, 500)
                rows = [0, 0]
                for value, y in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    into = counts[y == 1]
                    rows[y == 1] += 1
                    for b in beginnings(value.as_py()):
                        into[b] = into.get(b, 0) + 1
                neg, pos = counts
                keys = [*pos, *(b for b in neg if b not in pos)]
                yield pa.RecordBatch.from_arrays([pa.array([*keys, ""], pa.string()), pa.array([*(pos.get(b, 0) for b in keys), rows[1]], pa.int64()), pa.array([*(neg.get(b, 0) for b in keys), rows[0]], pa.int64())], ["b", "pos", "neg"])

    counts = stored(sample.mapInArrow(lean(opened), "b string, pos long, neg long").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).coalesce(PARTS), "beginnings")
    total = counts.where("b = ''").first()
    p, n = (total["pos"], total["neg"]) if total else (0, 0)
    if not p or not n:
        return [], 0.1
    share = p / (p + n)
    # So many documents that the label's share alone would hardly give them, whichever of a million beginnings it is.
    least = max(4, math.ceil(math.log(CHANCE) / math.log(share)))
    gain = (F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))) * F.sqrt("pos")
    told = counts.where((F.col("b") != "") & (F.col("pos") >= least) & (F.col("pos") / p > 12 * F.col("neg") / n) & (F.col("pos") >= 4 * F.col("neg"))).orderBy(gain.desc(), F.length("b"), "b").limit(40 * most).collect()
    rows = [(r["b"], r["pos"], r["neg"]) for r in told]
    if not rows:
        return [], share
    place = {b: i for i, (b, _, _) in enumerate(rows)}

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row with label 1: the candidates it holds, and -1 if a listed insult."""
        listed = set(INSULTS)
        for batch in batches:
            found = []
            for value in batch.column(0):
                text = value.as_py()
                held = {place[b] for b in beginnings(text) if b in place}
                found.append(sorted(held | ({-1} if listed.intersection(WORD.findall((text or "").lower())) else set())))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["held"])

    # Bounded: rows of the labelled sample times at most 40 * most candidates.
    held = sample.where("y = 1").select("text").mapInArrow(lean(holding), "held array<int>").toArrow()["held"].to_pylist()
    holds = np.zeros((len(held), len(rows)), bool)
    for i, at in enumerate(held):
        holds[i, [j for j in at if j >= 0]] = True
    open_ = np.array([-1 not in at for at in held], bool)
    against = 3 * np.array([neg for _, _, neg in rows])
    taken: list[str] = []
    while len(taken) < most:
        # The beginning that explains the most documents which none taken before (nor a listed insult) explains:
        # words that copies of one toxic document share explain nothing more once it has a voter.
        worth = holds[open_].sum(axis=0) - against
        j = int(worth.argmax())
        if worth[j] < least:
            break
        taken.append(rows[j][0])
        open_ &= ~holds[:, j]
    return taken, share


def voters_for(mined: list[str]) -> Voters:
    v = Voters()
    for w in INSULTS:
        v.words[w] = len(v) - 1
    for p in PATTERNS:
        v.patterns.append((p, len(v) - 1))
    for b in mined:
        v.begins[b] = len(v) - 1
    return v


def votes(docs: DataFrame, voters: Voters, *extra: str) -> DataFrame:
    """(doc_id, *extra, fired): the numbers of the voters that fire on each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(re.compile(p), i) for p, i in voters.patterns]
        leads = {b[:SHORTEST] for b in voters.begins}
        for batch in batches:
            fired = []
            for value in batch.column(0):
                text = (value.as_py() or "").lower()
                fired.append(voters.fired(text, set(WORD.findall(text)), patterns, leads))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fired, pa.list_(pa.int32()))], [*batch.schema.names[1:], "fired"])

    rest = docs.select("text", "doc_id", *extra)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields[1:])
    return rest.mapInArrow(lean(run), f"{kinds}, fired array<int>")


@dataclass
class LabelModel:
    """P(label 1), and P(voter fires | label, whether its parent fires); voters without a parent have it once.

    An abstention's probability is taken to be the same under both labels, as voters speak different languages: it
    drops out of the posterior. rates is labels x (parent silent, parent fires) x voters; label 0 comes first.
    """

    prior: float
    rates: np.ndarray
    parent: np.ndarray

    def log_odds(self, fired: list[int]) -> float:
        at = np.asarray(fired, np.int64)
        on = np.isin(self.parent[at], at).astype(np.int64)
        return math.log(self.prior / (1 - self.prior)) + float(np.log(self.rates[1, on, at] / self.rates[0, on, at]).sum())

    def posterior(self, fired: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.log_odds(fired)))))


def dependencies(pairs: np.ndarray, least: float = DEPENDENT) -> np.ndarray:
    """The parent of each voter (or -1): the forest of the strongest correlations within the labels (Chow and Liu).

    pairs: labels x (voters + 1) x (voters + 1) expected counts of voters that fire together; the last one always does.
    """
    n = pairs.shape[1] - 1
    gain = np.zeros((n, n))
    together = np.zeros((n, n), bool)
    for c in pairs:
        total, single, both = c[n, n] + 1e-9, c[n, :n], c[:n, :n]
        for x in (0, 1):
            for y in (0, 1):
                a, b = (single if x else total - single)[:, None], (single if y else total - single)[None, :]
                cell = both if x and y else single[:, None] - both if x else single[None, :] - both if y else total - single[:, None] - single[None, :] + both
                cell = np.maximum(cell, 0)
                gain += 2 * cell * np.log(np.maximum(cell, 1e-12) * total / np.maximum(a * b, 1e-12))
        together |= both * total > np.outer(single, single) * 1.0001
    gain[~together] = 0
    parent, root = np.full(n, -1), np.arange(n)
    links: list[list[int]] = [[] for _ in range(n)]
    for i, j in sorted(zip(*np.nonzero(np.triu(gain, 1) > least), strict=True), key=lambda ij: (-gain[ij], ij)):
        if root[i] != root[j]:
            links[i].append(int(j))
            links[j].append(int(i))
            root[root == root[j]] = root[i]
    seen: set[int] = set()
    for start in range(n):
        stack = [] if start in seen else [start]
        while stack:
            i = stack.pop()
            seen.add(i)
            for j in links[i]:
                if j not in seen:
                    parent[j] = i
                    stack.append(j)
    return parent


def maximised(pairs: np.ndarray, parent: np.ndarray, trusted: np.ndarray) -> LabelModel:
    """The model of greatest likelihood for expected counts, with prior counts.

    Rates shrink to the labelled rows' (trusted: label 1, label 0); rates beside a firing parent shrink to what both
    labels have in common, so that a voter that only repeats its parent says nothing new.
    """
    n = pairs.shape[1] - 1
    totals = pairs[:, n, n] + 1e-9
    single = pairs[:, n, :n]
    at = np.maximum(parent, 0)
    both = np.where(parent >= 0, pairs[:, at, np.arange(n)], 0.0)
    led = np.where(parent >= 0, single[:, at], 0.0)
    known = trusted[::-1]
    silent = (single - both + STRENGTH * known) / (totals[:, None] - led + STRENGTH)
    common = (both.sum(axis=0) + 1e-3) / (led.sum(axis=0) + 2e-3)
    beside = (both + PAIR_STRENGTH * common) / (led + PAIR_STRENGTH)
    rates = np.stack([silent, np.where(parent >= 0, beside, silent)], axis=1)
    return LabelModel(float(np.clip(totals[1] / totals.sum(), 1e-3, 0.5)), np.clip(rates, [[[1e-6]], [[1e-5]]], 1 - 1e-5), parent)


def label_model(patterns: DataFrame, n_voters: int, share: float, trusted: np.ndarray) -> LabelModel:
    """The generative model of the votes by expectation maximisation over all documents' vote patterns.

    patterns (fired, n) holds each distinct pattern once, in PARTS partitions at most; every round sums expected counts of
    single voters and pairs in each and brings back (n_voters + 1)**2 numbers of it at most. trusted: firing rates under label 1 and 0 to start
    from, which also act as prior counts. After ROUNDS rounds with independent voters, those that are correlated within
    the labels become each other's parents, and TREE_ROUNDS more rounds estimate accuracies and correlations together.
    """
    none = np.full(n_voters, -1)
    start = np.stack([trusted[1], trusted[0]])
    model = LabelModel(share, np.clip(np.stack([start, start], axis=1), [[[1e-6]], [[1e-5]]], 1 - 1e-5), none)
    for turn in range(ROUNDS + TREE_ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, n_voters + 1, n_voters + 1))
            for batch in batches:
                for fired, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    p = model.posterior(fired)
                    at = np.ix_([*fired, n_voters], [*fired, n_voters])
                    sums[1][at] += p * n
                    sums[0][at] += (1 - p) * n
            i, j = np.nonzero(sums.sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[0, i, j]), pa.array(sums[1, i, j])], ["i", "j", "zero", "one"])

        # PARTS * (n_voters + 1)**2 sums at most.
        found = patterns.mapInArrow(expect, "i int, j int, zero double, one double").toArrow()
        pairs = np.zeros((2, n_voters + 1, n_voters + 1))
        i, j = (found[x].to_numpy() for x in ("i", "j"))
        np.add.at(pairs[0], (i, j), found["zero"].to_numpy())
        np.add.at(pairs[1], (i, j), found["one"].to_numpy())
        parent = none if turn < ROUNDS - 1 else dependencies(pairs) if turn == ROUNDS - 1 else model.parent
        model = maximised(pairs, parent, trusted)
    return model


def fit_linear(fired: list[list[int]], target: np.ndarray, n: int, ridge: float = 1e-6, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression of posterior labels on voters, by Nesterov steps; the columns are few, the rows bounded."""
    x = np.zeros((len(fired), n + 1))
    for row, at in enumerate(fired):
        x[row, at] = 1
    x[:, n] = 1
    rows, place = np.unique(x, axis=0, return_inverse=True)
    place = place.reshape(-1)
    count = np.bincount(place).astype(float)
    mean = np.bincount(place, target) / count
    count /= count.sum()
    w, v = np.zeros(n + 1), np.zeros(n + 1)
    lipschitz = 0.25 * float((rows * rows).sum(axis=1) @ count) + ridge
    decay = np.full(n + 1, ridge)
    decay[n] = 0
    for t in range(steps):
        z = v
        p = 1 / (1 + np.exp(-np.clip(rows @ z, -60, 60)))
        new = z - (rows.T @ (count * (p - mean)) + decay * z) / lipschitz
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, labelled: int, fitted: int, *keep: str) -> tuple[Model, DataFrame]:
    """(model, votes on all documents with doc_id and the columns keep). Only labelled rows that aren't held out are learnt from."""
    small_batches(docs.sparkSession)
    picked = stored(picked_labels(labels, labelled), "labelled")
    mined, share = mine(stored(labelled_sample(docs, picked).coalesce(PARTS), "sample"))
    voters = voters_for(mined)
    n = len(voters)
    cast = stored(votes(docs, voters, *keep), "votes")
    # Firing rates of the labelled rows: where the label model starts.
    known = cast.join(F.broadcast(picked), "doc_id")
    rates = known.select("y", F.explode("fired").alias("i")).groupBy("y", "i").count().collect()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    fires = np.zeros((2, n))
    for r in rates:
        fires[0 if r["y"] == 1 else 1, r["i"]] = r["count"]
    trusted = np.stack([np.clip((fires[0] + 0.02) / (sizes.get(1, 0) + 1), 1e-5, 0.999), np.clip((fires[1] + 0.002) / (sizes.get(0, 0) + 1), 1e-6, 0.999)])
    # Voters that the labels don't know start as weak evidence for label 1.
    unseen = (fires.sum(axis=0) == 0)
    trusted[0, unseen], trusted[1, unseen] = 1e-3, 1e-4
    rows = cast.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted).select("fired").toArrow()["fired"].to_pylist()
    if not rows:
        return Model(voters, np.zeros(n), -3.0), cast
    found = label_model(stored(cast.groupBy("fired").agg(F.count("*").alias("n")).coalesce(PARTS), "patterns"), n, share, trusted)
    weights, bias = fit_linear(rows, np.array([found.posterior(f) for f in rows]), n)
    return Model(voters, weights, bias), cast


def scored(docs: DataFrame, labels: DataFrame, labelled: int, fitted: int, *keep: str) -> DataFrame:
    """(doc_id, *keep, score) per row of docs."""
    model, cast = fit(docs.select("doc_id", "text", *keep), labels.select("doc_id", "toxic"), labelled, fitted, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(f) for f in batch.column(batch.num_columns - 1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

    rest = cast.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "fired")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields[:-1])
    return rest.mapInArrow(run, f"{kinds}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, labelled: int = LABELLED, fitted: int = FITTED) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs (doc_id, text) from labels (doc_id, toxic).

    Voters: listed insults, attack patterns, and word beginnings mined from at most `labelled` labelled rows. A
    generative model of the votes of all documents estimates how often each voter fires under either label, and beside
    which other; a logistic regression on the votes of at most `fitted` rows is fitted to its posteriors and scores
    every whole text. Rows with crc32(doc_id as text) mod 3 = 1 are held out: their labels are never read. Labels,
    lang, source and doc_id are no inputs of a score.

    Null and empty texts have no votes and the score of silence; a null id is not held out; repeated rows and ids are
    scored each; conflicting labels of an id count as toxic; without labels the listed voters alone speak; an empty
    table gives no rows; other columns aren't read.
    """
    told = scored(docs, labels, labelled, fitted)
    return told.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, labelled: int = LABELLED, fitted: int = FITTED) -> DataFrame:
    """The documents that aren't predicted toxic. Each row is judged by itself, whatever its id."""
    (row,) = free_name(docs, "_row")
    told = numbered(docs, row)
    return without_rows(told, scored(told, labels, labelled, fitted, row).where(F.col("score") >= threshold).select(row), row)
