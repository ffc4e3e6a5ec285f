"""Repeated long spans by a sampled De Bruijn graph: k-mers as edges, nonbranching paths compacted by joins, coordinates as proof."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import KEPT, free_name, kept_since, lean, numbered, quoted, small_batches, stored

WINDOW = 35
#: Words of a k-mer. Of the WINDOW - KMER + 1 k-mers of a window the one of least hash (the leftmost) is its edge.
KMER = 12
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xD1B54A32D192ED03)
KEPT_WORDS = 400_000
#: Documents from which hot k-mers are taken, and the share of them that makes a k-mer hot. They only spread work.
HOT_SAMPLE, HOT_SHARE, HOT_KMERS = 8000, 1 / 256, 1 << 16
#: Rows of a partition in which runs are contracted.
RUN_ROWS = 100_000
#: What tells rows apart.
KEY = ["__f", "__r"]
PATH = ["context", "check"]
ADDED = ("n_words", "n_removed", "kept_text", "kept_sha256")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the task's commonest words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of word runs of one document: polynomials modulo 2**64 over the words' hashes, mixed."""

    def __init__(self, hashes: np.ndarray, base: np.uint64) -> None:
        n = len(hashes)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up = np.full(n + 1, base)
        down = np.full(n + 1, inverse)
        up[0] = down[0] = 1
        self.up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[:n], dtype=np.uint64)))

    def runs(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.up[starts])


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def edges_of(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...] | None:
    """(k-mer hash, context hash, check, first window, last window, tied) of each k-mer that is the least of some window.

    The windows of one k-mer occurrence are consecutive. Its context is the path through it that they cover: the words
    of [first, last + window) and where in them the k-mer lies; check is 32 more bits of it. tied: the k-mer occurs there again, so that windows of
    this one occurrence may equal each other.
    """
    n = len(hashes) - window + 1
    if n < 1:
        return None
    rolling = Rolling(hashes, BASE)
    kmers = rolling.runs(np.arange(len(hashes) - k + 1), k)
    span = window - k + 1
    views = np.lib.stride_tricks.sliding_window_view(kmers, span)
    place = np.arange(n) + views.argmin(axis=1)
    # Where equal k-mers tie (texts that repeat themselves), one occurrence serves all windows that hold it.
    least = kmers[place]
    moved = np.flatnonzero((place[1:] != place[:-1]) & (least[1:] == least[:-1]))
    ties = np.zeros(n, bool)
    done = 0
    for i in moved.tolist():
        if i < done:
            continue
        start = int(np.searchsorted(place[: i + 1], place[i]))
        stop = start + int(np.argmax(np.concatenate((least[start:] != least[start], [True]))))
        at = start + np.flatnonzero(kmers[start : stop + span - 1] == least[start])
        window_at = start
        while window_at < stop:
            chosen = int(at[np.searchsorted(at, window_at + span) - 1])
            until = min(stop, chosen + 1)
            place[window_at:until] = chosen
            window_at = until
        ties[start:stop] = True
        done = stop
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    at = place[first]
    where = ((at - first) * 1000 + (last - first)).astype(np.uint64) * BASE2
    context = mixed(rolling.runs(first, last - first + window) + where)
    check = mixed(Rolling(mixed(hashes), BASE2).runs(first, last - first + window) + where) >> np.uint64(32)
    return kmers[at], context, check.astype(np.uint32), first, last, ties[first]


def hot_kmers(texts: DataFrame, window: int, k: int) -> np.ndarray:
    """k-mers that more than HOT_SHARE of a sample of documents hold: at most HOT_KMERS of them."""
    rows = texts.count()
    share = min(1.0, HOT_SAMPLE / max(rows, 1))
    picked = texts.where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 62)) < int(share * (1 << 62)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [np.unique(edges[0]) for value in batch.column(0) if (edges := edges_of(word_hashes((value.as_py() or b"").split(), known), window, k)) is not None]
            if found:
                kmers, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kmers.view(np.int64)), pa.array(counts.astype(np.int64))], ["kmer", "n"])

    counted = picked.select(F.col("__text").cast("binary").alias("text")).mapInArrow(lean(run), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    least = max(8, int(min(rows, HOT_SAMPLE) * HOT_SHARE))
    hot = counted.where(F.col("n") > least).orderBy(F.col("n").desc(), "kmer").limit(HOT_KMERS).select("kmer").toArrow()["kmer"]
    return np.sort(hot.to_numpy().view(np.uint64))


def graph_edges(texts: DataFrame, window: int, k: int, hot: np.ndarray) -> DataFrame:
    """(kmer, context, check, __f, __r, first, last, weight, asked): the sampled edges with their source coordinates.

    Occurrences with one context within a batch of documents are combined before anything is shuffled: one of them
    carries their number as its weight, the others, repeated as they are, have weight 0 and a kmer that spreads them. A hot
    k-mer is mixed with the context, so that its edges are spread too; they count as branching (asked), as do tied ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                found: list[tuple[np.ndarray, ...]] = []
                rows: list[np.ndarray] = []
                for i, value in enumerate(part.column(2)):
                    if (edges := edges_of(word_hashes((value.as_py() or b"").split(), known), window, k)) is not None:
                        found.append(edges)
                        rows.append(np.full(len(edges[0]), i))
                if not found:
                    continue
                kmer, context, check, first, last, asked = (np.concatenate(c) for c in zip(*found, strict=True))
                row = np.concatenate(rows)
                weight = combined(context, check)
                spread = mixed(context + (row.astype(np.uint64) << np.uint64(32)) + first.astype(np.uint64))
                is_hot = np.isin(kmer, hot)
                kmer = np.where(weight > 0, np.where(is_hot, mixed(kmer ^ context), kmer), spread)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kmer.view(np.int64)), pa.array(context.view(np.int64)), pa.array(check.view(np.int32)), part.column(0).take(taken), part.column(1).take(taken), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(weight), pa.array(asked | is_hot)],
                    ["kmer", *PATH, *KEY, "first", "last", "weight", "asked"],
                )

    return texts.select(*KEY, F.col("__text").cast("binary").alias("text")).mapInArrow(lean(run), "kmer long, context long, check int, __f long, __r long, first int, last int, weight long, asked boolean")


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of equal (a, b) one has their number, the others 0."""
    order = np.lexsort((b, a))
    starts = np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))))
    weight = np.zeros(len(a), np.int64)
    weight[order[starts]] = np.diff(np.concatenate((starts, [len(a)])))
    return weight


def branches(edges: DataFrame) -> DataFrame:
    """(KEY, first, last, PATH, repeated, asked): edges whose path occurs twice, and one of each path through a branching k-mer."""
    by_kmer, by_path = Window.partitionBy("kmer"), Window.partitionBy("kmer", *PATH)
    path = F.struct(*PATH)
    told = edges.withColumns({"n": F.sum("weight").over(by_kmer), "low": F.min(path).over(by_kmer), "high": F.max(path).over(by_kmer), "same": F.sum("weight").over(by_path), "at": F.row_number().over(by_path.orderBy(*KEY, "first"))})
    alone = F.col("weight") == 0
    shown = told.where((F.col("n") > 1) | alone | F.col("asked"))
    repeated = alone | (F.col("same") > 1)
    return shown.select(*KEY, "first", "last", *PATH, repeated.alias("repeated"), (~alone & (F.col("at") == 1) & ((F.col("low") != F.col("high")) | F.col("asked"))).alias("asked")).where("repeated or asked")


def heads(steps: DataFrame) -> DataFrame:
    """(node, head, dist): for every path that is reached without branching, where its nonbranching run begins and how far.

    steps has node, next (null at a document's end or where the next edge isn't repeated). a -> b doesn't branch if every
    occurrence of a is followed by b and b occurs no more often. Runs are contracted by joining the table of
    predecessors with itself, which doubles what each row spans: as many rounds as the longest run has binary digits.
    """
    before = list(KEPT)
    nodes = stored(steps.groupBy("node").agg(F.count("*").alias("n"), F.count("next").alias("m"), F.min("next").alias("next"), F.max("next").alias("other")), "nodes")
    links = nodes.where("m = n and next = other").select(F.col("node").alias("head"), F.col("next").alias("node"), "n")
    # So many partitions as the rows need, for each round writes them.
    parts = -(-nodes.count() // RUN_ROWS) or 1
    live = stored(links.join(nodes.select("node", "n").hint("merge"), ["node", "n"]).select("node", "head", F.lit(1).cast("long").alias("dist")).coalesce(parts), "runs")
    while True:
        old = kept_since(before)
        far = live.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("dist").alias("more"))
        jumped = live.join(far.hint("merge"), "head", "left").select("node", F.coalesce("far", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("far").isNotNull().alias("moved"))
        live = stored(jumped.coalesce(parts), "runs", clear=old)
        if live.where("moved").isEmpty():
            return live.select("node", "head", "dist")
        live = live.select("node", "head", "dist")


def compacted(paths: DataFrame) -> DataFrame:
    """(KEY, first, last): the repeated edges of paths, those of one nonbranching run in a row as one span."""
    order = Window.partitionBy(*KEY).orderBy("first")
    node = F.struct(*PATH)
    follows = F.lead("first").over(order) == F.col("last") + 1
    steps = paths.where("repeated").select(*KEY, "first", "last", node.alias("node"), F.when(follows, F.lead(node).over(order)).alias("next"), F.row_number().over(order).alias("place"))
    steps = stored(steps, "steps")
    # A hot path is many rows of steps beside one of heads: sorted and merged, adaptive execution splits it.
    met = steps.join(heads(steps).hint("merge"), "node", "left")
    begun = met.select(*KEY, "first", "last", F.coalesce("head", "node").alias("head"), (F.col("place") - F.coalesce("dist", F.lit(0))).alias("begin"))
    return begun.groupBy(*KEY, "head", "begin").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*KEY, "first", "last")


def verified(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(KEY, first, last): what the source's own words prove to occur twice.

    spans: KEY, first, last, kind. A run (kind 0) is read at its coordinates and compared whole, by a 128-bit digest of its
    words: as all its edges' contexts are equal to another's, 96 bits each, an unequal one can't be, and is an error. The
    windows of branching edges are compared one by one, by 128 bits; of kind 1 they're wanted, of kind 2 (an edge that
    is repeated itself) they only answer. Equal ones within a batch are combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple[np.ndarray, ...]] = []
                rows: list[np.ndarray] = []
                for i, (value, ranges) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    if not ranges.is_valid:
                        continue
                    fields = ranges.values
                    first, last, kind = (fields.field(j).to_numpy().astype(np.int64) for j in range(3))
                    words = (value.as_py() or b"").split()
                    runs = kind == 0
                    digests = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(words[x : y + window]), digest_size=16).digest() for x, y in zip(first[runs].tolist(), last[runs].tolist(), strict=True)), np.uint64).reshape(-1, 2)
                    out.append((digests[:, 0], digests[:, 1], first[runs], last[runs], kind[runs]))
                    first, last, kind = first[~runs], last[~runs], kind[~runs]
                    counts = last - first + 1
                    starts = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(first) else first
                    if len(starts):
                        hashes = word_hashes(words, known)
                        out.append((Rolling(hashes, BASE).runs(starts, window), Rolling(mixed(hashes), BASE2).runs(starts, window), starts, starts, np.repeat(kind, counts)))
                    rows.append(np.full(int(runs.sum()) + len(starts), i))
                if not rows:
                    continue
                a, b, first, last, kind = (np.concatenate(c) for c in zip(*out, strict=True))
                row = np.concatenate(rows)
                weight = combined(a, b)
                a = np.where(weight > 0, a, mixed(a + (row.astype(np.uint64) << np.uint64(32)) + first.astype(np.uint64)))
                use = np.flatnonzero((weight > 0) | (kind < 2))
                taken = pa.array(row[use])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[use].view(np.int64)), pa.array(b[use].view(np.int64)), part.column(0).take(taken), part.column(1).take(taken), pa.array(first[use].astype(np.int32)), pa.array(last[use].astype(np.int32)), pa.array(kind[use].astype(np.int32)), pa.array(weight[use])],
                    ["a", "b", *KEY, "first", "last", "kind", "weight"],
                )

    asked = spans.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "kind")).alias("ranges"))
    met = texts.join(asked, KEY, "left").select(*KEY, F.col("__text").cast("binary").alias("text"), "ranges", "__row")  # __row: the same columns as below, so that one shuffle serves both
    read = met.mapInArrow(lean(run), "a long, b long, __f long, __r long, first int, last int, kind int, weight long")
    n = F.sum("weight").over(Window.partitionBy("a", "b"))
    twice = (F.col("weight") == 0) | (F.col("n") > 1)
    told = read.withColumn("n", n).where(twice & (F.col("kind") < 2) | (F.col("kind") == 0))
    return told.select(*KEY, F.when(twice, F.col("first")).otherwise(F.raise_error(F.lit("a path's words differ from those of its like")).cast("int")).alias("first"), "last")


def remove_repeated(docs: DataFrame, text: str = "text", window: int = WINDOW, k: int = KMER, spacing: bool = False) -> DataFrame:
    """docs with n_words, n_removed, kept_text and kept_sha256: words that a repeated window covers are removed.

    Words are runs of other characters than \\x20 and \\x09-\\x0D, unchanged. A window is `window` consecutive words of one
    document; each word covered by a window whose words also start anywhere else, in the same document too, goes.
    Kept words are joined by one space; with spacing, kept_text (not kept_sha256) keeps the spacing of runs of kept words.

    Method: every window is one path of the De Bruijn graph of the corpus's k-mers. Of a window's k-mers only the one of
    least hash is an edge (equal windows have equal ones), about one word in twelve. An edge occurrence's context is the
    path through it that its windows span. Edges are met by k-mer: where a context occurs twice or more, all its windows
    repeat; where one k-mer has several contexts, the paths branch there. Repeated edges that follow one another without
    branching are compacted to runs by joins. Then the source is read again at the coordinates: every run is held against
    its like word by word, and of each context of a branching k-mer one occurrence's windows are compared one by one. What is
    proven is joined to the documents and united to spans.

    Hot passages: equal contexts, runs and windows are combined within a batch before the shuffle; edges of k-mers that
    many documents hold in differing contexts are spread by context. Counting goes through windows over sorted runs,
    which spill. Rows are told apart by their place, whatever their ids: equal rows each count as a place of their own.
    Null texts have no words; texts under `window` words keep all; empty tables give no rows. Other columns are passed on,
    whatever their names, but for the four that are added.
    """
    names = [c for c in docs.columns if c not in ADDED and c != text]
    done = without_repeated(docs, names, text, window, k, spacing)
    return done.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)], *ADDED)


def cut_repeated(docs: DataFrame, text: str = "text", window: int = WINDOW, k: int = KMER) -> DataFrame:
    """docs with remove_repeated's words cut from its texts; what is left keeps its spacing, all other columns stay as they are."""
    rest = [c for c in docs.columns if c != text]
    done = without_repeated(docs, rest, text, window, k, True, whole=True)
    return done.select(*[F.col("kept_text").alias(c) if c == text else F.col(f"__row.c{rest.index(c)}").alias(c) for c in docs.columns])


def spaced(text: bytes, gone: np.ndarray) -> bytes:
    """text without the words that are gone: kept runs keep their own spacing, and are joined by a line's end if one lay between."""
    found = [m.span() for m in WORD.finditer(text)]
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return b""
    cuts = np.flatnonzero(np.diff(kept) > 1)
    starts, ends = kept[np.concatenate(([0], cuts + 1))].tolist(), kept[np.concatenate((cuts, [len(kept) - 1]))].tolist()
    out = [text[found[starts[0]][0] : found[ends[0]][1]]]
    for last, first, end in zip(ends, starts[1:], ends[1:]):
        broken = b"\n" in text[found[last][1] : found[last + 1][0]] or b"\n" in text[found[first - 1][1] : found[first][0]]
        out += [b"\n" if broken else b" ", text[found[first][0] : found[end][1]]]
    return b"".join(out)


def without_repeated(docs: DataFrame, names: list[str], text: str, window: int, k: int, spacing: bool, whole: bool = False) -> DataFrame:
    """(__row: the columns names as c0, c1 ..., ADDED). whole: a text that loses nothing stays as it is, null too."""
    small_batches(docs.sparkSession)
    (row,) = free_name(docs, "_row")
    told = numbered(docs, row)
    texts = told.select(F.col(f"{row}.f").alias("__f"), F.col(f"{row}.r").alias("__r"), quoted(text).alias("__text"), F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)] or [F.lit(0).alias("c")]).alias("__row"))
    before = list(KEPT)
    paths = stored(branches(graph_edges(texts, window, k, hot_kmers(texts, window, k))), "paths")
    runs = compacted(paths).withColumn("kind", F.lit(0))
    open_ = paths.where("asked").select(*KEY, "first", "last", F.when(F.col("repeated"), 2).otherwise(1).alias("kind"))
    asked = stored(runs.unionByName(open_), "spans", clear=kept_since(before))
    dealt = texts.repartition(*KEY)
    spans = verified(dealt, asked, window).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_text, shas = [], [], [], []
            for value, spans_of in zip(batch.column(0), batch.column(1), strict=True):
                source = value.as_py()
                words = (source or b"").split()
                total, gone = len(words), None
                if spans_of.is_valid:
                    fields = spans_of.values
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, fields.field(0).to_numpy(), 1)
                    np.add.at(edge, fields.field(1).to_numpy() + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                shas.append(hashlib.sha256(kept).hexdigest())
                n_words.append(total)
                n_removed.append(total - len(words))
                if spacing and gone is not None:
                    kept = spaced(source, gone)
                elif whole:
                    kept = source
                kept_text.append(None if kept is None else kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string()), pa.array(shas, pa.string())], ["__row", *ADDED])

    met = dealt.join(spans, KEY, "left").select(F.col("__text").cast("binary").alias("text"), "spans", "__row")
    kind = met.schema["__row"].dataType.simpleString()
    return met.mapInArrow(lean(cut), f"__row {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
