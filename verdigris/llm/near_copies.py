"""Near copies by Jaccard similarity of five-word shingles: SimHash's cover links the nearest, banded MinHash finds what is left, exact sets confirm all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import simhash
from verdigris.llm.common import KEPT, broadcast_if_small, free_name, kept_since, lean, numbered, quoted, small_batches, stored, without_rows
from verdigris.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: Two sets of similarity s share no band with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, 4e-13 at 0.9.
BANDS, ROWS = 32, 5
#: Sets and bytes of shingles of one bucket that meet in one task; larger buckets are cut into squares.
SIDE, SIDE_BYTES = 4096, 32 << 20
#: Sets of one group of fingerprints that meet in one task, with the group's least set.
SLICE = 256
_rng = np.random.default_rng(20260831)
FACTORS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
MIX = _rng.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
NUMBERS = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles, with op9's words; fewer words are one shingle, none for no words."""
    import xxhash

    found = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band: ROWS minima of the hashes under as many random maps, and the band's number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, at : at + 2048] * FACTORS + OFFSETS).min(axis=1))
    return (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) ^ NUMBERS


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text_hash, text) -> (doc_id, text_hash, set, n, fp, keys): the set's hash, size, SimHash fingerprint and bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(x.as_py() or b"", words) for x in batch.column(2)]
            ids = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64))
            fps = pa.array(np.array([simhash.majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64))
            keys = [bands(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.array([len(s) for s in sets], pa.int32()), fps, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "set", "n", "fp", "keys"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, set long, n int, fp long, keys array<long>")


def with_shingles(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """texts (set, text) -> (set, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py() or b"", words).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["set", "shingles"])

    return texts.mapInArrow(lean(run), "set long, shingles array<long>")


def links_of(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with exact Jaccard of similarity or more.

    A set is held against all others at once. Any link between two components has an end outside the largest one, so
    its members need no turn: a group of near copies takes a few turns, not one per pair.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    root, done, out = np.arange(len(sets)), np.zeros(len(sets), bool), []
    flag = np.zeros(len(values), np.int64)
    while True:
        names, counts = np.unique(root, return_counts=True)
        waiting = np.flatnonzero(~done & (root != names[counts.argmax()]))
        if not len(waiting):
            return out
        i = int(waiting[0])
        done[i] = True
        own = ids[starts[i] : starts[i] + sizes[i]]
        flag[own] = 1
        shared = np.add.reduceat(flag[ids], starts)
        flag[own] = 0
        near = shared >= similarity * (sizes[i] + sizes - shared) - 1e-9
        for j in np.flatnonzero(near & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]


def compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Batches (key, part, set, shingles) sorted by (key, part) -> edges (a, b) between sets."""

    def edges(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = list(rows)
        found = links_of(list(rows.values()), similarity) if len(rows) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    at, rows = None, {}
    for batch in batches:
        for key, part, name, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if (key, part) != at:
                yield from edges(rows)
                at, rows = (key, part), {}
            rows[name] = values.values.to_numpy().copy()
    yield from edges(rows)


def fingerprint_groups(sets: DataFrame, side: int = SLICE, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """sets (set, n, fp), each set once -> (key, part, set): sets that SimHash's links (op9's cover, up to 3 bits) join.

    A group is dealt in slices that all hold its least set, so its rows stay in proportion to its sets; pairs of
    different slices that aren't linked through that set are left to the buckets.
    """
    near = simhash.linked(sets.select("fp").distinct()).withColumnRenamed("node", "fp")
    rooted = stored(sets.join(broadcast_if_small(near, near.count(), 32), "fp", "left").select("set", "n", F.coalesce("root", "fp").alias("key")), "fingerprints")
    several = rooted.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.min("set").alias("least")).where("m > 1")
    cuts = F.greatest(F.ceil(F.col("m") / side), F.ceil(F.col("n") * 8 / side_bytes)).cast("int")
    hot = stored(several.select("key", "least", cuts.alias("cuts")), "groups")
    own = rooted.join(broadcast_if_small(hot, hot.count(), 64), "key").select("key", F.pmod(F.xxhash64("set", F.lit(1)), F.col("cuts")).cast("int").alias("part"), "set")
    return own.unionByName(hot.select("key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.col("least").alias("set")))


def buckets(sets: DataFrame, side: int = SIDE, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """sets (set, n, keys, root), each set once -> (key, part, set): sets that share a band's key, and so may be near.

    Buckets whose sets all have one root are linked already and fall away. Of buckets with the same members one stays (two near copies meet in most bands). Keys are counted with map-side
    combine; a bucket above side is cut into squares, each a pair of slices of its sets, so that all its pairs meet.
    """
    rows = stored(sets.select("set", "n", "root", F.explode("keys").alias("key")), "bands")
    several = rows.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("set").alias("x"), F.bit_xor(F.xxhash64("set")).alias("y"), F.sum("n").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("m > 1 and r <> s")
    once = several.groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    cuts = F.greatest(F.ceil(F.col("m") / side), F.ceil(F.col("n") * 8 / side_bytes)).cast("int")
    hot = stored(once.select("key", cuts.alias("cuts")), "buckets")
    met = rows.select("key", "set").join(broadcast_if_small(hot, hot.count(), 64), "key")
    own = F.pmod(F.xxhash64("set", F.lit(1)), F.col("cuts")).cast("int")
    # Slices i <= j meet in part i * cuts + j.
    parts = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j))
    return met.select("key", F.explode(parts).alias("part"), "set")


def confirmed(members: DataFrame, sets: DataFrame, raw: DataFrame, words: int, similarity: float) -> DataFrame:
    """members (key, part, set) -> (a, b): links of exact Jaccard of similarity or more that connect what meets in a part."""
    wanted = stored(members.select("set").distinct().join(sets.select("set", "text_hash"), "set"), "wanted")
    # Only texts that have a candidate are shingled again; copies of one text are dealt once.
    texts = raw.select("text_hash", "text").join(broadcast_if_small(wanted, wanted.count(), 64), "text_hash").groupBy("set").agg(F.first("text").alias("text"))
    dealt = members.join(with_shingles(texts, words), "set").select("key", "part", "set", "shingles").repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(lean(lambda batches: compare(batches, similarity)), "a long, b long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, side: int = SIDE, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """(doc_id, component_id) per row: the smallest doc_id that links of similarity or more reach.

    Similarity is the exact Jaccard of the distinct shingles' hashes. Texts of the same set, those without words
    among them, are one. SimHash fingerprints within 3 bits are linked first, through op9's anchors; then BANDS bands of
    MinHash find the candidates that these links don't join yet. Every candidate of either is verified: nothing below
    similarity is linked, and a pair at 0.8 is missed with probability 3e-6. Ids are of any type that has an
    order; null ids count last. Very long texts are taken whole; empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    raw = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).cast("binary").alias("text"))
    known = stored(signatures(raw, words), "signatures")
    sets = stored(known.dropDuplicates(["set"]).select("set", "n", "fp", "keys", "text_hash"), "sets")
    before = list(KEPT)
    members = stored(fingerprint_groups(sets.where("n > 0").select("set", "n", "fp"), side_bytes=side_bytes), "members", clear=kept_since(before))
    near = stored(confirmed(members, sets, raw, words, similarity), "near", clear=kept_since(before))
    linked = connected_components(near).withColumnRenamed("node", "set")
    before += kept_since(before)
    rooted = sets.join(broadcast_if_small(linked, linked.count(), 32), "set", "left").select("set", "n", "keys", F.coalesce("root", "set").alias("root"))
    members = stored(buckets(rooted, side, side_bytes), "members", clear=kept_since(before))
    linked = connected_components(confirmed(members, sets, raw, words, similarity).unionByName(near))
    least = known.groupBy("set").agg(F.min("doc_id").alias("least"))
    rooted = stored(least.join(linked.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root")), "rooted")
    named = rooted.select("set", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    return known.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group stays: that of the smallest id (null ids last; of rows that repeat it, the first in its file)."""
    row, rank = free_name(docs, "_row", "_rank")
    told = numbered(docs, row)
    ranked = told.withColumn(rank, F.struct(quoted(doc_id).isNull().alias("none"), quoted(doc_id).alias("id"), F.col(row).alias("row")))
    found = groups(ranked, rank, text).where(F.col("doc_id") != F.col("component_id"))
    return without_rows(told, found.select("doc_id.row"), row)
