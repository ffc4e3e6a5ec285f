"""SimHash near-duplicates by anchor-point covering: a Hamming code per half of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import broadcast_if_small, lean, quoted, small_batches, stored
from verdigris.llm.components import connected_components

WORDS = 3
RADIUS = 3
#: Bits of the code's blocks. [31, 26] Hamming codes are perfect: every block is within 1 of exactly one codeword.
BLOCK = 31
#: Where the two blocks begin; bits 31 and 63 are in no block.
BLOCK_STARTS = (0, 32)
#: Members of an anchor that are compared as one square; larger anchors are cut into squares of this side.
SIDE = 4096


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits of a UTF-8 text: bit i is set if over half of the shingles' XXH64 (seed 42) have it."""
    import xxhash

    found = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    hashed, seed = xxhash.xxh64_intdigest, 42
    return majority(np.array([hashed(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit i is set if over half of the hashes have it; zero for none."""
    hashes = hashes.astype("<u8", copy=False)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    above = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(above, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number. Null text has no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py() or b"", words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def syndrome(block: Column) -> Column:
    """0 for a codeword, else the number (from 1) of the bit whose flip gives the only codeword within 1."""
    masks = [sum(1 << (i - 1) for i in range(1, BLOCK + 1) if i >> b & 1) for b in range(5)]
    total = F.lit(0)
    for b, mask in enumerate(masks):
        total = total + F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(mask).cast("long"))) % 2, b)
    return total


def flips(s: int) -> list[int]:
    """Masks that lead from a block of syndrome s to every codeword within 2, the home codeword first.

    Bits i < j lead to a codeword if i xor j = s, for their columns of the parity check are the numbers i and j.
    """
    home = 1 << (s - 1) if s else 0
    return [home] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BLOCK + 1) if s and i != s and i < i ^ s]


def anchored(fps: DataFrame) -> DataFrame:
    """fps (fp) -> (anchor, fp, home): every fingerprint at every anchor within covering radius plus threshold.

    Fingerprints within 3 differ by at most 1 in one of the two halves. Per half the codewords are anchors with
    covering radius 1, so it suffices to take each fingerprint's home (nearest) anchor, to copy it to all anchors
    within 1 + 1 = 2 (16, or 1 for a codeword), and to compare homes with copies at the same anchor.
    """
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in flips(s)]) for s in range(32)])
    out = []
    for half, start in enumerate(BLOCK_STARTS):
        block = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << BLOCK) - 1).cast("long"))
        opened = fps.select("fp", block.alias("b")).select("fp", "b", F.posexplode(F.element_at(table, syndrome(F.col("b")) + 1)).alias("at", "m"))
        out.append(opened.select((F.col("b").bitwiseXOR(F.col("m")) + F.lit(half << BLOCK)).alias("anchor"), "fp", (F.col("at") == 0).alias("home")))
    return out[0].unionByName(out[1])


def squares(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """rows with a part number: an anchor of more than side rows is cut into squares, each a pair of slices of its rows.

    Anchors are counted with map-side combine; only those above side are listed, at most rows / side of them.
    """
    hot = rows.groupBy("anchor").count().where(F.col("count") > side).select("anchor", F.ceil(F.col("count") / side).cast("int").alias("cuts"))
    many = hot.count()
    if not many:
        return rows.select("anchor", F.lit(0).alias("part"), "fp", "home")
    met = rows.join(broadcast_if_small(hot, many, 64), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # Row slice for homes, column slice for copies; a home row is its own copy's partner too.
    parts = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).when(F.col("home"), F.array_union(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: own * F.col("cuts") + j), F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: i * F.col("cuts") + own))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: i * F.col("cuts") + own))
    return met.select("anchor", F.explode(parts).alias("part"), "fp", "home")


def links_of(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect what homes and copies of one square link: a spanning forest, not all pairs."""
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)
        a = root(i)
        for j in near[parent[near] != a].tolist():
            b = root(j)
            if a != b:
                parent[b] = a
                left.append(int(i))
                right.append(j)
    return left, right


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (anchor, part) -> edges (a, b). A run of rows that goes on in the next batch is carried over."""
    carried: list[np.ndarray] | None = None

    def edges(anchor: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
        ends = np.concatenate((starts[1:], [len(anchor)]))
        full = (ends - starts > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
        a: list[int] = []
        b: list[int] = []
        for lo, hi in zip(starts[full].tolist(), ends[full].tolist(), strict=True):
            x, y = links_of(fp[lo:hi], home[lo:hi], radius)
            a.extend((fp[lo:hi][x]).tolist())
            b.extend((fp[lo:hi][y]).tolist())
        keep = [(p, q) for p, q in zip(a, b, strict=True) if p != q]
        if not keep:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*keep, strict=True)], ["a", "b"])

    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)]
        if carried is not None:
            now = [np.concatenate(x) for x in zip(carried, now, strict=True)]
        if not len(now[0]):
            continue
        changes = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        carried = [x[cut:] for x in now]
        if cut and (out := edges(*[x[:cut] for x in now])) is not None:
            yield out
    if carried is not None and len(carried[0]) and (out := edges(*carried)) is not None:
        yield out


def linked(fps: DataFrame, radius: int = RADIUS, side: int = SIDE) -> DataFrame:
    """fps (fp), distinct -> (node, root): the components of links of at most radius bits; only fingerprints that have a link."""
    if radius > RADIUS:
        raise ValueError("the two-block code covers links of up to 3 bits")
    rows = squares(anchored(fps), side)
    dealt = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return connected_components(dealt.select("anchor", "part", "fp", "home").mapInArrow(lambda batches: compare(batches, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits, and the smallest doc_id that links of <= radius bits reach.

    Words are runs of other characters than \\x20 and \\x09-\\x0D, with A-Z lower-cased; shingles of three, repeats
    included; fewer words are one shingle; without words (null and empty texts) the fingerprint is zero and is linked
    like others. Repeated rows and ties share fingerprint and component. Null ids count last: a component's id is null
    only if all its ids are. Very long texts are taken whole; empty tables give no rows.

    Copies have one fingerprint, so only distinct fingerprints meet; a square of an anchor returns a spanning forest
    of its links, so a group of n near copies costs no n**2 rows; components are found in Spark. radius may be up to 3.
    """
    if radius > RADIUS:
        raise ValueError("the two-block code covers links of up to 3 bits")
    known = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = distinct.join(linked(distinct.select("fp"), radius).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # A component's least id, on the linked fingerprints and the lone ones alike.
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return known.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
