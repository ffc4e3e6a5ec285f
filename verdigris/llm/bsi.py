"""Exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import lean, open_fs, quoted, stored

SCALE = 256
#: Components of an index block (rows times dimensions): a task holds one block. Rows below which a block isn't split for more tasks.
BLOCK_CELLS = 1 << 23
LEAST_ROWS = 1 << 12
#: Queries that a task reads at a time.
QUERY_CHUNK = 256

ONE = np.uint64(1)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Booleans over rows -> 64-bit words, row 0 in the lowest bit."""
    padded = np.zeros(-(-len(bits) // 64) * 64, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def unpack_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def slices_of(matrix: np.ndarray) -> tuple[int, np.ndarray]:
    """Integers (rows x dims) -> (bits m, planes dims x m x words) of matrix + 2**(m-1), which is not negative."""
    top = max((max(int(c.max()), -int(c.min())) for c in matrix.T), default=1) if len(matrix) else 1
    m = max(2, top.bit_length() + 1)
    planes = np.empty((matrix.shape[1], m, -(-len(matrix) // 64)), np.uint64)
    for d in range(matrix.shape[1]):  # one dimension at a time: no copy of the whole block
        shifted = (matrix[:, d] + (1 << (m - 1))).astype(np.uint64)
        for b in range(m):
            planes[d, b] = pack_bits((shifted >> np.uint64(b)) & ONE)
    return m, planes


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(bit, +1 or -1) of the non-adjacent form: fewer digits than the binary one."""
    sign, q, out, bit = (1 if q > 0 else -1), abs(q), [], 0
    while q:
        if q & 1:
            digit = 2 - (q & 3)
            out.append((bit, digit * sign))
            q -= digit
        q >>= 1
        bit += 1
    return out


def scores_sliced(planes: np.ndarray, inverse: np.ndarray, query: np.ndarray, m: int) -> tuple[list[np.ndarray], int]:
    """(planes of sum + offset from the least significant up, offset): the inner product of query with every row.

    Each digit of each query component adds that dimension's slices, shifted, or for a negative digit their complement
    (2**m - 1 - value). At each weight three planes become a sum and a carry until two are left, then one.
    """
    columns: dict[int, list[np.ndarray]] = {}
    offset = 0
    for d, q in enumerate(query.tolist()):
        for bit, sign in signed_digits(q):
            source = planes[d] if sign > 0 else inverse[d]
            offset += (1 << bit) * ((1 << (m - 1)) if sign > 0 else (1 << m) - 1 - (1 << (m - 1)))
            for b in range(m):
                columns.setdefault(bit + b, []).append(source[b])
    words = planes.shape[2]
    out: list[np.ndarray] = []
    at, top = 0, max(columns, default=-1)
    half, both = np.empty(words, np.uint64), np.empty(words, np.uint64)
    while at <= top:
        stack = columns.pop(at, [])
        above = columns.setdefault(at + 1, []) if len(stack) > 1 else None
        while len(stack) > 1:
            a, b = stack.pop(), stack.pop()
            if stack:
                c = stack.pop()
                np.bitwise_xor(a, b, out=half)
                np.bitwise_and(a, b, out=both)
                carry = np.bitwise_and(half, c)
                np.bitwise_or(carry, both, out=carry)
                stack.insert(0, np.bitwise_xor(half, c))
            else:
                carry = np.bitwise_and(a, b)
                stack.append(np.bitwise_xor(a, b))
            above.append(carry)
        top = max(top, max(columns, default=-1))
        out.append(stack[0] if stack else np.zeros(words, np.uint64))
        at += 1
    return out, offset


def top_rows(score: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best candidate rows, the most significant slice first; boundary ties to the lowest positions."""
    sure, open_ = np.zeros_like(candidates), candidates.copy()
    need = k
    for plane in reversed(score):
        hit = open_ & plane
        n = int(np.bitwise_count(hit).sum())
        if n > need:
            open_ = hit
        else:
            sure |= hit
            need -= n
            open_ &= ~plane
            if not need:
                return unpack_bits(sure)
    return np.concatenate([unpack_bits(sure), unpack_bits(open_)[:need]])


def matrix_of(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers -> rows x dims, shorter lists padded with zeros."""
    lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    matrix = np.zeros((len(lists), dims), np.int64)
    matrix[np.arange(dims)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return matrix


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = quoted(embedding).cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(quoted(vec_id).cast("long").alias("vec_id"), x.alias("x"), sound.alias("sound")).where("sound and vec_id is not null").select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def top_inner_products(embeddings: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, its k best other rows.

    Components x become floor(256 * x); score is the integer inner product; ties go to the smaller vec_id. Rows of the
    query's own id are no candidates. Null ids, null vectors and vectors with a null or non-finite component take no
    part; shorter vectors count as padded with zeros; a repeated query row is asked once; other repeated rows are
    candidates each. An empty table gives an empty result. Scores must fit 62 bits.

    Index: rows are dealt by hash to blocks, sorted by id in the block, and each dimension is stored as bit planes over
    the block's rows. A block's rows times dimensions are bounded, so a task's memory is. Queries are written too; each
    task keeps its block where it is and reads the queries a chunk at a time from the shared folder, so neither index nor
    queries are shuffled for the search. A task returns its block's k best for each query; those are ranked per query.
    All rows are indexed and all queries meet all blocks.
    """
    spark = embeddings.sparkSession
    valid = stored(valid_vectors(embeddings, vec_id, embedding), "vectors")
    stats = valid.agg(F.count("*"), F.max(F.size("x"))).first()
    dims = stats[1] or 1
    block_rows = max(64, BLOCK_CELLS // dims)
    blocks = max(-(-stats[0] // block_rows), min(spark.sparkContext.defaultParallelism, -(-stats[0] // LEAST_ROWS)), 1)

    def build(key, table):  # noqa: ANN001, ANN202  Spark reads annotations as a choice of API
        table = table.sort_by("vec_id")
        m, planes = slices_of(matrix_of(table["x"], dims))
        return pa.table({"bits": pa.array([m], pa.int32()), "ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "planes": pa.array([planes.tobytes()], pa.binary())})

    # So many partitions that a task has one block or few.
    dealt = valid.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).repartition(blocks, "block")
    index = stored(dealt.groupBy("block").applyInArrow(build, "bits int, ids binary, planes binary"), "index")
    asked = stored(valid.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")), "queries").inputFiles()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[at].as_buffer(), "<i8")
                m = batch.column(0)[at].as_py()
                planes = np.frombuffer(batch.column(2)[at].as_buffer(), np.uint64).reshape(dims, m, -1)
                inverse = ~planes
                everyone = pack_bits(np.ones(len(ids), bool))
                for names, vectors in query_chunks(asked, dims):
                    out: list[tuple[int, int, int]] = []
                    for query_id, vector in zip(names.tolist(), vectors, strict=True):
                        score, offset = scores_sliced(planes, inverse, vector, m)
                        lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
                        candidates = everyone
                        if hi > lo:
                            own = np.zeros(len(ids), bool)
                            own[lo:hi] = True
                            candidates = everyone & ~pack_bits(own)
                        for row in top_rows(score, candidates, k).tolist():
                            value = sum(int(plane[row >> 6] >> np.uint64(row & 63) & ONE) << b for b, plane in enumerate(score))
                            out.append((query_id, int(ids[row]), value - offset))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = index.repartition(blocks).mapInArrow(lean(search), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_chunks(files: list[str], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the written queries, QUERY_CHUNK at a time."""
    import pyarrow.parquet as pq

    for name in files:
        fs, path = open_fs(name)
        with fs.open_input_file(path) as src:
            for part in pq.ParquetFile(src).iter_batches(QUERY_CHUNK, columns=["vec_id", "x"]):
                if part.num_rows:
                    yield part.column(0).to_numpy(), matrix_of(pa.chunked_array([part.column(1)]), dims)
