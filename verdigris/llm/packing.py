"""Hierarchical multi-length packing of token ids into context windows."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import NOT_LATIN, lean, small_batches

#: Windows, longest first. A filled window of any tier is a power of two long and needs no padding.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens pooled before a pool is packed; bounds a task's memory beside its longest document.
POOL_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 16

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def byte_bpe(path: str, rank_path: str | None = None):
    """text -> ids as tokenizers' file at path gives them, without added special tokens.

    With rank_path (the same vocabulary as tiktoken ranks), texts that hold only Latin characters take tiktoken, which
    is several times faster and gives the same ids there, the end-of-text string included; others take tokenizers.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if rank_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: slow.encode(text, add_special_tokens=False).ids if NOT_LATIN.search(text) else fast.encode(text, allowed_special=allowed, disallowed_special=())


class Packer:
    """Packs pieces (document, start, ids) of one pool tier by tier; windows is a list of (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.held: list[np.ndarray] = []
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def tier_of(self, n: int) -> int:
        return min(t for t in self.tiers if t >= n)

    def route(self, doc: int, start: int, length: int) -> None:
        """Whole longest windows go out at once; what remains joins the pool of its tier, sorted by length."""
        longest = self.tiers[0]
        while length >= longest:
            self.windows.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        if length:
            insort(self.pools[self.tier_of(length)], (length, doc, start))

    def fill(self, tier: int, gap: int) -> list[tuple[int, int, int]]:
        """Pieces from shorter tiers for a window's gap: best fits first, then the head of a piece that is longer."""
        out: list[tuple[int, int, int]] = []
        while gap:
            fitting, longer = None, None
            for t in self.tiers:
                if t < tier and (pool := self.pools[t]):
                    at = bisect_right(pool, (gap, 1 << 62, 1 << 62))
                    if at and (fitting is None or pool[at - 1][0] > self.pools[fitting[0]][fitting[1]][0]):
                        fitting = (t, at - 1)
                    if at < len(pool):
                        longer = (t, at)
            if fitting:
                length, doc, start = self.pools[fitting[0]].pop(fitting[1])
                out.append((doc, start, length))
                gap -= length
            elif longer:
                length, doc, start = self.pools[longer[0]].pop(longer[1])
                out.append((doc, start, gap))
                self.route(doc, start + gap, length - gap)
                gap = 0
            else:
                break
        return out

    def pack(self, last: bool) -> list[tuple[int, int, int]]:
        """Packs the pools into full windows; returns the few pieces, under the shortest tier, that fill none."""
        least = self.tiers[-1]
        for tier in self.tiers[:-1]:
            while pool := self.pools[tier]:
                length, doc, start = pool.pop()
                filled = self.fill(tier, tier - length)
                if (used := length + sum(p[2] for p in filled)) == tier:
                    self.windows.append((tier, [(doc, start, length), *filled]))
                    continue
                # Shorter tiers are empty: the window becomes one of half its size, and the rest is routed again.
                rest, room, kept = [(doc, start, length), *filled], tier // 2, []
                assert used >= room
                for d, s, n in rest:
                    take = min(n, room)
                    if take:
                        kept.append((d, s, take))
                    if n > take:
                        self.route(d, s + take, n - take)
                    room -= take
                self.windows.append((tier // 2, kept))
        left: list[tuple[int, int, int]] = []
        room = least
        for length, doc, start in self.pools[least]:
            while length:
                take = min(length, room)
                left.append((doc, start, take))
                start, length, room = start + take, length - take, room - take
                if not room:
                    self.windows.append((least, left))
                    left, room = [], least
        self.pools[least] = []
        if last and left:
            self.windows.append((least, left))
            left = []
        return left


def pack_batches(batches: Iterator[pa.RecordBatch], encode, tiers: tuple[int, ...], end_id: int, part: int) -> Iterator[pa.RecordBatch]:
    docs: list[tuple[int | None, np.ndarray]] = []
    tokens, sequence, group, in_group = 0, part << 33, part << 33, 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal docs, tokens, sequence, group, in_group
        packer = Packer(tiers)
        for i, (_, ids) in enumerate(docs):
            packer.route(i, 0, len(ids))
        left = packer.pack(last)
        # Step groups take windows from the tiers in turn, so that each holds a like mix of lengths.
        by_tier = {t: [w for w in packer.windows if w[0] == t] for t in tiers}
        order = sorted((((k + 0.5) / len(ws), t, k) for t, ws in by_tier.items() for k in range(len(ws))), key=lambda x: (x[0], -x[1]))
        out: list[tuple] = []
        for _, t, k in order:
            offset = 0
            for doc, start, length in by_tier[t][k][1]:
                doc_id, ids = docs[doc]
                out.append((doc_id, start + base[doc], length, zlib.crc32(ids[start : start + length].tobytes()), total[doc], sequence, offset, t, group))
                offset += length
            sequence += 1
            in_group += t
            if in_group >= STEP_TOKENS:
                group, in_group = group + 1, 0
        kept, kept_base, kept_total = [], [], []
        for doc, start, length in left:
            kept.append((docs[doc][0], docs[doc][1][start : start + length]))
            kept_base.append(start + base[doc])
            kept_total.append(total[doc])
        docs, tokens = kept, sum(len(x[1]) for x in kept)
        base[:], total[:] = kept_base, kept_total
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
        kinds = [pa.int32() if n == "tier" else pa.int64() for n in names]
        for at in range(0, len(out), 50_000):
            columns = list(zip(*out[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    base: list[int] = []
    total: list[int] = []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
            docs.append((doc_id, ids))
            base.append(0)
            total.append(len(ids))
            tokens += len(ids)
            if tokens >= POOL_TOKENS:
                yield from flush(False)
    yield from flush(True)


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document's ids (PIECE_SCHEMA): where it starts in the document, and its place in a sequence.

    A document's ids are the vocabulary's and then end_id. Whole longest windows are cut off; what remains is routed
    to the smallest tier that holds it. Tiers are packed from the longest down: a window's gap takes pieces of
    shorter tiers, the best fits first, then the head of a longer one. Every window is full, a power of two, except
    at most one short one per task, which is padded. Windows are dealt to step groups of equal tokens with a like mix
    of tiers. Vocabularies are names of public tokenizers or paths that all executors can read.

    No shuffle: each task packs its own rows in pools of about a million tokens, so memory is bounded by the pool and
    the longest document, and a retried task makes the same rows. Null text is empty (one id, end_id); null and
    repeated ids are kept, each row is packed; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        place = lambda name: name if name is None or "/" in name else public_tokenizers.path(name)
        yield from pack_batches(batches, byte_bpe(place(vocabulary), place(ranks)), tiers, end_id, TaskContext.get().partitionId())

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), PIECE_SCHEMA)
