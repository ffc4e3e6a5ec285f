"""Token counts from distinct pre-tokens: pieces counted once each, joined to per-document frequencies, summed."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import LATIN_END, NOT_LATIN, char_class, lean, quoted, small_batches

#: Frequent pre-tokens whose piece counts are sent to all tasks: at most so many, each at most so many characters.
HEAD_SIZE = 1 << 18
HEAD_CHARS = 48
#: Documents from which the frequent pre-tokens are taken. They only save shuffling; the others are joined.
HEAD_SAMPLE = 20_000
#: Documents and bytes of text whose pre-tokens are tallied together in a task, and pre-tokens (of at most so many
#: characters) that a task remembers.
TALLY_ROWS, TALLY_BYTES = 1000, 8 << 20
KEPT, KEPT_CHARS = 1 << 17, 1 << 10
#: A private character, which the fast path never sees.
MARK = "\ue000"
#: The rules of word_bpe, which the fast path spells out (fixed values).
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable Latin-1 itself, others from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordPieces:
    """A BPE vocabulary's pre-tokens, and pieces of each, by the rules of its file.

    Rules like word_bpe's (NFC, white space folding, lower case, a split pattern) have a fast path of our own for Latin
    texts; all others take the library's normaliser and pre-tokeniser. Files whose tokens aren't sums over pre-tokens
    are refused.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        if not path.endswith(".json"):
            raise ValueError(f"{path}: only tokenizers' files split texts into pre-tokens")
        with open(path, encoding="utf-8") as src:
            rules = json.load(src)
        model, added = rules["model"], rules["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or not rules.get("pre_tokenizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: its tokens can't be counted by pre-token")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.special = re.compile("|".join(map(re.escape, sorted((t["content"] for t in added), key=len, reverse=True))) or r"(?!)")
        self.lead = os.path.commonprefix([t["content"] for t in added])
        splits = [p.get("pattern", {}).get("Regex") for p in rules["pre_tokenizer"].get("pretokenizers", [])]
        self.fast = (rules["normalizer"] or {}).get("normalizers") == WORD_NORMALIZER and splits == [WORD_SPLIT, None]
        space = "".join(c for c in map(chr, range(LATIN_END)) if c in "\t\n\x0b\x0c\r \x85\xa0")
        letter, number = char_class("L"), char_class("N")
        # The vocabulary's own split pattern, with its classes spelled out below LATIN_END and ̇, which lower-casing makes.
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{re.escape(space)}{letter}{number}]+")

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """(pre-tokens with their counts, special tokens in the text). Pre-tokens of the library's path begin with MARK."""
        if self.lead not in text or not self.special.search(text):
            return self.plain(text), 0
        parts = self.special.split(text)
        counts: Counter = Counter()
        for part in parts:
            counts.update(self.plain(part))
        return counts, len(parts) - 1

    def plain(self, text: str) -> Counter:
        if self.fast and not NOT_LATIN.search(text):
            return Counter(self.split.findall(text.lower()))
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        # Byte-level letters already; marked, so that they're not mapped again.
        return Counter(MARK + piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def pieces(self, pre_token: str) -> int:
        if pre_token[:1] == MARK:
            mapped = pre_token[1:]
        else:
            mapped = "".join(map(self.letters.__getitem__, pre_token.encode()))
        return len(self.model.tokenize(mapped))


def opened(vocabulary: str) -> WordPieces:
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordPieces(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def frequent_pieces(docs: DataFrame, vocabulary: str, text: str) -> dict[str, int]:
    """pre-token -> pieces for the commonest short pre-tokens of a sample; HEAD_SIZE * HEAD_CHARS bounds it."""
    rows = docs.count()
    share = min(1.0, HEAD_SAMPLE / max(rows, 1))
    picked = docs.where(F.pmod(F.xxhash64(quoted(text)), F.lit(1 << 62)) < int(share * (1 << 62))).select(quoted(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(vocabulary)
        for batch in batches:
            counts: Counter = Counter()
            for value in batch.column(0):
                counts.update(words.pre_tokens(value.as_py() or "")[0])
            kept = [(t, n) for t, n in counts.items() if len(t) <= HEAD_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["tok", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.pieces(t) for t in batch.column(0).to_pylist()], pa.int32())], ["tok", "pieces"])

    top = picked.mapInArrow(count, "tok string, n long").groupBy("tok").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "tok").limit(HEAD_SIZE)
    table = top.select("tok").mapInArrow(measure, "tok string, pieces int").toArrow()
    return dict(zip(table["tok"].to_pylist(), table["pieces"].to_pylist(), strict=True))


class Tallies:
    """Pieces of pre-tokens that a task may count itself: those of the head, and those that several of its documents hold.

    Documents are tallied TALLY_ROWS at a time; of a tally only pre-tokens that one of its documents alone holds are
    left to the shuffle. So however many documents hold a pre-token, and however long it is, it crosses the shuffle at
    most once per tally: no key is hot.
    """

    def __init__(self, words: WordPieces, known: dict[str, int]) -> None:
        self.words, self.known, self.own = words, known, {}

    def pieces(self, tok: str, held: int) -> int | None:
        if (n := self.known.get(tok)) is None and (n := self.own.get(tok)) is None and held > 1:
            n = self.words.pieces(tok)
            if len(self.own) < KEPT and len(tok) <= KEPT_CHARS:
                self.own[tok] = n
        return n

    def count(self, texts: list[str]) -> list[tuple[int, list[tuple[str, int]]]]:
        """Per text: tokens counted here, and (pre-token, frequency) of those left over."""
        found = [self.words.pre_tokens(t) for t in texts]
        held = Counter(tok for counts, _ in found for tok in counts if tok not in self.known and tok not in self.own)
        out = []
        for counts, total in found:
            rest = []
            for tok, n in counts.items():
                if (pieces := self.pieces(tok, held[tok])) is None:
                    rest.append((tok, n))
                else:
                    total += pieces * n
            out.append((total, rest))
        return out


def tallies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(rows, ids, texts) of at most TALLY_ROWS documents and about TALLY_BYTES characters."""
    rows, ids, texts, size = [], [], [], 0
    for batch in batches:
        for number, doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            rows.append(number)
            ids.append(doc)
            texts.append(value.as_py())
            size += len(texts[-1])
            if len(rows) >= TALLY_ROWS or size >= TALLY_BYTES:
                yield rows, ids, texts
                rows, ids, texts, size = [], [], [], 0
    if rows:
        yield rows, ids, texts


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, doc_id: str = "doc_id", text: str = "text", head: Callable = frequent_pieces) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row: UTF-8 bytes, tokens as the vocabulary gives them, n_tokens > limit.

    A document becomes frequencies of its pre-tokens; no token ids are made. Pre-tokens of the bounded head table, and
    those that several documents of a tally hold, meet their piece counts in the task; all others are shuffled by
    pre-token, sorted, counted once per distinct pre-token and joined by merging. Partial sums per document are then
    added up. A pre-token crosses the shuffle at most once per tally of documents, so no key is hot.

    Null text is empty: no bytes, no tokens. Null and repeated ids stay one result per row, as rows are told apart by an
    internal number. Very long texts are counted whole; empty tables give no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(head(docs, vocabulary, text))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    names = ["row", "tok", "n", "doc_id", "n_bytes"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tallies(opened(vocabulary), shared.value)
        for numbers, ids, texts in tallies_of(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for number, doc, value, (total, rest) in zip(numbers, ids, texts, tallies.count(texts), strict=True):
                for column, head_value in zip(out, (number, None, total, doc, len(value.encode())), strict=True):
                    column.append(head_value)
                if rest:
                    out[0].extend([number] * len(rest))
                    out[1].extend(t for t, _ in rest)
                    out[2].extend(n for _, n in rest)
                    out[3].extend([None] * len(rest))
                    out[4].extend([None] * len(rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(vocabulary)
        last: tuple[str, int] = ("", 0)
        for batch in batches:
            toks = batch.column(1)
            whole = toks.is_null().to_numpy(zero_copy_only=False)
            if whole.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(whole)) for c in (batch.column(0), batch.column(2), batch.column(3), batch.column(4))], ["row", "n", "doc_id", "n_bytes"])
            if whole.all():
                continue
            rest = batch.filter(pa.array(~whole))
            coded = rest.column(1).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            # Sorted rows: only the first pre-token of a batch may have been counted before.
            pieces = np.array([last[1] if i == 0 and t == last[0] else words.pieces(t) for i, t in enumerate(distinct)], np.int64)
            last = (distinct[-1], int(pieces[-1]))
            sums = pieces[coded.indices.to_numpy()] * rest.column(2).to_numpy()
            numbers, place = np.unique(rest.column(0).to_numpy(), return_inverse=True)
            total = np.zeros(len(numbers), np.int64)
            np.add.at(total, place, sums)
            none = pa.nulls(len(numbers), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(total), none, none], ["row", "n", "doc_id", "n_bytes"])

    spread = rows.mapInArrow(lean(split), "row long, tok string, n long, doc_id long, n_bytes long").repartition(F.coalesce(F.col("tok"), F.col("row").cast("string"))).sortWithinPartitions("tok")
    parts = spread.mapInArrow(lean(merge), "row long, n long, doc_id long, n_bytes long")
    added = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return added.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
