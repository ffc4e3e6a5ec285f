"""Benchmark passages inside documents: size-partitioned bottom-k MinHash search, exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import broadcast_if_small, free_name, numbered, quoted, stored, without_rows

WORDS = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased; punctuation and spacing don't count."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hash_of(words: Column, at: Column, n: int) -> Column:
    """64 bits of the n words from at on, one after another, each seeded by the last: no shingle's string is built."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(n)])


def shingle_hashes(words: Column, lengths: list[int]) -> Column:
    """Distinct hashes of the shingles of each of the lengths; a text with fewer words has none of that length."""

    def of(w: Column) -> Column:
        def of_length(n: int) -> Column:
            return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: hash_of(w, i, n))).otherwise(F.array().cast("array<bigint>"))

        parts = [of_length(n) for n in lengths]
        return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])

    # Bound to a lambda's variable, the words are split once and not for every shingle.
    return F.element_at(F.transform(F.array(words), of), 1)


def shingles(words: Column, n: Column) -> Column:
    """The distinct shingles of n words themselves, joined by spaces, which no word holds."""

    def of(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words), of), 1)


def sketches(items: DataFrame, item_id: str, text: str, words: int, threshold: float) -> DataFrame:
    """(item_id, _n, n_shingles, _shingles, _sketch): an item's shingle length, its shingles, and the hashes that are searched for."""
    opened = items.select(quoted(item_id).alias("item_id"), words_of(quoted(text)).alias("_w")).where(F.size("_w") > 0)
    grouped = opened.groupBy("item_id").agg(F.collect_list("_w").alias("_ws"), F.min(F.least(F.size("_w"), F.lit(words))).alias("_n"))
    n = F.col("_n")

    def both(w: Column) -> Column:
        one = lambda i: F.struct(F.coalesce(*[F.when(n == k, hash_of(w, i, k)) for k in range(1, words + 1)]).alias("h"), F.array_join(F.slice(w, i + 1, n), " ").alias("s"))
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), one)

    found = grouped.select("item_id", "_n", F.array_sort(F.array_distinct(F.flatten(F.transform("_ws", both)))).alias("_s"))
    size = F.size("_s")
    top = F.lit(2).cast("double") ** F.ceil(F.log2(size.cast("double")))
    least = F.floor((1 - threshold) * top + 1e-9).cast("int") + 1
    return found.select("item_id", "_n", size.cast("long").alias("n_shingles"), F.transform("_s", lambda x: x["s"]).alias("_shingles"), F.transform(F.slice("_s", F.lit(1), least), lambda x: x["h"]).alias("_sketch"))


def candidates(docs: DataFrame, listed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, item_id): documents that hold a hash of an item's sketch. Only sketches meet the documents."""
    known = listed.agg(F.collect_set("_n").alias("lengths"), F.sum(F.size("_sketch")).alias("rows")).first()
    index = listed.select("item_id", F.explode("_sketch").alias("_h"))
    probes = docs.select(quoted(doc_id).alias("doc_id"), F.explode(shingle_hashes(words_of(quoted(text)), sorted(known["lengths"]) or [WORDS])).alias("_h"))
    return probes.join(broadcast_if_small(index, known["rows"] or 0, 64), "_h").select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): items of whose distinct shingles a document holds threshold or more.

    An item's shingles have `words` words, or all of its own if it has fewer; documents are shingled by the same length,
    so an item of one to four words is found inside a longer document too.

    Search: items are partitioned by size (powers of two of their shingle count). Within a partition of at most u
    shingles an item's sketch is its floor((1 - threshold) * u) + 1 least shingle hashes, a bottom-k MinHash sketch.
    An item of q <= u shingles may miss at most floor((1 - threshold) * q) of them, so a document that contains it
    holds at least one hash of the sketch: no pair is lost. Documents of any length are probed whole, against the
    sketches alone. Verification: each candidate pair's shingles themselves (words, not hashes) are intersected.

    Sizes: candidates are distinct pairs, written first, so that Spark broadcasts them where they're few and the
    documents aren't shuffled. Sketches are sent to all executors only if they're few (counted first); else both sides
    are shuffled by hash. Shared shingles are counted with map-side combine, so no document and no passage that many
    documents hold is gathered in a task.

    Null ids are compared like values (rows of a null id count as one document); null and empty texts hold nothing
    and no empty item is found; repeated rows with the same id count as one, whose shingles are united (of the shortest
    one's length). Very long texts are taken whole. Empty tables give an empty result; columns beside these aren't read.
    """
    listed = stored(sketches(items, item_id, text, words, threshold), "items")
    pairs = stored(candidates(docs, listed, doc_id, text).toDF("_d", "_i"), "candidates")
    told = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("_t"))
    met = told.join(pairs, told["doc_id"].eqNullSafe(pairs["_d"])).join(listed, pairs["_i"].eqNullSafe(listed["item_id"]))
    held = met.select("doc_id", "item_id", "n_shingles", F.explode(F.array_intersect("_shingles", shingles(words_of(F.col("_t")), F.col("_n")))).alias("_s"))
    shared = held.groupBy("doc_id", "item_id", "n_shingles").agg(F.countDistinct("_s").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)).withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The documents that contain no item. Each row is judged by itself, whatever its id."""
    (row,) = free_name(docs, "_row")
    told = numbered(docs, row)
    return without_rows(told, contained_items(told, items, doc_id=row, text=text, **options).select("doc_id"), row)
