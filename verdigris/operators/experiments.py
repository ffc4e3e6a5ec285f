"""How far clusters depend on the order and number of answers: seeded permutations and subsets of every record."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import metrics


def shuffled(heads: list[str], n: int) -> np.ndarray:
    """A permutation of 0..n-1 for each head, by the MD5 of head and place: it depends on nothing else."""
    md5 = hashlib.md5
    found = b"".join(md5(f"{head}:{i}".encode()).digest()[:8] for head in heads for i in range(n))
    return np.frombuffer(found, ">u8").reshape(len(heads), n).argsort(axis=1, kind="stable")


def scanned(related: np.ndarray) -> np.ndarray:
    """Anchor scans of replicates at once: related is replicates x answers x answers, the answers in each one's order."""
    p, m, _ = related.shape
    ids, count = np.full((p, m), -1), np.zeros(p, int)
    for i in range(m):
        unassigned = ids[:, i] == -1
        taken = related[:, i, :].copy()
        taken[:, :i] = False
        taken[:, i] = True
        ids = np.where(taken & unassigned[:, None], count[:, None], ids)
        count += unassigned
    return ids


def entropies(labels: np.ndarray) -> np.ndarray:
    """Plug-in entropy of each row of labels 0, 1, ...; counts are summed in rising order, as arrays.entropy does."""
    m = labels.shape[1]
    counts = np.sort(np.stack([(labels == v).sum(axis=1) for v in range(int(labels.max(initial=0)) + 1)], axis=1), axis=1)
    share = counts / m
    return -np.cumsum(share * np.log(np.where(counts > 0, share, 1)), axis=1)[:, -1]


def parts(ids: np.ndarray) -> np.ndarray:
    """Partitions in one form: for each answer the first that shares its label."""
    return (ids[:, :, None] == ids[:, None, :]).argmax(axis=2)


def replicates(records: DataFrame, keep: list[str], key: list[str], related: dict[str, Column], surface: Column, n: int = 10, orders: int = 50, sizes: tuple[int, ...] = (2, 4, 6, 8), subsets: int = 50, seed: int = 20260911) -> DataFrame:
    """(keep, experiment, samples, repeat, method, score, changed): entropies of every record under every replicate.

    order: all n answers in a permuted order, per relation. samples: a subset of the answers in their own order, per
    relation and for the surface entropy; all n answers once. It is defined for records of n answers; others take no part.
    changed: the partition of the answers taken differs from the one in their own order (so null for subsets). A record
    gives orders + len(sizes) * subsets + 1 replicates, which are scanned together as arrays; only scores leave the record.
    """
    plan = [("order", n, orders)] + [("samples", m, subsets) for m in sizes] + [("samples", n, 1)]
    base = records.where(F.size(surface) == n).select(*keep, F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("_key"), surface.alias("_surface"), *[r.alias(f"_r_{v}") for v, r in related.items()])
    names = list(related)

    def of_record(head: str, words: list, relations: list[np.ndarray]) -> Iterator[tuple]:
        """(experiment, samples, method, scores, changed) of each part of the plan."""
        _, codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)
        for kind, m, repeats in plan:
            taken = shuffled([f"{seed}:{kind}:{m}:{r}:{head}" for r in range(repeats)], n)[:, :m]
            if kind == "samples":
                taken = np.sort(taken, axis=1)
                yield kind, m, "surface", entropies(codes[taken]), None
            for name, relation in zip(names, relations, strict=True):
                ids = scanned(relation[taken[:, :, None], taken[:, None, :]])
                changed = None
                if kind == "order":
                    back = np.empty_like(ids)
                    np.put_along_axis(back, taken, ids, axis=1)
                    changed = (parts(back) != parts(scanned(relation[None]))).any(axis=1)
                yield kind, m, name, entropies(ids), changed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                told = zip(part.column("_key").to_pylist(), part.column("_surface").to_pylist(), *(part.column(f"_r_{v}").to_pylist() for v in names), strict=True)
                row, out = [], [[], [], [], [], [], []]
                for i, (head, words, *relations) in enumerate(told):
                    for kind, m, name, scores, changed in of_record(head, words, [np.array(r, bool) for r in relations]):
                        k = len(scores)
                        row.append(np.full(k, i))
                        for column, values in zip(out, ([kind] * k, [m] * k, range(k), [name] * k, scores.tolist(), [None] * k if changed is None else changed.tolist()), strict=True):
                            column.extend(values)
                if row:
                    places = pa.array(np.concatenate(row))
                    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(places) for c in keep), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*keep, "experiment", "samples", "repeat", "method", "score", "changed"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return base.mapInArrow(run, f"{spec}, experiment string, samples int, repeat int, method string, score double, changed boolean")


def cell_aurocs(rows: DataFrame, keys: list[str], cell: list[str], incorrect: str) -> DataFrame:
    """(keys, experiment, samples, repeat, method, mean_auroc, valid_cells): AUROC per cell, then its mean over cells that have both classes."""
    by = [*keys, "experiment", "samples", "repeat", "method"]
    found = metrics.auroc(rows, [*by, *cell], incorrect, "score")
    return found.groupBy(*by).agg(F.avg("auroc").alias("mean_auroc"), F.count("auroc").alias("valid_cells"))


def summary(aurocs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, experiment, samples, method, mean_auroc, minimum, maximum, repeats, valid_cells) over the replicates."""
    return aurocs.groupBy(*keys, "experiment", "samples", "method").agg(
        F.avg("mean_auroc").alias("mean_auroc_over_repeats"), F.min("mean_auroc").alias("minimum"), F.max("mean_auroc").alias("maximum"), F.count("mean_auroc").alias("repeats"), F.min("valid_cells").alias("valid_cells")
    ).withColumnRenamed("mean_auroc_over_repeats", "mean_auroc")


def eligibility(records: DataFrame, keys: list[str], incorrect: str) -> DataFrame:
    """(keys, records, incorrect, eligible): cells in which discrimination is defined."""
    n, bad = F.count("*"), F.count_if(F.col(incorrect))
    return records.groupBy(*keys).agg(n.alias("records"), bad.alias("incorrect"), ((bad > 0) & (bad < n)).alias("eligible"))


def order_diagnostics(rows: DataFrame, keep: list[str], n: int = 10, tolerance: float = 1e-12) -> DataFrame:
    """(keep, method, partition_change, entropy_change, entropy_range): how far the order of all n answers moves a record."""
    full = rows.where((F.col("samples") == n) & (F.col("method") != "surface"))
    is_order = F.col("experiment") == "order"
    by = full.groupBy(*keep, "method").agg(
        F.max(F.when(~is_order, F.col("score"))).alias("_own"), F.collect_list(F.when(is_order, F.col("score"))).alias("_s"),
        F.avg(F.col("changed").cast("double")).alias("partition_change"), (F.max("score") - F.min("score")).alias("entropy_range"),
    )
    moved = F.size(F.filter("_s", lambda s: F.abs(s - F.col("_own")) > tolerance)) / F.size("_s")
    return by.select(*keep, "method", "partition_change", moved.alias("entropy_change"), "entropy_range")
