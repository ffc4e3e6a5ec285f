"""Row-local operators on a record's arrays: entropies, clusters, representatives, probe scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import let, strip


def counts(labels: Column) -> Column:
    """How often each label occurs, ascending: sums over it don't depend on the order of clusters."""
    return F.array_sort(F.transform(F.array_distinct(labels), lambda v: F.size(F.filter(labels, lambda x: x == v))))


def entropy(labels: Column) -> Column:
    """Plug-in Shannon entropy in nats; null for no labels."""

    def of(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0), lambda s, x: s + x)
        return F.aggregate(n, F.lit(0.0), lambda s, x: s - x / total * F.log(x / total))

    return F.when(F.size(labels) > 0, let(counts(labels), of))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def naive_entropy(logprobs: Column) -> Column:
    return F.when(F.size(logprobs) > 0, -mean(logprobs))


def logsumexp(values: Column) -> Column:
    """log of the sum of exponentials; minus infinity if all values are."""

    def of(v: Column) -> Column:
        top = F.array_max(v)
        return F.when(top == float("-inf"), top).otherwise(top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))))

    return let(values, of)


def semantic_entropy_full(ids: Column, logprobs: Column) -> Column:
    """Entropy of clusters weighted by their normalised probability mass."""
    pairs = F.arrays_zip(ids.alias("i"), logprobs.alias("l"))
    mass = F.transform(F.array_sort(F.array_distinct(ids)), lambda c: logsumexp(F.transform(F.filter(pairs, lambda p: p["i"] == c), lambda p: p["l"])))

    def of(m: Column) -> Column:
        return let(logsumexp(m), lambda z: F.aggregate(m, F.lit(0.0), lambda s, x: F.when(F.exp(x - z) > 0, s - F.exp(x - z) * (x - z)).otherwise(s)))

    return F.when(F.size(logprobs) > 0, let(mass, of))


def first_ids(values: Column) -> Column:
    """Contiguous ids in order of first occurrence; equal values share one."""
    return let(values, lambda v: let(F.array_distinct(v), lambda d: F.transform(v, lambda x: (F.array_position(d, x) - 1).cast("int"))))


def mutual(matrix: Column) -> Column:
    """r[i][j]: i = j, or both directions hold."""
    return let(matrix, lambda e: F.transform(e, lambda row, i: F.transform(row, lambda x, j: (i == j) | (x & F.get(F.get(e, j), i)))))


def nondefeating(codes: Column) -> Column:
    """r[i][j]: i = j, or at least one direction entails (1) and none contradicts (0)."""

    def cell(c: Column, i: Column, j: Column, x: Column) -> Column:
        y = F.get(F.get(c, j), i)
        return (i == j) | (((x == 1) | (y == 1)) & (x != 0) & (y != 0))

    return let(codes, lambda c: F.transform(c, lambda row, i: F.transform(row, lambda x, j: cell(c, i, j, x))))


def components(related: Column) -> Column:
    """Connected components of a symmetric reflexive relation, renumbered: squared as often as its size has binary digits."""
    return let(related, _components)


def _components(related: Column) -> Column:
    squared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(related).cast("double"))).cast("int"))),
        related,
        lambda r, _: F.transform(r, lambda row: F.transform(row, lambda x, j: F.exists(F.arrays_zip(row.alias("a"), F.transform(r, lambda other: F.get(other, j)).alias("b")), lambda p: p["a"] & p["b"]))),
    )
    return first_ids(F.transform(squared, lambda row: F.array_position(row, True)))


def anchor_scan(related: Column) -> Column:
    """Order-dependent clusters: each unassigned answer opens one and takes every later answer it's related to.

    A later anchor takes over members of earlier ones; anchors themselves stay.
    """

    def step(e: Column, s: Column, i: Column) -> Column:
        taken = F.struct(F.transform(s["a"], lambda v, j: F.when((j == i) | ((j > i) & F.get(F.get(e, i), j)), s["k"]).otherwise(v)).alias("a"), (s["k"] + 1).alias("k"))
        return F.when(F.get(s["a"], i) != -1, s).otherwise(taken)

    def of(e: Column) -> Column:
        start = F.struct(F.transform(e, lambda _: F.lit(-1)).alias("a"), F.lit(0).alias("k"))
        return F.aggregate(F.sequence(F.lit(0), F.size(e) - 1), start, lambda s, i: step(e, s, i), lambda s: s["a"])

    return let(related, of)


def submatrix(matrix: Column, order: Column) -> Column:
    """Rows and columns picked by positions (from 0) in the given order."""
    return let(matrix, lambda m: let(order, lambda o: F.transform(o, lambda i: let(F.get(m, i), lambda row: F.transform(o, lambda j: F.get(row, j))))))


def restored(labels: Column, order: Column) -> Column:
    """Labels given in a permuted order, put back to the original positions."""
    return let(labels, lambda v: let(order, lambda o: F.transform(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.get(v, (F.array_position(o, i) - 1).cast("int")))))


def representatives(ids: Column, normalized: Column) -> Column:
    """The first normalised answer of each cluster, in order of id."""
    return F.transform(F.array_sort(F.array_distinct(ids)), lambda c: F.get(normalized, (F.array_position(ids, c) - 1).cast("int")))


def most_frequent(values: Column) -> Column:
    """The commonest value; ties to the first one met."""

    def of(v: Column) -> Column:
        ranked = F.transform(F.array_distinct(v), lambda x, i: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-i).alias("first"), x.alias("value")))
        return F.array_max(ranked)["value"]

    return let(values, of)


def majority_representative(ids: Column, answers: Column) -> Column:
    """The first answer of the largest cluster; ties to the smallest id."""
    sizes = F.transform(F.array_distinct(ids), lambda c: F.struct(F.size(F.filter(ids, lambda x: x == c)).alias("n"), (-c).alias("id")))
    return F.get(answers, (F.array_position(ids, -F.array_max(sizes)["id"]) - 1).cast("int"))


def fixed_representative(most_likely: Column, answers: Column) -> Column:
    """The recorded most likely answer, else the commonest non-blank one, else the commonest, else empty."""
    full = F.filter(answers, lambda a: strip(a) != "")
    return F.coalesce(F.nullif(strip(most_likely), F.lit("")), most_frequent(F.when(F.size(full) > 0, full).otherwise(answers)), F.lit(""))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def probe_score(hidden: Column, weights: Column, intercept: Column) -> Column:
    """A linear probe's probability."""
    return sigmoid(dot(hidden, weights) + intercept)


def pooled(states: Column, how: str = "last", k: int = 1) -> Column:
    """Token states (array of vectors) as one vector: last, mean, or mean of the last k."""
    if how == "last":
        return F.element_at(states, -1)
    used = states if how == "mean" else F.slice(states, F.greatest(F.lit(1), F.size(states) - k + 1), k)
    return let(used, lambda u: F.transform(F.get(u, 0), lambda _, d: F.aggregate(u, F.lit(0.0), lambda s, v: s + F.get(v, d)) / F.size(u)))
