"""Embedding near-dedup by spherical-cap filters.

The filters are the directions ``(c1[i], c2[j]) / sqrt(2)`` of a product of two seeded random codes, one for each half of the dimensions; a code
is made of random orthonormal bases and their negatives. A vector is list-decoded to all directions whose cap it lies in, and to its
``LEAST`` best ones where fewer hold it; only code words that can still reach the threshold together are looked at.

Vectors meet in cells: a cell is a word of the first code with a run of words of the second, so it unites neighbouring filters of the list. How many
words a run has follows from the counted vectors (one where there are many), so that a cell stays of a size to compare and a vector is sent to few
of them. Each vector is sent once to each of its cells, where blocks of bounded size are compared by matrix products in double precision.
A pair counts in the smallest cell that both have, so no pair is emitted to be deduplicated: a cell gives each vector's number of links and a
spanning star for the components. Equal vectors are one class with a size.

With the parameters below a vector of 64 dimensions has some 26 filters. Recall of pairs at cosine 0.9 exactly, the hardest ones, is 0.998 when only a
shared filter counts (runs of one word) and higher with longer runs; figures are in the README.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component; vectors
of different lengths never link; repeated ids each get their row; a null ``vec_id`` takes part; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import join_small, stored

COSINE = 0.9
CODE_WORDS = 256
#: A cap begins so many standard deviations of a random vector's projection from the centre.
TAIL = 3.4
#: Filters that a vector has at least.
LEAST = 24
SEED = 20_240_501
#: Vectors of one cell that are compared in one piece.
BLOCK = 2048
#: Vectors that a cell is laid out for; more of them than this on average, and cells are made of shorter runs.
CELL_VECTORS = 2500


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def code_words(rng: np.random.Generator, size: int) -> np.ndarray:
    """Unit vectors of ``size`` dimensions, from random orthonormal bases and their negatives; one dimension has only two."""
    bases: list[np.ndarray] = []
    while sum(map(len, bases)) < (CODE_WORDS if size > 1 else 2):
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        q *= np.sign(np.diag(r))
        bases += [q, -q]
    return np.concatenate(bases)[:CODE_WORDS]


class Filters:
    """The product code for one number of dimensions."""

    def __init__(self, dims: int) -> None:
        rng = np.random.default_rng([SEED, dims])
        self.half = (dims + 1) // 2
        self.codes = [code_words(rng, size) for size in (self.half, max(1, dims - self.half))]
        # Half of a random unit vector projects on a code word with variance 1 / (2 * half size).
        self.least = min(TAIL * np.sqrt(sum(1 / (2 * c.shape[1]) for c in self.codes)), 0.9 * np.sqrt(2))

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row its filters ``i * CODE_WORDS + j``, sorted."""
        one = x[:, : self.half] @ self.codes[0].T
        two = x[:, self.half :] @ self.codes[1].T if x.shape[1] > self.half else np.zeros((len(x), len(self.codes[1])))
        best = self._best(one, two)
        out = []
        for a, b, some in zip(one, two, best):
            i, j = np.flatnonzero(a >= self.least - b.max()), np.flatnonzero(b >= self.least - a.max())
            p, q = np.nonzero(a[i][:, None] + b[j] >= self.least)
            out.append(np.sort(i[p] * CODE_WORDS + j[q]) if len(p) >= len(some) else np.sort(some))
        return out

    @staticmethod
    def _best(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The ``LEAST`` filters of the largest sums of each row; they are made of the ``LEAST`` largest of each half."""
        i, j = (np.argpartition(-m, min(LEAST, m.shape[1]) - 1, axis=1)[:, :LEAST] for m in (one, two))
        sums = np.take_along_axis(one, i, 1)[:, :, None] + np.take_along_axis(two, j, 1)[:, None]
        names = i[:, :, None] * CODE_WORDS + j[:, None]
        sums, names = sums.reshape(len(one), -1), names.reshape(len(one), -1)
        top = np.argpartition(-sums, min(LEAST, sums.shape[1]) - 1, axis=1)[:, :LEAST]
        return np.take_along_axis(names, top, 1)


def cells_of(filters: np.ndarray, runs: int) -> np.ndarray:
    """The cells of sorted filters when each code word of the first half has ``runs`` of them."""
    i, j = np.divmod(filters, CODE_WORDS)
    return np.unique(i * runs + j * runs // CODE_WORDS)


def runs_for(vectors: int) -> int:
    """The least power of two of runs for which that many vectors fill cells with ``CELL_VECTORS`` on average at most."""
    runs = 1
    while runs < CODE_WORDS and vectors * LEAST > CELL_VECTORS * CODE_WORDS * runs:
        runs *= 2
    return runs


def _decode(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Filters] = {}
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist(), dtype=np.int64)
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                code = codes.setdefault(d, Filters(d))
                for first in range(0, part.num_rows, 1024):
                    piece = part.slice(first, 1024)
                    cells = [cells_of(f, runs).astype(np.int32) for f in code.of(unit_rows(piece.column("embedding")))]
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*piece.schema.names, "cells"])

    return run


def _shared_before(at: int, a: list[list[int]], b: list[list[int]]) -> np.ndarray:
    """For each pair of lists: do they have a number below ``at`` in common?"""
    number = {f: i for i, f in enumerate({f for x in a for f in x if f < at} & {f for x in b for f in x if f < at})}
    if not number:
        return np.zeros((len(a), len(b)), dtype=bool)
    sides = []
    for lists in (a, b):
        m = np.zeros((len(lists), len(number)), dtype=np.float32)
        for i, x in enumerate(lists):
            m[i, [number[f] for f in x if f in number]] = 1
        sides.append(m)
    return sides[0] @ sides[1].T > 0


def block_links(at: int, left: dict, right: dict | None) -> Iterator[tuple[int, int, int]]:
    """(class, links, neighbour) of the pairs of a block, or between two blocks, that have no smaller cell in common."""
    other = left if right is None else right
    hit = left["x"] @ other["x"].T >= COSINE
    if right is None:
        np.fill_diagonal(hit, False)
    rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return
    hit = hit[np.ix_(rows, columns)]
    lists = [side["cells"].take(pa.array(i)).to_pylist() for side, i in ((left, rows), (other, columns))]
    hit &= ~_shared_before(at, *lists)
    one, two = (side["class"][i] for side, i in ((left, rows), (other, columns)))
    for matrix, names, sizes in ((hit, one, other["size"][columns]), *(() if right is None else ((hit.T, two, left["size"][rows]),))):
        links = matrix @ sizes
        for i in np.flatnonzero(links).tolist():
            yield names[i], int(links[i]), names[i]
    # Within one block rows and columns are the same vectors.
    for a, b in _forest(hit, right is None):
        yield one[a], 0, two[b]


def _forest(hit: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs (row, column) of ``hit`` that connect all that it connects, at most one for each row and column."""
    row_new, column_new = np.ones(hit.shape[0], dtype=bool), np.ones(hit.shape[1], dtype=bool)
    for start in np.flatnonzero(hit.any(axis=1)).tolist():
        if not row_new[start]:
            continue
        row_new[start] = False
        if same:
            column_new[start] = False
        rows = [start]
        while rows:
            r = rows.pop()
            for c in np.flatnonzero(hit[r] & column_new).tolist():
                column_new[c] = False
                yield r, c
                if same:
                    row_new[c] = False
                    rows.append(c)
                    continue
                for x in np.flatnonzero(hit[:, c] & row_new).tolist():
                    row_new[x] = False
                    yield x, c
                    rows.append(x)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups (dims, cell, p, q), sorted: p = q is a block, p < q two blocks of one cell."""

    def results(key: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        out = []
        if len(t) > 1:
            x, cells = unit_rows(t.column("embedding").chunk(0)), t.column("cells").chunk(0)
            block, size, name = (t.column(c).to_numpy() for c in ("block", "size", "class"))
            sides = []
            for b in sorted({key[2], key[3]}):
                i = np.flatnonzero(block == b)
                sides.append({"x": x[i], "cells": cells.take(pa.array(i)), "size": size[i].astype(np.int64), "class": name[i]})
            out = list(block_links(key[1], sides[0], sides[1] if len(sides) > 1 else None))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["class", "links", "neighbour"])

    key, rows = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("dims", "cell", "p", "q"))))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if keys[first] != key and rows:
                    yield results(key, rows)
                    rows = []
                key = keys[first]
                rows.append(batch.slice(first, i - first))
                first = i
    if rows:
        yield results(key, rows)


#: Vectors that can link: not null or empty, all components finite, one at least not zero.
USABLE = "coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0), false)"


def classed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, class, embedding)``: equal usable vectors have one class (either zero is the same), any other vector has none."""
    same = vectors.select("vec_id", F.expr("transform(embedding, x -> x + cast(0 as float))").alias("embedding"))
    return same.select("vec_id", F.when(F.expr(USABLE), F.xxhash64("embedding")).alias("class"), "embedding")


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``(class, size, dims, embedding)``: the distinct usable vectors."""
    counted = classed(vectors).where("class is not null").groupBy("embedding").agg(F.count("*").alias("size"))
    return counted.select(F.xxhash64("embedding").alias("class"), "size", F.size("embedding").alias("dims"), "embedding")


def linked(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(class, size)``, ``(class, links)`` and ``(node, root)`` over the classes."""
    classes = stored(vector_classes(vectors), "vec-classes")
    kind = dict(classes.dtypes)["embedding"]
    decode = _decode(runs_for(classes.count()))
    rows = classes.repartition(F.xxhash64("class")).mapInArrow(decode, f"class long, size long, dims int, embedding {kind}, cells array<int>")
    rows = stored(rows, "vec-cells")
    # A cell of many vectors is compared block by block; each vector goes to the pairs of blocks that hold its own.
    counts = rows.select("dims", F.explode("cells").alias("cell")).groupBy("dims", "cell").count().where(f"count > {BLOCK}")
    blocks = stored(counts.select("dims", "cell", F.expr(f"cast(count div {BLOCK // 2} + 1 as int)").alias("blocks")), "vec-blocks")
    rows = join_small(rows.withColumn("cell", F.explode("cells")), blocks, ["dims", "cell"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int"))
    pair = "transform(sequence(0, coalesce(blocks, 1) - 1), o -> struct(least(o, block) as p, greatest(o, block) as q))"
    rows = rows.withColumn("pq", F.explode(F.expr(pair))).select("dims", "cell", "pq.p", "pq.q", "block", "class", "size", "embedding", "cells")
    met = rows.repartition("dims", "cell", "p", "q").sortWithinPartitions("dims", "cell", "p", "q")
    found = stored(met.mapInArrow(_compare, "class long, links long, neighbour long"), "vec-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    return classes.select("class", "size"), links, components(found.select(F.col("class").alias("a"), F.col("neighbour").alias("b")))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    vectors = vectors.select("vec_id", "embedding")
    classes, links, roots = linked(vectors)
    links, roots = stored(links, "vec-counts"), roots.toDF("class", "root")
    facts = stored(join_small(join_small(classes, links, ["class"], "left"), roots, ["class"], "left"), "vec-facts")
    rows = stored(join_small(classed(vectors).select("vec_id", "class"), facts, ["class"], "left"), "vec-rows")
    own = rows.withColumn("root", F.when(F.col("size").isNotNull(), F.coalesce("root", "class")))
    least = stored(own.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")), "vec-least")
    joined = join_small(own, least, ["root"], "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    n = F.when(F.col("root").isNull(), 0).otherwise(F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    return joined.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
