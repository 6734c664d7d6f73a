"""Approximate nearest neighbours by cosine: a forest of random-projection trees searched through one priority queue.

The directions of a tree's levels are random. Thresholds are medians of a bounded sample: of each node while KNOWN_ROWS of the
sample fall into it, of the whole level below that; so depth follows the number of vectors and the forest's size doesn't.
Every vector is indexed. A query walks all trees at once: the queue holds branches not taken, cheapest sum of squared
margins first, and is drained until the leaves taken hold as many rows as calibrate() finds to be needed: what reaches TARGET on
the sample, and how that grows with the number of vectors. The candidates are ranked exactly, in double precision, on the
original vectors.

Vectors and queries meet in cells, runs of neighbouring leaves of one tree, and only in those that a query visits: each vector
goes to one cell a tree, each query to the cells of its leaves. A cell of many vectors or queries is dealt in shares; a task
keeps the nearest of each of its queries. Equal vectors are one entry that carries its smallest ids, as many as can be among
the answers, and equal queries are asked once.

Defined cases: vectors that are null, zero, of another length than the most usual one, or hold a null or non-finite
component take no part, nor do rows with a null id; equal scores go to the smaller id; a query with fewer than k other
vectors gets all of them; one that finds fewer than it could is asked again in all leaves; an empty table gives an empty
result; further columns are ignored. Ids are unique.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import ragged
from sightline.runtime import broadcast_if_small, materialize

#: Vectors that the thresholds and the effort are fitted on at most, and sample rows that a node needs for its own threshold.
SAMPLE_ROWS, KNOWN_ROWS = 20_000, 16
TREES, LEAF_ROWS = 8, 64
#: The recall that the effort is fitted for, the queries that it is fitted on, and what is added to the power of its growth.
TARGET, FITTED_ON, STEEPER = 0.96, 200, 0.05
#: Rows of a cell, vectors and queries of a share, and hits of a share that are cut down at once.
CELL_ROWS, VECTOR_SHARE, QUERY_SHARE, HITS = 16_384, 32_768, 2048, 1 << 20


@dataclass
class Forest:
    directions: np.ndarray  # (trees, dimension, depth)
    thresholds: list[np.ndarray]  # per level (trees, 2 ** level), or (trees, 1) below the known levels
    rows: np.ndarray  # (trees, 2 ** known), estimated vectors in each leaf below a node of the last known level

    @property
    def depth(self) -> int:
        return len(self.thresholds)

    @property
    def known(self) -> int:
        return self.rows.shape[1].bit_length() - 1

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """(n, trees): the leaf of each vector in each tree."""
        out = np.zeros((len(unit), len(self.directions)), np.int64)
        for t, d in enumerate(self.directions):
            p = unit @ d
            node = np.zeros(len(unit), np.int64)
            for level, cut in enumerate(self.thresholds):
                node = node * 2 + (p[:, level] > (cut[t][node] if cut.shape[1] > 1 else cut[t, 0]))
            out[:, t] = node
        return out

    def search(self, unit: np.ndarray, rows: float) -> Iterator[tuple[int, int]]:
        """The leaves (tree, leaf) that the shared queue reaches until they hold so many rows."""
        depth, deeper, known = self.depth, self.depth - self.known, self.known
        margins = np.einsum("d,tdl->tl", unit, self.directions)
        fixed = [cut.shape[1] == 1 for cut in self.thresholds]
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        held = 0.0
        while queue and held < rows:
            cost, t, level, node = heapq.heappop(queue)
            m = margins[t]
            while level < depth:
                d = m[level] - self.thresholds[level][t, 0 if fixed[level] else node]
                right = int(d > 0)
                heapq.heappush(queue, (cost + d * d, t, level + 1, 2 * node + 1 - right))
                node, level = 2 * node + right, level + 1
            yield t, node
            held += self.rows[t, node >> deeper if known else 0]


def unit_rows(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(unit: np.ndarray, count: int, seed: int = 7) -> Forest:
    """A forest for `count` vectors from a sample of them, scaled to length 1."""
    depth = max(0, int(np.ceil(np.log2(max(1, count) / LEAF_ROWS))))
    known = min(depth, max(0, int(np.log2(max(1, len(unit)) / KNOWN_ROWS))))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(TREES, unit.shape[1], depth))
    thresholds = [np.zeros((TREES, 1 << level if level < known else 1)) for level in range(depth)]
    rows = np.zeros((TREES, 1 << known))
    for t in range(TREES):
        p, node = unit @ directions[t], np.zeros(len(unit), np.int64)
        for level in range(depth):
            if level >= known:
                thresholds[level][t] = np.median(p[:, level])
                continue
            order = np.lexsort((p[:, level], node))
            start = np.searchsorted(node[order], np.arange((1 << level) + 1))
            size = np.diff(start)
            low, high = start[:-1] + np.maximum(size - 1, 0) // 2, start[:-1] + size // 2
            v = p[order, level]
            mid = np.where(size > 0, (v[np.minimum(low, len(v) - 1)] + v[np.minimum(high, len(v) - 1)]) / 2, np.median(v))
            thresholds[level][t] = mid
            node = node * 2 + (p[:, level] > mid[node])
        rows[t] = np.bincount(node, minlength=1 << known)
    return Forest(directions, thresholds, np.maximum(rows, 0.5) * (count / max(1, len(unit)) / (1 << (depth - known))))


def needed(unit: np.ndarray, k: int, seed: int = 11) -> float:
    """Leaf rows that the queue has to take until its candidates hold TARGET of the k nearest, in a forest of these vectors."""
    n = len(unit)
    if n <= k + 1:
        return float(TREES * n)
    forest = grow(unit, n)
    leaves = forest.leaves(unit)
    asked = np.random.default_rng(seed).permutation(n)[:FITTED_ON]
    order = [np.argsort(leaves[:, t], kind="stable") for t in range(TREES)]
    start = [np.searchsorted(leaves[o, t], np.arange((1 << forest.depth) + 1)) for t, o in enumerate(order)]
    when = []
    for q in asked:
        s = unit @ unit[q]
        s[q] = -np.inf
        wanted = set(np.argpartition(-s, k)[:k].tolist())
        held = 0
        for t, leaf in forest.search(unit[q], np.inf):
            own = order[t][start[t][leaf] : start[t][leaf + 1]]
            held += len(own)
            got = wanted.intersection(own.tolist())
            when += [held] * len(got)
            wanted -= got
            if not wanted:
                break
    return float(np.quantile(when, TARGET))


def calibrate(unit: np.ndarray, count: int, k: int) -> float:
    """Leaf rows a query needs among `count` vectors: those in the sample, times a power of the ratio of the counts.

    The power is what the need grows with from a quarter of the sample to all of it, and STEEPER more, between 0 and 1: near
    0 for vectors in clusters, near 1 for those without any structure.
    """
    rows = needed(unit, k)
    if count <= len(unit) or len(unit) < 4 * LEAF_ROWS:
        return rows * max(1.0, count / max(1, len(unit)))
    power = np.log(rows / needed(unit[: len(unit) // 4], k)) / np.log(4) + STEEPER
    return rows * (count / len(unit)) ** float(np.clip(power, 0, 1))


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(n, -1)


def distinct_vectors(df: DataFrame, ids: int) -> DataFrame:
    """(vector, ids): each distinct vector with its `ids` smallest ids, cut down batch by batch before the shuffle."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["vector"], b.num_rows)
            key = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            own = np.asarray(b["id"], dtype=np.int64)
            order = np.lexsort((own, group))
            to = np.searchsorted(group[order], np.arange(len(first) + 1))
            short = [own[order[s : min(e, s + ids)]] for s, e in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["vector"].take(pa.array(first)), pa.array(short, pa.list_(pa.int64()))], ["vector", "ids"])

    folded = df.select("id", "vector").mapInArrow(ragged.released(fold), f"vector {df.schema['vector'].dataType.simpleString()}, ids array<long>")
    return folded.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("ids"))


def places(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1 and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def nearest_in(x: np.ndarray, leaf: np.ndarray, asked: np.ndarray, asking: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score): for each query (row of asked) the k nearest rows in its leaves, and all that tie with the last.

    asking and wanted are the (query, leaf) pairs. Scores are sums row by row, so a pair has the same one in every leaf.
    """
    norms, lengths = np.sqrt((x * x).sum(1)), np.sqrt((asked * asked).sum(1))
    unit, units = x / norms[:, None], asked / lengths[:, None]
    order = np.argsort(leaf, kind="stable")
    by = np.argsort(wanted, kind="stable")
    names, first = np.unique(wanted[by], return_index=True)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def cut() -> None:
        """Of all hits so far, keep the k best of each query and what may tie with them."""
        nonlocal held, size
        q, v, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        to = np.lexsort((-s, q))
        q, v, s = q[to], v[to], s[to]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        n = np.diff(np.r_[start, len(q)])
        last = np.repeat(s[start + np.minimum(k, n) - 1], n)
        on = s >= last - 1e-9
        held, size = [(q[on], v[on], s[on])], int(on.sum())

    for name, lo, hi in zip(names, first, np.r_[first[1:], len(by)], strict=True):
        a, b = np.searchsorted(leaf[order], [name, name + 1])
        if a == b:
            continue
        rows, qs = order[a:b], asking[by[lo:hi]]
        s = unit[rows] @ units[qs].T
        if len(rows) > k:
            i, j = np.nonzero(s >= np.partition(s, len(rows) - k, axis=0)[len(rows) - k] - 1e-9)
        else:
            i, j = np.nonzero(np.ones_like(s, bool))
        held.append((qs[j], rows[i], s[i, j]))
        size += len(i)
        if size > HITS:
            cut()
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cut()
    q, v, _ = held[0]
    score = np.concatenate([(x[v[a : a + 4096]] * asked[q[a : a + 4096]]).sum(1) for a in range(0, len(q), 4096)])
    return q, v, np.clip(score / (norms[v] * lengths[q]), -1.0, 1.0)


def nearest(df: DataFrame, k: int = 5, every: int = 50, effort: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    effort is the share of the vectors that the leaves of a query hold, over all trees; by default it is calibrated.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).filter("id is not null").filter(usable("vector"))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == size["d"])
    entries = materialize(distinct_vectors(rows, k + 1).withColumn("rep", F.element_at("ids", 1)), "ann-vectors")
    count = entries.count()
    sample = entries.select("vector").orderBy(F.xxhash64("vector"), "rep").limit(SAMPLE_ROWS).toArrow()["vector"]
    unit = unit_rows(matrix(sample, len(sample)).astype(np.float64))
    forest = grow(unit, count)
    most = calibrate(unit, count, k) if effort is None else effort * count
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0)
    asked = materialize(queries.groupBy("vector").agg(F.min("id").alias("query"), F.count("*").alias("n")), "ann-asked")
    found = materialize(ask(entries, asked, forest, most, k), "ann-found")
    total = entries.select(F.sum(F.size("ids"))).first()[0]
    short = found.groupBy("query").count().filter(F.col("count") < min(k + 1, total)).select("query")
    again = asked.join(found.select("query").distinct(), "query", "left_anti").select("query").union(short)
    if not again.isEmpty():
        # too few in the leaves visited: these queries visit all
        again = materialize(asked.join(again, "query", "left_semi"), "ann-again")
        whole = materialize(ask(entries, again, forest, np.inf, k), "ann-found")
        found = found.join(again, "query", "left_anti").unionByName(whole)
    best = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("best"))
    answers = asked.join(best, "query").select("vector", "n", "best")
    # equal queries meet their answers: those of a vector that very many queries share by a broadcast, of bounded size
    n_queries = queries.count()
    hot = F.broadcast(answers.filter(F.col("n") * 1000 > n_queries).drop("n"))
    own = queries.select(F.col("id").alias("query_id"), "vector")
    rest = own.join(hot.select("vector"), "vector", "left_anti").join(answers.filter(F.col("n") * 1000 <= n_queries).drop("n"), "vector")
    listed = own.join(hot, "vector").unionByName(rest).select("query_id", F.slice(F.filter("best", lambda p: p["id"] != F.col("query_id")), 1, k).alias("best"))
    return listed.select("query_id", F.posexplode("best").alias("at", "p")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.far")).alias("score"))


def ask(entries: DataFrame, asked: DataFrame, forest: Forest, most: float, k: int) -> DataFrame:
    """(query, id, far): the k + 1 nearest of each query (vector, query) among the entries (vector, ids, rep) of its leaves.

    far is the score's negative. A query's own row is among them.
    """
    depth, trees = forest.depth, len(forest.directions)
    count = forest.rows[0].sum() * (1 << (depth - forest.known))
    down = depth - min(depth, max(0, int(np.ceil(np.log2(max(1.0, count) / CELL_ROWS)))))  # levels inside a cell
    kind = entries.schema["vector"].dataType.simpleString()

    def cells_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        leaves = forest.leaves(unit_rows(matrix(b["vector"], b.num_rows).astype(np.float64)))
        return (leaves >> down) * trees + np.arange(trees), leaves

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, n = np.unique(cells_of(b)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                cell, leaves = cells_of(b)
                one = pa.array(np.repeat(np.arange(b.num_rows), trees))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(leaves.ravel()), b["rep"].take(one), b["ids"].take(one), b["vector"].take(one)], ["cell", "leaf", "rep", "ids", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                of, cells, lists = [], [], []
                for i, u in enumerate(unit_rows(matrix(b["vector"], b.num_rows).astype(np.float64))):
                    seen = np.array(list(forest.search(u, most)), np.int64).reshape(-1, 2)
                    cell = (seen[:, 1] >> down) * trees + seen[:, 0]
                    order = np.argsort(cell, kind="stable")
                    names, first = np.unique(cell[order], return_index=True)
                    of += [i] * len(names)
                    cells += names.tolist()
                    lists += np.split(seen[order, 1], first[1:])
                one = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), b["query"].take(one), b["vector"].take(one), pa.array(lists, pa.list_(pa.int64()))], ["cell", "query", "vector", "leaves"])

    n_asked = max(1, asked.count())
    probes = materialize(asked.select("query", "vector").repartition(min(n_asked, max(12, -(-n_asked // 64))), "query").mapInArrow(ragged.released(probe), f"cell long, query long, vector {kind}, leaves array<long>"), "ann-probes")
    # how many shares the vectors and the queries of a cell are dealt in; most have one of each
    vs = entries.select("vector").mapInArrow(ragged.released(tally), "cell long, n long").groupBy("cell").agg(F.ceil(F.sum("n") / VECTOR_SHARE).cast("int").alias("vs"))
    qs = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_SHARE).cast("int").alias("qs"))
    dealt = broadcast_if_small(materialize(vs.join(qs, "cell").filter("vs > 1 or qs > 1"), "ann-shares"), 32)
    share = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    left = entries.select("ids", "vector", "rep").mapInArrow(ragged.released(index), f"cell long, leaf long, rep long, ids array<long>, vector {kind}").join(dealt, "cell", "left")
    left = left.withColumn("v", share("rep", F.col("vs"))).withColumn("q", every("qs"))
    right = probes.join(dealt, "cell", "left").withColumn("q", share("query", F.col("qs"))).withColumn("v", every("vs"))

    def meet(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if vectors.num_rows and asking.num_rows:
            x = matrix(vectors["vector"], vectors.num_rows).astype(np.float64)
            wanted = asking["leaves"].combine_chunks()
            leaves = np.asarray(wanted.flatten(), dtype=np.int64)
            of = np.repeat(np.arange(asking.num_rows), np.asarray(wanted.value_lengths(), dtype=np.int64))
            q, v, score = nearest_in(x, np.asarray(vectors["leaf"].combine_chunks()), matrix(asking["vector"], asking.num_rows).astype(np.float64), of, leaves, k + 1)
            ids = vectors["ids"].combine_chunks()
            n = np.asarray(ids.value_lengths(), dtype=np.int64)
            start = np.cumsum(n) - n
            flat = np.asarray(ids.flatten())
            one = np.repeat(np.arange(len(v)), n[v])
            ident = flat[start[v][one] + places(n[v])]
            query = np.asarray(asking["query"].combine_chunks())[q][one]
            far = -score[one]
            order = np.lexsort((ident, far, query))
            query, ident, far = query[order], ident[order], far[order]
            first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
            on = places(np.diff(np.r_[first, len(query)])) <= k
            out = [query[on], ident[on], far[on]]
        return pa.table({"query": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "far": pa.array(out[2], pa.float64())})

    wanted = left.select("cell", "q", "v", "leaf", "ids", "vector")
    met = wanted.groupBy("cell", "q", "v").cogroup(right.select("cell", "q", "v", "query", "vector", "leaves").groupBy("cell", "q", "v")).applyInArrow(meet, "query long, id long, far double")
    # a vector found in several trees has one rank; the ranks are cut down before the shuffle as well
    ranked = met.withColumn("rank", F.dense_rank().over(Window.partitionBy("query").orderBy("far", "id"))).filter(F.col("rank") <= k + 1)
    return ranked.groupBy("query", "id").agg(F.min("far").alias("far"))
