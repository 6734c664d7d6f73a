"""Track embeddings and identities: pooling, similarity, constrained agglomeration, labels and merge maps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pool(df: DataFrame, keys: list[str], vector: str, ties: list[str], k: int) -> DataFrame:
    """(keys, i, value, n): the k vectors of largest norm as one: mean of unit vectors weighted by norm, unit length again.

    Values come in long form, one row a dimension.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("_norm", 6)), *ties)
    top = df.withColumn("_norm", norm(F.col(vector))).filter("_norm > 0").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    long = top.select(*keys, "_norm", F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(*keys, "i").agg((F.sum(F.col("x").cast("double")) / (F.sum("_norm") + 1e-8)).alias("m"), F.count("*").alias("n"))
    size = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*keys)))
    return mean.select(*keys, "i", F.coalesce(F.try_divide("m", size), F.lit(0.0)).alias("value"), "n")


#: Vectors of a cell that a task compares at once, and pivots at most.
BLOCK, PIVOTS = 2048, 1024


def similar_pairs(df: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    """(a, b, similarity): all pairs a < b of rows whose cosine is at least `least`; null and zero vectors take no part.

    Each vector lies in the cell of its nearest pivot, one of a bounded sample, and visits the cells that can hold a vector near
    enough: by the triangle inequality of angles those whose pivot is no farther than the cell's widest angle and the threshold's
    together. Members and visitors of a cell meet in shares of BLOCK rows, as products of matrices; so no pair is lost, and the work
    falls with how well the vectors are separated.
    """
    unit = df.select(F.col(ident).alias("id"), F.col(vector).alias("vector")).withColumn("n", norm(F.col("vector"))).filter("n > 0").drop("n")
    count = unit.count()
    chosen = unit.orderBy(F.xxhash64("id"), "id").limit(int(np.clip(-(-count // BLOCK), 1, PIVOTS))).toPandas()["vector"]
    pivots = _unit(np.stack(chosen.to_list())) if len(chosen) else np.zeros((1, 1))
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-9
    id_kind, kind = (unit.schema[c].dataType.simpleString() for c in ("id", "vector"))

    def angles(b: pa.RecordBatch) -> np.ndarray:
        return np.arccos(np.clip(_unit(np.asarray(b["vector"].flatten(), dtype=float).reshape(b.num_rows, -1)) @ pivots.T, -1, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = angles(b)
            own = angle.argmin(1)
            cells, at = np.unique(own, return_inverse=True)
            wide = np.zeros(len(cells))
            np.maximum.at(wide, at, angle[np.arange(len(own)), own])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.bincount(at, minlength=len(cells)), pa.int64()), pa.array(wide)], ["cell", "n", "wide"])

    seen = {r["cell"]: (r["n"], r["wide"]) for r in unit.mapInArrow(measure, "cell int, n long, wide double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("wide").alias("wide")).collect()}
    width = np.array([seen.get(c, (0, -np.inf))[1] for c in range(len(pivots))])
    shares = np.array([max(1, -(-seen.get(c, (0, 0))[0] // BLOCK)) for c in range(len(pivots))])
    every = max(1, -(-count // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                angle, key = angles(b), np.array([zlib.crc32(str(i).encode()) for i in b["id"].to_pylist()], np.int64)
                own = angle.argmin(1)
                row, cell = np.nonzero(angle <= width[None, :] + reach)
                # a member is copied for the shares of visitors, a visitor for those of members
                n = np.concatenate([np.full(b.num_rows, every), shares[cell]])
                rows = np.repeat(np.concatenate([np.arange(b.num_rows), row]), n)
                cells = np.repeat(np.concatenate([own, cell]), n)
                other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                member = np.repeat(np.arange(len(n)) < b.num_rows, n)
                u = np.where(member, key[rows] % shares[cells], other)
                v = np.where(member, other, key[rows] % every)
                one = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(u, pa.int32()), pa.array(v, pa.int32()), pa.array(member), b["id"].take(one), b["vector"].take(one)], ["cell", "u", "v", "member", "id", "vector"])

    def meet(t: pa.Table) -> pa.Table:
        side = np.asarray(t["member"].combine_chunks().cast(pa.int8())) == 1
        x = _unit(np.asarray(t["vector"].combine_chunks().flatten(), dtype=float).reshape(t.num_rows, -1))
        member, visitor = np.flatnonzero(side), np.flatnonzero(~side)
        i, j = np.nonzero(x[visitor] @ x[member].T >= least - 1e-9)
        ids = t["id"].combine_chunks()
        a, b = ids.take(pa.array(visitor[i])), ids.take(pa.array(member[j]))
        similarity = (x[visitor[i]] * x[member[j]]).sum(1)
        out = pa.table({"a": a, "b": b, "similarity": pa.array(similarity)})
        return out.filter(pc.and_(pc.less(a, b), pa.array(similarity >= least)))

    dealt = unit.mapInArrow(deal, f"cell int, u int, v int, member boolean, id {id_kind}, vector {kind}")
    return dealt.groupBy("cell", "u", "v").applyInArrow(meet, f"a {id_kind}, b {id_kind}, similarity double")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def agglomerate(vectors: np.ndarray, least: float, cannot: set[tuple[int, int]] = frozenset()) -> np.ndarray:
    """Group number of each unit vector: the closest pair of centroids merges while its cosine reaches `least`.

    Groups that hold a forbidden pair never merge. Groups are numbered by their smallest member.
    """
    n = len(vectors)
    total = vectors.astype(float).copy()
    members = [[i] for i in range(n)]
    alive = np.ones(n, bool)
    barred = np.zeros((n, n), bool)
    for i, j in cannot:
        barred[i, j] = barred[j, i] = True
    unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -np.inf)
    while alive.sum() > 1:
        open_ = np.where(barred | ~alive[:, None] | ~alive[None, :], -np.inf, sim)
        i, j = divmod(int(open_.argmax()), n)
        if open_[i, j] < least:
            break
        i, j = min(i, j), max(i, j)
        total[i] += total[j]
        members[i] += members[j]
        alive[j] = False
        barred[i] |= barred[j]
        barred[:, i] |= barred[:, j]
        u = total[i] / max(np.linalg.norm(total[i]), 1e-12)
        unit[i] = u
        sim[i] = sim[:, i] = unit @ u
        sim[i, i] = -np.inf
    out = np.zeros(n, int)
    for k, root in enumerate(sorted((min(m), i) for i, m in enumerate(members) if alive[i])):
        out[members[root[1]]] = k
    return out


def identities(df: DataFrame, keys: list[str], ident: str, vector: str, least: float) -> DataFrame:
    """(keys, ident, identity): agglomeration inside each group, named Person_1, Person_2, ... by smallest member."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ident)
        x = np.stack(g[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return g[[*keys, ident]].assign(identity=[f"Person_{k + 1}" for k in agglomerate(x, least)])

    return df.select(*keys, ident, vector).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*keys, ident]) + ", identity string")


def merge_map(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, target): each id with the member of its component that appears first. spans is (id, first)."""
    joined = labels.join(spans, "id")
    best = joined.groupBy("label").agg(F.min_by("id", F.struct("first", "id")).alias("target"))
    return joined.join(best, "label").select("id", "target")
