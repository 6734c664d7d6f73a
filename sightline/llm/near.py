"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and exact verification.

Shingles are five words (of the lower-case text, ASCII punctuation taken as space), weighted by how often they occur; a
shorter text is one shingle of all its words. A sketch has SLOTS registers: each shingle's arrivals are a Poisson process
whose rate is its weight, each arrival falls in a random register, and the earliest owns it; a shingle is given up once
its next arrival comes later than every register's. Two registers agree with the probability Jaccard similarity J_P.

Texts of equal words are one text from the start. Texts that share a band are candidates and are verified exactly, as
far as they aren't connected otherwise: see links().

Defined cases: a null text or one without words is in a class of its own and isn't a duplicate of anything, so is a row
with a null id (its class is null); a class's id is its smallest doc_id and that document stays; rows that repeat an id are one
document, whose text is the smallest of theirs, and one row of them is kept if it stays; an empty table gives an empty result; further
columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import ragged
from sightline.operators.components import components
from sightline.runtime import BROADCAST_BYTES, broadcast_if_small, discard, materialize, unused

SHINGLE, LEAST = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 30 = 7e-6.
ROWS, BANDS = 5, 30
SLOTS = ROWS * BANDS
#: Pairs of one leader that a task compares at once; texts of a block; members beyond which a bucket is settled in blocks.
SHARE, BLOCK, LARGE = 32, 512, 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct shingle, its weight, row offsets, word-sequence digests (n, 2)); rows are sorted by hash."""
    data, offs = ragged.buffer_of(pc.utf8_lower(pc.fill_null(column, "")))
    data = _FOLD[data]
    starts, ends, rows = ragged.words(data, offs)
    h = ragged.span_hashes(data, starts, ends)
    g, to = ragged.grams(h, rows, SHINGLE)
    n, sizes = len(rows) - 1, np.diff(rows)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(rows[:-1], sizes).astype(np.uint64)
    digest = np.zeros((n, 2), np.uint64)
    full = sizes > 0
    for k, seed in enumerate((1, 2)):
        if len(h):
            digest[full, k] = np.add.reduceat(ragged.mix(h ^ ragged.mix(place * np.uint64(2) + np.uint64(seed << 40))), rows[:-1][full])
    short = np.flatnonzero(full & (sizes < SHINGLE))
    own = np.concatenate([ragged.owner(to), short])
    g = np.concatenate([g, ragged.mix(digest[short, 0])])
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return g[first], np.diff(np.append(first, len(g))), np.searchsorted(own[first], np.arange(n + 1)), digest


def sketch(g: np.ndarray, weight: np.ndarray, rows: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(n, slots): the shingle that owns each register; rows without shingles are 0.

    Arrivals beyond a row's horizon are put off, as the registers are nearly always full by then; where one is still
    empty the row is done again with a horizon twice as far, from the same draws.
    """
    n = len(rows) - 1
    total = ragged.row_sums(weight, rows)
    out = np.zeros((n, slots), np.uint64)
    todo, reach = np.flatnonzero(total > 0), np.log(slots) + 3
    while len(todo):
        horizon = np.zeros(n)
        horizon[todo] = slots * reach / total[todo]
        own = ragged.owner(rows)
        live = np.flatnonzero(horizon[own] > 0)
        own, e, rate, t, j = own[live], g[live], weight[live].astype(np.float64), np.zeros(len(live)), 0
        best = np.full(n * slots, np.inf)
        who = np.zeros(n * slots, np.uint64)
        while len(e):
            j += 1
            draw = ragged.mix(e + np.uint64((j * 0x9E3779B97F4A7C15) % (1 << 64)))
            t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            on = t <= horizon[own]
            own, e, rate, t, draw = own[on], e[on], rate[on], t[on], draw[on]
            at = own * slots + (ragged.mix(draw ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)).astype(np.int64) % slots
            np.minimum.at(best, at, t)
            won = best[at] == t
            who[at[won]] = e[won]
            if j < 4 or j % 8 == 0:
                horizon[todo] = np.minimum(horizon[todo], best.reshape(n, slots)[todo].max(1))
        empty = np.isinf(best.reshape(n, slots)[todo]).any(1)
        done = todo[~empty]
        out[done] = who.reshape(n, slots)[done]
        todo, reach = todo[empty], reach * 2
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of the bands, each salted with its place."""
    key = np.zeros((len(registers), BANDS), np.uint64)
    cut = registers.reshape(len(registers), BANDS, ROWS)
    for k in range(ROWS):
        key = ragged.mix(key + cut[:, :, k])
    return ragged.mix(key ^ ragged.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact J_P of two weighted sets: sorted distinct hashes and their weights."""
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = b[place] == a
    if not both.any():
        return 0.0
    u, v = x[both].astype(np.float64), y[place[both]].astype(np.float64)
    only_a, only_b = x.sum() - u.sum(), y.sum() - v.sum()
    ratio = u / v
    order = np.argsort(ratio)
    u, v, ratio = u[order], v[order], ratio[order]
    above = np.append(np.cumsum(u[::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(v))
    cut = np.searchsorted(ratio, ratio, "left")
    return float(np.sum(u / (only_a + above[cut] + ratio * (only_b + below[cut]))))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, bands) of the documents that have words, from one pass over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ragged.chunks(batches, "text", 1 << 20):
            g, w, rows, digest = shingles(b["text"])
            keys = bands(sketch(g, w, rows)).view(np.int64)
            full = np.diff(rows) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), lists], ["doc_id", "hi", "lo", "bands"]).filter(pa.array(full))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return ragged.map_batches(rows, work, "doc_id long, hi long, lo long, bands array<long>")


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, member, sim): J_P of each pair (leader, member), from the whole texts (rep, text).

    The members of one leader are dealt in shares, each with a copy of the leader's text, and a task holds one leader's
    shingles and one chunk of members at a time.
    """
    size = pairs.groupBy("leader").agg(F.count("*").alias("n")).select("leader", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    members = pairs.join(size, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int").alias("share"))
    leaders = size.select("leader", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    asked = members.select("leader", "share", F.lit(1).alias("kind"), F.col("member").alias("rep")).union(leaders.select("leader", "share", F.lit(0), F.col("leader")))
    rows = texts.hint("merge").join(asked, "rep").select("leader", "share", "kind", "rep", "text")
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(tasks, "leader", "share").sortWithinPartitions("leader", "share", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in ragged.chunks(batches, "text", 1 << 20):
            g, w, at, _ = shingles(b["text"])
            found = []
            for i, (leader, kind, doc) in enumerate(zip(b["leader"].to_pylist(), b["kind"].to_pylist(), b["rep"].to_pylist(), strict=True)):
                own = g[at[i] : at[i + 1]], w[at[i] : at[i + 1]]
                if kind == 0:
                    now, held = leader, own
                elif now == leader:
                    found.append((leader, doc, probability_jaccard(*held, *own)))
            yield pa.RecordBatch.from_pydict({"leader": pa.array([f[0] for f in found], pa.int64()), "member": pa.array([f[1] for f in found], pa.int64()), "sim": pa.array([f[2] for f in found], pa.float64())})

    return ragged.map_batches(dealt, work, "leader long, member long, sim double")


def block_links(g: np.ndarray, w: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (a row of left, a row of right) that are similar enough, from products of membership matrices.

    Between texts whose shingles all weigh the same J_P is the Jaccard similarity of the sets; for others the product
    bounds it (it can't exceed the share of either's weight in common shingles) and the rest is computed pair by pair.
    """
    own = ragged.owner(at)
    _, column, times = np.unique(g, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    code = np.cumsum(np.unique(column[shared], return_index=True)[1] >= 0)
    dense = np.full(len(times), -1)
    dense[np.unique(column[shared])] = code - 1
    n, width = len(at) - 1, len(code)
    size = np.diff(at).astype(np.float64)
    total = ragged.row_sums(w, at)
    even = np.array([at[i] == at[i + 1] or w[at[i] : at[i + 1]].min() == w[at[i] : at[i + 1]].max() for i in range(n)])
    both = np.zeros((len(left), len(right)))
    mass_l, mass_r = np.zeros_like(both), np.zeros_like(both)
    uneven = not even.all()
    step = max(1, int(4e6 // max(1, n)))
    for lo in range(0, width, step):
        pick = shared & (dense[column] >= lo) & (dense[column] < lo + step)
        x = np.zeros((n, min(step, width - lo)), np.float32)
        x[own[pick], dense[column[pick]] - lo] = 1
        both += x[left] @ x[right].T
        if uneven:
            y = np.zeros_like(x)
            y[own[pick], dense[column[pick]] - lo] = w[pick] / total[own[pick]]
            mass_l += y[left] @ x[right].T
            mass_r += x[left] @ y[right].T
    jaccard = both / np.maximum(size[left][:, None] + size[right][None, :] - both, 1)
    plain = even[left][:, None] & even[right][None, :]
    found = [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(plain & (jaccard >= LEAST - 1e-9)), strict=True)]
    if uneven:
        for i, j in zip(*np.nonzero(~plain & (np.minimum(mass_l, mass_r) >= LEAST - 1e-3)), strict=True):
            a, b = int(left[i]), int(right[j])
            if probability_jaccard(g[at[a] : at[a + 1]], w[at[a] : at[a + 1]], g[at[b] : at[b + 1]], w[at[b] : at[b + 1]]) >= LEAST - 1e-9:
                found.append((a, b))
    return found


def dense_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) inside clusters, from members (cluster, rep, label, open): every open member meets every other.

    Open members and all members of a cluster are dealt in blocks, and each pair of blocks is compared in one task, which
    returns only links between labels that it hasn't connected yet: rows grow with members times blocks, not with pairs.
    """
    count = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"), F.ceil(F.count_if("open") / BLOCK).cast("int").alias("nu"))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    dealt = members.join(count.filter("nu > 0"), "cluster")
    left = dealt.filter("open").select("cluster", own("nu").alias("u"), blocks("nv").alias("v"), "rep", "label", F.lit(True).alias("left"))
    right = dealt.select("cluster", blocks("nu").alias("u"), own("nv").alias("v"), "rep", "label", F.lit(False).alias("left"))
    rows = texts.hint("merge").join(left.union(right), "rep")

    def meet(t: pa.Table) -> pa.Table:
        g, w, at, _ = shingles(t["text"].combine_chunks())
        side = np.asarray(t["left"].combine_chunks().cast(pa.int8())) == 1
        rep, label = t["rep"].to_pylist(), t["label"].to_pylist()
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        out = []
        for a, b in block_links(g, w, at, np.flatnonzero(side), np.flatnonzero(~side)):
            p, q = find(label[a]), find(label[b])
            if p != q:
                parent[p] = q
                out.append((rep[a], rep[b]))
        ragged.release()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("cluster", "u", "v").applyInArrow(meet, "a long, b long")


def linked(seen: DataFrame) -> DataFrame:
    return seen.filter(F.col("sim") >= LEAST - 1e-9).select(F.col("leader").alias("a"), F.col("member").alias("b"))


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, label): the components of at least two among the distinct texts (rep, bands).

    First each text meets the leaders of its buckets, the smallest id each: that settles nearly all of a group of copies
    by one link a member. What isn't connected to its leader then meets the rest of its bucket: in pairs where the bucket
    is small, in blocks of the clusters that large buckets form. So no link between texts that share a band is lost.
    """
    keyed = reps.select("rep", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    cells = materialize(keyed.join(buckets, "band"), "cells")
    involved = cells.select("rep").distinct()
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null and text is not null").hint("merge").join(involved, "rep", "left_semi"), "involved")
    pairs = materialize(cells.filter("rep <> leader").groupBy("leader", F.col("rep").alias("member")).agg(F.count("*").alias("shared")), "pairs")
    # the leader that shares most bands first
    top = pairs.groupBy("member").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader"))
    seen = materialize(verify(texts, top.select("leader", "member")), "seen")
    edges = linked(seen)
    labels = components(edges)

    def open_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        """Rows of df whose x and y aren't known to be connected."""
        one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"_{c}")) for c in (x, y))
        joined = df.join(one, x, "left").join(two, y, "left")
        return joined.filter(F.coalesce(f"_{x}", x) != F.coalesce(f"_{y}", y)).drop(f"_{x}", f"_{y}")

    rest = materialize(open_pairs(pairs.join(seen, ["leader", "member"], "left_anti").select("leader", "member"), "leader", "member"), "rest")
    seen2 = materialize(verify(texts, rest), "seen")
    known = seen.union(seen2)
    edges = edges.union(linked(seen2))
    labels = components(edges)
    cell = cells.join(known.withColumnRenamed("member", "rep"), ["leader", "rep"], "left").withColumn("sim", F.when(F.col("rep") == F.col("leader"), F.lit(1.0)).otherwise(F.col("sim")))
    cell = cell.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    cell = cell.join(labels.select(F.col("id").alias("leader"), F.col("label").alias("head")), "leader", "left").withColumn("head", F.coalesce("head", "leader"))
    cell = materialize(cell.select("band", "n", "rep", "leader", "sim", "label", (F.col("label") != F.coalesce("head", "leader")).alias("open")), "cell")
    busy = cell.filter("open").select("band").distinct()
    live = cell.join(busy, "band", "left_semi")
    large, small = live.filter(F.col("n") > LARGE), live.filter(F.col("n") <= LARGE)
    cluster = components(large.select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    members = large.groupBy("rep").agg(F.first("label").alias("label"), F.max("open").alias("open")).join(cluster.select(F.col("id").alias("rep"), F.col("label").alias("cluster")), "rep")
    members = materialize(members, "members")
    dense = materialize(dense_links(texts, members), "dense")
    edges = edges.union(dense)
    apart = small.filter("open").select("band", F.col("rep").alias("u"), F.col("label").alias("ul"), F.col("sim").alias("us"))
    others = small.filter("rep <> leader").select("band", F.col("rep").alias("v"), F.col("label").alias("vl"), F.col("sim").alias("vs"), F.col("open").alias("va"))
    # 1 - J_P is a metric, so similarities to the leader that differ by more than 1 - LEAST rule a link out
    possible = F.col("us").isNull() | F.col("vs").isNull() | (F.abs(F.col("us") - F.col("vs")) <= 1 - LEAST + 1e-9)
    left = apart.join(others, "band").filter((F.col("ul") != F.col("vl")) & (~F.col("va") | (F.col("u") < F.col("v"))) & possible)
    # dense_links has compared two members of one cluster if either is open in a large bucket
    one, two = (members.select(F.col("rep").alias(c), F.col("cluster").alias(f"{c}c"), F.col("open").alias(f"{c}o")) for c in ("u", "v"))
    left = left.join(one, "u", "left").join(two, "v", "left").filter("uc is null or vc is null or uc <> vc or not (uo or vo)")
    apart_pairs = materialize(left.select(F.least("u", "v").alias("leader"), F.greatest("u", "v").alias("member")).distinct(), "open")
    last = materialize(verify(texts, apart_pairs), "seen")
    out = components(edges.union(linked(last)))
    discard(cells, texts, pairs, seen, rest, seen2, cell, members, dense, apart_pairs, last)
    return out


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id, n) of the ids that more than one row has, or None where all are unique."""
    found = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1")
    found = materialize(found, "repeated")
    return None if found.isEmpty() else found


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of every row of docs; of rows that repeat an id one at most is kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = repeated_ids(docs)
    if repeated is None:
        return unique_classes(docs)
    rest = docs.join(broadcast_if_small(repeated.select("doc_id"), 16), "doc_id", "left_anti")
    merged = docs.join(broadcast_if_small(repeated.select("doc_id"), 16), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = unique_classes(rest.unionByName(merged))
    again = repeated.select("doc_id", F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("_")).join(found, "doc_id")
    return found.unionByName(again.select("doc_id", "class_id", F.lit(False).alias("kept")))


def unique_classes(docs: DataFrame) -> DataFrame:
    """classes() of rows (doc_id, text) whose ids are unique or null."""
    made = materialize(sketches(docs), "sketches")
    texts = materialize(made.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "texts")
    labels = links(docs, texts.select("rep", "bands"))
    named = texts.select("hi", "lo", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("hi", "lo", F.coalesce("label", "rep").alias("class_id"))
    found = made.select("doc_id", "hi", "lo").join(named, ["hi", "lo"]).select("doc_id", "class_id")
    # the smallest id among the distinct texts' smallest ids is the smallest of the class
    alone = docs.filter("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"))
    blank = docs.filter("doc_id is not null and text is not null").select("doc_id").join(made.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"))
    return found.union(alone).union(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each class, all columns.

    Of rows that repeat an id that stays the one of the smallest text does; of equal texts the one whose other columns hash lowest.
    """
    gone = unused(docs.columns, "gone")
    found = materialize(classes(docs), "classes")
    lost = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    out = lambda rows: rows.select(F.col("doc_id").alias(gone))
    stay = docs.join(broadcast_if_small(out(lost.filter("doc_id is not null and not kept")), 16, BROADCAST_BYTES), F.col("doc_id") == F.col(gone), "left_anti")
    twice = lost.filter("doc_id is not null and kept and n > 1")
    if twice.isEmpty():
        return stay
    twice = broadcast_if_small(out(twice), 16, BROADCAST_BYTES)
    same = F.col("doc_id") == F.col(gone)
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*[F.col(c) for c in docs.columns]))
    one = stay.join(twice, same, "left_semi").withColumn(gone, F.row_number().over(order)).filter(F.col(gone) == 1).drop(gone)
    return stay.join(twice, same, "left_anti").unionByName(one)
