"""SentencePiece encoding and decoding with N-best segmentations over the piece lattice of a model file.

A text is a lattice of the model's pieces (a space before the text, spaces inside pieces' heads only), scored by the
model's piece scores; a character that no piece covers is spelled in byte pieces. As no piece reaches over a space or
over a character such as the line feed that no piece has, the lattice falls into segments: forward Viterbi runs over all distinct segments of a chunk at once,
and a text's N best segmentations differ from its best one in the N - 1 segments of the smallest loss at most. For these,
a backward A-star search, whose exact heuristics are the forward scores, lists the alternatives, and a heap combines them.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; ties prefer the longer last piece,
and among alternatives the earlier segment; U+2581 in a text is spelled in bytes, so every text decodes to itself; the
model's pieces for runs of spaces take no part; equal rows get equal results; columns named ids, nbest, swaps (or round_trip, where
that is asked for) are replaced, further ones are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sightline.llm import ragged

#: Segmentations listed of each text; segments longer than this many bytes are searched one by one.
NBEST, LONG = 4, 40
#: Segments whose alternatives a task remembers, and cells (segments times bytes) that are searched at once.
KNOWN, CELLS = 4000, 50_000
#: Score of a byte piece below the lowest piece, and the score under which the model marks a piece as reserved.
BYTE_PENALTY, RESERVED = 10.0, -1e8
ENCODED = "ids array<int>, nbest array<double>, swaps array<array<struct<segment:int,ids:array<int>>>>"

_READY: dict[tuple, Lattice] = {}


def load(path: str) -> tuple[tuple[str, ...], tuple[float, ...], int]:
    """(pieces, scores, id of the first byte piece) of a model file; read on the driver, shipped with the tasks."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(m.get_piece_size())]
    return tuple("" if s else m.id_to_piece(i) for i, s in enumerate(skip)), tuple(m.get_score(i) for i in range(m.get_piece_size())), m.piece_to_id("<0x00>")


class Lattice:
    """The pieces as a byte trie: node 0 is dead, node 1 the root. The rows of its table lie inside one another, see packed()."""

    def __init__(self, pieces: tuple[str, ...], scores: tuple[float, ...], first_byte: int) -> None:
        self.first_byte = first_byte
        self.spelling = Spelling(pieces, first_byte)
        self.bytes = self.spelling.bytes
        used = [i for i, p in enumerate(pieces) if p and scores[i] > RESERVED]
        if any(b" " in self.bytes[i][1:] for i in used):
            raise ValueError("a piece reaches over a space")
        alphabet = sorted({b for i in used for b in self.bytes[i]})
        self.classes = np.zeros(256, np.int64)
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        self.alone = (self.classes == 0) & (np.arange(256) < 128)
        nodes, children, ends = 2, {}, {}
        for i in used:
            at = 1
            for b in self.bytes[i]:
                key = at * self.width + int(self.classes[b])
                if key not in children:
                    children[key], nodes = nodes, nodes + 1
                at = children[key]
            ends[at] = i
        self.base, self.owner, self.child = packed(np.array(list(children), np.int64), np.array(list(children.values()), np.int32), nodes, self.width)
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.score = np.full(nodes, -np.inf)
        self.score[list(ends)] = [scores[i] for i in ends.values()]
        self.byte_score = min(scores[i] for i in used) - BYTE_PENALTY
        self.longest = max(len(self.bytes[i]) for i in used)
        self.known: dict[bytes, list[tuple[float, tuple[int, ...]]]] = {}

    def step(self, node: np.ndarray, byte_class: np.ndarray) -> np.ndarray:
        """The child of each node by a byte's class, or the dead node."""
        at = self.base[node] + byte_class
        return np.where(self.owner[at] == node, self.child[at], 0)

    def edges(self, word: bytes) -> list[list[tuple[int, float, int]]]:
        """For each position the (end, score, id) of the pieces that start there."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in word]
        byte = np.zeros(len(word), bool)
        for i, lead in enumerate(word):
            at = 1
            for j in range(i, len(word)):
                place = int(self.base[at] + self.classes[word[j]])
                if self.owner[place] != at:
                    break
                at = int(self.child[place])
                if self.piece[at] >= 0:
                    out[i].append((j + 1, float(self.score[at]), int(self.piece[at])))
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if not 0x80 <= lead < 0xC0 and not any(e == i + size for e, _, _ in out[i]):
                byte[i : i + size] = True
        for i in np.flatnonzero(byte):
            out[i].append((int(i) + 1, self.byte_score, self.first_byte + word[i]))
        return out

    def nbest(self, word: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a segment as (score, ids), best first: A-star from the end."""
        if (got := self.known.get(word)) is not None:
            return got[:n]
        edges = self.edges(word)
        size = len(word)
        forward = [-np.inf] * size + [-np.inf]
        forward[0] = 0.0
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
        for i, row in enumerate(edges):
            for end, s, p in row:
                into[end].append((i, s, p))
                if forward[i] + s > forward[end]:
                    forward[end] = forward[i] + s
        queue = [(-forward[size], size, 0, 0.0, ())]  # of equal promise, what is nearest to the start goes first
        out, made = [], 0
        while queue and len(out) < NBEST:
            _, at, _, done, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for i, s, p in into[at]:
                if forward[i] > -np.inf:
                    made += 1
                    heapq.heappush(queue, (-(forward[i] + s + done), i, made, done + s, (p, path)))
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known[word] = out
        return out[:n]

    def best(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids (n, L) right-aligned, their number, best score, loss of the second best) of n segments of equal length L."""
        n, size = words.shape
        codes, top = self.classes[words], min(size, self.longest)
        node = np.full((n, size), 1, np.int32)
        scores, ids = [], []
        for k in range(1, top + 1):
            node = self.step(node[:, : size - k + 1], codes[:, k - 1 :])
            if not node.any():
                break
            scores.append(self.score[node])
            ids.append(self.piece[node])
        if not scores:
            scores, ids = [np.full((n, size), -np.inf)], [np.full((n, size), -1, np.int32)]
        length = np.where(words < 0x80, 1, np.where(words < 0xC0, 0, np.where(words < 0xE0, 2, np.where(words < 0xF0, 3, 4))))
        byte = np.zeros((n, size), bool)
        for c in range(1, 5):
            lead = length == c
            if lead.any():
                if c <= len(scores):
                    lead = lead.copy()
                    lead[:, : size - c + 1] &= ~np.isfinite(scores[c - 1])
                for k in range(c):
                    byte[:, k:] |= lead[:, : size - k]
        if byte.any():
            byte &= ~np.isfinite(scores[0])
            scores[0] = np.where(byte, self.byte_score, scores[0])
            ids[0] = np.where(byte, self.first_byte + words, ids[0])
        rows = np.arange(n)
        forward, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64)
        forward[0] = 0
        for j in range(1, size + 1):
            for k in range(min(j, len(scores)), 0, -1):
                x = forward[j - k] + scores[k - 1][:, j - k]
                better = x > forward[j]
                forward[j] = np.where(better, x, forward[j])
                back[j] = np.where(better, k, back[j])
        backward = np.full((size + 1, n), -np.inf)
        backward[size] = 0
        for i in range(size - 1, -1, -1):
            for k in range(min(size - i, len(scores)), 0, -1):
                np.maximum(backward[i], scores[k - 1][:, i] + backward[i + k], out=backward[i])
        out, count, at = np.zeros((n, size), np.int32), np.zeros(n, np.int64), np.full(n, size)
        taken = np.zeros((size, n), np.int64)
        stack = np.stack([np.pad(x, ((0, 0), (0, size - x.shape[1])), constant_values=-1) for x in ids])
        while True:
            live = rows[at > 0]
            if not len(live):
                break
            k = back[at[live], live]
            at[live] -= k
            count[live] += 1
            out[live, size - count[live]] = stack[k - 1, live, at[live]]
            taken[at[live], live] = k
        second = np.full(n, -np.inf)
        for k in range(1, len(scores) + 1):
            for i in range(size - k + 1):
                x = forward[i] + scores[k - 1][:, i] + backward[i + k]
                np.maximum(second, np.where(taken[i] == k, -np.inf, x), out=second)
        return out, count, forward[size], forward[size] - second

    def segments(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the segments (at spaces, at rows, at and after ASCII characters of no piece) and row offsets into them."""
        cut = data == 32
        alone = self.alone[data]
        cut |= alone
        cut[1:] |= alone[:-1]
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offs)

    def encode(self, column: pa.Array, nbest: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        spaced = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
        data, offs = ragged.buffer_of(spaced)
        starts, rows = self.segments(data, offs)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        _, first, which = np.unique(ragged.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        count, score, loss = np.zeros(len(first), np.int64), np.zeros(len(first)), np.full(len(first), np.inf)
        place = np.zeros(len(first), np.int64)
        pool, held = [], 0
        for length in np.unique(size):
            own = np.flatnonzero(size == length)
            if length > LONG:
                for u in own:
                    found = self.nbest(data[starts[first[u]] : ends[first[u]]].tobytes(), max(2, nbest))
                    score[u], got = found[0]
                    loss[u] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
                    count[u], place[u] = len(got), held
                    pool.append(np.array(got, np.int32))
                    held += len(got)
                continue
            for part in np.array_split(own, max(1, len(own) * int(length) // CELLS)):
                ids, c, s, g = self.best(data[starts[first[part]][:, None] + np.arange(length)])
                count[part], score[part], loss[part] = c, s, g
                pool.append(ids[np.arange(length)[None, :] >= length - c[:, None]])
                place[part] = held + np.cumsum(c) - c
                held += int(c.sum())
        flat = np.concatenate(pool) if pool else np.zeros(0, np.int32)
        each = count[which]
        ids = flat[ragged.take_runs(place[which], each)] if len(which) else flat
        to = np.concatenate([[0], np.cumsum(each)])[rows]
        null = np.asarray(column.is_null())
        lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
        total = ragged.row_sums(score[which], rows)
        losses = loss[which]
        best, swaps = [], []
        for r in range(len(rows) - 1):
            lo, hi = rows[r], rows[r + 1]
            x = losses[lo:hi]
            if null[r]:
                best.append(None)
                swaps.append(None)
                continue
            near = np.lexsort((np.arange(len(x)), x))[: nbest - 1] if len(x) <= nbest else _smallest(x, nbest - 1)
            near = [int(i) for i in near if np.isfinite(x[i])]
            options = [self.nbest(data[starts[lo + i] : ends[lo + i]].tobytes(), nbest) for i in near]
            found = combine(options, nbest)
            best.append([float(total[r] + s) for s, _ in found])
            swaps.append([[{"segment": near[j], "ids": list(options[j][o][1])} for j, o in enumerate(choice) if o] for _, choice in found])
        return lists, pa.array(best, pa.list_(pa.float64())), pa.array(swaps, pa.list_(pa.list_(pa.struct([("segment", pa.int32()), ("ids", pa.list_(pa.int32()))]))))


def packed(keys: np.ndarray, children: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base of each node, owner and child of each place) of the transitions node * width + class -> child.

    A node's child by a class is at base + class, if the owner there is the node. Rows of several children take the first
    place where all of theirs are free, the longest rows first; rows of one child then fill the gaps.
    """
    order = np.argsort(keys, kind="stable")
    keys, children = keys[order], children[order]
    node, byte_class = keys // width, keys % width
    names, first, count = np.unique(node, return_index=True, return_counts=True)
    base = np.zeros(nodes, np.int32)
    owner = np.full(2 * len(keys) + 6 * width, -1, np.int32)
    child = np.zeros(len(owner), np.int32)
    free, low = np.ones(len(owner), bool), 0
    free[-width:] = False  # so that base + class is a place for any class
    for r in np.argsort(-count, kind="stable")[: int((count > 1).sum())]:
        own = byte_class[first[r] : first[r] + count[r]]
        at, span = low, 4 * width
        while True:
            tried = at + np.flatnonzero(free[at + own[0] : at + own[0] + span])
            for c in own[1:]:
                tried = tried[free[np.minimum(tried + c, len(free) - 1)]]
            if len(tried):
                break
            at += span
        base[names[r]] = tried[0]
        free[tried[0] + own] = False
        while not free[low : low + width].any():
            low += width
    single = np.flatnonzero(count == 1)
    gaps = np.flatnonzero(free)
    gaps = gaps[gaps >= width][: len(single)]
    base[names[single]] = gaps - byte_class[first[single]]
    place = base[node] + byte_class
    owner[place], child[place] = node, children
    return base, owner, child


class Spelling:
    """The bytes of each piece."""

    def __init__(self, pieces: tuple[str, ...], first_byte: int) -> None:
        self.bytes = [p.replace("\u2581", " ").encode() for p in pieces]
        for i in range(256):
            self.bytes[first_byte + i] = bytes([i])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids; null for null."""
        null = np.asarray(lists.is_null())
        ids = np.asarray(lists.flatten(), dtype=np.int64)
        rows = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))])
        size = np.diff(self.offs)[ids]
        data = self.flat[ragged.take_runs(self.offs[:-1][ids], size)]
        to = np.concatenate([[0], np.cumsum(size)])[rows]
        skip = np.diff(to) > 0  # the space before the text
        keep = np.ones(len(data), bool)
        keep[to[:-1][skip]] = False
        to = to - np.concatenate([[0], np.cumsum(skip)])
        data = data[keep]
        offsets = pa.py_buffer(to.astype(np.int64).tobytes())
        bits = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.LargeStringArray.from_buffers(len(null), offsets, pa.py_buffer(data.tobytes()), bits).cast(pa.string())


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest, ties to the earlier."""
    most = np.partition(x, n - 1)[n - 1]
    near = np.flatnonzero(x <= most)
    return near[np.argsort(x[near], kind="stable")][:n]


def combine(options: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best choices of one option a segment: (score relative to all firsts, option numbers)."""
    start = (0,) * len(options)
    queue, seen, out = [(0.0, start)], {start}, []
    while queue and len(out) < n:
        cost, choice = heapq.heappop(queue)
        out.append((-cost, choice))
        for j, o in enumerate(choice):
            if o + 1 < len(options[j]):
                new = (*choice[:j], o + 1, *choice[j + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(queue, (cost + options[j][o][0] - options[j][o + 1][0], new))
    return out


def lattice(model: tuple) -> Lattice:
    """The lattice of a loaded model, built once in each worker."""
    key = (len(model[0]), hash(model[0]), hash(model[1]))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Lattice(*model)
    return _READY[key]


def encode(docs: DataFrame, path: str, nbest: int = NBEST, keep: tuple[str, ...] | None = None, check: bool = False) -> DataFrame:
    """docs (or its columns `keep`) with ids, the scores of the n best segmentations and where they differ from ids.

    check=True adds round_trip, whether the ids decode to the text.
    """
    if not 1 <= nbest <= NBEST:
        raise ValueError(f"nbest has to be 1 to {NBEST}")
    new = StructType.fromDDL(ENCODED + (", round_trip boolean" if check else ""))
    source = docs.select(*[c for c in (keep or docs.columns) if c not in new.names], *(["text"] if keep and "text" not in keep else []))
    schema = StructType(source.schema.fields + new.fields)
    model = load(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for b in ragged.chunks(batches, "text", 1 << 20):
            made = own.encode(b["text"], nbest)
            if check:
                back = own.spelling.decode(made[0])
                same = pc.if_else(b["text"].is_null(), back.is_null(), pc.fill_null(pc.equal(back, b["text"]), False))
                made = (*made, same)
            yield pa.RecordBatch.from_arrays([*b.columns, *made], schema.names)
        own.known.clear()

    return ragged.map_batches(source, work, schema)


def decode(encoded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """encoded with the text of its ids."""
    schema = StructType([f for f in encoded.schema.fields if f.name != column] + StructType.fromDDL(f"{column} string").fields)
    pieces, _, first_byte = load(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spelling(pieces, first_byte)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, own.decode(part["ids"])], schema.names)

    return ragged.map_batches(encoded.select([f.name for f in schema.fields if f.name != column]), work, schema)
