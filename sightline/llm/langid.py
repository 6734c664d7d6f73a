"""Language identification of mixed-language texts: spans by Viterbi over per-word scores.

The scripts of a word's letters narrow its candidate languages; hashed character n-grams and the whole word score it
under each; a penalty for each switch keeps spans together. A text's language is the one whose spans hold the most
letters-bearing words, its score their share.

Defined cases: a null text, or one without a letter, is `und` with score 0 and no span; words without a letter join the
span around them; ties go to the alphabetically first language; equal texts get equal results; with no training row
every text is `und`; further columns are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.llm import ragged

#: Labelled texts that the model is fitted on at most.
SAMPLE_ROWS = 6000
BUCKETS = 1 << 15
#: Log-odds that a switch of language costs, and the most that one word may count against a language.
SWITCH, WORD_LIMIT = 8.0, 6.0
#: Share of a language's letters that a script needs for its words to be candidates.
SCRIPT_SHARE = 0.001
#: Block starts of the scripts told apart, by first code point; letters before the first are Latin.
SCRIPT_STARTS = [0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
SPANS = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point of the first four planes, whether it is a letter; no later plane has one."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x40000)), bool, 0x40000))
    return _LETTERS[0]


@dataclass
class Words:
    """The distinct words of a batch as code points."""

    cp: np.ndarray
    rows: np.ndarray
    letter: np.ndarray  # words that have a letter
    script: np.ndarray  # bit set of the scripts of their letters


def distinct_words(dictionary: pa.Array) -> Words:
    data, offs = ragged.buffer_of(pc.utf8_lower(dictionary))
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    rows = np.concatenate([[0], np.cumsum(ragged._LEAD[data])])[offs]
    is_letter = letters()[np.minimum(cp, 0x3FFFF)]
    bit = np.where(is_letter, np.uint64(1) << np.searchsorted(SCRIPT_STARTS, cp, "right").astype(np.uint64), np.uint64(0))
    script = np.zeros(len(rows) - 1, np.uint64)
    full = np.diff(rows) > 0
    if full.any():
        script[full] = np.bitwise_or.reduceat(bit, rows[:-1][full])
    return Words(cp, rows, script > 0, script)


def word_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, row offsets): pairs and triples of ^word$, and the word itself."""
    n = len(w.rows) - 1
    sizes = np.diff(w.rows)
    rows = w.rows + 2 * np.arange(n + 1)
    padded = np.full(len(w.cp) + 2 * n, 0x110000, np.uint64)
    padded[ragged.take_runs(rows[:-1] + 1, sizes)] = w.cp
    parts = [ragged.grams(padded, rows, k) for k in (2, 3)]
    whole = np.bincount(ragged.owner(rows), weights=(ragged.mix(padded + np.arange(len(padded), dtype=np.uint64) - np.repeat(rows[:-1], sizes + 2).astype(np.uint64) * np.uint64(1)) >> np.uint64(24)).astype(np.float64), minlength=n) if n else np.zeros(0)
    parts.append((ragged.mix(whole.astype(np.uint64)), np.arange(n + 1)))
    counts = sum(np.diff(r) for _, r in parts)
    to = np.concatenate([[0], np.cumsum(counts)])
    out, at = np.zeros(int(to[-1]), np.int64), to[:-1].copy()
    for g, r in parts:
        size = np.diff(r)
        out[ragged.take_runs(at, size)] = (g >> np.uint64(44)).astype(np.int64) % BUCKETS
        at += size
    return out, to


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs) log probabilities
    scripts: np.ndarray  # bit set of the scripts of each language

    def word_scores(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each distinct word, at most 0 and 0 for its best language; whether it has a letter)."""
        w = distinct_words(dictionary)
        g, rows = word_grams(w)
        s = np.stack([ragged.row_sums(self.weights[:, k][g], rows) for k in range(len(self.langs))], 1)
        foreign = (w.script[:, None] & self.scripts[None, :]) == 0
        foreign &= ~foreign.all(1, keepdims=True)
        s[foreign] = -np.inf
        s = np.maximum(s - s.max(1, keepdims=True), -WORD_LIMIT)
        s[~w.letter] = 0
        return s, w.letter


def split(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row offsets, distinct words, index of each word into them)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    flat = pc.list_flatten(lists)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    offs = np.asarray(lists.offsets, dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(full)])[offs - offs[0]]
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return rows, coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def train(docs: DataFrame) -> Model:
    """Fit on the texts of at most SAMPLE_ROWS rows of docs (doc_id, text, lang): the smallest hashes of their ids.

    The executors count n-grams by language; only those counts come to the driver.
    """
    ids = docs.filter("doc_id is not null and lang is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = docs.join(F.broadcast(ids.distinct()), "doc_id").filter("lang is not null").select("lang", "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in ragged.chunks(batches, "text"):
            langs = np.array(b["lang"].to_pylist(), object)
            for lang in sorted(set(langs)):
                rows, words, codes = split(b["text"].filter(pa.array(langs == lang)))
                w = distinct_words(words)
                g, to = word_grams(w)
                times = np.bincount(codes, minlength=len(words)).astype(np.float64) * w.letter
                grams[lang] = grams.get(lang, 0) + np.bincount(g, weights=np.repeat(times, np.diff(to)), minlength=BUCKETS)
                bits = ((w.script[:, None] >> np.arange(32, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.float64)
                scripts[lang] = scripts.get(lang, 0) + times @ bits
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([x.tolist() for x in grams.values()], pa.list_(pa.float64())), pa.array([x.tolist() for x in scripts.values()], pa.list_(pa.float64()))], ["lang", "grams", "scripts"])

    found = ragged.map_batches(sample, count, "lang string, grams array<double>, scripts array<double>").toArrow().to_pylist()
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0, np.uint64))
    grams = np.stack([np.sum([r["grams"] for r in found if r["lang"] == x], 0) for x in langs], 1)
    uses = np.stack([np.sum([r["scripts"] for r in found if r["lang"] == x], 0) for x in langs])
    kept = uses >= SCRIPT_SHARE * np.maximum(uses.sum(1, keepdims=True), 1)
    scripts = (kept.astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return Model(langs, np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)), scripts)


def viterbi(s: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The best label of each item, for every row of items at once; ties stay, and then take the first label.

    A row whose best single label can't be beaten is settled first: if no run of items favours another label by more
    than half the penalty, two or more runs of others save less than their switches cost.
    """
    n, labels = len(rows) - 1, s.shape[1]
    sums = np.stack([ragged.row_sums(s[:, k], rows) for k in range(labels)], 1)
    best = sums.argmax(1)
    of = ragged.owner(rows)
    out = best[of]
    if not len(s):
        return out
    gain = s - s[np.arange(len(s)), out][:, None]
    far = 4 * SWITCH + 2 * WORD_LIMIT * np.max(np.diff(rows), initial=0)
    mixed = np.zeros(n, bool)
    full = np.diff(rows) > 0
    for k in range(labels):
        # rows are laid end to end at falling levels, so that a running minimum never reaches back into an earlier row
        c = np.cumsum(gain[:, k])
        before = np.concatenate([[0.0], c[:-1]])
        level = -far * 2 * of.astype(np.float64)
        base = np.repeat(before[rows[:-1][full]], np.diff(rows)[full])
        run = (c - base + level) - np.minimum.accumulate(before - base + level)
        mixed[full] |= np.maximum.reduceat(run, rows[:-1][full]) > SWITCH / 2
    todo = np.flatnonzero(mixed)
    todo = todo[np.argsort(-np.diff(rows)[todo], kind="stable")]
    if not len(todo):
        return out
    first, size = rows[todo], np.diff(rows)[todo]
    v = s[first].copy()
    back = np.zeros((int(size.sum()), labels), np.int8)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    own = np.tile(np.arange(labels, dtype=np.int8), (len(todo), 1))
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    for t in range(1, size[0]):
        m = live[t]
        x = v[:m]
        top = x.argmax(1)
        jump = x[np.arange(m), top] - SWITCH
        stay = x >= jump[:, None]
        back[at[:m] + t] = np.where(stay, own[:m], top[:, None])
        v[:m] = np.where(stay, x, jump[:, None]) + s[first[:m] + t]
    state = v.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        m = live[t]
        out[first[:m] + t] = state[:m]
        if t:
            state[:m] = back[at[:m] + t, state[:m]]
    return out


def label(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and, if wanted, spans (word positions, end excluded) appended."""
    extra = StructType.fromDDL(SPANS).fields[: 3 if spans else 2]
    source = docs.select([c for c in docs.columns if c not in ("lang_pred", "score", "spans")])
    langs = np.array([*model.langs, "und"], object)
    schema = StructType(source.schema.fields + extra)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ragged.chunks(batches, "text"):
            rows, words, codes = split(b["text"])
            n, labels = b.num_rows, len(model.langs)
            if labels:
                scores, letter = model.word_scores(words)
                path = viterbi(scores[codes], rows)
                counts = np.bincount(ragged.owner(rows) * labels + path, weights=letter[codes].astype(float), minlength=n * labels).reshape(n, labels)
            else:
                path, counts = np.zeros(len(codes), np.int64), np.zeros((n, 1))
            total = counts.sum(1)
            pred = np.where(total > 0, counts.argmax(1), labels)
            cols = [pa.array(langs[pred], pa.string()), pa.array(np.where(total > 0, counts.max(1) / np.maximum(total, 1), 0.0))]
            if spans:
                cut = np.ones(len(path), bool)
                cut[1:] = path[1:] != path[:-1]
                cut[rows[:-1][np.diff(rows) > 0]] = True
                cut &= (total > 0)[ragged.owner(rows)]
                begin = np.flatnonzero(cut)
                row = np.searchsorted(rows, begin, "right") - 1
                end = np.append(begin[1:], len(path))
                end = np.minimum(end, rows[row + 1])
                flat = pa.StructArray.from_arrays([pa.array((begin - rows[row]).astype(np.int32)), pa.array((end - rows[row]).astype(np.int32)), pa.array(langs[path[begin]], pa.string())], ["start", "end", "lang"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), flat).cast(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], schema.names)

    return ragged.map_batches(source, work, schema)


def held_out(column: str = "doc_id") -> Column:
    """Whether an id belongs to the fold that is never learned from."""
    return F.crc32(F.encode(F.col(column).cast("string"), "utf-8")) % 4 == 2
