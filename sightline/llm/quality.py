"""Quality rules: base counts over whole texts and a calibrated n-gram classifier held against fixed thresholds.

A document is kept when it passes the base rules and its calibrated probability of good quality reaches the threshold.

Defined cases: a null or empty text has no words and fails the base rules; equal texts get equal verdicts; a label row
with a null id or a quality other than 0 or 1 is ignored, several labels of a document count as their smallest; without
any label row every text has probability one half and the verdict is the base rules'; of several texts under a labelled id the
smallest is learned from; rows may repeat; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.llm import linear, ragged

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 3000
#: Fixed thresholds: fewest words, highest percentage of words in repeated windows, lowest probability of quality.
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_PROBABILITY = 50, 50, 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which items have an equal item in their row."""
    of = ragged.owner(rows).astype(np.uint64)
    k = ragged.mix(keys ^ ragged.mix(of + np.uint64(1)))
    order = np.argsort(k, kind="stable")
    same = k[order][1:] == k[order][:-1]
    out = np.zeros(len(k), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts of each text."""
    n = len(offs) - 1
    starts, ends, rows = ragged.words(data, offs)
    h = ragged.span_hashes(data, starts, ends)
    g, at = ragged.grams(h, rows, 3)
    twice = repeated(g, at)
    inside = np.zeros(len(h), bool)
    first = ragged.take_runs(rows[:-1], np.diff(at))[twice]
    for k in range(3):
        inside[first + k] = True
    cuts = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    return {
        "n_words": np.diff(rows),
        "word_chars": ragged.row_sums(ragged.code_points(data, starts, ends), rows).astype(np.int64),
        "n_symbols": cuts[offs[1:]] - cuts[offs[:-1]],
        "n_dup_lines": duplicate_lines(data, offs, n),
        "n_repeat_words": ragged.row_sums(inside, rows).astype(np.int64),
    }


def duplicate_lines(data: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Lines (split at line feeds) that have a word and equal an earlier line of their text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    solid = np.concatenate([[0], np.cumsum(~ragged._SPACE[data])])
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offs, starts, "right") - 1
    k = ragged.mix(ragged.span_hashes(data, starts, ends) ^ ragged.mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(k, return_index=True)
    later = np.ones(len(k), bool)
    later[first] = False
    return np.bincount(row[later], minlength=n)


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])


def train(docs: DataFrame, labels: DataFrame) -> linear.Model | None:
    """The classifier, or None where no label row helps."""
    rows = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    if rows.isEmpty():
        return None
    return linear.fit_on(docs, rows, 2, SAMPLE_ROWS)


def assess(docs: DataFrame, model: linear.Model | None) -> DataFrame:
    """docs with the rule columns appended (columns of docs by the same names are replaced)."""
    names = [f.split()[0] for f in RULES.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(kept)
    schema = StructType(source.schema.fields + StructType.fromDDL(RULES).fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ragged.chunks(batches, "text"):
            data, offs = ragged.buffer_of(b["text"])
            c = base_counts(data, offs)
            failed = base_failed(c)
            p = model.probabilities(data, offs)[:, 1] if model is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c[k].astype(np.int64)) for k in names[:5]), pa.array(failed), pa.array(p), pa.array(~failed & (p >= MIN_PROBABILITY))], [*b.schema.names, *names])

    return ragged.map_batches(source, work, schema)
