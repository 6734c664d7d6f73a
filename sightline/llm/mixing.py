"""Mixing to target weights by soft membership: document rates whose expected domain tokens meet the targets.

A classifier fitted on a labelled table gives each document posteriors p over the domains. With n its words and r its
rate, the expected tokens of domain d are the sum of r * n * p[d], and the squared distance to the targets is minimized
over 0 <= r <= limit. Where the posteriors' moments are even, projected gradient descent with momentum does it. Where they
aren't, or the descent ends beyond TOLERANCE of a target, Newton steps on the dual do: of the rates of least distance,
those nearest to 1 are clip(1 + p . x) with one number x[d] a domain, see solve(). Documents of equal posteriors have equal
rates either way: posteriors are rounded to thousandths that sum to one (each is less than a thousandth off), and each round is one
aggregation over their distinct values, of three domains some 500 000 at most whatever the number of documents. Targets that aren't met within TOLERANCE are logged.
A document's copies are its rate's whole part and one more where a hash of its id falls below the rest, so runs agree.

Defined cases: a null or empty text has no words, weighs nothing and gets the rate of its posteriors; without labelled
rows the posteriors are even; an unreachable target is met as nearly as the limits allow, and logged; weights are scaled to sum to 1;
a null id draws from the hash of an empty one; equal texts get equal rates, and rows of one id one draw; the result has a row for
each of docs, with doc_id and the columns made here: texts and further columns are not carried along.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.llm import linear, ragged
from sightline.runtime import discard, materialize

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 3000
DIGITS, ROUNDS = 3, 40
#: Share of a target that its total may be off; moments whose eigenvalues differ by more are beyond the descent.
TOLERANCE, UNEVEN = 1e-3, 8.0
#: Weights of the distance from 1 against that to the targets, as shares of the words; the last one counts.
WEIGHTS = (1e-1, 1e-3, 1e-5, 1e-7, 1e-9)

LOG = logging.getLogger(__name__)


def posteriors(docs: DataFrame, model: linear.Model | None, domains: int) -> DataFrame:
    """docs with n_tokens (words) and posterior, an array of thousandths."""
    source = docs.select([c for c in docs.columns if c not in ("n_tokens", "posterior")])
    schema = StructType(source.schema.fields + StructType.fromDDL("n_tokens long, posterior array<short>").fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ragged.chunks(batches, "text"):
            data, offs = ragged.buffer_of(b["text"])
            p = model.probabilities(data, offs) if model is not None else np.full((b.num_rows, domains), 1 / domains)
            q = thousandths(p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, domains, dtype=np.int32)), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(ragged.words(data, offs)[2])), lists], schema.names)

    return ragged.map_batches(source, work, schema)


def thousandths(p: np.ndarray) -> np.ndarray:
    """Probabilities in units of 10 ** -DIGITS that sum to one in each row: the largest remainders are rounded up, ties in order."""
    q = np.floor(p * 10**DIGITS + 1e-9)
    order = np.argsort(np.argsort(q - p * 10**DIGITS, axis=1, kind="stable"), axis=1)
    return (q + (order < 10**DIGITS - q.sum(1, keepdims=True))).astype(np.int16)


def off_target(got: np.ndarray, targets: np.ndarray, words: float) -> float:
    """The largest distance of a total to its target, as a share of that (of the words where the target is 0)."""
    return float((np.abs(got - targets) / np.where(targets > 0, targets, words)).max())


def solve(totals: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], targets: np.ndarray, words: float) -> np.ndarray:
    """x for which the rates clip(1 + p . x) are optimal; totals(x) gives their totals and the moments of unclipped ones.

    Minimized is |targets - totals|**2 / 2 + w / 2 * sum of n * (r - 1)**2, whose optimum has x = (targets - totals) / w. w
    falls through WEIGHTS, and each Newton step is shortened until the dual's slope along it has fallen by half or turned.
    """
    x = np.zeros(len(targets))
    got, m = totals(x)
    for w in WEIGHTS:
        w *= words
        for _ in range(100):
            if off_target(got + w * x, targets, words) <= TOLERANCE / 10:
                break
            g = got - targets + w * x
            step = -np.linalg.solve(m + w * np.eye(len(x)), g)
            slope, size = -(g @ step), 1.0
            while True:
                got, m = totals(x + size * step)
                ahead = (got - targets + w * (x + size * step)) @ step
                if ahead <= 0.5 * slope or size < 1e-12:
                    break
                size *= min(0.5, max(0.1, slope / (slope + ahead)))
            x = x + size * step
        else:
            LOG.warning("mixing: no optimum of weight %g after 100 steps", w / words)
    return x


def fit_rates(scored: DataFrame, weights: list[float], limit: float | None, total: float | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(steps, targets): the steps in posterior space from which each rate follows, and the target totals.

    The steps are the descent's, or a single one from solve(). One aggregation a round over the distinct posteriors; only sums by domain come to the driver.
    """
    d = len(weights)
    groups = materialize(scored.groupBy("posterior").agg(F.sum("n_tokens").cast("double").alias("n")).filter("n > 0"), "posteriors")
    p = [F.element_at("posterior", k + 1) / 10.0**DIGITS for k in range(d)]
    moments = groups.agg(F.coalesce(F.sum("n"), F.lit(0.0)), *[F.coalesce(F.sum(F.col("n") * p[i] * p[j]), F.lit(0.0)) for i in range(d) for j in range(i, d)]).first()
    words = moments[0]
    share = np.array(weights, float) / sum(weights)
    targets = share * (words if total is None else total)
    if not words:
        discard(groups)
        return np.zeros((0, d)), targets
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = moments[1:]
    m = np.maximum(m, m.T)
    low, *_, high = np.linalg.eigvalsh(m)
    eta = 1 / high
    steps: list[np.ndarray] = []

    def totals(r: Column) -> np.ndarray:
        return np.array(groups.agg(*[F.sum(F.col("n") * r * p[k]) for k in range(d)]).first(), float)

    def with_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = sum((p[k] * float(x[k]) for k in range(d)), F.lit(1.0))
        free = (y > 0) if limit is None else (y > 0) & (y < float(limit))
        r = rate(F.col("posterior"), x[None, :], limit)
        sums = groups.select("n", "posterior", r.alias("r"), free.cast("double").alias("free")).agg(
            *[F.sum(F.col("n") * F.col("r") * p[k]) for k in range(d)], *[F.sum(F.col("n") * F.col("free") * p[i] * p[j]) for i in range(d) for j in range(i, d)]
        ).first()
        own = np.zeros((d, d))
        own[np.triu_indices(d)] = sums[d:]
        return np.array(sums[:d], float), np.maximum(own, own.T)

    if high <= UNEVEN * low:
        for _ in range(rounds):
            step = eta * (targets - totals(rate(F.col("posterior"), np.array(steps).reshape(-1, d), limit, ahead=True)))
            steps.append(step)
            if np.abs(step).max() < 1e-7:
                break
        got = totals(rate(F.col("posterior"), np.array(steps), limit))
    if not steps or off_target(got, targets, words) > TOLERANCE:
        steps = [solve(with_moments, targets, words)]
        got = with_moments(steps[0])[0]
    discard(groups)
    report = LOG.warning if off_target(got, targets, words) > TOLERANCE else LOG.info
    report("mixing: shares %s for targets %s, in tokens %s for %s", got / words, share, got, targets)
    return np.array(steps), targets


def rate(posterior: Column, steps: np.ndarray, limit: float | None, ahead: bool = False) -> Column:
    """The rate after the steps, as one expression: r' = clip(y + p . step), with y the rate plus its momentum.

    ahead=True gives the point y at which the next gradient is taken.
    """
    if not len(steps):
        return F.lit(1.0)
    d = steps.shape[1]
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    numbered = F.arrays_zip(rows.alias("s"), F.sequence(F.lit(0), F.lit(len(steps) - 1)).alias("t"))
    pull = lambda s: sum((F.element_at(posterior, k + 1) / 10.0**DIGITS * F.element_at(s, k + 1) for k in range(d)), F.lit(0.0))

    def move(acc: Column, x: Column) -> Column:
        new = F.greatest(acc["y"] + pull(x["s"]), F.lit(0.0))
        new = new if limit is None else F.least(new, F.lit(float(limit)))
        return F.struct(new.alias("r"), (new + (new - acc["r"]) * (x["t"] / (x["t"] + 3.0))).alias("y"))

    last = F.aggregate(numbered, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), move)
    return last["y"] if ahead else last["r"]


def mix(docs: DataFrame, labelled: DataFrame, weights: list[float], limit: float | None = None, total: float | None = None) -> DataFrame:
    """docs with n_tokens, posterior, rate and n_copies; labelled is (doc_id, label) with labels from 0.

    weights are the target shares of the domains, total the target tokens (the corpus's own by default).
    """
    model = None if labelled.isEmpty() else linear.fit_on(docs, labelled, len(weights), SAMPLE_ROWS, linear.FEW)
    scored = materialize(posteriors(docs.select("doc_id", "text"), model, len(weights)).drop("text"), "scored")
    steps, _ = fit_rates(scored, weights, limit, total)
    draw = (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)).cast("double") + 2.0**63) / 2.0**64
    rated = scored.withColumn("rate", rate(F.col("posterior"), steps, limit))
    return rated.withColumn("n_copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the table (doc_id, quality, toxic): 0 clean, 1 low quality, 2 toxic."""
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 0)
    return labels.select("doc_id", label.alias("label")).filter("label is not null")
