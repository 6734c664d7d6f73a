"""Extension points: metrics, datasets, query filters and embedders by name, and the evaluation that runs over them."""

from __future__ import annotations

import functools
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import metrics


@dataclass
class Sequences:
    """What a metric is given: truth (seq, t, gt_id), found (seq, t, tk_id) and the pairs sim (seq, t, gt_id, tk_id, sim)."""

    truth: DataFrame
    found: DataFrame
    sim: DataFrame
    keys: list[str]


class Metric(ABC):
    """A metric of tracks: a table a sequence, and how tables of sequences and of classes become one."""

    name: str

    @abstractmethod
    def sequences(self, data: Sequences) -> DataFrame:
        """One row a sequence and threshold."""

    @abstractmethod
    def combined(self, per_sequence: DataFrame, keys: list[str]) -> DataFrame:
        """Sequences of equal keys as one, each weighed by its detections."""

    @abstractmethod
    def class_average(self, per_class: DataFrame, ignore_empty: bool = True) -> DataFrame:
        """Plain means over classes."""


class Dataset(ABC):
    """Where sequences come from."""

    @abstractmethod
    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Truth and predictions as they are."""

    @abstractmethod
    def preprocess(self, truth: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that are evaluated."""

    @abstractmethod
    def similarity(self, truth: DataFrame, found: DataFrame) -> Sequences:
        """The sides with their pairs."""

    def sequences(self, spark: SparkSession) -> Sequences:
        return self.similarity(*self.preprocess(*self.load(spark)))


class Hota(Metric):
    name = "hota"

    def sequences(self, data: Sequences) -> DataFrame:
        return metrics.hota(data.truth, data.found, data.sim, data.keys)

    def combined(self, per_sequence: DataFrame, keys: list[str]) -> DataFrame:
        return metrics.combine(per_sequence, keys)

    def class_average(self, per_class: DataFrame, ignore_empty: bool = True) -> DataFrame:
        return metrics.class_average(per_class, ignore_empty)


METRICS: dict[str, Metric] = {"hota": Hota()}


def register_metric(metric: Metric) -> Metric:
    """Make a metric known by its name; a name is given once."""
    if metric.name in METRICS:
        raise ValueError(f"a metric is called {metric.name!r} already")
    METRICS[metric.name] = metric
    return metric


def evaluate(names: Iterable[str], data: Sequences, keys: list[str]) -> dict[str, DataFrame]:
    """For each metric the sequences of equal keys as one."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"no metric {unknown}; there are {sorted(METRICS)}")
    return {n: METRICS[n].combined(METRICS[n].sequences(data), keys) for n in names}


#: A filter takes queries and gives the ids (key columns) of those that go.
Filter = Callable[[DataFrame], DataFrame]


def apply_filters(queries: DataFrame, keys: list[str], filters: Iterable[Filter]) -> DataFrame:
    """The queries left by filters one after another, each of which sees what the ones before it left."""
    for f in filters:
        queries = queries.join(f(queries).select(*keys).distinct(), keys, "left_anti")
    return queries


def with_text_in(text: str, words: Iterable[str]) -> Filter:
    """Drops queries of these texts."""
    return lambda q: q.filter(F.col(text).isin(*words))


def beyond(most: int, per: list[str], order: list, positive: str | None = None) -> Filter:
    """Drops queries beyond the first `most` of a group, by order; those whose column `positive` holds all stay if it is given."""
    from pyspark.sql import Window

    def drop(q: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*per).orderBy(*([F.desc(positive)] if positive else []), *order))
        ranked = q.withColumn("_place", place).filter(F.col("_place") > most)
        return ranked.filter(~F.coalesce(F.col(positive), F.lit(False))) if positive else ranked

    return drop


EMBEDDERS: dict[str, Callable[[], Callable]] = {}


def register_embedder(name: str, make: Callable[[], Callable]) -> None:
    """Make an embedder known: make() gives a function from a batch of crops to vectors, and is called once a process."""
    EMBEDDERS[name] = make
    embedder.cache_clear()


@functools.lru_cache(maxsize=8)
def embedder(name: str) -> Callable:
    if name not in EMBEDDERS:
        raise KeyError(f"no embedder {name!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]()
