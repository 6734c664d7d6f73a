"""Interactive sessions as tables of requests: what is open, which objects are in it, and what the next propagation does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests of a session, and the actions that its propagations are decided by.
REQUESTS = ("start", "add", "remove", "reset", "close")
ACTIONS = ("add", "remove", "refine", "propagation_full", "propagation_partial", "propagation_fetch")


def session_states(requests: DataFrame, session: str, order: str) -> DataFrame:
    """(session, is_open, objects): the state after all requests (session, order, type, obj_id).

    A start or reset empties a session, a close ends it; objects added since and not removed after their last addition are in it.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "type", "obj_id"))).alias("r")
    g = requests.groupBy(session).agg(rows, F.max(F.when(F.col("type").isin("start", "reset"), F.col(order))).alias("fresh"), F.max(F.when(F.col("type") == "close", F.col(order))).alias("closed"))
    is_open = F.col("fresh").isNotNull() & (F.col("closed").isNull() | (F.col("closed") < F.col("fresh")))
    since = F.filter("r", lambda x: x["o"] > F.col("fresh"))
    # the last request about an object says whether it is there
    state = F.aggregate(since, F.array().cast("array<long>"), lambda acc, x: F.when(x["type"] == "add", F.array_union(acc, F.array(x["obj_id"].cast("long")))).when(x["type"] == "remove", F.array_except(acc, F.array(x["obj_id"].cast("long")))).otherwise(acc))
    return g.select(session, is_open.alias("is_open"), F.when(is_open, F.array_sort(state)).otherwise(F.array().cast("array<long>")).alias("objects"))


def next_propagation(actions: DataFrame, session: str, order: str, n_frames: str) -> DataFrame:
    """(session, kind, objects): what the next propagation does, from the actions (session, order, type, frame, objects, n_frames).

    Without any action all is propagated; that is the caller's default for sessions that aren't here. After a fetch, or a
    propagation that was the second in a row or began at the first or last frame, results are fetched; after another one the
    rest of the frames is done in its way. Otherwise the objects added or refined since the last propagation are propagated, or
    results fetched if there are none.
    """
    row = F.struct(F.col(order).alias("o"), "type", "frame", "objects")
    g = actions.groupBy(session).agg(F.array_sort(F.collect_list(row)).alias("r"), F.max(n_frames).alias("n"), F.max(F.when(F.col("type").startswith("propagation"), F.col(order))).alias("last_run"))
    last, before = F.element_at("r", -1), F.try_element_at("r", F.lit(-2))
    runs = ("propagation_partial", "propagation_full")
    fetched = F.coalesce(before["type"].isin(*runs), F.lit(False)) | last["frame"].isin(0) | (last["frame"] == F.col("n") - 1)
    since = F.filter("r", lambda x: (F.col("last_run").isNull() | (x["o"] > F.col("last_run"))) & x["type"].isin("add", "refine"))
    touched = F.array_sort(F.array_distinct(F.flatten(F.transform(since, lambda x: x["objects"]))))
    none = F.lit(None).cast("array<long>")
    kind = (
        F.when(last["type"] == "propagation_fetch", "propagation_fetch")
        .when(last["type"].isin(*runs), F.when(fetched, "propagation_fetch").otherwise(last["type"]))
        .when(F.size(touched) > 0, "propagation_partial").otherwise("propagation_fetch")
    )
    objects = F.when(last["type"].isin(*runs), F.when(~fetched, last["objects"])).when(last["type"].startswith("propagation"), none).when(F.size(touched) > 0, touched)
    return g.select(session, kind.alias("kind"), objects.alias("objects"))
