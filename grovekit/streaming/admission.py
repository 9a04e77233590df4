"""Admission state over streams of check and review events.

A change may go in if it has an approval, nobody asks for changes, and every required check's latest
result is a success. Arrival order is what counts; late data isn't put back in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "names array<string>, states array<string>"
OUT = "change string, admissible boolean, approvals long, failing long"


def batch(events: DataFrame, required: list[str], order: list[str]) -> DataFrame:
    """The state after all events (change, kind, name, state, <order>): the latest of each name decides."""
    last = events.groupBy("change", "kind", "name").agg(F.max_by("state", F.struct(*order)).alias("state"))
    return last.groupBy("change").agg(*_verdict(F.col("kind"), F.col("name"), F.col("state"), required)).select("change", F.expr("approvals > 0 and refusals = 0 and passing = needed").alias("admissible"), "approvals", F.expr("needed - passing").alias("failing"))


def _verdict(kind: Column, name: Column, state: Column, required: list[str]) -> list[Column]:
    review, check = kind == "review", (kind == "check") & name.isin(required)
    return [F.count_if(review & (state == "approved")).alias("approvals"), F.count_if(review & (state == "changes_requested")).alias("refusals"), F.count_if(check & (state == "success")).alias("passing"), F.lit(len(required)).cast("long").alias("needed")]


def stream(events: DataFrame, required: list[str]) -> DataFrame:
    """The same state kept by change over a stream of (change, kind, name, state); a row each time a change has news."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*map(list, state.get), strict=True)) if state.exists else {}
        for pdf in frames:
            for r in pdf.itertuples():
                held[f"{r.kind}\t{r.name}"] = r.state
        state.update((list(held), list(held.values())))
        reviews = [s for k, s in held.items() if k.startswith("review\t")]
        approvals = reviews.count("approved")
        failing = sum(held.get(f"check\t{name}") != "success" for name in required)
        yield pd.DataFrame({"change": [key[0]], "admissible": [approvals > 0 and "changes_requested" not in reviews and not failing], "approvals": [approvals], "failing": [failing]})

    return events.groupBy("change").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def typed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Webhook texts to (change, kind, name, state); other events are dropped."""
    body = F.from_json(column, "action string, number long, check_run struct<name:string,conclusion:string>, review struct<state:string,user:struct<login:string>>")
    e = raw.select(body.alias("e")).select("e.*")
    kind = F.when(F.col("check_run").isNotNull(), "check").when(F.col("review").isNotNull(), "review")
    state = F.when(kind == "check", F.coalesce("check_run.conclusion", F.lit("pending"))).otherwise(F.when(F.col("action") == "dismissed", "dismissed").otherwise(F.lower("review.state")))
    return e.select(F.col("number").cast("string").alias("change"), kind.alias("kind"), F.coalesce("check_run.name", "review.user.login").alias("name"), state.alias("state")).where("kind is not null and change is not null")


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """An extension beyond arrival order: repeats within a watermark are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, keys: list[str], length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """An extension: counts in tumbling windows, final once the watermark has passed."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))
