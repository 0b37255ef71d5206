"""Event-sourced golden entries: log ingestion, fold into current state, and changes as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: reviewers' levels from the highest; entries without a human review are 'synthetic'.
LEVELS = ["expert", "phd", "masters", "bachelors", "other"]


def first_of_each(events: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """The first row of each key."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def new_events(log: DataFrame, batch: DataFrame) -> DataFrame:
    """What an idempotent append adds: first occurrences whose id the log lacks."""
    return first_of_each(batch).join(log.select("event_id"), "event_id", "left_anti")


def fold(events: DataFrame) -> DataFrame:
    """Current state of each entry from (entry_id, event_id, event_type, ts, valid_created, level).

    Events apply in the order of (ts, event_id). The last valid 'created' starts
    the entry anew; reviews and deprecations before it, or without one, are left
    out. A deprecation is a review too. One shuffle by entry_id.
    """
    made = (F.col("event_type") == "created") & F.col("valid_created")
    at = F.struct("ts", "event_id")
    rows = events.withColumn("at", at).withColumn("born", F.max(F.when(made, at)).over(Window.partitionBy("entry_id"))).where(F.col("at") >= F.col("born"))
    changes = F.col("event_type").isin("reviewed", "deprecated")
    chain = F.sort_array(F.collect_list(F.when(changes, F.struct("at", "event_type", "level"))))
    state = rows.groupBy("entry_id").agg(F.max("born.event_id").alias("created_event"), chain.alias("review_chain"), F.max(F.col("event_type") == "deprecated").alias("deprecated"))
    return state.withColumn("level", highest_level(F.col("review_chain")))


def highest_level(chain):
    """The highest level among reviews that have one."""
    rank = F.array_min(F.transform(F.filter(chain, lambda r: r["level"].isNotNull()), lambda r: F.array_position(F.array(*map(F.lit, LEVELS)), r["level"])))
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), (rank - 1).cast("int")), F.lit("synthetic"))


def active(state: DataFrame) -> DataFrame:
    return state.where(~F.col("deprecated"))


def orphans(events: DataFrame) -> DataFrame:
    """Reviews and deprecations of entries that no valid 'created' precedes."""
    made = F.when((F.col("event_type") == "created") & F.col("valid_created"), F.struct("ts", "event_id"))
    first = F.min(made).over(Window.partitionBy("entry_id"))
    return events.withColumn("first", first).where(F.col("event_type").isin("reviewed", "deprecated") & (F.col("first").isNull() | (F.struct("ts", "event_id") < F.col("first")))).drop("first")


def refine(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Two events for each (entry_id, new_id) whose entry is there and active: 'created' of the new entry, 'deprecated' of the old."""
    good = requests.join(active(state).select("entry_id"), "entry_id")
    both = F.array(F.struct(F.col("new_id").alias("entry_id"), F.lit("created").alias("event_type"), F.col("entry_id").alias("refines")), F.struct(F.col("entry_id"), F.lit("deprecated").alias("event_type"), F.lit(None).cast("long").alias("refines")))
    return good.select(F.explode(both).alias("e")).select("e.*")
