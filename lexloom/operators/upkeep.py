"""What an editor keeps between builds, as filters and folds: panels, open files, queues of runs, a bounded cache, register edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import register as reg

COMPILE_RULE = "every file compiles without errors"
CACHE_BYTES, CACHE_FLOOR = 24 << 20, 4


def without_curated(backlog: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Backlog rows whose surface has not been dealt with."""
    return backlog.join(surfaces.select("surface").distinct(), "surface", "left_anti")


def replace_shard(entries: DataFrame, shard: str, fresh: DataFrame) -> DataFrame:
    """entries (shard, surface, ...) with one shard's rows gone and fresh ones in."""
    return entries.filter(F.col("shard") != shard).unionByName(fresh)


def patched_panel(entries: DataFrame, backlog: DataFrame, shard: str, fresh: DataFrame, surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and backlog as shown until the next build: the shard swapped, curated rows gone, both marked stale."""
    stale = F.lit(True).alias("stale")
    return replace_shard(entries, shard, fresh).select("*", stale), without_curated(backlog, surfaces).select("*", stale)


def shown_violations(violations: DataFrame, open_paths: DataFrame) -> DataFrame:
    """Violations but for compile errors of open files, which the editor shows itself."""
    hidden = open_paths.select("path", F.lit(COMPILE_RULE).alias("rule")).distinct()
    return violations.join(hidden, ["rule", "path"], "left_anti")


def current_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results (panel, seq) of each panel's latest request; those of superseded ones are dropped."""
    latest = requests.groupBy("panel").agg(F.max("seq").alias("seq"))
    return results.join(latest, ["panel", "seq"], "left_semi")


def coalesced_runs(requests: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Runs (key, start, request) where each takes so many seconds, one at a time, and of the requests that come meanwhile the latest alone runs next.

    at is in seconds; requests of a key are folded in order within a row.
    """
    empty = F.array().cast("array<struct<start:bigint,request:bigint>>")
    times = F.sort_array(F.collect_set(F.col(at).cast("long")))
    pair = lambda start, request: F.struct(start.cast("long").alias("start"), request.cast("long").alias("request"))

    def step(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        waiting = F.size(runs) > 0
        # the last run may still wait for the one before it: a later request takes its place
        return (
            F.when(~F.coalesce(waiting, F.lit(False)) | (t > last["start"] + seconds), F.array_append(runs, pair(t, t)))
            .when(t <= last["start"], F.array_append(F.slice(runs, F.lit(1), F.size(runs) - 1), pair(last["start"], t)))
            .otherwise(F.array_append(runs, pair(last["start"] + seconds, t)))
        )

    runs = requests.groupBy(key).agg(F.aggregate(times, empty, step).alias("runs"))
    return runs.select(key, F.inline("runs"))


def resident(accesses: DataFrame, cache: str, entry: str, size: str, order: str, budget: int = CACHE_BYTES, floor: int = CACHE_FLOOR) -> DataFrame:
    """Entries that a least-recently-used cache of so many bytes holds after all accesses; the floor latest ones stay in any case."""
    last = accesses.groupBy(cache, entry).agg(F.max(order).alias("_last"), F.max_by(size, order).alias(size))
    recent = Window.partitionBy(cache).orderBy(F.col("_last").desc())
    ranked = last.withColumns({"_rank": F.row_number().over(recent), "_held": F.sum(size).over(recent.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.filter((F.col("_held") <= budget) | (F.col("_rank") <= floor)).select(cache, entry, size)


def serialised_edits(values: DataFrame, edits: DataFrame) -> DataFrame:
    """values (surface, value) after edits (seq, surface, value) one after the other; a null value removes. The last edit of a surface counts."""
    last = edits.groupBy("surface").agg(F.max_by(F.struct("value"), "seq").alias("last")).select("surface", "last.value")
    return reg.edit_entries(values, last.filter("value is not null"), last.filter("value is null"))


def reload_register(state: DataFrame, readings: DataFrame) -> DataFrame:
    """state (path, surface, ...) with the statuses that a changed register gives; documents are not read again."""
    known = readings.select("surface", F.lit(True).alias("_known")).distinct()
    return state.drop("status").join(known, "surface", "left").withColumn("status", F.when(F.col("_known"), "registered").otherwise("unaccounted")).drop("_known")


class Snapshot:
    """A register parsed once; what is derived from it is worked out when first asked for."""

    def __init__(self, entries: DataFrame):
        self.entries, self._held = entries, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def readings(self) -> DataFrame:
        return self._once("readings", lambda: reg.readings(self.entries))

    def expanded(self) -> DataFrame:
        return self._once("expanded", lambda: reg.expand(self.readings()))

    def variants(self) -> DataFrame:
        return self._once("variants", lambda: reg.variants(self.readings()))
