"""Checks on streams: findings, windowed counts, repeated keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import Rule, run_rules


def findings_stream(stream: DataFrame, rules: Iterable[Rule], row_id: str = "row_id", dataset: str = "data") -> DataFrame:
    """Findings of row-local rules on a stream: the same single projection as on a table, without state."""
    return run_rules(stream, rules, row_id, dataset)


def sink_findings(findings: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Write a findings stream to files, exactly once."""
    writer = findings.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_quality(
    stream: DataFrame, rules: Iterable[Rule], time: str, window: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Rows and findings per rule and tumbling window; rows later than ``lateness`` are dropped by the watermark.

    Conditions become counters of one aggregate, so a row is not exploded and the state is one row per window.
    """
    listed = list(rules)
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    counted = timed.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(r.bad).alias(f"__{i}") for i, r in enumerate(listed)]
    )
    per_rule = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"__{i}").alias("findings")) for i, r in enumerate(listed)])
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_rows",
        F.explode(per_rule).alias("r"),
    ).select("window_start", "window_end", "n_rows", "r.*")


class _SeenBefore(StatefulProcessor):
    """Keeps the first row id of a key, for as long as the state lives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "row_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen = self.first.exists()
        first = self.first.get()[0] if seen else None
        for batch in rows:
            ids = [None if i is None else int(i) for i in batch["row_id"]]
            if not seen and ids:
                seen, first, ids = True, ids[0], ids[1:]
                self.first.update((first,))
            if ids:
                yield pd.DataFrame({"row_id": pd.array(ids, dtype="Int64"), "first_id": pd.array([first] * len(ids), dtype="Int64")})

    def close(self) -> None:
        pass


class _SeenWithin(_SeenBefore):
    ttl_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "row_id bigint", ttlDurationMs=self.ttl_ms)


def repeated_keys(stream: DataFrame, keys: list[str], row_id: str = "row_id", ttl_ms: int | None = None) -> DataFrame:
    """Later rows of a key on a stream: ``row_id, first_id``, in order of arrival.

    Needs the RocksDB state store.  ``ttl_ms`` forgets a key after that time, which bounds the state.  Only the row id
    travels with the key, as text, so a null id stays null and a large one exact; the rows of a key pass through in chunks and are
    never held together.
    """
    slim = stream.select(*[F.col(k) for k in keys], F.col(row_id).cast("bigint").cast("string").alias("row_id"))
    processor: StatefulProcessor = _SeenBefore()
    if ttl_ms:
        processor = _SeenWithin()
        processor.ttl_ms = ttl_ms
    return slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="row_id bigint, first_id bigint", outputMode="append",
        timeMode="processingTime" if ttl_ms else "none",
    )


def first_rows(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The stream without rows that repeat a key within ``lateness`` of its first one: keep-first on streams.

    A key is forgotten once the watermark has passed it, so the state holds the keys of that span alone.  Rows without a time, and
    rows later than the watermark, are dropped by Spark; rows with equal null keys are copies of one another.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.dropDuplicatesWithinWatermark(keys)
