"""Publication of candidates as a stream: unchanged snapshots write nothing, a bad batch leaves the last valid state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Publisher(StatefulProcessor):
    """Keeps each key's snapshot; emits every candidate with its outcome, in order of seq within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("snapshot", "snapshot string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        outcome = []
        for snapshot in batch["snapshot"]:
            outcome.append("unchanged" if before is not None and snapshot == before else "published")
            before = snapshot
        self.last.update((before,))
        yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "snapshot": batch["snapshot"], "outcome": outcome})

    def close(self) -> None:
        pass


def outcomes(candidates: DataFrame) -> DataFrame:
    """A stream of candidates (key, seq, snapshot) with outcome. Needs the RocksDB state store."""
    return candidates.groupBy("key").transformWithStateInPandas(statefulProcessor=Publisher(), outputStructType="key long, seq long, snapshot string, outcome string", outputMode="append", timeMode="None")


def run_available(candidates: DataFrame, checkpoint: str, target: str) -> None:
    """Take all that has landed, append outcomes to the table folder target, and stop."""
    query = outcomes(candidates).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


A, B, C = TypeVar("A"), TypeVar("B"), TypeVar("C")


def paired(first: Callable[[], A], second: Callable[[], B]) -> tuple[A, B]:
    """Both results, read at the same time; if either fails, its error is raised, the first's before the second's."""
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(first), pool.submit(second)
        return a.result(), b.result()


def cycle(ingest: Callable[[], C], publish: Callable[[C], str], log: Callable[[dict], None]) -> str:
    """One scheduled update: the outcome of publishing what was ingested, or `failed`. Errors end here, so the last valid state stays and the
    next cycle runs; only their code is logged, UNEXPECTED_ERROR where they have none."""
    try:
        outcome = publish(ingest())
    except Exception as error:
        log({"event": "update_failed", "code": getattr(error, "code", None) or "UNEXPECTED_ERROR", "source": getattr(error, "source", None)})
        return "failed"
    log({"event": "update_done", "outcome": outcome})
    return outcome
