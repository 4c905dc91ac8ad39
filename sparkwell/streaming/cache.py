"""A semantic cache as a stream: each index's entries are state, looked up, expired and pushed out as requests come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import semantic_cache as sc

REQUEST = (
    "request_id bigint, at timestamp, index_id bigint, op string, version string, context string, query string, embedding array<double>,"
    " ttl_ms bigint, threshold double"
)
RESULT = (
    "request_id bigint, index_id bigint, op string, hit boolean, entry_id bigint, cache_key string, similarity double, threshold double, reason string,"
    " hits bigint, evicted bigint, held bigint"
)
_ENTRY = "entry_id bigint, at_ms bigint, ttl_ms bigint, version string, context string, cache_key string, embedding binary, hits bigint"


class Cache(StatefulProcessor):
    """One index: a map from an entry's number to the entry, and the number of the next.

    Entries are at most ``most``, since each put takes the oldest one beyond that away. A timer at the latest expiry of what an index
    holds clears indexes that nobody uses any more, so that state does not grow with the number of indexes ever seen.
    """

    def __init__(self, most: int = sc.MOST_ENTRIES, clear: bool = True):
        self.most, self.clear = most, clear

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "number bigint", _ENTRY)
        self.next = handle.getValueState("next", "number bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: list(v) for k, v in self.entries.iterator()}
        before, touched = set(held), set()
        number = self.next.get()[0] if self.next.exists() else 0
        out = []
        frame = pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable")
        for r in frame.itertuples(index=False):
            at = int(r.at.timestamp() * 1000)
            if r.op == "put":
                number += 1
                held[number] = [r.request_id, at, int(r.ttl_ms), r.version, r.context, r.cache_key, np.array(r.embedding, "<f8").tobytes(), 0]
                touched.add(number)
                gone = sorted(held)[: max(0, len(held) - self.most)]
                for k in gone:
                    del held[k]
                out.append(self._row(r, key, evicted=len(gone), held=len(held)))
            elif r.op == "invalidate":
                gone = [k for k, e in held.items() if r.version is None or e[3] == r.version]
                for k in gone:
                    del held[k]
                out.append(self._row(r, key, evicted=len(gone), held=len(held)))
            else:
                out.append(self._look(r, key, held, at, touched))
        for k in before - set(held):
            self.entries.removeKey((k,))
        for k in touched & set(held):
            self.entries.updateValue((k,), tuple(held[k]))
        self.next.update((number,))
        if self.clear:
            self._set_timer(held, timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    def _row(self, r, key, **more):
        found = {"hit": None, "entry_id": None, "cache_key": None, "similarity": None, "threshold": None, "reason": None, "hits": None, "evicted": 0, "held": 0} | more
        return [r.request_id, key[0], r.op, *found.values()]

    def _look(self, r, key, held, at, touched):
        best = None
        mine = np.array(r.embedding, float)
        for k in sorted(held, reverse=True):  # the newest of equals
            e = held[k]
            if at - e[1] > e[2] or e[3] != r.version or e[4] != r.context:
                continue
            similarity = _cosine(mine, np.frombuffer(e[6], "<f8"))
            if best is None or similarity > best[0]:
                best = similarity, k
        if best is None:
            return self._row(r, key, hit=False, threshold=r.threshold, reason=sc.NO_MATCH if held else sc.NO_ENTRIES, held=len(held))
        entry = held[best[1]]
        hit = bool(best[0] >= r.threshold)
        if hit:
            entry[7] += 1
            touched.add(best[1])
        return self._row(
            r, key, hit=hit, entry_id=entry[0], cache_key=entry[5], similarity=best[0], threshold=r.threshold, reason=sc.HIT if hit else sc.BELOW, hits=entry[7], held=len(held)
        )

    def _set_timer(self, held, timerValues) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if held:
            at = max(max(e[1] + e[2] for e in held.values()) + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All entries have expired: they can never be found again."""
        self.entries.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b):
        return 0.0
    size = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    return float((a * b).sum()) / size if size > 0 else 0.0


def cached(requests: DataFrame, *, most: int = sc.MOST_ENTRIES, ttl_ms: int = sc.TTL_MS, threshold: float = sc.THRESHOLD, late: str = "1 hour", clear: bool = True) -> DataFrame:
    """Every request's outcome (RESULT) from a stream of REQUEST rows; write it in append mode.

    The rules are those of ``operators.semantic_cache.lookups``, but an invalidated version's entries leave their places at once. Requests of one
    batch take effect in the order of time, those of later batches after them. Puts and invalidations tell how many entries went, lookups how often their
    entry was hit. With ``clear``, an index all of whose entries have expired loses its state, ``late`` after that. Rows later than ``late`` are dropped.
    The state store must be RocksDB: ``spark.sql.streaming.stateStore.providerClass``.
    """
    version = F.when(F.col("op") == "invalidate", F.col("version")).otherwise(F.coalesce("version", F.lit("")))
    context, text = sc.context_hash(F.col("context")), F.coalesce("query", F.lit(""))
    rows = requests.withWatermark("at", late).select(
        "request_id", "at", "index_id", "op", version.alias("version"), context.alias("context"), sc.cache_key(text, F.col("index_id"), context, version).alias("cache_key"),
        F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"), F.coalesce("ttl_ms", F.lit(ttl_ms)).alias("ttl_ms"), F.coalesce("threshold", F.lit(threshold)).alias("threshold"),
    )
    return rows.groupBy("index_id").transformWithStateInPandas(Cache(most, clear), RESULT, "Append", "EventTime" if clear else "None")
