"""A19 with TTL on a stream: names that are dropped often enough become a domain's labels, at most ``cap`` of them.

Two stateful steps. The first has a state for each name of a domain, so a domain that most names belong to is dealt over
all tasks: it counts, remembers when the name was last seen, and has an event-time timer that forgets it ``ttl`` later.
Only names that have reached the threshold go on. The second has a map a domain of no more than ``cap`` labels: a label
comes in, and beyond the cap the one that was seen least recently goes. Where a dropped name came with a type, the type
is the label, and keeps the names that led to it.

What comes out is the history of the sets: promoted, evicted (by the cap) and expired (by the timer). The last word on
each label gives the set, and the batch operators ``labels.candidates`` and ``labels.promote`` give the same one for the
same rows. An evicted label comes back when its name is seen again.

Needs the state store that keeps map states (``prepare`` sets it). Rows without a time, domain or plausible name are no
candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark import constants as C
from quillspark.functions import text as T

SEEN = "domain string, key string, label string, type string, occurrences long, seen timestamp, live boolean"
HISTORY = "domain string, label string, action string, occurrences long, names array<string>, seen timestamp"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Names(StatefulProcessor):
    """Counts a name of a domain; says so from ``least`` times on, and when it has not been seen for ``ttl_ms``."""

    def __init__(self, least: int, ttl_ms: int | None) -> None:
        self.least, self.ttl_ms = least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "label string, type string, first long, n long, last long")

    def _row(self, key: tuple, label: str, kind: str | None, n: int, last: int, live: bool) -> pd.DataFrame:
        seen = pd.Series(pd.to_datetime([last], unit="ms", utc=True)).dt.tz_localize(None)
        return pd.DataFrame({"domain": [key[0]], "key": [key[1]], "label": [label], "type": [kind], "occurrences": [n], "seen": seen, "live": [live]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the engine's names
        label, kind, first, n, last = self.seen.get() if self.seen.exists() else (None, None, None, 0, 0)
        for batch in rows:
            n += len(batch)
            for at, name, other in zip((batch["seen"].astype("datetime64[ms]").astype("int64")).tolist(), batch["name"], batch["type"], strict=True):
                if first is None or (at, name) < (first, label):
                    first, label = at, name
                last = max(last, at)
                kind = kind or other
        self.seen.update((label, kind, first, n, last))
        if self.ttl_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.ttl_ms)
        if n >= self.least:
            yield self._row(key, label, kind, n, last, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            label, kind, _, n, last = self.seen.get()
            self.seen.clear()
            if n >= self.least:
                yield self._row(key, label, kind, n, last, False)

    def close(self) -> None:
        return


class Labels(StatefulProcessor):
    """A domain's labels: a map of at most ``cap``, the least recently seen goes first."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "label string", "key string, n long, last long, names array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: [v[0], v[1], v[2], list(v[3])] for k, v in self.active.iterator()}
        before, out = {k: (v[2], len(v[3])) for k, v in held.items()}, []
        said = pd.concat(list(rows)).sort_values(["live", "seen", "occurrences", "key"], ascending=[False, True, True, False])
        for r in said.itertuples(index=False):
            label, last = r.type or r.label, int(r.seen.timestamp() * 1000)
            if not r.live:
                # A label of a type stays while another of its names is there; it was seen later then.
                if label in held and held[label][2] <= last:
                    out.append((label, "expired", held.pop(label)))
                continue
            key_, n, seen, names = held.get(label, [r.key, 0, 0, []])
            new = label not in held
            held[label] = [min(key_, r.key), max(n, r.occurrences), max(seen, last), sorted({*names, r.label})]
            if new:
                out.append((label, "promoted", held[label]))
            if len(held) > self.cap:
                worst = min(held, key=lambda k: (held[k][2], held[k][1], [-ord(c) for c in held[k][0]]))
                gone = held.pop(worst)
                if worst == label and new:
                    out.pop()  # it never was among them
                else:
                    out.append((worst, "evicted", gone))
        for k in before:
            if k not in held:
                self.active.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != (v[2], len(v[3])):
                self.active.updateValue((k,), (v[0], int(v[1]), v[2], v[3]))
        if out:
            seen = pd.Series(pd.to_datetime([v[2] for *_, v in out], unit="ms", utc=True)).dt.tz_localize(None)
            yield pd.DataFrame({"domain": key[0], "label": [x[0] for x in out], "action": [x[1] for x in out], "occurrences": [v[1] for *_, v in out], "names": [v[3] for *_, v in out], "seen": seen})

    def close(self) -> None:
        return


def label_history(dropped: DataFrame, least: int = C.PROMOTE_AT, cap: int = C.LABEL_CAP, ttl_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """(domain, label, action, occurrences, names, seen) from a stream of dropped names (domain, name, type, seen)."""
    prepare(dropped.sparkSession)
    name = T.strip(F.col("name"))
    plausible = dropped.where(T.plausible_entity(F.col("name")) & F.col("seen").isNotNull() & F.col("domain").isNotNull())
    named = plausible.select("domain", F.lower(name).alias("key"), name.alias("name"), "type", "seen").withWatermark("seen", late)
    mode = "EventTime" if ttl_ms else "None"
    seen = named.groupBy("domain", "key").transformWithStateInPandas(Names(least, ttl_ms), SEEN, "Append", mode)
    return seen.groupBy("domain").transformWithStateInPandas(Labels(cap), HISTORY, "Append", "None")
