"""Numbering over a scope (a conversation, a source) on a stream: keyed state that outlives batches and restarts.

What a batch job does with ranks (``operators.scope``) a stream does with state: for each scope the numbers that its
entities have so far, in order of arrival. Spans are found, settled and normalised by the native expressions before the
state; the state only hands out numbers and puts tags in place of spans. A type's only entity keeps its number
(``[EMAIL_1]``), since a stream can't know what is to come; ``number_entities(always_numbered=True)`` gives the same tags
on a table.

State per scope: one entry per entity (type and normal form to number, a map that RocksDB keeps on disk, so a scope of any
size is not held in memory) and one counter per type. With ``idle`` a timer forgets a scope that had no text for that long
(processing time); a later text of it starts at 1 again. Within a batch a scope's texts are taken in the order of ``order``.

Nulls and ties: NULL is a scope like any other; NULL and blank texts come out empty, with no entities; texts with equal
order are taken by text. Late texts get the next free numbers: tags handed out never change.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanveil.functions.checks import normal_value
from spanveil.functions.text import is_blank
from spanveil.operators.redact import detect

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTITIES = "array<struct<tag:string,type:string,value:string>>"


class ScopeNumbers(StatefulProcessor):
    """Numbers of one scope's entities. Rows are (keys ..., order, text, spans)."""

    def __init__(self, keys: list[str], idle_ms: int | None):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entity = T.StructType([T.StructField("type", T.StringType()), T.StructField("norm", T.StringType())])
        kind = T.StructType([T.StructField("type", T.StringType())])
        number = T.StructType([T.StructField("n", T.LongType())])
        self.numbers = handle.getMapState("numbers", entity, number)
        self.counters = handle.getMapState("counters", kind, number)

    def number_of(self, kind: str, norm: str) -> int:
        entity = (kind, norm)
        if self.numbers.containsKey(entity):
            return self.numbers.getValue(entity)[0]
        n = (self.counters.getValue((kind,))[0] if self.counters.containsKey((kind,)) else 0) + 1
        self.counters.updateValue((kind,), (n,))
        self.numbers.updateValue(entity, (n,))
        return n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (Spark's names)
        known: dict[tuple[str, str], int] = {}
        for row in sorted(rows, key=lambda r: (r["__order"], r["__text"])):
            text, at, pieces, entities = row["__text"], 0, [], {}
            for span in row["__spans"]:
                entity = span["type"], span["norm"]
                if entity not in known:
                    known[entity] = self.number_of(*entity)
                tag = f"[{span['type']}_{known[entity]}]"
                pieces += [text[at : span["start"]], tag]
                at = span["end"]
                entities[tag] = Row(tag=tag, type=span["type"], value=span["value"])  # the last spelling counts
            done = {"anonymized": "".join(pieces) + text[at:], "entities": list(entities.values())}
            yield Row(**{k: row[k] for k in self.keys}, **done)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.numbers.clear()
        self.counters.clear()
        return iter(())

    def close(self) -> None:
        pass


def redact_scope_stream(
    stream: DataFrame, scope: str, order: str, keys: list[str], text_col: str = "text", idle_ms: int | None = None, **options
) -> DataFrame:
    """The key columns (``keys``, the scope among them), ``anonymized`` and ``entities`` (tag, type, last value) of every text.

    With ``idle_ms`` the query must keep running (Spark ends no ``availableNow`` run that has processing-time timers).
    ``order`` is a numeric column. The session needs the RocksDB state store (``PROVIDER``), set before the query starts.
    ``options`` are those of ``detect``.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    found = detect(stream.withColumn("__order", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))), text_col, **options)
    spans = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["placeholder"].alias("type"), s["value"].alias("value"),
            normal_value(s["value"], s["placeholder"]).alias("norm"),
        ),
    )
    text = F.when(is_blank(F.col(text_col)), "").otherwise(F.col(text_col))
    rows = found.select(F.col(scope).alias("__scope"), *keys, "__order", text.alias("__text"), spans.alias("__spans"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    return rows.groupBy("__scope").transformWithState(
        statefulProcessor=ScopeNumbers(keys, idle_ms),
        outputStructType=", ".join([*fields, "anonymized string", f"entities {ENTITIES}"]),
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
