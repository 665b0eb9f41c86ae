"""Change events of a table: the latest state of each row, and totals over current rows.

An event is the envelope of a log-based connector: op (c, r, u, d, t), the row before
and after, and under ``source`` where in the log the change is. Before images may lack,
or hold the key only, and events may come again or be read anew by a snapshot. So
nothing is added up from differences: state is kept per key, the event of the highest
position wins, and totals are sums over the rows as they are. The functions take batch
or streaming frames.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The ops that remove a row, and all rows.
DELETE, TRUNCATE = "d", "t"
STRICT = {"mode": "FAILFAST"}


def envelope_schema(row: T.StructType) -> T.StructType:
    place = T.StructType([T.StructField("lsn", T.LongType()), T.StructField("ts_ms", T.LongType())])
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", row),
            T.StructField("after", row),
            T.StructField("source", place),
            T.StructField("ts_ms", T.LongType()),
        ]
    )


def _required(value: Column, present: Column, message: str) -> Column:
    return F.when(present, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def parse_envelopes(events: DataFrame, row: T.StructType, *keep: str) -> DataFrame:
    """Envelopes from topic rows as op, before, after and position; tombstones are skipped.

    ``position`` orders events: place in the log, time of the change, time of the event.
    Amounts written as JSON numbers are read straight into the declared decimals. What
    can't be read, doesn't fit, or has no op or position raises.
    """
    text = F.col("value").cast("string")
    position = F.struct(
        F.col("_event.source.lsn").alias("lsn"),
        F.coalesce("_event.source.ts_ms", F.lit(0)).alias("changed"),
        F.coalesce("_event.ts_ms", F.lit(0)).alias("sent"),
    )
    placed = F.col("_event.op").isNotNull() & F.col("_event.source.lsn").isNotNull()
    return (
        events.filter(F.col("value").isNotNull())
        .select(*keep, F.from_json(text, envelope_schema(row), STRICT).alias("_event"))
        .select(
            *keep,
            _required(F.col("_event.op"), placed, "change event without op or log position").alias("op"),
            F.col("_event.before").alias("before"),
            F.col("_event.after").alias("after"),
            position.alias("position"),
        )
    )


def latest_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last event of every key as (keys, op, after, position).

    Deletes are included: they have to stay in a stream's output, so that readers can
    drop the row. The last truncation is the row whose keys are null. State is one event
    per key, whatever the number of events.
    """
    keyed = changes.select(
        *[F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in keys],
        "op",
        "after",
        "position",
    )
    unnamed = F.lit(False)
    for key in keys:
        unnamed = unnamed | F.col(key).isNull()
    named = keyed.withColumn(
        "op", _required(F.col("op"), ~unnamed | (F.col("op") == TRUNCATE), "change event without key")
    )
    return (
        named.groupBy(*keys)
        .agg(F.max_by(F.struct("op", "after", "position"), "position").alias("_last"))
        .select(*keys, "_last.*")
    )


def current_rows(latest: DataFrame) -> DataFrame:
    """Rows of the table as it is: no deleted ones, and none from before the last truncation."""
    emptied = latest.filter(F.col("op") == TRUNCATE).agg(F.max("position")).scalar()
    there = ~F.col("op").isin(DELETE, TRUNCATE)
    return latest.filter(
        there & (emptied.isNull() | (F.col("position") > emptied))
    ).select("after.*")


def running_total(
    latest: DataFrame, amount: str, key_name: str, *, total_type: str | None = None
) -> DataFrame:
    """One row (key_name, total): the sum over the current rows of ``latest_changes``.

    A partial + final sum. On a stream, keep ``latest_changes`` in a keyed table and
    take the total of what is read from it. ``total_type`` narrows the total and fails
    on overflow.
    """
    summed = current_rows(latest).agg(F.sum(amount).alias("total"))
    value = F.col("total").cast(total_type) if total_type else F.col("total")
    return summed.select(F.lit(key_name).alias("key_name"), value.alias("total"))


class LastAmounts(StatefulProcessor):
    """Holds the amount and position of the last event of each key of a group, and tells what later ones change.

    Rows come as (group, key, op, amount, lsn, changed, sent). The state of a group is one
    value of bytes, the pickled dictionary of its keys: the JVM does not take it apart.
    """

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict = {}
        for _, name, _, amount, lsn, changed, sent in rows:
            if name is None:
                raise ValueError("a truncation can't be told from differences: keep latest_changes instead")
            event = (lsn, changed, sent, amount or Decimal(0))
            held = newest.get(name)
            if held is None or event[:3] > held[:3]:
                newest[name] = event
        state = self.state.get()
        held_rows = {} if state is None else pickle.loads(state[0])
        later = {
            k: event for k, event in newest.items() if k not in held_rows or event[:3] > held_rows[k][:3]
        }
        if not later:
            return
        changed_row = Row(self.key, "change")
        changes = [
            changed_row(k, event[3] - (held_rows[k][3] if k in held_rows else 0)) for k, event in later.items()
        ]
        held_rows.update(later)
        self.state.update((pickle.dumps(held_rows, pickle.HIGHEST_PROTOCOL),))
        yield from changes

    def close(self) -> None:
        pass


def amount_changes(
    changes: DataFrame, key: str, amount: str, *, group: Column | None = None
) -> DataFrame:
    """A stream of (key, change): what each batch's events change of a key's amount.

    Every key's last amount is kept as state, by the event's position, so events that
    come late or again change nothing, and images of rows before are not needed. A
    deleted row, and a null amount, count as 0. The sum of all changes is the table's
    total. A truncation is an error. Keys of one value of ``group``, by default each
    key alone, share a state, which is read and written as one: some dozens of keys
    that come together, like those of one range, cost little more than one.
    """
    kind = changes.schema["after"].dataType[amount].dataType.simpleString()
    there = F.when(F.col("op") != DELETE, F.col(f"after.{amount}"))
    name = F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}"))
    named = _required(F.col("op"), name.isNotNull() | (F.col("op") == TRUNCATE), "change event without key")
    keyed = changes.select(name.alias(key), named.alias("op"), there.alias("amount"), "position.*")
    placed = (F.col(key) if group is None else group).alias("_group")
    keyed = keyed.select(placed, key, "op", "amount", "lsn", "changed", "sent")
    kind_of_key = keyed.schema[key].dataType.simpleString()
    return keyed.groupBy("_group").transformWithState(
        LastAmounts(key), f"`{key}` {kind_of_key}, change {kind}", "Update", "None"
    )


# the state's code is shipped with the job, so that workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
