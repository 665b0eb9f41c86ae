"""Streams give the batch answer, over several micro-batches and after a restart."""

import json
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import cdc
from tidemill.plans.streams import count_lines, count_words
from tidemill.plans.tables import new_database
from tidemill.shared import new_folder
from tidemill.sources import catalog
from tidemill.streaming import sinks, sources
from tidemill.streaming.progress import listening

ROW = "sale_id int, sale_amount decimal(10,2)"


def lines_folder(tmp_path, batches):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for i, lines in enumerate(batches):
        (folder / f"{len(list(folder.iterdir()))}-{i}.txt").write_text("\n".join(lines) + "\n")
    return str(folder)


LINES = [["a b", "a  b", "b"], ["a b", ""], ["c"], ["b\ta", "a b"], ["a b"]]


def keyed_place(spark):
    """A table name, its folder, and a checkpoint."""
    return f"{new_database(spark, 'keyed')}.latest", new_folder(spark, "out"), new_folder(spark, "cp")


def batches_of(query):
    return [p for p in query.recentProgress if p["numInputRows"] > 0]


@pytest.mark.parametrize("counted", [count_lines, count_words])
def test_counts_equal_batch_over_many_batches_and_a_restart(spark, tmp_path, counted):
    place = keyed_place(spark)

    def go():
        lines = sources.text_lines(spark, folder, files_per_batch=1)
        return sinks.drain(spark, sinks.keyed_table_writer(counted(lines), *place, ["word"]))

    folder = lines_folder(tmp_path, LINES[:4])
    assert len(batches_of(go())) == 4
    lines_folder(tmp_path, LINES[4:])
    assert len(batches_of(go())) == 1
    whole = spark.read.text(folder).select("value")
    latest = sinks.read_latest(spark, place[0], ["word"])
    assert sorted(latest.collect()) == sorted(counted(whole).collect())


def test_snapshots_hold_the_whole_result_and_old_ones_go(spark, tmp_path):
    base, checkpoint = new_folder(spark, "out"), new_folder(spark, "cp")
    folder = lines_folder(tmp_path, LINES)
    lines = sources.text_lines(spark, folder, files_per_batch=1)
    sinks.drain(spark, sinks.snapshot_writer(count_words(lines), base, checkpoint))
    assert len(sinks.finished_batches(spark, base)) == 2
    whole = count_words(spark.read.text(folder))
    assert sorted(sinks.read_snapshot(spark, base).collect()) == sorted(whole.collect())


def test_state_is_kept_in_rocksdb(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sinks.HEAP_STATE)
    try:
        lines = sources.text_lines(spark, lines_folder(tmp_path, LINES))
        writer = sinks.keyed_table_writer(count_words(lines), *keyed_place(spark), ["word"])
        query = sinks.drain(spark, writer)
        metrics = batches_of(query)[0]["stateOperators"][0]["customMetrics"]
        assert any(name.startswith("rocksdb") for name in metrics)
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == sinks.HEAP_STATE
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_partitioned_file_sink_and_unset_options(spark, tmp_path):
    path, checkpoint = new_folder(spark, "out"), new_folder(spark, "cp")
    source = new_folder(spark, "rows")
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("part"))
    rows.repartition(4).write.parquet(source)
    stream = sources.table_stream(spark, source, files_per_batch=1)
    query = sinks.drain(
        spark, sinks.file_stream_writer(stream, checkpoint, path, partitions="part")
    )
    assert len(batches_of(query)) == 4
    assert spark.read.parquet(path).count() == 40
    assert spark.read.parquet(path).where("part = 1").count() == 13
    sinks.file_stream_writer(stream, checkpoint)
    sinks.console_writer(stream.groupBy("part").count(), checkpoint)


def test_a_repeated_batch_changes_nothing(spark):
    base = new_folder(spark, "out")
    write = sinks.write_batch(base)
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    write(spark.range(2), 1)
    assert sinks.read_appended(spark, base).count() == 7
    assert sinks.finished_batches(spark, base) == [0, 1]


def test_batches_do_not_depend_on_success_markers(spark):
    base = new_folder(spark, "out")
    marker = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    write = sinks.write_batch(base)
    write(spark.range(5), 0)
    conf.set(marker, "false")
    try:
        write(spark.range(3), 1)
    finally:
        conf.set(marker, "true")
    assert sinks.read_appended(spark, base).count() == 8
    spark.range(2).write.parquet(sinks.batch_folder(base, 2))
    assert sinks.read_appended(spark, base).count() == 8  # still being written
    write(spark.range(4), 3)
    with pytest.raises(RuntimeError, match="not committed"):
        sinks.read_appended(spark, base)


def test_keyed_table_over_many_batches_repeats_and_a_restart(spark):
    (name, base, _), rng, truth = keyed_place(spark), random.Random(1), {}
    catalog.create_table(
        spark, name, {"k": "int", "v": "int", "batch_id": "bigint"}, partition_by=["batch_id"], location=base
    )
    write = sinks.change_batch(name, base, ["k"], compact_after=8)
    for n in range(50):
        rows = {(rng.randrange(30) or None): rng.randrange(1000) for _ in range(rng.randrange(6))}
        truth |= rows
        batch = spark.createDataFrame(list(rows.items()), "k int, v int")
        if n % 10 == 3:  # cut short, then run again by a new writer
            spark.range(3).selectExpr("1 AS k", "-1 AS v").write.parquet(sinks.batch_folder(base, n))
            write = sinks.change_batch(name, base, ["k"], compact_after=8)
        write(batch, n)
        if n % 8 == 7:  # a batch that compacted runs again
            write(batch, n)
    latest = sinks.read_latest(spark, name, ["k"])
    assert {r["k"]: r["v"] for r in latest.collect()} == truth
    assert sinks.batch_partitions(spark, name) == [46, 47, 48, 49]
    # what is kept is as large as the table and the last batches
    assert len(sinks.matching_paths(spark, f"{base}/*")) <= 5


@pytest.mark.parametrize("cut", ["SET LOCATION", "DROP"])
def test_a_compaction_that_is_cut_short_changes_nothing(spark, cut, monkeypatch):
    name, base, _ = keyed_place(spark)
    catalog.create_table(
        spark, name, {"k": "int", "v": "int", "batch_id": "bigint"}, partition_by=["batch_id"], location=base
    )
    write = sinks.insert_batch(name, base)
    for n in range(6):
        write(spark.createDataFrame([(1, n), (n, 10 * n)], "k int, v int"), n)

    def rows():
        return {r["k"]: r["v"] for r in sinks.read_latest(spark, name, ["k"]).collect()}

    before, run = rows(), type(spark).sql

    def killed(self, text, *args, **kwargs):
        if cut in text:
            raise KeyboardInterrupt
        return run(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.compact(spark, name, base, ["k"], 4)
    monkeypatch.undo()
    assert rows() == before
    sinks.compact(spark, name, base, ["k"], 4)
    assert rows() == before and sinks.batch_partitions(spark, name) == [4, 5]


def test_reading_before_the_first_batch_fails(spark):
    for read in (sinks.read_appended, sinks.read_snapshot, sinks.read_totals):
        with pytest.raises(FileNotFoundError):
            read(spark, new_folder(spark, "none"))
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, "default.no_such_table", ["k"])


def test_single_file_table_can_be_streamed(spark, sf_dir):
    stream = sources.table_stream(spark, f"{sf_dir}/events.parquet")
    base = new_folder(spark, "out")
    sinks.drain(spark, sinks.appended_table_writer(stream, base, new_folder(spark, "cp")))
    assert sinks.read_appended(spark, base).count() == 10000


# -- change events ----------------------------------------------------------


def event(op, key, before, after, position):
    """An envelope as the connector writes it; ``before`` may be "key" for a key-only image."""

    def image(amount):
        if amount is None:
            return None
        return {"sale_id": key, "sale_amount": None if amount == "key" else amount}

    return json.dumps(
        {
            "before": image(before),
            "after": image(after),
            "source": {"connector": "x", "snapshot": "false", "ts_ms": 5, "lsn": position},
            "op": op,
            "ts_ms": 6,
            "transaction": None,
        }
    )


CASES = [
    event("c", 1, None, 100, 1),
    event("c", 2, None, 50, 2),
    event("u", 1, 100, 70, 3),
    event("u", 1, 100, 70, 3),
    event("d", 2, 50, None, 4),
    None,
]


def change_files(spark, values, files):
    path = new_folder(spark, "changes")
    for i in range(files):
        part = [(v,) for v in values[i::files]]
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").parquet(path)
    return path


def row_schema(spark):
    return spark.createDataFrame([], ROW).schema


def latest_of(spark, values):
    events = spark.createDataFrame([(v,) for v in values], "value string")
    return cdc.latest_changes(cdc.parse_envelopes(events, row_schema(spark)), ["sale_id"])


def total_of(spark, values):
    return cdc.running_total(latest_of(spark, values), "sale_amount", "t").collect()[0]["total"]


def stream_latest(spark, path, place):
    events = sources.table_stream(spark, path, files_per_batch=1)
    latest = cdc.latest_changes(cdc.parse_envelopes(events, row_schema(spark)), ["sale_id"])
    sinks.drain(spark, sinks.keyed_table_writer(latest, *place, ["sale_id"]))
    return sinks.read_latest(spark, place[0], ["sale_id"])


def test_running_total_with_update_delete_tombstone_and_repeats(spark):
    place, path = keyed_place(spark), change_files(spark, CASES, 3)

    def total():
        latest = stream_latest(spark, path, place)
        return cdc.running_total(latest, "sale_amount", "total_sales").collect()[0]["total"]

    assert total() == Decimal("70.00")
    more = [(event("r", 3, None, 0.1, 5),), (event("u", 1, 100, 70, 3),)]
    spark.createDataFrame(more, "value string").write.mode("append").parquet(path)
    assert total() == Decimal("70.10")


def test_latest_state_over_batches_and_restart(spark):
    place, path = keyed_place(spark), change_files(spark, CASES, 4)

    def state():
        rows = cdc.current_rows(stream_latest(spark, path, place))
        return {r["sale_id"]: r["sale_amount"] for r in rows.collect()}

    assert state() == {1: Decimal("70.00")}
    again = [(event("c", 2, None, 8, 6),), (event("d", 1, 70, None, 7),)]
    spark.createDataFrame(again, "value string").write.mode("append").parquet(path)
    assert state() == {2: Decimal("8.00")}


C, U, D, R = "c", "u", "d", "r"


@pytest.mark.parametrize(
    ("values", "total"),
    [
        ([event(C, 1, None, 100, 1), event(C, 2, None, 50, 2), event(U, 1, 100, 70, 3)], "120.00"),
        ([event(C, 1, None, 100, 1), event(U, 1, None, 70, 2)], "70.00"),
        ([event(R, 1, None, 100, 1), event(R, 1, None, 100, 9)], "100.00"),
        ([event(C, 1, None, 100, 1), event(C, 2, None, 5, 2), event(D, 1, "key", None, 3)], "5.00"),
        ([event(C, n, None, 100 * n, n) for n in range(1, 11)], "5500.00"),
        ([event(U, 1, 100, 70, 3), event(C, 1, None, 100, 1)], "70.00"),
    ],
)
def test_totals_of_incomplete_and_repeated_events(spark, values, total):
    assert total_of(spark, values) == Decimal(total)


def test_a_truncation_removes_what_was_before_it(spark):
    emptied = json.dumps({"op": "t", "before": None, "after": None, "source": {"lsn": 5}})
    values = [event("c", 1, None, 3, 1), emptied, event("c", 2, None, 4, 6), event("u", 1, None, 9, 4)]
    assert total_of(spark, values) == Decimal("4.00")
    latest = stream_latest(spark, change_files(spark, values, 4), keyed_place(spark))
    assert [r["sale_id"] for r in cdc.current_rows(latest).collect()] == [2]


@pytest.mark.parametrize(
    "bad",
    [
        event("c", 1, None, 100, 1)[:-9],
        event("c", 1, None, 99999999999, 1),
        event("c", 1, None, "much", 1),
        event("c", 1, None, 100, None),
        json.dumps({"op": "u", "after": {"sale_amount": 1}, "source": {"lsn": 3}}),
        json.dumps({"after": {"sale_id": 1, "sale_amount": 1}, "source": {"lsn": 3}}),
    ],
)
def test_bad_events_raise(spark, bad):
    with pytest.raises(Exception, match="MALFORMED|without"):
        total_of(spark, [event("c", 2, None, 50, 2), bad])


def test_narrow_total_fails_on_overflow(spark):
    values = [event("c", n, None, 99999999, n) for n in (1, 2)]
    assert total_of(spark, values) == Decimal("199999998.00")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        latest = latest_of(spark, values)
        cdc.running_total(latest, "sale_amount", "t", total_type="decimal(10,2)").collect()


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_latest_state_is_the_final_table(spark, seed):
    rng = random.Random(seed)
    table, values = {}, []
    for position in range(40):
        key = rng.randrange(6)
        if key not in table:
            table[key] = rng.randrange(1, 100)
            values.append(event("c", key, None, table[key], position))
        elif rng.random() < 0.3:
            del table[key]
            values.append(event("d", key, "key", None, position))
            values.append(None)
        else:
            table[key] = rng.randrange(1, 100)
            values.append(event("u", key, None, table[key], position))
    rng.shuffle(values)
    latest = latest_of(spark, values + values[:5])
    assert {r["sale_id"]: int(r["sale_amount"]) for r in cdc.current_rows(latest).collect()} == table
    total = cdc.running_total(latest, "sale_amount", "t").collect()[0]["total"]
    assert (total or 0) == sum(table.values())


def totals_of(spark, path, base, checkpoint, group=None):
    events = sources.table_stream(spark, path, files_per_batch=1)
    parsed = cdc.parse_envelopes(events, row_schema(spark))
    changes = cdc.amount_changes(parsed, "sale_id", "sale_amount", group=group)
    sinks.drain(spark, sinks.total_writer(changes, base, checkpoint, "change"))
    rows = sinks.read_totals(spark, base).orderBy("batch_id").collect()
    return [(r["batch_id"], r["change"], r["total"]) for r in rows]


@pytest.mark.parametrize("group", [None, "sale_id div 2"])
def test_continuous_total_takes_back_late_and_repeated_events(spark, group):
    path, places = new_folder(spark, "changes"), (new_folder(spark, "out"), new_folder(spark, "cp"))
    group = group and F.expr(group)
    parts = [
        [event("c", 1, None, 100, 1), event("c", 2, None, 50, 2)],
        [event("u", 1, None, 70, 5), event("u", 1, 100, 80, 3), None],
        [event("u", 1, 100, 80, 3), event("c", 1, None, 100, 1), event("d", 2, "key", None, 4)],
        [event("c", 2, None, 8, 6), event("d", 3, "key", None, 9)],
        [event("c", 3, None, 1000, 7), event("u", 1, 70, None, 10)],
    ]
    for part in parts:  # every part is a run of its own, from where the last one ended
        rows = spark.createDataFrame([(v,) for v in part], "value string")
        rows.coalesce(1).write.mode("append").parquet(path)
        got = totals_of(spark, path, *places, group=group)
    wanted = [(150, 150), (-30, 120), (-50, 70), (8, 78), (-70, 8)]
    assert got == [(n, Decimal(c), Decimal(t)) for n, (c, t) in enumerate(wanted)]
    # a batch that runs again gives the same row
    assert totals_of(spark, path, *places, group=group) == got


def test_continuous_total_refuses_truncations(spark):
    emptied = json.dumps({"op": "t", "before": None, "after": None, "source": {"lsn": 5}})
    path = change_files(spark, [event("c", 1, None, 3, 1), emptied], 1)
    with pytest.raises(Exception, match="truncation"):
        totals_of(spark, path, new_folder(spark, "out"), new_folder(spark, "cp"))


def test_read_text_files_are_put_away(spark, tmp_path):
    folder, archive = lines_folder(tmp_path, LINES[:3]), new_folder(spark, "archive")
    place = keyed_place(spark)

    def go():
        lines = sources.text_lines(spark, folder, files_per_batch=1, archive=archive)
        sinks.drain(spark, sinks.keyed_table_writer(count_words(lines), *place, ["word"]))

    go()
    lines_folder(tmp_path, LINES[3:])
    go()
    left = len(list((tmp_path / "in").iterdir()))
    assert left < len(LINES)  # those of the last batch stay until there is another
    whole = spark.createDataFrame([(line,) for part in LINES for line in part], "value string")
    latest = sinks.read_latest(spark, place[0], ["word"])
    assert sorted(latest.collect()) == sorted(count_words(whole).collect())


def test_streamed_table_knows_its_partitions(spark):
    name, base, checkpoint = keyed_place(spark)
    path = new_folder(spark, "rows")
    rows = spark.range(40).selectExpr("id", "id % 3 AS part", "concat('v', id) AS v")
    for low in (0, 20):
        rows.where(f"id >= {low} AND id < {low + 20}").repartition(4).write.mode("append").parquet(path)
        stream = sources.table_stream(spark, path, files_per_batch=2)
        sinks.drain(spark, sinks.table_writer(stream, name, base, checkpoint, ["part"]))
    assert sorted(spark.table(name).select("id", "part", "v").collect()) == sorted(rows.collect())
    parts = spark.sql(f"SHOW PARTITIONS {name}").collect()
    assert len(parts) == 12 and len(spark.table(name).inputFiles()) == 12
    write = sinks.table_batch(name, base, ["part"])
    write(rows.where("id < 20").limit(0), 9)
    batch = spark.table(name).where("batch_id = 3").select("id", "v", "part")
    again = spark.createDataFrame(batch.collect(), batch.schema)
    write(again, 3)  # the last batch runs again
    assert spark.table(name).count() == 40


def test_numbers_of_a_row_clock_go_on_after_a_restart(spark):
    base, checkpoint = new_folder(spark, "out"), new_folder(spark, "cp")
    for _ in range(3):
        ids = sources.counted_rows(spark, 7)
        sinks.drain(spark, sinks.appended_table_writer(ids, base, checkpoint))
    got = sinks.read_appended(spark, base)
    assert sorted(r["id"] for r in got.collect()) == list(range(21))
    assert got.select("timestamp").distinct().count() == 3


def test_progress_of_a_console_stream(spark, tmp_path):
    folder = lines_folder(tmp_path, LINES)
    counts = count_words(sources.text_lines(spark, folder, files_per_batch=2))
    with listening(spark) as heard:
        query = sinks.drain(spark, sinks.console_writer(counts, new_folder(spark, "cp")))
        batches = heard.of(spark, query).orderBy("batch_id").collect()
    assert [b["input_rows"] for b in batches if b["input_rows"]] == [5, 3, 1]
    assert [b["batch_id"] for b in batches][:3] == [0, 1, 2]
    assert batches[2]["output_rows"] == count_words(spark.read.text(folder)).count()
