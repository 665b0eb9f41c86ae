"""Loads of stored keyed tables: what they change, read and leave behind."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import merge, warehouse
from tidemill.plans.tables import new_database
from tidemill.shared import matching_paths, new_folder
from tidemill.sources import catalog, keyed

SCHEMA = "code int, name string, city string"


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def name_in_new_database(spark):
    return f"{new_database(spark, 'keyed')}.people"


def stored(spark, df, part="code div 10", **options):
    name = name_in_new_database(spark)
    keyed.create_keyed(df, name, ["code"], part, **options)
    return name


def plain(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def people(spark, n=60):
    return spark.range(n).selectExpr("int(id) AS code", "concat('n', id) AS name", "concat('c', id % 3) AS city")


def test_loads_equal_a_dictionary_over_many_versions(spark):
    rng, truth = random.Random(4), {i: (i, f"n{i}", "c") for i in range(40)}
    name = stored(spark, frame(spark, list(truth.values())))
    for n in range(8):
        keys = rng.sample(range(80), 12)
        new = [(k, f"v{n}", None if k % 5 == 0 else "d") for k in keys]
        source = frame(spark, new)
        kind = n % 4
        if kind == 0:
            keyed.upsert_keyed(spark, name, source)
            truth |= {r[0]: r for r in new}
        elif kind == 1:
            keyed.insert_absent_keyed(spark, name, source)
            truth = {r[0]: r for r in new} | truth
        elif kind == 2:
            keyed.update_keyed(spark, name, source.drop("name"), ["city"])
            truth |= {r[0]: (r[0], truth[r[0]][1], r[2]) for r in new if r[0] in truth}
        else:
            keyed.delete_keyed(spark, name, source.select("code"))
            truth = {k: r for k, r in truth.items() if k not in keys}
        assert rows(spark.table(name)) == sorted(truth.values(), key=str)
    # one earlier version stays readable, and only what the two need is kept
    table = keyed.keyed_table(spark, name)
    assert len(table.versions) == 2
    kept = [r["tableName"] for r in catalog.show_tables(spark, name.split(".")[0]).collect()]
    assert sorted(kept) == sorted(["people", *(v.split(".")[1] for v in table.versions)])
    used = {plain(p) for v in table.versions for p in keyed._places(spark, v).values()}
    assert set(map(plain, matching_paths(spark, f"{table.folder}/*/{keyed.PART}=*"))) == used


def test_untouched_partitions_are_neither_read_nor_written(spark, tmp_path):
    name = stored(spark, people(spark), folder=str(tmp_path / "people"))
    table = keyed.keyed_table(spark, name)
    before = keyed._places(spark, table.current)
    assert sorted(before) == list(range(6))
    source = frame(spark, [(11, "new", "x"), (47, "new", "x")])
    touched = keyed.touched_rows(spark, table, [1, 4])
    assert len(touched.inputFiles()) == 2
    merged = merge.merge_rows(touched, source, ["code"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [part_id" in plan.replace("isnotnull(part_id#", "[part_id")
    for part, place in before.items():
        if part not in (1, 4):  # no one can read these any more
            for file in matching_paths(spark, f"{place}/*.parquet"):
                with open(plain(file), "wb") as spoiled:
                    spoiled.write(b"spoiled")
    after = keyed.upsert_keyed(spark, name, source)
    places = keyed._places(spark, after.current)
    assert {p for p in places if places[p] != before[p]} == {1, 4}
    some = spark.table(after.current).where("part_id IN (1, 4)")
    assert some.count() == 20 and some.where("name = 'new'").count() == 2


@pytest.mark.parametrize("at", ["balanced_writer", "_switch"])
def test_a_killed_load_leaves_the_old_rows(spark, monkeypatch, at):
    name = stored(spark, people(spark))
    before, source = rows(spark.table(name)), frame(spark, [(1, "new", "x"), (99, "new", "x")])

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr(keyed, at, killed)
    with pytest.raises(KeyboardInterrupt):
        keyed.upsert_keyed(spark, name, source)
    monkeypatch.undo()
    assert rows(spark.table(name)) == before
    keyed.upsert_keyed(spark, name, source)
    after = {r[0]: r for r in before} | {1: (1, "new", "x"), 99: (99, "new", "x")}
    assert rows(spark.table(name)) == sorted(after.values(), key=str)
    table = keyed.keyed_table(spark, name)
    kept = catalog.show_tables(spark, name.split(".")[0]).count()
    assert kept == 1 + len(table.versions) == 3


def test_a_reader_of_the_version_before_is_not_disturbed(spark):
    name = stored(spark, people(spark))
    open_read, before = spark.table(name), rows(people(spark))
    keyed.upsert_keyed(spark, name, frame(spark, [(1, "new", "x")]))
    assert rows(open_read) == before and rows(spark.table(name)) != before


def test_a_failing_load_changes_nothing(spark):
    name = stored(spark, people(spark))
    twice = frame(spark, [(1, "a", "x"), (1, "b", "x")])
    with pytest.raises(Exception, match="repeated key: 1"):
        keyed.upsert_keyed(spark, name, twice)
    with pytest.raises(catalog.DuplicateKey):
        keyed.append_keyed(spark, name, frame(spark, [(1, "a", "x"), (77, "a", "x")]))
    with pytest.raises(catalog.DuplicateKey):
        keyed.create_keyed(twice, name_in_new_database(spark), ["code"], "code div 10")
    with pytest.raises(ValueError, match="no keyed table"):
        plain = name_in_new_database(spark)
        catalog.save_table(people(spark), plain)
        keyed.upsert_keyed(spark, plain, twice)
    assert rows(spark.table(name)) == rows(people(spark))
    keyed.append_keyed(spark, name, frame(spark, [(77, "a", "x")]))
    assert spark.table(name).count() == 61
    keyed.upsert_keyed(spark, name, twice, order_by="name")
    assert (1, "b", "x") in rows(spark.table(name))
    keyed.upsert_keyed(spark, name, twice.where("false"))
    assert spark.table(name).count() == 61


def test_null_keys_have_a_partition_of_their_own(spark):
    df = frame(spark, [(None, "t", "1"), (1, "t", "1")])
    name = stored(spark, df, unique=False)
    source = frame(spark, [(None, "s", "2"), (None, "s", "2"), (1, "s", "2")])
    keyed.upsert_keyed(spark, name, source)
    wanted = [(None, "t", "1"), (None, "s", "2"), (None, "s", "2"), (1, "s", "2")]
    assert rows(spark.table(name)) == sorted(wanted, key=str)
    keyed.insert_absent_keyed(spark, name, frame(spark, [(None, "u", "3"), (1, "u", "3"), (2, "u", "3")]))
    wanted += [(None, "u", "3"), (2, "u", "3")]
    assert rows(spark.table(name)) == sorted(wanted, key=str)
    keyed.delete_keyed(spark, name, frame(spark, [(None, "", ""), (1, "", "")]).select("code"))
    assert rows(spark.table(name)) == sorted((w for w in wanted if w[0] != 1), key=str)


def test_a_table_can_be_emptied_and_filled_again(spark):
    name = stored(spark, people(spark, 5))
    keyed.delete_keyed(spark, name, people(spark, 5).select("code"))
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["code", "name", "city"]
    keyed.upsert_keyed(spark, name, people(spark, 3))
    assert rows(spark.table(name)) == rows(people(spark, 3))
    for mode in ("stage", "scd-type1"):
        keyed.load_keyed_by_mode(spark, mode, name, people(spark, 4))
    assert spark.table(name).count() == 4
    with pytest.raises(KeyError, match="unknown load mode"):
        keyed.load_keyed_by_mode(spark, "scd-type2", name, people(spark, 4))


HISTORY = "id int, uuid string, city string, rowIsCurrent boolean, rowEndDate timestamp_ntz"


def history(spark):
    return frame(
        spark,
        [
            (1, "a", "A", False, None), (2, "a", "B", True, None), (3, "b", "C", False, None),
            (4, "c", "D", True, None), (5, None, "E", True, None), (6, "d", None, True, None),
        ],
        HISTORY,
    )


STAGED = [("a", "MOVED"), ("b", "C"), ("c", "D"), ("new", "X"), (None, "N"), ("d", None)]


@pytest.mark.parametrize("compare", [["city"], None])
def test_history_load_agrees_with_the_load_of_frames(spark, compare):
    stage = frame(spark, STAGED, "uuid string, city string")
    wanted = warehouse.scd2_apply(history(spark), stage, now(), compare=compare)
    assert rows(merge.merge_history(history(spark), stage, now(), compare=compare)) == rows(wanted)
    name = name_in_new_database(spark)
    keyed.create_keyed(history(spark), name, ["uuid"], keyed.hashed_part(["uuid"], 4), unique=False)
    keyed.load_history(spark, name, stage, now(), compare=compare)
    assert rows(spark.table(name)) == rows(wanted)
    if compare:  # the same load again adds only rows without a key
        keyed.load_history(spark, name, stage.where("uuid IS NOT NULL"), now(), compare=compare)
        assert rows(spark.table(name)) == rows(wanted)


def test_history_load_joins_once_and_refuses_two_current_rows(spark):
    stage = frame(spark, STAGED, "uuid string, city string")
    merged = merge.merge_history(history(spark), stage, now(), compare=["city"])
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    twice = history(spark).union(frame(spark, [(9, "a", "Z", True, None)], HISTORY))
    with pytest.raises(Exception, match="repeated key: a"):
        merge.merge_history(twice, stage, now()).collect()


def test_versions_lie_where_they_are_told(spark):
    folder = new_folder(spark, "people")
    name = stored(spark, people(spark, 12), part="pmod(code, 3)", folder=folder)
    files = spark.table(name).inputFiles()
    assert len(files) == 3 and all(folder.rsplit("/", 1)[1] in file for file in files)
