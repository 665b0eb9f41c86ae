import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import relational, warehouse
from tidemill.operators.skew import SkewRule, hot_keys
from tidemill.sources.catalog import DuplicateKey, require_key

SCHEMA = "code int, name string, city string"


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")



def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def dim(spark):
    return frame(
        spark,
        [
            (1, "same", "A"),
            (2, "old", "B"),
            (3, None, "C"),
            (4, "kept", "D"),
            (5, None, None),
            (9, "not staged", "Z"),
        ],
    )


@pytest.fixture(scope="module")
def stage(spark):
    return frame(
        spark,
        [
            (1, "same", "A"),
            (2, "new", "B"),
            (3, "named", "C"),
            (4, None, "D"),
            (5, "five", "E"),
            (6, "six", None),
        ],
    )


def test_find_separates_updates_from_inserts(dim, stage):
    updated, inserted = warehouse.scd1_find(dim, stage, ["code"])
    assert rows(updated) == [(2, "new", "B"), (3, "named", "C")]
    # A match whose attributes are all null counts as new.
    assert rows(inserted) == [(5, "five", "E"), (6, "six", None)]


def test_find_options(dim, stage):
    updated, _ = warehouse.scd1_find(dim, stage, ["code"], null_safe=True)
    assert (4, None, "D") in rows(updated)
    updated, inserted = warehouse.scd1_find(dim, stage, ["code"], by_key=True)
    assert rows(inserted) == [(6, "six", None)]
    assert (5, "five", "E") in rows(updated)


def test_updated_rows_contain_brand_new_rows_that_find_removes(dim, stage):
    joined = relational.join_right_suffix(dim, stage, ["code"])
    changed = warehouse.scd1_updated_rows(joined, dim.columns, ["code"])
    assert (6, "six", None) in rows(changed)
    fresh = warehouse.scd1_new_rows(joined, dim.columns, ["code"])
    assert rows(fresh) == [(5, "five", "E"), (6, "six", None)]


@pytest.mark.parametrize("size", [0, 1])
def test_a_placeholder_dimension_takes_everything(spark, stage, size):
    updated, inserted = warehouse.scd1_find(
        frame(spark, [(-1, "none", "none")][:size]), stage, ["code"], placeholder_rows=1
    )
    assert rows(updated) == []
    assert updated.columns == stage.columns
    assert rows(inserted) == rows(stage)


def test_a_dimension_of_one_row_is_a_dimension(spark, stage):
    one = stage.limit(1)
    updated, inserted = warehouse.scd1_find(one, stage, ["code"])
    assert inserted.count() == stage.count() - 1 and updated.count() == 0


def test_special_columns_are_not_compared(spark, stage):
    dim = frame(
        spark, [(1, 77, "same", "A"), (2, 78, "new", "B")], "code int, id int, name string, city string"
    )
    updated, inserted = warehouse.scd1_find(dim, stage, ["code", "id"])
    assert rows(updated) == []
    assert inserted.columns == ["code", "name", "city"]
    with pytest.raises(ValueError):
        warehouse.scd1_find(dim, stage, ["code"])


keyed_rows = st.lists(
    st.tuples(st.integers(1, 8), st.sampled_from(["a", "b", None]), st.sampled_from(["x", None])),
    max_size=8,
    unique_by=lambda r: r[0],
)


@settings(max_examples=12, deadline=None)
@given(keyed_rows, keyed_rows)
def test_updated_and_inserted_are_disjoint(spark, old, new):
    updated, inserted = warehouse.scd1_find(frame(spark, old), frame(spark, new), ["code"])
    assert not {r[0] for r in rows(updated)} & {r[0] for r in rows(inserted)}


@settings(max_examples=12, deadline=None)
@given(keyed_rows, keyed_rows)
def test_upsert_equals_a_dictionary_update_and_is_idempotent(spark, old, new):
    target, source = frame(spark, old), frame(spark, new)
    once = warehouse.upsert(target, source, ["code"])
    wanted = {r[0]: r for r in old} | {r[0]: r for r in new}
    assert rows(once) == sorted(wanted.values(), key=str)
    assert rows(warehouse.upsert(once, source, ["code"])) == rows(once)


@settings(max_examples=10, deadline=None)
@given(keyed_rows, keyed_rows)
def test_insert_if_absent_keeps_what_is_there(spark, old, new):
    got = warehouse.insert_if_absent(frame(spark, old), frame(spark, new), ["code"])
    wanted = {r[0]: r for r in new} | {r[0]: r for r in old}
    assert rows(got) == sorted(wanted.values(), key=str)


def test_repeated_source_keys(spark, dim):
    source = frame(spark, [(2, "first", "1"), (2, "second", "2"), (7, "x", "1")])
    with pytest.raises(Exception, match="repeated key: 2"):
        warehouse.upsert(dim, source, ["code"]).collect()
    with pytest.raises(Exception, match="repeated key: 2"):
        warehouse.insert_if_absent(dim, source, ["code"]).collect()
    assert (2, "second", "2") in rows(warehouse.upsert(dim, source, ["code"], latest_by="city"))
    fresh = frame(spark, [(7, "first", "1"), (7, "second", "2")])
    got = rows(warehouse.insert_if_absent(dim, fresh, ["code"], first_by="city"))
    assert (7, "first", "1") in got and (7, "second", "2") not in got


def test_null_keys_conflict_with_nothing(spark):
    target = frame(spark, [(None, "t", "1"), (1, "t", "1")])
    source = frame(spark, [(None, "s", "2"), (None, "s", "2"), (1, "s", "2")])
    assert rows(warehouse.upsert(target, source, ["code"])) == sorted(
        [(None, "t", "1"), (None, "s", "2"), (None, "s", "2"), (1, "s", "2")], key=str
    )
    assert rows(warehouse.insert_if_absent(target, source, ["code"])) == sorted(
        [(None, "t", "1"), (None, "s", "2"), (None, "s", "2"), (1, "t", "1")], key=str
    )


def test_keyed_update_writes_nulls_and_ignores_unknown_keys(spark, dim):
    source = frame(spark, [(1, "n", None), (50, "n", "n")])
    got = rows(warehouse.keyed_update(dim, source, ["code"], ["city"]))
    assert (1, "same", None) in got
    assert len(got) == 6


def test_hot_target_keys_do_not_change_the_result(spark, monkeypatch):
    rule = SkewRule(min_rows=0, share=0.1)
    monkeypatch.setattr(warehouse, "hot_keys", lambda df, keys: hot_keys(df, keys, rule))
    target = spark.range(600).selectExpr("if(id % 3 = 0, 0, id % 50) AS code", "id", "'old' AS v")
    source = spark.createDataFrame([(0, "zero"), (7, None), (99, "x")], "code long, v string")
    got = warehouse.keyed_update(target, source, ["code"], ["v"])
    assert got.columns == target.columns and got.count() == 600
    zeros = target.where("code = 0").count()
    assert got.where("code = 0 AND v = 'zero'").count() == zeros > 200
    assert got.where("code = 7 AND v IS NULL").count() == target.where("code = 7").count()
    assert got.where("v = 'old'").count() == target.where("code NOT IN (0, 7)").count()
    dim = target.selectExpr(
        "id", "concat('u', code) AS uuid", "id % 2 = 0 AS rowIsCurrent",
        "CAST(NULL AS timestamp_ntz) AS rowEndDate",
    )
    stage = spark.createDataFrame([("u0",), ("new",)], "uuid string")
    after = warehouse.scd2_apply(dim, stage, now())
    assert after.count() == 602
    assert after.where("uuid = 'u0' AND rowIsCurrent").count() == 1
    assert after.where("rowIsCurrent").count() == dim.where("rowIsCurrent AND uuid <> 'u0'").count() + 2


def test_keyed_delete(spark, dim):
    kept = rows(warehouse.keyed_delete(dim, "code", [1, 2, 77]))
    assert [r[0] for r in kept] == [3, 4, 5, 9]
    nulls = dim.unionByName(frame(spark, [(None, "n", "n")]))
    assert len(rows(warehouse.keyed_delete(nulls, "code", nulls.select("code")))) == 1


def test_load_by_mode(dim, stage):
    staged = warehouse.load_by_mode("stage", dim, stage, ["code"])
    assert (2, "old", "B") in rows(staged)
    replaced = warehouse.load_by_mode("scd-type1", dim, stage, ["code"])
    assert (2, "new", "B") in rows(replaced)
    with pytest.raises(KeyError):
        warehouse.load_by_mode("scd-type2", dim, stage, ["code"])


HISTORY = "id int, uuid string, city string, rowIsCurrent boolean, rowEndDate timestamp_ntz"


@pytest.fixture(scope="module")
def history(spark):
    return frame(
        spark,
        [
            (1, "a", "A", False, None),
            (2, "a", "B", True, None),
            (3, "b", "C", False, None),
            (4, "c", "D", True, None),
        ],
        HISTORY,
    )


def test_scd2_close_ends_current_rows_of_staged_keys(spark, history):
    stage = frame(
        spark,
        [("a", "B"), ("a", "B"), ("b", "C"), ("new", "X")],
        "uuid string, city string",
    )
    closed = warehouse.scd2_close(history, stage, now())
    assert closed.columns == ["id", "rowIsCurrent", "rowEndDate"]
    assert [(r["id"], r["rowIsCurrent"], str(r["rowEndDate"])) for r in closed.collect()] == [
        (2, False, "2024-06-01 12:00:00")
    ]
    assert warehouse.scd2_close(history, stage, now(), compare=["city"]).count() == 0


def test_scd2_apply_adds_versions_and_can_run_again(spark, history):
    stage = frame(
        spark, [("a", "MOVED"), ("b", "C"), ("c", "D"), ("new", "X")], "uuid string, city string"
    )
    after = warehouse.scd2_apply(history, stage, now(), compare=["city"])
    current = {(r["uuid"], r["city"]) for r in after.where("rowIsCurrent").collect()}
    assert current == {("a", "MOVED"), ("b", "C"), ("c", "D"), ("new", "X")}
    assert after.count() == 4 + 3
    again = warehouse.scd2_apply(after, stage, now(), compare=["city"])
    assert rows(again) == rows(after)
    moved = frame(spark, [("new", "Y")], "uuid string, city string")
    later = warehouse.scd2_apply(after, moved, now(), compare=["city"])
    assert [r["city"] for r in later.where("uuid = 'new' AND rowIsCurrent").collect()] == ["Y"]


def test_join_right_suffix_keeps_every_staged_row(dim, stage):
    joined = relational.join_right_suffix(dim, stage, ["code"])
    assert joined.columns == ["code", "name", "city", "name_new", "city_new"]
    assert joined.count() == 6
    assert joined.where("code = 6").collect()[0]["name"] is None


def test_load_time_column(dim):
    assert dict(warehouse.with_load_time(dim, now()).dtypes)["modifiedDate"] == "timestamp_ntz"
    assert dict(warehouse.with_load_time(dim).dtypes)["modifiedDate"] == "timestamp"


def test_require_key(spark):
    require_key(frame(spark, [(1, "a", "b"), (2, "a", "b")]), ["code"])
    for bad in ([(1, "a", "b"), (1, "a", "c")], [(None, "a", "b")]):
        with pytest.raises(DuplicateKey):
            require_key(frame(spark, bad), ["code"])
