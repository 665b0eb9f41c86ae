import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import generate, quality
from tidemill.plans.records import generated_table
from tidemill.sources import files
from tidemill.schema import DECLARED_TYPES, load_declared, parse_declared



def now():
    return F.lit("2024-06-01 12:30:15.250").cast("timestamp")



def declared(*columns, **more):
    dims = [{"name": n, "dataType": t} for n, t in columns]
    return parse_declared({"schemaName": "t", "dimensionFieldSpecs": dims, **more})


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_rows_do_not_depend_on_the_partitioning(spark, partitions):
    table = generated_table()
    ids = spark.range(0, 300, 1, partitions)
    rows = generate.generate_for(ids, table, now=now()).orderBy("serial").collect()
    one = generate.generate_for(spark.range(0, 300, 1, 1), table, now=now()).orderBy("serial").collect()
    assert rows == one


def test_values_follow_their_types(spark):
    rows = generate.generate_rows(spark, generated_table(), 500, now=now()).collect()
    assert len(rows) == 500
    assert {r["device_type"] for r in rows} == set(generate.VOCABULARIES["device_types"])
    assert {r["browser_version"] for r in rows} <= set(generate.VOCABULARIES["browser_versions"])
    assert len({r["serial"] for r in rows}) == 500
    assert all(0 <= r["reading"] <= 500 for r in rows)
    assert max(r["reading"] for r in rows) > 400 and min(r["reading"] for r in rows) < 100
    assert all(0.01 <= r["score"] <= 99.99 for r in rows)
    assert rows[0]["day"] == date(2024, 6, 1)
    assert rows[0]["clock"] == "12:30:15.250000"
    assert rows[0]["payload"] == "unknown"
    assert rows[0]["ts"] == 1717245015250
    assert rows[0]["description"].count(".") == 3


def test_seed_changes_the_rows(spark):
    table = declared(("n", "INT"))
    first = generate.generate_rows(spark, table, 50).collect()
    assert first == generate.generate_rows(spark, table, 50).collect()
    assert first != generate.generate_rows(spark, table, 50, seed=1).collect()


def test_every_declared_type_gets_a_value(spark):
    table = declared(*[(f"c_{t.lower()}", t) for t in DECLARED_TYPES], ("ts", "STRING"))
    df = generate.generate_rows(spark, table, 3, now=now())
    assert [f.dataType for f in df.schema.fields] == [c.spark_type for c in table.columns]
    assert all(v is not None for v in df.collect()[0])


def test_vocabulary_needs_a_similar_name():
    assert generate.closest_vocabulary("device_type") == "device_types"
    assert generate.closest_vocabulary("Locale") == "locales"
    assert generate.closest_vocabulary("device") is None


def test_record_key_is_the_key_of_the_same_row(spark):
    table = declared(("a", "INT"), ("b", "STRING"), primaryKeyColumns=["a", "b"])
    for r in generate.as_records(generate.generate_rows(spark, table, 20), table).collect():
        value = json.loads(r["value"])
        assert r["key"] == f"{value['a']}-{value['b']}"


def test_batch_input_is_csv_only(spark, tmp_path):
    table = generated_table()
    rows = generate.generate_rows(spark, table, 30, now=now())
    job = {"inputDirURI": f"{tmp_path}/in/", "recordReaderSpec": {"dataFormat": "CSV"}}
    ingested = files.ingest_declared(spark, generate.write_batch_input(rows, job), table)
    assert ingested.orderBy("serial").collect() == rows.orderBy("serial").collect()
    with pytest.raises(ValueError, match="avro is not supported"):
        generate.write_batch_input(rows, {**job, "recordReaderSpec": {"dataFormat": "avro"}})


def test_declared_schema(tmp_path):
    spec = {
        "schemaName": "s",
        "dimensionFieldSpecs": [{"name": "id", "dataType": "long"}],
        "metricFieldSpecs": [{"name": "score", "dataType": "FLOAT"}],
        "dateTimeFieldSpecs": [{"name": "at", "dataType": "LONG", "format": "1:MILLISECONDS:EPOCH"}],
        "primaryKeyColumns": ["id"],
    }
    path = tmp_path / "s.json"
    path.write_text(json.dumps(spec))
    table = load_declared(str(path))
    assert table.column_names == ["id", "score", "at"]
    struct = table.to_struct()
    assert [f.dataType for f in struct.fields] == [T.LongType(), T.FloatType(), T.LongType()]
    assert [f.metadata["role"] for f in struct.fields] == ["dimension", "metric", "dateTime"]
    for change in (
        {"primaryKeyColumns": ["at"]},
        {"dimensionFieldSpecs": [{"name": "id", "dataType": "MAP"}]},
    ):
        with pytest.raises(KeyError):
            parse_declared({**spec, **change})
    with pytest.raises(KeyError):
        parse_declared({"schemaName": "s"})


def test_checks(spark):
    seven = spark.range(7).agg(F.count("*").alias("n"))
    checked = quality.check_results({"right": (seven, 7), "wrong": (seven, 8), "none": (spark.range(0), 1)})
    got = {r["check"]: (r["actual"], r["expected"], r["ok"]) for r in checked.collect()}
    assert got == {"right": ("7", "7", True), "wrong": ("7", "8", False), "none": (None, "1", False)}
    with pytest.raises(quality.CheckFailed, match="wrong: 7 != 8"):
        quality.require(checked)
    assert quality.require(checked.where("ok")).count() == 1


def test_every_part_of_a_text_has_a_digest_of_its_own(spark):
    ids = spark.range(200)
    table = declared(("company", "STRING"), ("phone", "STRING"), ("description", "STRING"))

    def part(i, column, n):
        return int(hashlib.md5(f"{i}|{column}|0|{n}".encode()).hexdigest()[:15], 16)

    def phrase(i, column, first):
        kinds = (generate.VERBS, generate.QUALITIES, generate.NOUNS)
        return " ".join(w[part(i, column, first + n) % len(w)] for n, w in enumerate(kinds))

    wanted = [
        (
            phrase(i, "company", 0),
            "-".join(f"{part(i, 'phone', n) % 10**k:0{k}}" for n, k in enumerate((3, 3, 4))),
            " ".join(phrase(i, "description", 3 * n).title() + "." for n in range(3)),
        )
        for i in range(200)
    ]
    assert sorted(map(tuple, generate.generate_for(ids, table).collect())) == sorted(wanted)
    other = generate.generate_for(ids, table, one_digest=True)
    assert sorted(map(tuple, other.collect())) != sorted(wanted)
