import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill import shared
from tidemill.schema import parse_declared
from tidemill.sources import catalog, connectors, documents, files


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name, str(tmp_path / name))
    return name


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\n\nthree\n")
    assert [r["text"] for r in files.read_lines(spark, str(tmp_path)).collect()] == ["one two", "", "three"]


def test_csv_inference_and_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,at\n1,x,2024-01-01 00:00:00\n2,,2024-01-02 00:00:00\n")
    inferred = files.read_csv(spark, str(tmp_path))
    assert dict(inferred.dtypes) == {"id": "int", "name": "string", "at": "timestamp"}
    fixed = files.read_csv(spark, str(tmp_path), "id long, name string, at string")
    assert dict(fixed.dtypes)["id"] == "bigint"
    assert fixed.count() == 2


def test_csv_with_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,name\r\n1,x\r\n2,y\r\n")
    rows = files.read_csv(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, "y")]


def test_text_dump_keeps_nulls_and_empty_strings(spark, tmp_path):
    df = spark.createDataFrame(
        [
            (1, "a\tb", datetime(2024, 1, 1)),
            (2, "", None),
            (3, None, None),
            (4, ' "quoted" \\ ', None),
            (5, "two\nlines, \\\nand \"more", None),
            (6, "ends with \\", None),
            (7, "line\r\nends\rhere", None),
            (8, "\\N", None),
            (9, "\\t \\\\n \\p \\\\", None),
        ],
        "id int, name string, at timestamp_ntz",
    )
    path = str(tmp_path / "dump")
    files.dump_text(df, path)
    assert files.load_text(spark, path, df.schema).orderBy("id").collect() == df.collect()


def test_saving_to_an_existing_path_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    files.save_table_path(spark.range(3), path)
    assert files.read_table_path(spark, path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        files.save_table_path(spark.range(3), path)


def test_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.txt").write_text("text")
    top = files.list_objects(spark, str(tmp_path), "*.bin").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in top] == [("a.bin", 3)]
    deep = files.load_objects(spark, str(tmp_path), "*.bin", recursive=True).collect()
    assert {bytes(r["content"]) for r in deep} == {b"abc", b"\x00\x01"}


def test_listing_does_not_read_contents(spark, sf_dir):
    plan = files.list_objects(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


FILMS = parse_declared(
    {
        "schemaName": "films",
        "dimensionFieldSpecs": [
            {"name": "id", "dataType": "LONG"},
            {"name": "title", "dataType": "STRING"},
            {"name": "genre", "dataType": "STRING"},
            {"name": "year", "dataType": "INT"},
        ],
    }
)


def test_ingest_binds_by_header_name(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.csv").write_text('title,genre,year,id\n"One, Two",Drama,2006,4100200300400500600\n')
    (tmp_path / "b.csv").write_text("title,genre,year,id\nThree,Comedy,2022,4100200300400500601\n")
    (tmp_path / "c.txt").write_text("title,genre,year,id\nNot,Read,1,1\n")
    rows = files.ingest_declared(spark, str(tmp_path), FILMS).orderBy("year").collect()
    assert [tuple(r) for r in rows] == [
        (4100200300400500600, "One, Two", "Drama", 2006),
        (4100200300400500601, "Three", "Comedy", 2022),
    ]


def test_ingest_fills_missing_columns_and_drops_unknown_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("extra,id,title\nx,1,One\n")
    rows = files.ingest_declared(spark, str(tmp_path), FILMS).collect()
    assert [tuple(r) for r in rows] == [(1, "One", None, None)]


def test_ingest_binds_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,genre,year,id\nOne,Drama,2006,1\n")
    (tmp_path / "b.csv").write_text('genre,title,id\n"Dra,ma",Two,2\n')
    rows = files.ingest_declared(spark, str(tmp_path), FILMS).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "One", "Drama", 2006), (2, "Two", "Dra,ma", None)]


@pytest.mark.parametrize("line", ["One,Drama,soon,1", "One,Drama,99999999999,1", "One,Drama", "a,b,1,2,3"])
def test_rows_that_do_not_fit_raise(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(f"title,genre,year,id\nOk,Drama,2006,1\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|PARSE"):
        files.ingest_declared(spark, str(tmp_path), FILMS).collect()
    with pytest.raises(Exception, match="MALFORMED|PARSE"):
        files.read_csv(spark, str(tmp_path), "title string, genre string, year int, id long").collect()


@pytest.mark.parametrize("line", ["1", "1\t2\t3", "x\ty", "99999999999\ty"])
def test_dumps_that_do_not_fit_raise(spark, tmp_path, line):
    (tmp_path / "a.txt").write_text(f"7\tok\n{line}\n")
    with pytest.raises(Exception, match="CAST|width"):
        files.load_text(spark, str(tmp_path), "id int, name string").collect()


def test_one_large_dump_is_read_by_several_tasks(spark, tmp_path):
    text = F.concat(F.lit("line\nbreak"), F.col("id"))
    df = spark.range(200_000).select("id", text.alias("name"))
    files.dump_text(df.coalesce(1), str(tmp_path / "dump"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        loaded = files.load_text(spark, str(tmp_path / "dump"), df.schema)
        assert loaded.rdd.getNumPartitions() > 3
        assert loaded.exceptAll(df).isEmpty() and loaded.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_insert_by_name(spark, database):
    table = f"{database}.t"
    catalog.create_table(spark, table, {"a": "int", "b": "int"})
    catalog.insert_by_name(spark.createDataFrame([(2, 1)], "b int, a int"), table)
    assert tuple(spark.table(table).collect()[0]) == (1, 2)
    for bad in ("a int", "a int, b int, c int"):
        with pytest.raises(ValueError):
            catalog.insert_by_name(spark.createDataFrame([], bad), table)


def test_append_or_create_guards_the_key(spark, database):
    table = f"{database}.t"
    catalog.append_or_create(spark.createDataFrame([(1, "a")], "id int, v string"), table, ["id"])
    catalog.append_or_create(spark.createDataFrame([("b", 2)], "v string, id int"), table, ["id"])
    assert spark.table(table).count() == 2
    with pytest.raises(catalog.DuplicateKey):
        catalog.append_or_create(spark.createDataFrame([(2, "c")], "id int, v string"), table, ["id"])
    assert spark.table(table).count() == 2


def test_partitions_are_pruned(spark, database, tmp_path):
    table, location = f"{database}.t", str(tmp_path / "parts")
    catalog.create_table(
        spark, table, {"v": "bigint", "y": "int"}, partition_by=["y"], location=location
    )
    df = spark.range(100).select(F.col("id").alias("v"), (F.col("id") % 4).cast("int").alias("y"))
    catalog.append_partitioned(df, location, ["y"])
    catalog.append_partitioned(df, location, ["y"])
    catalog.add_partitions(df, table, ["y"])
    one = spark.table(table).where("y = 2")
    assert one.count() == 50
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan


def test_catalog_statements(spark, database):
    catalog.save_table(spark.range(3), f"{database}.t")
    assert database in {r[0] for r in catalog.show_databases(spark).collect()}
    assert database in {r[0] for r in catalog.show_databases(spark, "spark_catalog").collect()}
    before = catalog.current_database(spark).collect()[0][0]
    catalog.use_database(spark, database)
    assert catalog.current_database(spark).collect()[0][0] == database
    assert "t" in {r["tableName"] for r in catalog.show_tables(spark).collect()}
    catalog.use_database(spark, before)
    described = {r["col_name"]: r["data_type"] for r in catalog.describe_table(spark, f"{database}.t").collect()}
    assert described["id"] == "bigint" and described["Provider"] == "parquet"
    catalog.truncate_table(spark, f"{database}.t")
    assert catalog.run_statement(spark, f"SELECT * FROM {database}.t").count() == 0
    catalog.drop_table(spark, f"{database}.t")
    catalog.drop_table(spark, f"{database}.t")
    catalog.register_views({"some_view": spark.range(2)})
    catalog.register_views({"some_view": spark.range(4)})
    assert spark.table("some_view").count() == 4


def test_connector_options():
    assert connectors.topic_read_options("host", 9092, "sales") == {
        "kafka.bootstrap.servers": "host:9092",
        "subscribe": "sales",
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    assert connectors.topic_write_options("host", 9092, "sales")["topic"] == "sales"
    assert connectors.document_read_options("u", "d", "c") == {
        "spark.mongodb.read.connection.uri": "u",
        "spark.mongodb.read.database": "d",
        "spark.mongodb.read.collection": "c",
    }
    assert connectors.document_write_options("u", "d", "c")["spark.mongodb.write.batch.size"] == "10000"
    assert connectors.socket_options("h", 1) == {"host": "h", "port": "1"}
    assert connectors.query_options("jdbc:x", "SELECT 1")["query"] == "SELECT 1"
    sliced = connectors.query_options(
        "jdbc:x", "SELECT id FROM t", partition_column="id", lower=0, upper=9, partitions=3
    )
    assert sliced["dbtable"].startswith("(SELECT id FROM t)") and "query" not in sliced
    with pytest.raises(ValueError):
        connectors.query_options("jdbc:x", "SELECT 1", partition_column="id")
    assert connectors.table_write_options("jdbc:x", "t")["batchsize"] == "10000"


def test_read_and_write_apply_options(spark, tmp_path):
    path = str(tmp_path / "t")
    connectors.write(spark.range(3), "csv", {"sep": ";", "path": path}).save()
    assert connectors.read(spark, "csv", {"inferSchema": "true"}).load(path).count() == 3


def test_shared_folder(spark):
    root = shared.shared_root(spark)
    assert shared.new_folder(spark, "x") != shared.new_folder(spark, "x")
    assert shared.new_folder(spark, "x").startswith(root)
    kept = shared.keep(spark.range(5))
    assert kept.count() == 5
    path = shared.new_folder(spark, "folder")
    assert not shared.path_exists(spark, path)
    spark.range(2).write.parquet(path)
    assert shared.is_folder(spark, path) and shared.path_exists(spark, path)
    assert len(shared.matching_paths(spark, f"{path}/_SUCC*")) == 1
    assert shared.matching_paths(spark, f"{path}/none/x*") == []
    shared.remove_folder(spark, path)
    assert not shared.path_exists(spark, path)


def test_ingest_drops_first_lines_by_place(spark, tmp_path):
    header = "title,genre,year,id"
    (tmp_path / "a.csv").write_text(f"{header}\nOne,Drama,2006,1\n")
    # a column's names as data, and a file of nothing but a header
    (tmp_path / "b.csv").write_text("title,genre\nOne,Drama\ntitle,genre\n")
    (tmp_path / "c.csv").write_text(f"{header}\n")
    rows = files.ingest_declared(spark, str(tmp_path), FILMS).orderBy("id", "title").collect()
    assert [tuple(r) for r in rows] == [
        (None, "One", "Drama", None), (None, "title", "genre", None), (1, "One", "Drama", 2006)
    ]


def test_ingest_reads_lines_once_for_all_headers(spark, tmp_path):
    for i, header in enumerate(["title,id", "id,title", "id,title,extra", "genre,id"]):
        (tmp_path / f"{i}.csv").write_text(f"{header}\n" + ",".join("7" for _ in header.split(",")) + "\n")
    df = files.ingest_declared(spark, str(tmp_path), FILMS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and plan.count("FileScan text") == 0
    assert [r["id"] for r in df.collect()] == [7, 7, 7, 7]


def test_ingest_refuses_fields_with_line_breaks_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,genre,year,id\n"One\nTwo",Drama,2006,1\n')
    with pytest.raises(Exception, match="line break"):
        files.ingest_declared(spark, str(tmp_path), FILMS).collect()


def test_ingest_of_a_file_in_several_splits(spark, tmp_path):
    lines = "".join(f"t{i},{i}\n" for i in range(5000))
    (tmp_path / "a.csv").write_text("title,id\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.ingest_declared(spark, str(tmp_path), FILMS)
        assert df.rdd.getNumPartitions() > 3
        assert sorted(r["id"] for r in df.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


MIXED = [
    '{"_id": 1, "name": "a", "tags": ["x", "y"], "at": {"lat": 1.5}}',
    '{"_id": "2", "name": null, "tags": "none"}',
    '{"name": 7}',
    "{}",
]


def test_documents_of_differing_shape(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(MIXED) + "\n")
    docs = documents.read_documents(spark, str(tmp_path / "in"))
    fields = {
        "id": ("$._id", "bigint"), "name": ("$.name", "string"),
        "tag": ("$.tags[1]", "string"), "lat": ("$.at.lat", "double"),
    }
    wanted = {(1, "a", "y", 1.5), (2, None, None, None), (None, "7", None, None), (None, None, None, None)}
    assert {tuple(r) for r in documents.with_fields(docs, fields).drop("document").collect()} == wanted
    schema = documents.collection_schema(docs)
    assert "at: STRUCT<lat: DECIMAL(2,1)>" in schema.replace("`", "") and "tags: VARIANT" in schema
    documents.write_documents(docs, str(tmp_path / "out"))
    again = documents.read_documents(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in documents.with_fields(again, fields).drop("document").collect()} == wanted
    bare = documents.without_fields(docs, "_id", "at")
    assert {r["id"] for r in documents.with_fields(bare, fields).collect()} == {None}
    assert {r["name"] for r in documents.with_fields(bare, fields).collect()} == {"a", None, "7"}
    rows = documents.typed_rows(docs)
    assert set(rows.columns) == {"_id", "name", "tags", "at"} and rows.count() == 4


def test_documents_that_can_not_be_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        documents.read_documents(spark, str(tmp_path)).collect()
    texts = spark.createDataFrame([('{"a": 1}',), ("{",)], "text string")
    lenient = documents.parse_documents(texts, "text", strict=False)
    assert lenient.where("document IS NULL").count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        documents.parse_documents(texts, "text").collect()
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        one = documents.parse_documents(spark.createDataFrame([('{"a": "x"}',)], "text string"), "text")
        documents.with_fields(one, {"a": ("$.a", "int")}, strict=True).collect()
    rows = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    assert sorted(r[0] for r in documents.as_documents(rows).selectExpr("to_json(document)").collect()) == [
        '{"a":1}', '{"b":"x"}'
    ]


def test_a_profile_is_taken_while_a_table_is_saved(spark, database):
    df = spark.range(10).selectExpr("id", "if(id < 4, null, 'x') AS `odd name`", "array(id) AS xs")
    profile = catalog.save_profiled(df, f"{database}.profiled")
    assert [tuple(r) for r in profile.collect()] == [
        (0, "id", "bigint", 10, 0), (1, "odd name", "string", 10, 4), (2, "xs", "array<bigint>", 10, 0)
    ]
    assert spark.table(f"{database}.profiled").count() == 10
    nothing = catalog.save_profiled(df.where("false"), f"{database}.empty")
    assert {r["n_rows"] for r in nothing.collect()} == {0}
