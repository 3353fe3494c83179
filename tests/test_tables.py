"""Inference, quality, sinks, sources and streams."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.catalog import all_queries
from tidemill.catalog.check_queries import _moved
from tidemill.catalog.registry import fresh_name
from tidemill.operators import columns, inspect, quality
from tidemill.operators import rows as rows_module
from tidemill.operators.snapshots import snapshot_hash
from tidemill.operators.sql import step_sql
from tidemill.operators.changes import apply_changes
from tidemill.operators.snapshots import snapshot_hash
from tidemill.session import scratch_path
from tidemill.sinks import files as out
from tidemill.sinks import tables as sink
from tidemill.sources import envelopes as env
from tidemill.sources import extract as ex
from tidemill.sources import files, relational
from tidemill.streaming import sync


def inferred(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return inspect.infer_types(df, **kw)["c"]


@pytest.mark.parametrize("values, want", [
    (["1", "2", None], "SMALLINT"), (["-32768", "32767"], "SMALLINT"), (["32768"], "INTEGER"), (["2147483648"], "BIGINT"),
    (["9223372036854775807"], "BIGINT"), (["9223372036854775808"], "NUMERIC"), (["-9223372036854775808"], "BIGINT"),
    (["12345678901234567890123456789012"], "NUMERIC"), (["1" * 60], "NUMERIC"), (["1.5", "2"], "DOUBLE PRECISION"),
    (["1.0", "2.0"], "SMALLINT"), (["0", "1"], "BOOLEAN"), (["true", "False", None], "BOOLEAN"), (["true", "1"], "VARCHAR(8)"),
    (["2024-01-15", "2024-2-29"], "DATE"), (["2023-02-29"], "VARCHAR(20)"), (["13/02/2024"], "DATE"), (["02/13/2024"], "DATE"),
    (["2024/01/02"], "DATE"), (["2024-01-15 10:30:00"], "TIMESTAMP"), (["31/12/2024 23:59:59"], "TIMESTAMP"),
    (["2024-01-15", "15/01/2024"], "VARCHAR(20)"), (["2024-01-15T10:30:00"], "TIMESTAMP"), ([None, None], "TEXT"),
    (["a" * 200], "VARCHAR(255)"), (["a" * 256], "TEXT"), (["1", "x"], "VARCHAR(2)"), (["1900-02-29"], "VARCHAR(20)"),
    (["2000-02-29"], "DATE"), (["5d"], "VARCHAR(4)"),
])
def test_inference(spark, values, want):
    assert inferred(spark, values).sql_type == want


def test_inference_of_texts_and_typed_columns(spark):
    assert inferred(spark, ["0", "1"], numeric_text=False).sql_type == "SMALLINT"
    df = spark.sql("select 1 as a, cast(null as int) as b, timestamp_ntz'2024-01-01 00:00:00' as c, timestamp_ntz'2024-01-01 01:00:00' as d,"
                   " array(1) as e, 2.5D as f, 7L as g, true as h, date'2024-01-01' as i")
    got = {k: v.sql_type for k, v in inspect.infer_types(df).items()}
    assert got == {"a": "BOOLEAN", "b": "TEXT", "c": "DATE", "d": "TIMESTAMP", "e": "JSONB", "f": "DOUBLE PRECISION",
                   "g": "SMALLINT", "h": "BOOLEAN", "i": "DATE"}


def test_column_preview_samples(spark):
    # the only value of "late" lies beyond the first rows
    df = spark.range(3000).select(F.col("id").alias("ID-x"), F.when(F.col("id") == 2999, "end").alias("late"))
    got = {r["original_name"]: r for r in inspect.column_preview(df).collect()}
    assert got["late"]["sample_values"] == ["end"] and got["late"]["unique_values"] == 2 and got["late"]["nullable"]
    assert got["ID-x"]["name"] == "id_x" and len(got["ID-x"]["sample_values"]) == 5 and not got["ID-x"]["nullable"]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 7, F.lit("a")).when(F.col("id") == 9, "b").alias("few"),
                                 F.lit(None).cast("string").alias("none"))
    found = inspect.samples(df.repartition(7))
    assert found == inspect.samples(df.repartition(2, "few")) == inspect.samples(df.coalesce(1))
    assert sorted(found["few"]) == ["a"] * 4 + ["b"] and found["none"] == [] and len(set(found["id"])) == 5
    assert {len(v) for v in inspect.samples(df, 3).values()} == {0, 3}


def test_one_job_for_many_columns(spark):
    wide = spark.range(20).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(300)])
    assert len(inspect.infer_types(wide)) == 300


def test_import_with_text_id(spark, rows):
    path = scratch_path(spark, "mixed")
    csv = "id,Name,note\n1,a,\"x, \"\"y\"\"\"\n,b,z\ninvalid,c,w\n"
    spark.createDataFrame([(csv.rstrip(),)], "value string").write.text(path)
    df = files.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "string", "Name": "string", "note": "string"}
    assert df.filter("id = '1'").first()["note"] == 'x, "y"'
    made = columns.add_surrogate_id(columns.sanitize_columns(df), ["name"])
    assert rows(made.select("id", "id_original", "name")) == [(1, "1", "a"), (2, None, "b"), (3, "invalid", "c")]
    assert sink.ddl_for(df, "mixed").split("\n")[1:3] == ['    "id" BIGSERIAL PRIMARY KEY,', '    "id_original" VARCHAR(14),']


@pytest.fixture(scope="module")
def dirty(spark):
    data = [(1, "a", 5, "7"), (2, None, 50, "-5"), (3, "a", None, None), (4, "c", -1, "x")]
    return spark.createDataFrame(data, "id int, s string, n int, t string")


def test_quality_parts_add_up(dirty, rows):
    rules = [quality.not_null("s"), quality.unique("s"), quality.in_range("n", 0, 10), quality.data_type("t", "int")]
    found = quality.issues(dirty, rules, ["id"])
    assert rows(found.select("id", "issue_type")) == [
        (1, "duplicate_key"), (2, "null_value"), (2, "range_violation"), (2, "type_mismatch"), (3, "duplicate_key"),
        (4, "range_violation"), (4, "type_mismatch")]
    assert tuple(quality.validate(dirty, rules).first()) == (4, 4, 4, 0, 7)
    clean, bad = quality.isolate(dirty, rules[:1])
    assert clean.count() == 3 and bad.count() == 1 and clean.columns == dirty.columns
    assert quality.isolate(dirty, rules, "fix")[0].filter("s = ''").count() == 1
    assert quality.issues_head(found, ["id"], 3).first()["has_more"] and quality.issues_head(found, ["id"], 3).count() == 3
    assert not quality.issues_head(found, ["id"], 7).first()["has_more"]
    with pytest.raises(ValueError):
        quality.isolate(dirty, rules, "burn")


def test_two_nulls_are_duplicates(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, s string")
    assert quality.issues(df, [quality.unique("s")], ["id"]).count() == 2
    assert len({r[0] for r in quality.issues(df, [quality.unique("s")], ["id"]).select("issue_id").collect()}) == 2


def test_auto_profile_and_constraints(dirty):
    rules = {(r.kind, r.column) for r in quality.auto_profile(dirty)}
    assert {("not_null", "s"), ("unique", "id"), ("range", "n"), ("data_type", "t")} <= rules and ("not_null", "id") not in rules
    made = columns.constraint_rules([{"name": "id", "primary_key": True}, {"name": "s", "unique": True}])
    assert [(r.kind, r.column) for r in made] == [("not_null", "id"), ("unique", "id"), ("unique", "s")]


def test_auto_profile_reads_all_rows(spark):
    df = spark.range(5000).selectExpr("id % 4999 AS almost", "id AS v", "id AS k", "if(id = 4321, 'rare', 'usual') AS s")
    found = {(r.kind, r.column) for r in quality.auto_profile(df)}
    assert {("unique", "v"), ("unique", "k")} <= found and not {("unique", "almost"), ("unique", "s")} & found
    # the limits hold for every row, so no row breaks a rule that the data itself suggested
    assert quality.issues(df, quality.auto_profile(df), ["k"]).count() == 0
    assert quality.auto_profile(spark.createDataFrame([], "a int, s string")) == []


def test_upsert_twice_is_once(spark, rows):
    table, path = fresh_name("t"), scratch_path(spark, "t")
    sink.save(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, s string, n int"), table, location=path)
    batch = spark.createDataFrame([(2, "B1", 1), (2, "B2", 2), (None, "N", 1), (4, "d", 1)], "k int, s string, o int")
    for _ in range(2):
        sink.save_upsert(batch.select("k", "s", F.col("o").alias("n")).drop("n"), table, ["k"], ["s"], path)
        assert rows(spark.table(table)) == [(1, "a", 1), (2, "B2", 2), (4, "d", None), (None, "N", 3)]
    sink.save_replace_rows(spark.createDataFrame([(1, "z")], "k int, s string"), table, ["k"], location=path)
    assert spark.table(table).filter("k = 1").first()["n"] is None
    with pytest.raises(ValueError, match="order_by"):
        sink.save_upsert(batch.select("k", "s"), table, ["k"], location=path)
    with pytest.raises(ValueError, match="not in the target"):
        sink.save_append(spark.createDataFrame([(1, 2)], "k int, zz int"), table)
    with pytest.raises(ValueError, match="mode"):
        sink.save(batch, table, "truncate")


def test_failed_replace_leaves_the_table(spark, rows):
    table, path = fresh_name("t"), scratch_path(spark, "t")
    sink.save(spark.range(3), table, location=path)
    before = rows(spark.table(table))
    broken = spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))
    with pytest.raises(Exception, match="boom"):
        sink.save(broken, table, location=path)
    assert rows(spark.table(table)) == before
    # a plan may read the table it replaces
    sink.save(spark.table(table).withColumn("id", F.col("id") + 1), table, location=path)
    assert rows(spark.table(table)) == [(1,), (2,), (3,)]
    sink.save(spark.range(1).withColumn("x", F.lit("new schema")), table, location=path)
    assert spark.table(table).columns == ["id", "x"]
    sink.create_table(spark, fresh_name("made"), {"id": "BIGINT", "name": "VARCHAR(20)"})


def test_versions_and_the_warehouse(spark, rows):
    """Without a location a table lives in the warehouse; the last versions stay and can be restored."""
    table = fresh_name("homed")
    try:
        for n in range(1, 6):
            sink.save(spark.range(n), table)
        warehouse = spark.catalog.getDatabase(spark.catalog.currentDatabase()).locationUri
        assert sink.location_of(spark, table).startswith(f"{warehouse}/{table}/v_")
        kept = sink.table_versions(spark, table)
        assert len(kept) == sink.KEEP_VERSIONS and [spark.read.parquet(v).count() for v in kept] == [3, 4, 5]
        sink.restore_version(spark, table, kept[0])
        assert spark.table(table).count() == 3
        sink.save(spark.range(7), table)
        assert spark.table(table).count() == 7
        with pytest.raises(ValueError, match="no version"):
            sink.restore_version(spark, table, kept[0] + "x")
        for mode in ("append", "fail"):
            other = fresh_name(mode)
            sink.save(spark.range(2), other, mode)
            assert sink.location_of(spark, other).startswith(warehouse) and spark.table(other).count() == 2
            spark.sql(f"DROP TABLE {other}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_a_failing_change_of_schema_leaves_the_table(spark, rows, monkeypatch):
    table, path = fresh_name("t"), scratch_path(spark, "t")
    sink.save(spark.range(3), table, location=path)
    sink.set_keys(spark, table, ["id"])
    real, calls = sink._rename, []

    def failing(spark, old, new):
        calls.append((old, new))
        if len(calls) == 2:
            raise RuntimeError("lost the catalog")
        real(spark, old, new)

    monkeypatch.setattr(sink, "_rename", failing)
    with pytest.raises(RuntimeError, match="lost"):
        sink.save(spark.range(2).withColumn("x", F.lit(1)), table, location=path)
    assert spark.table(table).columns == ["id"] and spark.table(table).count() == 3
    monkeypatch.setattr(sink, "_rename", real)
    sink.save(spark.range(2).withColumn("x", F.lit(1)), table, location=path)
    assert spark.table(table).columns == ["id", "x"] and sink.table_keys(spark, table) == ["id"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{table}__")]


def test_upsert_by_the_keys_of_the_table(spark, rows):
    """Keys are kept with the table; the batch is computed once, also if it isn't deterministic."""
    table, path = fresh_name("t"), scratch_path(spark, "t")
    sink.save_upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"), table, ["k"], location=path)
    assert sink.table_keys(spark, table) == ["k"]
    sink.save_upsert(spark.createDataFrame([(2, "B"), (3, "c")], "k int, s string"), table)
    assert rows(spark.table(table)) == [(1, "a"), (2, "B"), (3, "c")]
    runs = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            runs.add(part.num_rows)
            yield part

    batch = spark.range(4, 6, numPartitions=1).selectExpr("cast(id as int) k", "'x' s").mapInArrow(seen, "k int, s string")
    sink.save_upsert(batch, table)
    assert runs.value == 2 and spark.table(table).count() == 5


def test_ids_and_numbers_are_not_lost(spark, rows):
    """Fractions and long numbers stay: as original id, as decimals with the scale they need, or as text."""
    df = spark.createDataFrame([("1.5", "a"), ("2", "b"), (None, "c"), ("2", "d")], "id string, n string")
    out_ids = columns.add_surrogate_id(df, ["n"])
    assert rows(out_ids.select("id", "id_original")) == [(1, "1.5"), (2, "2"), (3, None), (4, "2")]
    assert columns.id_report(df).first().asDict() == {"rows": 4, "null_ids": 1, "other_ids": 1, "repeated_ids": 1}
    assert columns.id_report(df.filter("false")).first().asDict() == {"rows": 0, "null_ids": 0, "other_ids": 0, "repeated_ids": 0}
    long = "1234567890" * 4
    cells = spark.createDataFrame([("12.5", long, "1e400", "7", "x"), ("-0.25", "1", "2", "00012.500", "3"), (None, None, None, " 5 ", None)], "a string, b string, c string, d string, e string")
    for cast in (lambda: rows_module.cast_to_ddl(cells, dict.fromkeys("abcde", "NUMERIC")), lambda: rows_module.preserve_big_integers(cells, list("abcde"))):
        found = cast()
        assert dict(found.dtypes) == {"a": "decimal(38,2)", "b": "string", "c": "string", "d": "decimal(38,1)", "e": "decimal(38,0)"}
        got = found.select([F.col(c).cast("string") for c in found.columns]).collect()
        assert [tuple(r) for r in got] == [("12.50", long, "1e400", "7.0", None), ("-0.25", "1", "2", "12.5", "3"), (None, None, None, "5.0", None)]
        assert rows_module.lost_cells(cells, found, list("abcde")) == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1}


def test_lines_are_numbered_where_they_are_read(spark):
    path = scratch_path(spark, "numbered")
    spark.range(3000).selectExpr("repeat(cast(id as string), 50) value").repartition(3).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.read_text_lines(spark, path, keep_source=True)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert lines.rdd.getNumPartitions() > 10
        found = {}
        for r in lines.collect():
            found.setdefault(r["file"], {})[r["line_number"]] = r["content"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 3
    for name, numbered in found.items():
        assert [numbered[i + 1] for i in range(len(numbered))] == Path(name.removeprefix("file://").removeprefix("file:")).read_text().splitlines()


def test_text_lines_by_brute_force(spark):
    path, texts = scratch_path(spark, "lines"), []
    for i in range(3):
        text = "\n".join("" if (j * 7 + i) % 5 == 0 else f"file {i} line {j} " + "x" * (j % 90) for j in range(1, 3000))
        texts.append(text)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(r[0], r[1]) for r in files.read_text_lines(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n, line) for text in texts for n, line in enumerate(text.split("\n"), 1) if line.strip()}
    assert got == want


def test_json_shapes(spark, rows):
    def written(text):
        path = scratch_path(spark, "json")
        spark.createDataFrame([(text,)], "value string").write.text(path)
        return path

    doc = written(json.dumps({"meta": {"v": 1}, "a": {"b": [{"x": 1, "y": {"z": 2}}, {"x": 3}]}}))
    assert rows(files.read_json_path(spark, doc, "root.a.b")) == [(1, 2), (3, None)]
    assert files.read_json_path(spark, doc, "root.a.b").columns == ["x", "y.z"]
    assert files.read_json_path(spark, doc, "root").columns == ["a.b", "meta.v"]
    assert rows(inspect.nested_array_inventory(files.read_json(spark, doc, flatten=False))) == [("a.b", 2, 2)]
    assert rows(files.read_json(spark, written('[{"a":1},{"a":2}]'))) == [(1,), (2,)]
    assert rows(files.read_json(spark, written("42"))) == [("42",)]
    wrapped = spark.read.json(written('{"results":[{"a":1},{"a":2}],"count":9}'))
    assert rows(env.unwrap_response(wrapped)) == [(1,), (2,)] and env.response_total(wrapped).first()[0] == 9


def test_bad_files_are_skipped(spark):
    root = scratch_path(spark, "many")
    out.write_csv(spark.range(3), f"{root}/a.csv")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{root}/b.parquet")
    spark.createDataFrame([("l1",), ("",), ("l3",)], "value string").coalesce(1).write.text(f"{root}/c")
    errors = []
    found = files.read_by_extension(spark, [f"{root}/a.csv", f"{root}/b.parquet", f"{root}/c"], lambda f, e: errors.append(f))
    assert set(found) == {"csv", "txt"} and errors == [f"{root}/b.parquet"]
    assert sorted(tuple(r) for r in found["txt"].collect()) == [(1, "l1"), (3, "l3")]


def test_columns_are_united_by_name(spark):
    root = scratch_path(spark, "names")
    for name, text in (("a.csv", "id,name\n1,ann\n"), ("b.csv", "name,id\nbob,2\n"), ("c.csv", "id,age\n3,30\n")):
        spark.createDataFrame([(line,) for line in text.split()], "value string").coalesce(1).write.text(f"{root}/{name}")
    out.write_parquet(spark.createDataFrame([(1,)], "a int"), f"{root}/a.parquet")
    out.write_parquet(spark.createDataFrame([(2, "x")], "a int, b string"), f"{root}/b.parquet")
    out.write_parquet(spark.createDataFrame([("three",)], "a string"), f"{root}/c.parquet")
    paths = [f"{root}/{n}" for n in ("a.csv", "b.csv", "c.csv", "a.parquet", "b.parquet")]
    found = files.read_by_extension(spark, paths)
    people = {tuple(r) for r in found["csv"].select("id", "name", "age").collect()}
    assert people == {("1", "ann", None), ("2", "bob", None), ("3", None, "30")}
    assert {tuple(r) for r in found["parquet"].select("a", "b").collect()} == {(1, None), (2, "x")}
    mixed = files.read_by_extension(spark, [f"{root}/{n}.parquet" for n in "abc"])["parquet"]
    assert {tuple(r) for r in mixed.select("a", "b").collect()} == {("1", None), ("2", "x"), ("three", None)}


def test_a_bad_file_leaves_its_neighbours(spark):
    root = scratch_path(spark, "bad")
    out.write_parquet(spark.range(2), f"{root}/in_a")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{root}/in_b")
    folder = Path(f"{root}/in_b".removeprefix("file://"))
    (folder / "broken.parquet").write_bytes(b"not parquet")
    (folder / "empty.parquet").write_bytes(b"")  # holds nothing that could be lost
    errors = []
    df = files.read_prefix(spark, f"{root}/", "in_", lambda f, e: errors.append(f))
    assert sorted(r["id"] for r in df.where("id is not null").collect()) == [0, 1]
    assert len(errors) == 1 and errors[0].endswith("broken.parquet")
    docs = scratch_path(spark, "docs.json")
    spark.createDataFrame([('{"a":1}',), ("{broken",)], "value string").repartition(2).write.option("maxRecordsPerFile", 1).text(docs)
    errors.clear()
    found = files.read_by_extension(spark, [docs], lambda f, e: errors.append(e))
    assert [tuple(r) for r in found["json"].collect()] == [(1,)] and found["json"].count() == 1
    assert errors == ["no JSON document"] and [r["text"].strip() for r in files.rejected_json(spark, docs).collect()] == ["{broken"]


def test_responses_of_differing_types(spark):
    lines = ['{"data":[{"a":1}]}', '{"results":[{"a":"x","b":2}]}', '{"items":["t"]}', '{"message":"none"}', '{"data":[],"message":"m"}']
    df = env.unwrap_response(spark.read.json(spark.sparkContext.parallelize(lines)))
    found = {tuple(r) for r in df.select("a", "b", "value", "message").collect()}
    assert found == {("1", None, None, None), ("x", 2, None, None), (None, None, "t", None), (None, None, None, "none")}


def test_numbers_of_many_digits_are_loaded_as_text(spark):
    digits = ["1" * 40, "2" * 5, None]
    table = "digits_" + scratch_path(spark, "x").split("/")[-2]
    types = ex.extract_and_load(spark.createDataFrame([(d,) for d in digits], "n string"), table, scratch_path(spark, "digits"))
    assert types["n"] == "TEXT" and {r["n"] for r in spark.table(table).collect()} == set(digits)
    spark.sql(f"DROP TABLE {table}")


def test_few_reads_find_the_bad_files(spark, monkeypatch):
    root = scratch_path(spark, "halves")
    out.write_parquet(spark.range(40).repartition(40), f"{root}/p")
    good = sorted(Path(f"{root}/p".removeprefix("file:")).glob("part*.parquet"))
    for bad in (good[0], good[17]):
        (bad.parent / f"{bad.stem}-broken.parquet").write_bytes(b"no parquet, and long enough to have a footer")
    paths, errors, reads = [str(p) for p in sorted(good[0].parent.glob("part*.parquet"))], [], []
    read = files._read_files
    monkeypatch.setattr(files, "_read_files", lambda *a, **k: reads.append(a) or read(*a, **k))
    found = files.read_by_extension(spark, paths, lambda f, e: errors.append(f))["parquet"]
    assert sorted(r["id"] for r in found.collect()) == list(range(40))
    assert len(errors) == 2 and all("broken" in e for e in errors) and len(reads) < 25


def test_prefix_unites_kinds(spark):
    root = scratch_path(spark, "prefix")
    out.write_csv(spark.range(2), f"{root}/in_a")
    out.write_parquet(spark.range(2, 4), f"{root}/in_b")
    spark.createDataFrame([("line",)], "value string").write.text(f"{root}/in_c")
    df = files.read_prefix(spark, f"{root}/", "in_")
    assert df.count() == 5 and {"id", "content", "line_number", files.SOURCE_KEY} == set(df.columns)


def test_filters_reach_the_scan(spark):
    df = files.read_parquet(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"], {"o_orderstatus": "F"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_jdbc_options():
    config = {"db_type": "postgresql", "host": "h", "database": "d", "username": "u", "password": "p"}
    assert relational.jdbc_options(config) == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p"}
    assert relational.jdbc_url({"db_type": "mssql", "database": "x"}) == "jdbc:sqlserver://localhost:1433;databaseName=x"
    with pytest.raises(ValueError):
        relational.jdbc_url({"db_type": "abacus"})


def test_incremental_run_twice(spark):
    state = scratch_path(spark, "marks")
    df = spark.range(10).withColumn("k", F.when(F.col("id") != 3, F.col("id")))
    first, mark = ex.extract_since_mark(df, "k", state, "s")
    assert first.count() == 10 and mark == "9"
    ex.write_mark(spark, state, "s", mark)
    assert ex.extract_since_mark(df, "k", state, "s")[0].count() == 0
    later, mark = ex.extract_since_mark(spark.range(12).withColumn("k", F.col("id")), "k", state, "s")
    assert later.count() == 2 and mark == "11"


def test_hash_ignores_order(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    assert snapshot_hash(df).first() == snapshot_hash(df.orderBy(F.desc("id")).repartition(3)).first()
    assert snapshot_hash(df).first() != snapshot_hash(df.union(df.limit(1))).first()


def test_moved_rows_fall_into_more_tasks_when_there_are_more(spark, tmp_path):
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
    rows = spark.range(0, 20_000, 1, 8).select(*[(F.xxhash64("id", F.lit(n)) % 1000).cast("string" if "flag" in n or "status" in n else "double").alias(n) for n in names])
    rows.withColumn("l_partkey", F.lit(7)).write.parquet(f"{tmp_path}/lineitem.parquet")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        moved = _moved(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), "l_partkey")
        per_task = [r["count"] for r in moved.select(F.spark_partition_id().alias("p")).withColumn("one", F.lit(1)).groupBy("p").count().collect()]
        tasks = moved.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert sum(per_task) == 20_000 and tasks > 5
    found = all_queries()["snapshot_hash"](spark, str(tmp_path)).collect()
    assert {r["kind"]: r["alike"] for r in found} == {"same": True, "moved": True, "changed": False, "swapped": False, "repeated": False}


def test_fingerprint_sees_nulls_names_and_maps(spark):
    def print_of(rows, schema):
        return spark.createDataFrame(rows, schema).transform(snapshot_hash).first()

    assert print_of([(None, "a")], "x string, y string") != print_of([("a", None)], "x string, y string")
    assert print_of([("a",)], "x string") != print_of([("a",)], "y string")
    assert print_of([({"k": 1},)], "x map<string,int>") != print_of([({"k": 2},)], "x map<string,int>")


def test_sql_step_leaves_the_users_views(spark):
    spark.range(3).createOrReplaceTempView("source_data")
    assert step_sql(spark.range(5), "SELECT count(*) AS n FROM source_data").first().n == 5
    assert spark.table("source_data").count() == 3
    spark.catalog.dropTempView("source_data")


def test_quarantine_ids_stay_text(spark):
    path = scratch_path(spark, "quarantine_ids")
    quality.quarantine_records(spark.range(2), path, "set", "007", "by hand")
    assert [r.quarantine_id for r in quality.list_quarantine(spark, path).collect()] == ["007"]


def test_pages_lose_no_ties(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    pages = [rows_module.page(df, [F.col("k").desc()], n, 30) for n in range(1, 5)]
    assert sorted(r.id for p in pages for r in p.collect()) == list(range(100))


def test_positional_mapping(spark):
    assert columns.positional_mapping(["ID", "Big Name", "x", "b"], ["id_original", "name", "b"]) == {
        "ID": "id_original", "Big Name": "name", "x": "b", "b": "b"}


def test_stream_restart_and_batch_agree(spark, rows):
    inbox, log, mark = (scratch_path(spark, n) for n in ("inbox", "log", "mark"))
    schema = "k int, seq int, v string, op string"
    waves = [[(1, 1, "a", "insert"), (2, 2, "b", "insert")], [(1, 3, "A", "update"), (2, 4, None, "delete")], [(3, 5, "c", "insert")]]
    for wave in waves:
        spark.createDataFrame(wave, schema).write.mode("append").json(inbox)
        stream = sync.stream_source(spark, {"format": "json", "path": inbox, "schema": schema})
        sync.changes_stream(stream, log, mark).awaitTermination()
    assert sync.read_batches(spark, log).count() == 5
    base = spark.createDataFrame([(2, "old"), (7, "kept")], "k int, v string")
    want = rows(apply_changes(base, spark.createDataFrame(sum(waves, []), schema), ["k"], ["seq"]))
    assert rows(sync.state_of(spark, log, ["k"], ["seq"], base=base)) == want == [(1, "A"), (3, "c"), (7, "kept")]
    assert rows(sync.state_of(spark, log, ["k"], ["seq"]).select("k", "v")) == [(1, "A"), (3, "c")]
    table, path = fresh_name("compacted"), scratch_path(spark, "compacted")
    sink.save(base, table, location=path)
    for _ in range(2):
        sync.compact(spark, log, table, ["k"], ["seq"], location=path, remove_folded=False)
        assert rows(spark.table(table)) == want
    # a restart finds nothing new
    sync.changes_stream(stream, log, mark).awaitTermination()
    assert sync.read_batches(spark, log).count() == 5


def test_a_new_checkpoint_keeps_earlier_batches(spark, rows):
    inbox, target = scratch_path(spark, "inbox"), scratch_path(spark, "target")
    for n in (5, 2):
        source = f"{inbox}_{n}"
        spark.range(n).write.json(source)
        stream = sync.stream_source(spark, {"format": "json", "path": source, "schema": "id long"})
        sync.write_batches(stream, target, scratch_path(spark, "mark")).awaitTermination()
    assert sync.read_batches(spark, target).count() == 7


def test_compaction_reads_only_what_is_new(spark, rows):
    """Twice folded between changes: late changes lose, deletes stay, folded batches go."""
    log, mark, inbox = (scratch_path(spark, n) for n in ("log", "mark", "inbox"))
    table, path = fresh_name("folded"), scratch_path(spark, "folded")
    schema = "k int, seq int, v string, op string"
    waves = [
        [(1, 10, "a", "insert"), (2, 11, "b", "insert"), (None, 12, "n", "insert")],
        [(1, 20, None, "delete"), (2, 5, "late", "update"), (3, 21, "c", "insert")],
        [(1, 15, "late", "insert"), (3, 30, "C", "update")],
        [(1, 40, "again", "insert")],
    ]
    state, seen = {}, {}
    for n, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").json(inbox)
        stream = sync.stream_source(spark, {"format": "json", "path": inbox, "schema": schema})
        sync.changes_stream(stream, log, mark if n < 2 else scratch_path(spark, "mark2")).awaitTermination()
        for k, seq, v, op in wave:
            if seq > seen.get(k, -1):
                seen[k] = seq
                state[k] = (k, seq, v, op)
        want = sorted((r for r in state.values() if r[3] != "delete"), key=repr)
        if n:
            assert rows(sync.state_of_table(spark, log, table, ["k"], ["seq"])) == want
        sync.compact(spark, log, table, ["k"], ["seq"], location=path)
        assert rows(spark.table(table)) == want
        assert not sync._batches(spark, log, {})
        before = sink.location_of(spark, table)
        sync.compact(spark, log, table, ["k"], ["seq"], location=path)
        assert sink.location_of(spark, table) == before  # nothing new, nothing written


def test_a_failure_before_the_commit_folds_again(spark, rows, monkeypatch):
    log, inbox = scratch_path(spark, "log"), scratch_path(spark, "inbox")
    table, path = fresh_name("folded"), scratch_path(spark, "folded")
    schema = "k int, seq int, op string"
    spark.createDataFrame([(1, 1, "insert"), (2, 2, "insert")], schema).write.json(inbox)
    sync.changes_stream(sync.stream_source(spark, {"format": "json", "path": inbox, "schema": schema}), log, scratch_path(spark, "m")).awaitTermination()

    def failing(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sync.tables, "publish", failing)
        with pytest.raises(RuntimeError):
            sync.compact(spark, log, table, ["k"], ["seq"], location=path)
    assert not spark.catalog.tableExists(table) and len(sync._batches(spark, log, {})) == 1
    sync.compact(spark, log, table, ["k"], ["seq"], location=path)
    assert spark.table(table).count() == 2


def test_kafka_options():
    got = sync.kafka_options({"bootstrap_servers": ["a:1", "b:2"], "topic": "t", "security_protocol": "SASL_SSL"})
    assert got == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "t", "startingOffsets": "earliest",
                   "kafka.security.protocol": "SASL_SSL"}


def test_change_event_document_keeps_types_and_unknown_fields(spark):
    kind = "operationType string, fullDocument struct<_id:bigint,n:int,tags:array<string>,kind:string>, documentKey struct<_id:bigint>, " \
           "updateDescription struct<updatedFields:map<string,string>>, clusterTime timestamp"
    log = spark.createDataFrame([
        ("insert", (1, 5, ["a"], "k"), (1,), None, None), ("delete", None, (3,), None, None), ("drop", None, (4,), None, None),
        ("update", None, (2,), ({"n": "7", "tags": '["b","c"]', "x": "new", "a.b": "deep"},), None),
        ("update", None, (5,), ({"n": "seven", "kind": None},), None), ("update", None, (6,), ({"n": "8"},), None)], kind)
    out = env.change_event_document(log)
    assert out.schema["n"].dataType.simpleString() == "int" and out.schema["_id"].dataType.simpleString() == "bigint"
    got = {r["_id"]: (r["n"], r["tags"], r["kind"], r["_updated_fields"]) for r in out.collect()}
    assert got == {
        1: (5, ["a"], "k", None), 3: (None, None, None, None), 2: (7, ["b", "c"], None, {"x": "new", "a.b": "deep"}),
        5: (None, None, None, {"n": "seven", "kind": None}), 6: (8, None, None, None)}
    mixed = log.selectExpr("operationType", "fullDocument", "documentKey", "clusterTime",
                           "struct(parse_json('{\"n\":9,\"x\":[1]}')::map<string,variant> AS updatedFields) AS updateDescription")
    row = env.change_event_document(mixed).where("_id = 6").selectExpr("n", "to_json(_updated_fields) AS rest").first()
    assert tuple(row) == (9, '{"x":[1]}')
    fields = mixed.selectExpr("operationType", "fullDocument", "documentKey", "clusterTime", "struct(struct(4 AS n, true AS y) AS updatedFields) AS updateDescription")
    row = env.change_event_document(fields).where("_id = 6").selectExpr("n", "to_json(_updated_fields) AS rest").first()
    assert tuple(row) == (4, '{"y":true}')


def csv_of(spark, text):
    path = scratch_path(spark, "import")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return files.read_csv(spark, path)


def test_import_of_untidy_files(spark, rows):
    """Ids that are no numbers, numbers of many digits, empty columns, special names: nothing is lost, ids go on."""
    mixed = csv_of(spark, "id,Name,Category Type,notes\n1,a,x,\n2,b,y,n\n,c,x,\n4,d,y,\ninvalid,e,x,\n6,f,y,z")
    table, path = fresh_name("mixed"), scratch_path(spark, "mixed")
    report = ex.import_table(mixed, table, path, [{"name": "notes", "default_value": "-"}])
    assert report["names"]["Category Type"] == "category_type" and report["ids"]["other_ids"] == 1 and report["ids"]["null_ids"] == 1
    got = rows(spark.table(table).select("id", "id_original", "name", "notes"))
    assert got == [(1, "1", "a", "-"), (2, "2", "b", "n"), (3, None, "c", "-"), (4, "4", "d", "-"), (5, "invalid", "e", "-"), (6, "6", "f", "z")]
    ex.import_table(mixed, table, path)
    assert sorted(r["id"] for r in spark.table(table).collect()) == list(range(1, 13))

    large = csv_of(spark, "id,account number,balance,amount\n1,12345678901234567890123456789012,0.5,9223372036854775807\n2,99999999999999999999999999999999,12.25,1")
    table = fresh_name("large")
    report = ex.import_table(large, table, scratch_path(spark, "large"))
    assert report["lost_cells"] == {} and report["types"]["id"] == "bigint"
    cells = spark.table(table).select("id", F.col("account_number").cast("string"), "balance", F.col("amount").cast("string"))
    assert rows(cells) == [(1, "12345678901234567890123456789012", 0.5, "9223372036854775807"), (2, "9" * 32, 12.25, "1")]

    holes = csv_of(spark, "name,e-mail,1st\na,,\n,b@c,")
    table = fresh_name("holes")
    report = ex.import_table(holes, table, scratch_path(spark, "holes"))
    assert list(report["names"].values()) == ["name", "e_mail", "col_1st"] and report["ids"] is None
    assert spark.table(table).columns[0] == "id" and spark.table(table).count() == 2


def test_views_of_a_table(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}", i % 4) for i in range(40)], "k int, name string, v int")
    view = rows_module.table_view(df, "name", "n1", "v", "desc", 2, 5)
    ordered = sorted(((v, f'{{"k":{k},"name":"{n}","v":{v}}}', k) for k, n, v in ((i, f"n{i % 3}", i % 4) for i in range(40)) if n == "n1"), reverse=True)
    assert [(r["k"], r["total_count"]) for r in view.collect()] == [(k, 13) for *_, k in ordered[5:10]]
    assert rows_module.table_view(df).count() == 25 and rows_module.table_view(df, page_number=2, shallow=0).count() == 15
    with pytest.raises(ValueError, match="direction"):
        rows_module.table_view(df, order_by="v", direction="up")


def test_dump_of_empty_and_unknown_values(spark, rows):
    schema = "key string, type string, ttl int, string string, hash map<string,string>, list array<string>, `set` array<string>, zset array<struct<value:string,score:double>>"
    dump = spark.createDataFrame([
        ("a", "string", -1, None, None, None, None, None), ("b", "string", 5, "", None, None, None, None), ("c", "hash", -1, None, {}, None, None, None),
        ("d", "list", -1, None, None, ["x", None, "x"], None, None), ("e", "set", -1, None, None, None, ["x", "x"], None), ("f", "zset", -1, None, None, None, None, [("m", 1.5)]),
        ("g", "stream", -1, "lost?", None, None, None, None), ("h", "list", -1, "no", None, None, ["no"], None)], schema)
    found = rows(env.dump_rows(dump).select("key", "index", "value", "score", "ttl", "size"))
    assert found == sorted([
        ("a", None, None, None, -1, 0), ("b", None, "", None, 5, 0), ("d", 0, "x", None, -1, 1), ("d", 1, None, None, -1, 0), ("d", 2, "x", None, -1, 1),
        ("e", None, "x", None, -1, 1), ("f", None, "m", 1.5, -1, 1)], key=repr)
