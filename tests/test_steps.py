"""Row and column steps on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.functions.conversion import datetime_pattern, spark_type_name
from tidemill.operators import aggregate, columns, joins, rows
from tidemill.operators import fill as fills
from tidemill.operators import sql as sqls
from tidemill.operators.snapshots import Snapshots
from tidemill.plans import config
from tidemill.plans.runner import make_step, preview_steps, run_steps
from tidemill.session import scratch_path

SAMPLE = [
    (1, "John Doe", "john@example.com", "A", 150.50, dt.date(2024, 1, 15), "active"),
    (2, "Jane Smith", "jane@example.com", "B", 200.00, dt.date(2024, 1, 16), "active"),
    (3, "Bob Johnson", "bob@example.com", "A", 75.25, dt.date(2024, 1, 17), "inactive"),
    (4, "Alice Brown", "alice@example.com", "C", 300.00, dt.date(2024, 1, 18), "active"),
    (5, "Charlie Wilson", "charlie@example.com", "B", 125.75, dt.date(2024, 1, 19), "active"),
]
SCHEMA = "id int, name string, email string, category string, amount double, date date, status string"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE, SCHEMA)


@pytest.fixture(scope="module")
def holes(spark):
    data = [(1, "Abc", 1.0), (2, None, None), (3, "xyz", float("nan")), (4, "a.c", -2.0)]
    return spark.createDataFrame(data, "id int, s string, d double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("rule, want", [
    (("s", "equals", "Abc"), [1]), (("s", "not_equals", "Abc"), [2, 3, 4]), (("d", ">", 0.0), [1, 3]),
    (("s", "in", ["Abc", "xyz"]), [1, 3]), (("s", "not_in", ["Abc"]), [2, 3, 4]), (("s", "contains", "a.c"), [4]),
    (("s", "not_contains", "b"), [2, 3, 4]), (("s", "starts_with", "a."), [4]), (("s", "ends_with", "c"), [1, 4]),
    (("s", "is_null", None), [2]), (("d", "is_null", None), [2, 3]), (("d", "is_not_null", None), [1, 4]),
    (("s", "regex", "^[a-z]+$"), [3]),
])
def test_filter_rules(holes, rule, want):
    made = {"column": rule[0], "operator": rule[1], "value": rule[2]}
    assert ids(rows.filter_rows(holes, [made])) == want


def test_contains_is_a_regex_unless_literal(holes):
    rule = {"column": "s", "operator": "contains", "value": "A.C", "case_sensitive": False}
    assert ids(rows.filter_rows(holes, [rule])) == [1, 4]
    assert ids(rows.filter_rows(holes, [{**rule, "literal": True}])) == [4]


@pytest.mark.parametrize("rule, want", [
    (("s", "eq", 5), []), (("s", "ne", 5), [1, 2, 3, 4]), (("id", "gt", "2"), [3, 4]), (("id", "lt", "2.5"), [1, 2]),
    (("id", "eq", "x"), []), (("id", "ne", "x"), [1, 2, 3, 4]), (("id", "in", ["1", "y", 3]), [1, 3]), (("id", "gt", 2.5), [3, 4]),
    (("s", "not_in", [1]), [1, 2, 3, 4]),
])
def test_values_of_another_type_do_not_fail(holes, rule, want):
    made = {"column": rule[0], "operator": rule[1], "value": rule[2]}
    assert ids(rows.filter_rows(holes, [made])) == want


def test_dates_compare_with_text(sample):
    rule = {"column": "date", "operator": ">=", "value": "2024-01-18"}
    assert ids(rows.filter_rows(sample, [rule])) == [4, 5]


def test_or_keeps_duplicates_and_null_is_not_true(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, s string")
    out = rows.filter_rows(df, [{"column": "s", "operator": "eq", "value": "a"}, {"column": "id", "operator": "eq", "value": 2}], "OR")
    assert ids(out) == [1, 1, 2]


@pytest.mark.parametrize("call", [
    lambda d: rows.filter_rows(d, [{"column": "zz", "operator": "eq", "value": 1}]),
    lambda d: rows.filter_rows(d, [{"column": "id", "operator": "near", "value": 1}]),
    lambda d: rows.filter_rows(d, [{"column": "id", "operator": "eq", "value": 1}], "XOR"),
    lambda d: rows.clean(d, [{"column": "s", "rule_type": "polish"}]),
    lambda d: rows.convert(d, "s", "complex"),
    lambda d: columns.rename(d, {"zz": "y"}), lambda d: columns.drop(d, ["zz"]),
    lambda d: columns.split_column(d, "s", ["a"]),
    lambda d: aggregate.aggregate(d, ["zz"], []),
    lambda d: aggregate.aggregate(d, ["id"], [{"column": "s", "function": "product"}]),
    lambda d: aggregate.aggregate(d, ["id"], [{"column": "s", "function": "first"}]),
    lambda d: aggregate.aggregate(d, ["id"], {"s": "sum"}),
    lambda d: joins.join(d, d, [{"left": "id", "right": "s"}]),
    lambda d: joins.join(d, d, "zz"), lambda d: joins.join(d, d, "id", "sideways"),
    lambda d: make_step({"type": "teleport", "config": {}}), lambda d: sqls.step_sql(d, "DROP TABLE x"),
    lambda d: fills.fill_carried(d, ["d"], ["id"], direction="up"),
])
def test_bad_configs_are_value_errors(holes, call):
    with pytest.raises(ValueError):
        call(holes)


@pytest.mark.parametrize("rule, text, want", [
    ({"rule_type": "trim"}, "\t a b \n", "a b"), ({"rule_type": "trim"}, " a ", "a"),
    ({"rule_type": "remove_special"}, "a-b_c é 1!", "abc  1"), ({"rule_type": "remove_special_chars"}, "a#b", "ab"),
    ({"rule_type": "remove_special", "parameters": {"pattern": "[aeiou]"}}, "hello", "hll"),
    ({"rule_type": "uppercase"}, "straße", "STRASSE"), ({"rule_type": "lowercase"}, "ÀB", "àb"),
    ({"rule_type": "remove_numbers"}, "a1b22", "ab"), ({"rule_type": "remove_spaces"}, " a \n b ", "ab"),
    ({"rule_type": "normalize_whitespace"}, "  a \n\t b ", "a b"),
    ({"rule_type": "remove_punctuation"}, "José, où? _x_", "José où _x_"),
    ({"rule_type": "remove_html"}, "<p class='x'>a<br/>b</p>", "ab"),
    ({"rule_type": "remove_urls"}, "see https://a.bc/d?e=1&f=%20 now", "see  now"),
    ({"rule_type": "custom_regex", "parameters": {"pattern": r"(\w)(\d)", "replacement": r"\2$\1"}}, "a1", "1$a"),
    ({"rule_type": "custom_regex"}, "a1", "a1"),
])
def test_cleaning(spark, rule, text, want):
    df = spark.createDataFrame([(text,), (None,)], "s string")
    assert [r[0] for r in rows.clean(df, [{"column": "s", **rule}]).collect()] == [want, None]


def test_long_url_does_not_overflow(spark):
    df = spark.createDataFrame([("x https://" + "ab/" * 50_000 + " y",)], "s string")
    assert rows.clean(df, [{"column": "s", "rule_type": "remove_urls"}]).first()[0] == "x  y"


@pytest.mark.parametrize("kind, fmt, text, want", [
    ("integer", None, "7", 7), ("integer", None, "7.0", 7), ("integer", None, "7.5", None), ("integer", None, "x", None),
    ("integer", None, " 12 ", 12), ("integer", None, "1e3", 1000), ("integer", None, "9007199254740993", 9007199254740993),
    ("integer", None, "99999999999999999999", None), ("float", None, "1e3", 1000.0), ("float", None, "5d", None),
    ("float", None, None, None), ("string", None, None, None), ("boolean", None, "Yes", True), ("boolean", None, "on", False),
    ("boolean", None, None, False), ("date", "%d/%m/%Y", "03/02/2024", dt.date(2024, 2, 3)),
    ("date", "%d/%m/%Y", "31/02/2024", None), ("date", None, "2024-02-03", dt.date(2024, 2, 3)),
    ("datetime", "%Y-%m-%d %H:%M:%S", "2024-02-03 04:05:06", dt.datetime(2024, 2, 3, 4, 5, 6)),
    ("datetime", "%Y-%m-%dT%H:%M", "2024-02-03T04:05", dt.datetime(2024, 2, 3, 4, 5)),
    ("date", None, "03/02/2024", dt.date(2024, 2, 3)), ("array", None, '["a","b"]', ["a", "b"]), ("array", None, "a,b", None),
])
def test_conversion(spark, kind, fmt, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert rows.convert(df, "s", kind, fmt).first()[0] == want


def test_defaults_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(ValueError, match="default"):
        rows.convert(df, "s", "integer", default_value="n/a")
    assert rows.convert(df, "s", "integer", default_value=7).first()[0] == 7


def test_loading_keeps_ones_and_zeros_and_no_fraction_is_rounded(spark):
    df = spark.createDataFrame([("1.0",), ("0.0",), ("1",), (None,)], "s string")
    assert [r[0] for r in rows.cast_on_load(df, {"s": "BOOLEAN"}).collect()] == [True, False, True, None]
    whole = rows.preserve_big_integers(spark.createDataFrame([("12.5",), ("12",)], "s string"), ["s"])
    assert [float(r[0]) for r in whole.collect()] == [12.5, 12.0]


def test_conversion_default_and_json(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    assert [r[0] for r in rows.convert(df, "s", "integer", default_value=-1).collect()] == [1, -1]
    js = rows.convert(spark.createDataFrame([('{"a":[1]}',), ("{",)], "s string"), "s", "json")
    assert [r[0] for r in js.select(F.to_json("s")).collect()] == ['{"a":[1]}', None]


def test_names_and_patterns():
    assert datetime_pattern("%d.%m.%Y at %H:%M") == "dd.MM.yyyy 'at' HH:mm"
    assert [spark_type_name(x) for x in ("varchar(20)", "NUMERIC(10,2)", "double  precision", "serial", "int2")] == [
        "STRING", "DECIMAL(10,2)", "DOUBLE", "BIGINT", "SMALLINT"]
    assert [columns.sanitize_name(x) for x in (" A-b.C d ", "1x", "!!", "Prénom", "")] == [
        "a_b_c_d", "col_1x", "unnamed_column", "prénom", "unnamed_column"]


def test_split_and_merge_are_inverse(sample):
    split = columns.split_column(sample, "name", ["first", "last"], delimiter=" ")
    merged = columns.merge_columns(split, ["first", "last"], "name", drop_original=True)
    assert sorted(r["name"] for r in merged.collect()) == sorted(r[1] for r in SAMPLE)


def test_split_details(spark):
    df = spark.createDataFrame([("a|b|c",), ("x",), (None,)], "s string")
    out = columns.split_column(df, "s", ["p", "q"], delimiter="|")
    assert [tuple(r) for r in out.collect()] == [("a", "b|c"), ("x", None), (None, None)]
    longer = columns.split_column(df, "s", ["p", "q"], delimiter="[|]+")
    assert longer.first()["q"] == "b|c"
    by_pattern = columns.split_column(df, "s", ["p", "q", "r"], pattern=r"(\w)\|(\w)", keep_original=True)
    assert [tuple(r) for r in by_pattern.collect()] == [("a|b|c", "a", "b", None), ("x", None, None, None), (None, None, None, None)]


def test_merge_skips_nulls(spark):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, z int")
    assert columns.merge_columns(df, ["x", "y", "z"], "m", "-").first()["m"] == "a-1"


def test_mini_results(spark, rows):
    mini = spark.createDataFrame([(1, "Test 1", 100, "A"), (2, "Test 2", 200, "B"), (3, "Test 3", 150, "A")],
                                 "id int, name string, value int, category string")
    keep = run_steps(mini, [{"type": "filter", "config": {"conditions": [{"column": "category", "operator": "equals", "value": "A"}]}}])
    assert keep.count() == 2
    total = run_steps(mini, [{"type": "aggregate", "config": {"group_by": "category", "aggregations": [
        {"column": "value", "function": "sum", "alias": "total"}, {"column": "id", "function": "count", "alias": "n"}]}}])
    assert rows(total) == [("A", 250, 2), ("B", 200, 1)]


def test_sample_steps(sample, rows):
    out = run_steps(sample, [
        {"type": "filter", "config": {"logic": "and", "rules": [
            {"column": "status", "operator": "equals", "value": "active"}, {"column": "amount", "operator": "greater_than", "value": 100}]}},
        {"type": "clean", "config": {"operations": [{"column": "email", "operation": "uppercase"}]}},
        {"type": "type_conversion", "config": {"conversions": [{"column": "amount", "to_type": "string"}]}},
        {"type": "drop", "config": {"columns": ["id"]}, "enabled": False},
        {"type": "rename", "config": {"rename_map": {"id": "key"}}},
    ])
    assert sorted(r["key"] for r in out.collect()) == [1, 2, 4, 5]
    assert out.first()["email"].isupper() and dict(out.dtypes)["amount"] == "string"


def test_aggregate_null_rules(spark, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, 5, 3)], "k string, v int, o int")
    out = aggregate.aggregate(df, ["k"], {"v": "sum"})
    assert rows(out) == [("a", 0)]
    assert aggregate.aggregate(df, ["k"], {"v": "sum"}, keep_null_keys=True).count() == 2
    ends = aggregate.aggregate(df, [], [{"column": "v", "function": "first"}, {"column": "o", "function": "last"}], order_by=["o"])
    assert tuple(ends.first()) == (5, 3)


def test_config_dialects():
    assert config.filter_config({"column": "a", "operator": "eq", "value": 1})["rules"][0]["column"] == "a"
    assert config.join_config({"join_type": "OUTER", "conditions": [{"left": "a", "right": "b"}]})["how"] == "outer"
    assert config.step_type("cleaning") == "clean"


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (None, "m"), (9, "z")], "rk int, v string")
    return left, right


@pytest.mark.parametrize("how, want", [
    ("inner", {(2, "b", "x"), (2, "c", "x"), (None, "n", "m")}),
    ("left", {(1, "a", None), (2, "b", "x"), (2, "c", "x"), (None, "n", "m")}),
    ("right", {(2, "b", "x"), (2, "c", "x"), (None, "n", "m"), (9, None, "z")}),
    ("outer", {(1, "a", None), (2, "b", "x"), (2, "c", "x"), (None, "n", "m"), (9, None, "z")}),
])
@pytest.mark.parametrize("hot", [0, 10])
def test_joins_match_null_keys(sides, how, want, hot):
    out = joins.join(*sides, [{"left": "k", "right": "rk"}], how, hot_key_rows=hot)
    assert out.columns == ["k", "v_left", "v_right"]
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_join_variants(sides):
    left, right = sides
    on = [{"left": "k", "right": "rk"}]
    assert joins.join(left, right, on, null_safe=False).count() == 2
    assert joins.join(left, right, on, "full", null_safe=False).count() == 6
    assert joins.join(left, right, on, "semi").count() == 3 and joins.join(left, right, on, "anti").count() == 1
    assert joins.join(left, right, how="cross").count() == 12
    assert joins.join(left, right, on, right_prefix="ds2_").columns == ["k", "v", "ds2_v"]
    assert joins.check_key_types(left, right.withColumn("rk", F.col("rk").cast("string")), on) == ["k is int but rk is string"]
    facts = joins.join_check(left, right, on).first()
    assert facts["inner_rows"] == 3 and facts["left_null_keys"] == 1 and facts["left_duplicate_keys"] == 1


def test_join_step_by_source_name(sample, spark):
    ref = spark.createDataFrame([("A", "first")], "category string, label string")
    step = {"type": "join", "config": {"left_source": "1", "right_source": "2", "join_type": "left", "on": ["category"]}}
    out = run_steps(sample, [step], {"2": ref})
    assert "ds2_label" in out.columns and "ds1_id" in out.columns and out.count() == 5
    with pytest.raises(ValueError, match="source"):
        run_steps(sample, [step])


def test_empty_result_can_fail(sample):
    step = {"type": "filter", "config": {"column": "id", "operator": ">", "value": 99}}
    assert run_steps(sample, [step]).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        run_steps(sample, [step], fail_on_empty=True)


def test_preview_is_the_same_steps(sample):
    report = preview_steps(sample, [{"type": "rename", "config": {"rename_map": {"id": "key"}}}], preview_rows=3)
    assert report["original_shape"] == (3, 7) and report["columns"][0] == "key" and len(report["data"]) == 3


def test_step_sql_and_python(sample):
    out = run_steps(sample, [
        {"type": "custom_sql", "config": {"query": "SELECT category, max(amount) AS top FROM source_data GROUP BY category"}},
        {"type": "custom_python", "config": {"function": lambda df, low: df.filter(F.col("top") > low), "parameters": {"low": 180}}},
    ])
    assert out.count() == 2
    with pytest.raises(ValueError):
        make_step({"type": "python", "config": {"code": "df"}})


def test_resume_equals_full_run(spark, sample, rows):
    steps = [
        {"name": "keep", "type": "filter", "config": {"column": "amount", "operator": ">", "value": 100}},
        {"name": "fail", "type": "custom_python", "config": {"function": lambda df: 1 / 0}},
        {"name": "sum", "type": "aggregate", "config": {"group_by": ["category"], "aggregations": {"amount": "sum"}}},
    ]
    store = Snapshots(spark, scratch_path(spark, "snapshots"), "run")
    with pytest.raises(ZeroDivisionError):
        run_steps(sample, steps, snapshots=store)
    steps[1] = {"type": "drop", "config": {"columns": ["email"]}}
    resumed = run_steps(sample.limit(0), steps, snapshots=store, resume=True)
    assert rows(resumed) == rows(run_steps(sample, steps))
    assert [r["step_index"] for r in store.list().collect()] == [2, 1, 0]
    assert store.rollback_to(0).count() == 4
    assert [r["status"] for r in store.list().collect()] == ["rolled_back", "rolled_back", "active"]
