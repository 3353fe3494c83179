"""Queries for filters, cleaning and conversion."""

from pyspark.sql import functions as F

from tidemill.catalog.registry import Tables, nulled, query
from tidemill.functions.cleaning import value_transformed
from tidemill.operators import rows

_DERIVED = """WITH d AS (SELECT o_orderkey,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
 o_orderstatus AS status FROM orders) SELECT * FROM d WHERE """


def _derived(t: Tables):
    return t.orders.select(
        "o_orderkey", nulled("o_orderpriority", "o_orderkey", 7).alias("priority"),
        nulled("o_totalprice", "o_orderkey", 11).alias("price"), F.col("o_orderstatus").alias("status"),
    )


def _filter_query(name: str, rule: dict, where: str) -> None:
    query(name, _DERIVED + where)(lambda t: rows.filter_rows(_derived(t), [rule]))


for _name, _rule, _where in [
    ("filter_eq", ("priority", "equals", "1-URGENT"), "priority = '1-URGENT'"),
    ("filter_ne", ("priority", "not_equals", "1-URGENT"), "priority IS NULL OR priority <> '1-URGENT'"),
    ("filter_gt", ("price", "greater_than", 250000.0), "price > 250000"),
    ("filter_lt", ("price", "less_than", 250000.0), "price < 250000"),
    ("filter_ge", ("price", "greater_equal", 250000.0), "price >= 250000"),
    ("filter_le", ("price", "less_equal", 250000.0), "price <= 250000"),
    ("filter_in", ("priority", "in", ["1-URGENT", "5-LOW"]), "priority IN ('1-URGENT', '5-LOW')"),
    ("filter_not_in", ("priority", "not_in", ["1-URGENT", "5-LOW"]),
     "priority IS NULL OR priority NOT IN ('1-URGENT', '5-LOW')"),
    ("filter_contains", ("priority", "contains", "U[RM]"), "regexp_matches(priority, 'U[RM]')"),
    ("filter_not_contains", ("priority", "not_contains", "HIGH"),
     "priority IS NULL OR NOT regexp_matches(priority, 'HIGH')"),
    ("filter_starts_with", ("priority", "starts_with", "2-"), "starts_with(priority, '2-')"),
    ("filter_ends_with", ("priority", "ends_with", "LOW"), "ends_with(priority, 'LOW')"),
    ("filter_is_null", ("priority", "is_null", None), "priority IS NULL"),
    ("filter_not_null", ("priority", "not_null", None), "priority IS NOT NULL"),
    ("filter_regex", ("priority", "regex", "^[1-3]-[A-Z]+$"), "regexp_matches(priority, '^[1-3]-[A-Z]+$')"),
]:
    _filter_query(_name, {"column": _rule[0], "operator": _rule[1], "value": _rule[2]}, _where)

_filter_query(
    "filter_contains_any_case",
    {"column": "priority", "operator": "contains", "value": "urgent", "case_sensitive": False},
    "regexp_matches(priority, '(?i)urgent')",
)


@query("filter_and", _DERIVED + "status = 'F' AND price > 200000 AND (priority IS NULL OR priority <> '5-LOW')")
def filter_and(t: Tables):
    return rows.filter_rows(_derived(t), [
        {"column": "status", "operator": "eq", "value": "F"}, {"column": "price", "operator": "gt", "value": 200000.0},
        {"column": "priority", "operator": "ne", "value": "5-LOW"},
    ], "AND")


@query("filter_or", _DERIVED + "status = 'P' OR price > 400000 OR priority IS NULL")
def filter_or(t: Tables):
    return rows.filter_rows(_derived(t), [
        {"column": "status", "operator": "eq", "value": "P"}, {"column": "price", "operator": "gt", "value": 400000.0},
        {"column": "priority", "operator": "is_null"},
    ], "OR")


def _clean_query(name: str, table: str, key: str, column: str, rule: dict, expression: str) -> None:
    def run(t: Tables):
        df = getattr(t, table).select(key, nulled(column, key, 13).alias("value"))
        return rows.clean(df, [{"column": "value", **rule}])

    sql = (f"WITH d AS (SELECT {key}, CASE WHEN {key} % 13 <> 0 THEN {column} END AS value FROM {table}) "
           f"SELECT {key}, {expression} AS value FROM d")
    query(name, sql)(run)


for _name, _table, _key, _column, _kind, _expr in [
    ("clean_trim", "documents", "doc_id", "text", "trim",
     r"regexp_replace(value, '^\s+|\s+$', '', 'g')"),
    ("clean_remove_special", "documents", "doc_id", "text", "remove_special",
     r"regexp_replace(value, '[^a-zA-Z0-9\s]', '', 'g')"),
    ("clean_lowercase", "pages", "page_id", "url", "lowercase", "lower(value)"),
    ("clean_uppercase", "part", "p_partkey", "p_name", "uppercase", "upper(value)"),
    ("clean_remove_numbers", "pages", "page_id", "html", "remove_numbers", r"regexp_replace(value, '\d+', '', 'g')"),
    ("clean_remove_spaces", "documents", "doc_id", "text", "remove_spaces", r"regexp_replace(value, '\s+', '', 'g')"),
    ("clean_normalize_whitespace", "documents", "doc_id", "text", "normalize_whitespace",
     r"trim(regexp_replace(value, '\s+', ' ', 'g'))"),
    ("clean_remove_punctuation", "documents", "doc_id", "text", "remove_punctuation",
     r"regexp_replace(value, '[^\p{L}\p{M}\p{N}_\s]', '', 'g')"),
    ("clean_remove_html", "pages", "page_id", "html", "remove_html", "regexp_replace(value, '<[^>]+>', '', 'g')"),
    ("clean_remove_urls", "documents", "doc_id", "text", "remove_urls",
     "regexp_replace(value, 'https?://[$-_a-z!]+', '', 'g')"),
]:
    _clean_query(_name, _table, _key, _column, {"rule_type": _kind}, _expr)

_clean_query(
    "clean_custom_regex", "customer", "c_custkey", "c_name",
    {"rule_type": "custom_regex", "parameters": {"pattern": r"(\w+)#0*(\d+)", "replacement": r"\2-\1"}},
    r"regexp_replace(value, '(\w+)#0*(\d+)', '\2-\1', 'g')",
)


@query("value_replace", """SELECT e.event_id, replace(event_type, 'view', 'seen') AS replaced,
 upper(event_type) AS upper_type, lower(upper(event_type)) AS lower_type FROM events e""")
def value_replace(t: Tables):
    col = F.col("event_type")
    return t.events.select(
        "event_id", value_transformed(col, "replace", "view", "seen").alias("replaced"),
        value_transformed(col, "uppercase").alias("upper_type"),
        value_transformed(F.upper(col), "lowercase").alias("lower_type"),
    )


_RAW_NUMBER = """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey::VARCHAR
 WHEN 1 THEN concat(o_orderkey, '.0') WHEN 2 THEN concat(o_orderkey, '.5') WHEN 3 THEN concat('x', o_orderkey)
 WHEN 4 THEN concat('-', o_orderkey) END AS raw FROM orders) """


def _raw_number(t: Tables):
    key = F.col("o_orderkey").cast("string")
    place = F.col("o_orderkey") % 6
    raw = (
        F.when(place == 0, key).when(place == 1, F.concat(key, F.lit(".0"))).when(place == 2, F.concat(key, F.lit(".5")))
        .when(place == 3, F.concat(F.lit("x"), key)).when(place == 4, F.concat(F.lit("-"), key))
    )
    return t.orders.select("o_orderkey", raw.alias("raw"))


@query("convert_integer", _RAW_NUMBER + """SELECT o_orderkey, CASE WHEN try_cast(raw AS DOUBLE) =
 floor(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE)::BIGINT END AS raw FROM d""")
def convert_integer(t: Tables):
    return rows.convert(_raw_number(t), "raw", "integer")


@query("convert_float", _RAW_NUMBER + "SELECT o_orderkey, try_cast(raw AS DOUBLE) AS raw FROM d")
def convert_float(t: Tables):
    return rows.convert(_raw_number(t), "raw", "float")


@query("convert_string", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::VARCHAR END AS o_custkey FROM orders")
def convert_string(t: Tables):
    df = t.orders.select("o_orderkey", nulled("o_custkey", "o_orderkey", 7).alias("o_custkey"))
    return rows.convert(df, "o_custkey", "string")


_RAW_DATE = """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'soon'
 WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '{fmt}') END AS raw FROM orders) """


def _raw_date(t: Tables, pattern: str):
    text = F.date_format("o_orderdate", pattern)
    raw = F.when(F.col("o_orderkey") % 9 == 0, "soon").when(F.col("o_orderkey") % 10 != 0, text)
    return t.orders.select("o_orderkey", raw.alias("raw"))


@query("convert_date", _RAW_DATE.format(fmt="%d/%m/%Y")
       + "SELECT o_orderkey, try_strptime(raw, '%d/%m/%Y')::DATE AS raw FROM d")
def convert_date(t: Tables):
    return rows.convert(_raw_date(t, "dd/MM/yyyy"), "raw", "date", "%d/%m/%Y")


@query("convert_datetime", _RAW_DATE.format(fmt="%Y-%m-%d %H:%M:%S")
       + "SELECT o_orderkey, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS raw FROM d")
def convert_datetime(t: Tables):
    return rows.convert(_raw_date(t, "yyyy-MM-dd HH:mm:ss"), "raw", "datetime", "%Y-%m-%d %H:%M:%S")


@query("convert_boolean", """WITH d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'YES'
 WHEN 2 THEN 'no' WHEN 3 THEN '1' WHEN 4 THEN event_type END AS raw FROM events)
 SELECT event_id, coalesce(raw IN ('true','True','TRUE','1','t','T','yes','Yes','YES'), false) AS raw FROM d""")
def convert_boolean(t: Tables):
    place = F.col("event_id") % 6
    raw = (F.when(place == 0, "true").when(place == 1, "YES").when(place == 2, "no").when(place == 3, "1")
           .when(place == 4, F.col("event_type")))
    return rows.convert(t.events.select("event_id", raw.alias("raw")), "raw", "boolean")


@query("convert_json", """WITH d AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props ELSE '{bad' END AS raw FROM events)
 SELECT event_id, CASE WHEN json_valid(raw) THEN (raw::JSON ->> 'k')::BIGINT END AS k FROM d""")
def convert_json(t: Tables):
    raw = F.when(F.col("event_id") % 5 != 0, F.col("props")).otherwise("{bad")
    parsed = rows.convert(t.events.select("event_id", raw.alias("raw")), "raw", "json")
    return parsed.select("event_id", F.try_variant_get("raw", "$.k", "bigint").alias("k"))


@query("convert_array", """SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS joined,
 len(string_split(p_name, ' ')) AS n FROM part""")
def convert_array(t: Tables):
    text = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('","')), F.lit('"]'))
    arrays = rows.convert(t.part.select("p_partkey", text.alias("words")), "words", "array")
    return arrays.select("p_partkey", F.array_join("words", "|").alias("joined"), F.size("words").cast("long").alias("n"))


@query("convert_default", _RAW_NUMBER + "SELECT o_orderkey, coalesce(try_cast(raw AS DOUBLE), -1.0) AS raw FROM d")
def convert_default(t: Tables):
    return rows.convert(_raw_number(t), "raw", "float", default_value=-1.0)


@query("cast_on_load", """SELECT o_orderkey::INTEGER AS o_orderkey, o_totalprice, o_orderdate::DATE AS o_orderdate,
 CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders""")
def cast_on_load(t: Tables):
    flag = F.when(F.col("o_orderkey") % 3 == 0, "True").when(F.col("o_orderkey") % 3 == 1, "0").otherwise("maybe")
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), flag.alias("flag"),
    )
    types = {"o_orderkey": "INTEGER", "o_totalprice": "DOUBLE PRECISION", "o_orderdate": "DATE", "flag": "BOOLEAN"}
    return rows.cast_on_load(text, types, {"o_orderdate": "%Y-%m-%d"})


@query("cast_to_ddl", """SELECT o_orderkey::BIGINT AS o_orderkey, o_totalprice, o_orderdate,
 o_orderkey % 3 = 0 AS flag FROM orders""")
def cast_to_ddl(t: Tables):
    flag = F.when(F.col("o_orderkey") % 3 == 0, "True").when(F.col("o_orderkey") % 3 == 1, "0").otherwise("maybe")
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), flag.alias("flag"),
    )
    return rows.cast_to_ddl(text, {"o_orderkey": "INT8", "o_totalprice": "FLOAT8", "o_orderdate": "DATETIME", "flag": "BOOLEAN"})


@query("preserve_big_integers", """SELECT o_orderkey, concat('12345678901234567890', lpad(o_orderkey::VARCHAR, 10, '0')) AS big,
 true AS beyond FROM orders""")
def preserve_big_integers(t: Tables):
    text = F.concat(F.lit("12345678901234567890"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    exact = rows.preserve_big_integers(t.orders.select("o_orderkey", text.alias("big")), ["big"])
    return exact.select("o_orderkey", F.col("big").cast("string").alias("big"), (F.col("big") > 2**63 - 1).alias("beyond"))
