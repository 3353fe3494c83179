"""Queries for column steps and null filling."""

from pyspark.sql import functions as F

from tidemill.catalog.registry import Tables, nulled, query
from tidemill.operators import columns, fill


@query("rename", "SELECT s_suppkey AS supplier_id, s_name AS supplier, s_nationkey, s_acctbal FROM supplier")
def rename(t: Tables):
    return columns.rename(t.supplier, {"s_suppkey": "supplier_id", "s_name": "supplier"})


@query("drop", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def drop(t: Tables):
    return columns.drop(t.orders, ["o_totalprice", "o_orderstatus"])


@query("select_columns", "SELECT c_name, c_custkey FROM customer")
def select_columns(t: Tables):
    return columns.select_columns(t.customer, ["c_name", "c_custkey"])


@query("apply_column_mapping", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def apply_column_mapping(t: Tables):
    return columns.apply_column_mapping(t.customer, {"c_custkey": "id", "c_mktsegment": "segment"})


@query("positional_mapping", "SELECT p_partkey AS id_original, p_name AS name, p_brand AS brand FROM part")
def positional_mapping(t: Tables):
    df = t.part.select(F.col("p_partkey").alias("ID"), "p_name", "p_brand", "p_size")
    mapping = columns.positional_mapping(df.columns, ["id_original", "name", "brand"])
    return columns.apply_column_mapping(df, mapping)


@query("sanitize_columns", """SELECT s_suppkey AS supplier_key, s_name AS name, s_nationkey AS col_1st_nation,
 s_acctbal AS unnamed_column FROM supplier""")
def sanitize_columns(t: Tables):
    return columns.sanitize_columns(t.supplier.toDF(" Supplier-Key ", "Name!", "1st.Nation", "?"))


@query("split_delimiter", """SELECT c_custkey, split_part(c_name, '#', 1) AS label,
 CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) END AS number, NULL::VARCHAR AS rest FROM customer""")
def split_delimiter(t: Tables):
    df = t.customer.select("c_custkey", "c_name")
    return columns.split_column(df, "c_name", ["label", "number", "rest"], delimiter="#")


@query("split_regex", r"""SELECT p_partkey, p_brand, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#1(\d)')
 THEN regexp_extract(p_brand, '([A-Za-z]+)#1(\d)', 1) END AS word,
 CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#1(\d)') THEN regexp_extract(p_brand, '([A-Za-z]+)#1(\d)', 2) END AS digit FROM part""")
def split_regex(t: Tables):
    df = t.part.select("p_partkey", "p_brand")
    return columns.split_column(df, "p_brand", ["word", "digit"], pattern=r"([A-Za-z]+)#1(\d)", keep_original=True)


@query("merge_columns", """SELECT p_partkey, concat_ws(' / ', p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_type END,
 p_size::VARCHAR) AS label FROM part""")
def merge_columns(t: Tables):
    df = t.part.select("p_partkey", "p_brand", nulled("p_type", "p_partkey", 7).alias("p_type"), "p_size")
    return columns.merge_columns(df, ["p_brand", "p_type", "p_size"], "label", " / ", drop_original=True)


@query("add_metadata", """SELECT event_id, user_id, TIMESTAMP '2024-01-01 00:00:00' AS _sync_timestamp,
 'insert' AS _sync_operation FROM events""")
def add_metadata(t: Tables):
    out = columns.add_metadata(t.events.select("event_id", "user_id"), "insert", "2024-01-01 00:00:00")
    return out.withColumn("_sync_timestamp", F.col("_sync_timestamp").cast("timestamp_ntz"))


@query("add_surrogate_id", """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id,
 o_orderpriority AS id_original, o_orderkey, o_orderdate FROM orders""")
def add_surrogate_id(t: Tables):
    df = t.orders.select(F.col("o_orderpriority").alias("id"), "o_orderkey", "o_orderdate")
    return columns.add_surrogate_id(df, ["o_orderdate", "o_orderkey"])


@query("surrogate_id_kept", "SELECT c_custkey AS id, c_name FROM customer")
def surrogate_id_kept(t: Tables):
    return columns.add_surrogate_id(t.customer.select(F.col("c_custkey").cast("string").alias("id"), "c_name"))


@query("with_defaults", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, 'none') AS priority,
 coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END, 0.0) AS price FROM orders""")
def with_defaults(t: Tables):
    df = t.orders.select("o_orderkey", nulled("o_orderpriority", "o_orderkey", 7).alias("priority"),
                         nulled("o_totalprice", "o_orderkey", 5).alias("price"))
    return columns.with_defaults(df, [
        {"name": "priority", "default_value": "none"}, {"name": "price", "default_value": "0"}, {"name": "o_orderkey"},
    ])


_GAPS = """WITH d AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS value,
 CASE WHEN event_id % 4 = 0 THEN event_type END AS event_type FROM events) """


def _gaps(t: Tables):
    return t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("event_type"),
    )


@query("fill_value", _GAPS + "SELECT event_id, coalesce(value, 0.0) AS value FROM d")
def fill_value(t: Tables):
    return fill.fill_value(_gaps(t).select("event_id", "value"), "value", 0)


@query("fill_all_value", _GAPS + "SELECT event_id, user_id, ts, value, coalesce(event_type, 'none') AS event_type FROM d")
def fill_all_value(t: Tables):
    return fill.fill_all_value(_gaps(t), "none")


@query("fill_forward", _GAPS + """SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER w AS value, event_type
 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward(t: Tables):
    return fill.fill_carried(_gaps(t), ["value"], ["ts", "event_id"], ["user_id"], "forward")


@query("fill_backward", _GAPS + """SELECT event_id, user_id, ts, first_value(value IGNORE NULLS) OVER w AS value, event_type
 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_backward(t: Tables):
    return fill.fill_carried(_gaps(t), ["value"], ["ts", "event_id"], ["user_id"], "backward")


@query("fill_forward_all", _GAPS + """SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER w AS value,
 last_value(event_type IGNORE NULLS) OVER w AS event_type FROM d
 WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward_all(t: Tables):
    return fill.fill_carried(_gaps(t), ["value", "event_type"], ["ts", "event_id"], buckets=512)


@query("fill_mean", _GAPS + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value FROM d")
def fill_mean(t: Tables):
    out = fill.fill_mean(_gaps(t).select("event_id", "value"), "value")
    return out.withColumn("value", F.round("value", 6))


@query("fill_median", _GAPS + "SELECT event_id, coalesce(value, (SELECT median(value) FROM d)) AS value FROM d")
def fill_median(t: Tables):
    return fill.fill_median(_gaps(t).select("event_id", "value"), "value")


@query("fill_mode", _GAPS + """SELECT event_id, coalesce(event_type, (SELECT event_type FROM d WHERE event_type IS NOT NULL
 GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM d""")
def fill_mode(t: Tables):
    return fill.fill_mode(_gaps(t).select("event_id", "event_type"), "event_type")
