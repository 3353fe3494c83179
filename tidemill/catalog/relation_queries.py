"""Queries for aggregation, joins, set operations and SQL text."""

from pyspark.sql import functions as F

from tidemill.catalog.registry import Tables, fresh_name, nulled, query
from tidemill.operators import aggregate as agg
from tidemill.operators import joins, rows, sql

_LINES = """WITH d AS (SELECT l_orderkey, l_linenumber, l_linestatus,
 CASE WHEN l_orderkey % 17 <> 0 THEN l_returnflag END AS flag,
 CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS qty, l_extendedprice, l_partkey FROM lineitem) """


def _lines(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_linestatus", nulled("l_returnflag", "l_orderkey", 17).alias("flag"),
        nulled("l_quantity", "l_linenumber", 4).alias("qty"), "l_extendedprice", "l_partkey",
    )


@query("agg_group", _LINES + """SELECT flag, l_linestatus, count(qty) AS qty_count, round(sum(l_extendedprice), 2) AS revenue,
 round(avg(qty), 6) AS mean_qty FROM d WHERE flag IS NOT NULL GROUP BY flag, l_linestatus""")
def agg_group(t: Tables):
    out = agg.aggregate(_lines(t), ["flag", "l_linestatus"], [
        {"column": "qty", "function": "count"}, {"column": "l_extendedprice", "function": "sum", "alias": "revenue"},
        {"column": "qty", "function": "avg", "alias": "mean_qty"},
    ])
    return out.withColumns({"revenue": F.round("revenue", 2), "mean_qty": F.round("mean_qty", 6)})


@query("agg_group_null_keys", _LINES + "SELECT flag, count(l_orderkey) AS n FROM d GROUP BY flag")
def agg_group_null_keys(t: Tables):
    spec = [{"column": "l_orderkey", "function": "count", "alias": "n"}]
    return agg.aggregate(_lines(t), ["flag"], spec, keep_null_keys=True)


@query("agg_global", "SELECT count(l_orderkey) AS n, max(l_shipdate) AS latest FROM lineitem")
def agg_global(t: Tables):
    return agg.aggregate(t.lineitem, [], [
        {"column": "l_orderkey", "function": "count", "alias": "n"},
        {"column": "l_shipdate", "function": "max", "alias": "latest"},
    ])


def _agg_query(name: str, function: str, expression: str, digits: int | None = None) -> None:
    def run(t: Tables):
        out = agg.aggregate(_lines(t), ["flag"], [{"column": "qty", "function": function, "alias": "result"}])
        return out if digits is None else out.withColumn("result", F.round("result", digits))

    value = expression if digits is None else f"round({expression}, {digits})"
    query(name, _LINES + f"SELECT flag, {value} AS result FROM d WHERE flag IS NOT NULL GROUP BY flag")(run)


for _name, _function, _expr, _digits in [
    ("agg_count", "count", "count(qty)", None), ("agg_sum", "sum", "coalesce(sum(qty), 0.0)", 2),
    ("agg_avg", "avg", "avg(qty)", 6), ("agg_min", "min", "min(qty)", None), ("agg_max", "max", "max(qty)", None),
    ("agg_median", "median", "median(qty)", None), ("agg_std", "std", "stddev_samp(qty)", 6),
    ("agg_var", "var", "var_samp(qty)", 6), ("agg_count_distinct", "nunique", "count(DISTINCT qty)", None),
    ("nunique", "nunique", "count(DISTINCT qty)", None),
]:
    _agg_query(_name, _function, _expr, _digits)


@query("agg_median_price", "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS price FROM lineitem GROUP BY ALL")
def agg_median_price(t: Tables):
    spec = [{"column": "l_extendedprice", "function": "median", "alias": "price"}]
    return agg.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], spec)


_FIRST_LAST = """SELECT l_suppkey, arg_min(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS first_qty,
 arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS last_qty
 FROM (SELECT * FROM lineitem WHERE l_linenumber % 4 <> 0) GROUP BY l_suppkey"""


def _first_last(t: Tables, wanted: list[str]):
    df = t.lineitem.withColumn("qty", nulled("l_quantity", "l_linenumber", 4))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    specs = [{"column": "qty", "function": w, "alias": f"{w}_qty"} for w in wanted]
    out = agg.aggregate(df, ["l_suppkey"], specs, order_by=order)
    return out.filter(F.col(f"{wanted[0]}_qty").isNotNull())


@query("agg_first", f"SELECT l_suppkey, first_qty FROM ({_FIRST_LAST})")
def agg_first(t: Tables):
    return _first_last(t, ["first"])


@query("agg_last", f"SELECT l_suppkey, last_qty FROM ({_FIRST_LAST})")
def agg_last(t: Tables):
    return _first_last(t, ["last"])


@query("agg_having", """SELECT l_suppkey, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
 GROUP BY l_suppkey HAVING count(l_orderkey) > 500 AND sum(l_quantity) < 1e12""")
def agg_having(t: Tables):
    out = agg.aggregate(t.lineitem, ["l_suppkey"], [
        {"column": "l_orderkey", "function": "count", "alias": "n"},
        {"column": "l_quantity", "function": "sum", "alias": "qty"},
    ], having=[{"column": "n", "operator": "greater_than", "value": 500}, {"column": "qty", "operator": "lt", "value": 1e12}])
    return out.withColumn("qty", F.round("qty", 2))


@query("agg_dict_form", """SELECT o_orderstatus, count(o_orderkey) AS o_orderkey_count, max(o_totalprice) AS o_totalprice_max
 FROM orders GROUP BY o_orderstatus""")
def agg_dict_form(t: Tables):
    return agg.aggregate(t.orders, ["o_orderstatus"], {"o_orderkey": "count", "o_totalprice": "max"})


_SIDES = """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS cust, o_totalprice FROM orders),
 r AS (SELECT CASE WHEN c_custkey % 500 <> 0 THEN c_custkey + 200 END AS custkey, c_name FROM customer) """


def _sides(t: Tables):
    left = t.orders.select("o_orderkey", nulled("o_custkey", "o_orderkey", 50).alias("cust"), "o_totalprice")
    right = t.customer.select(nulled(F.col("c_custkey") + 200, "c_custkey", 500).alias("custkey"), "c_name")
    return left, right


def _join_query(how: str, sql_join: str, key: str) -> None:
    text = _SIDES + (f"SELECT o_orderkey, {key} AS cust, o_totalprice, c_name FROM l {sql_join} JOIN r "
                     "ON cust IS NOT DISTINCT FROM custkey")
    query(f"join_{how}", text)(lambda t: joins.join(*_sides(t), [{"left": "cust", "right": "custkey"}], how, split_pairs=True))


_join_query("inner", "INNER", "cust")
_join_query("left", "LEFT", "cust")
_join_query("right", "RIGHT", "coalesce(cust, custkey)")
_join_query("full", "FULL", "coalesce(cust, custkey)")


@query("join_cross", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, r_regionkey, r_name FROM supplier CROSS JOIN region")
def join_cross(t: Tables):
    # the feature itself; the five regions make it linear in the suppliers
    return joins.join(t.supplier, t.region, how="cross")


@query("join_prefixing", """SELECT s_suppkey AS ds1_s_suppkey, s_name AS ds1_s_name, s_nationkey, s_acctbal AS ds1_s_acctbal,
 n_name AS ds2_n_name, n_regionkey AS ds2_n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def join_prefixing(t: Tables):
    on = [{"left": "s_nationkey", "right": "n_nationkey"}]
    return joins.join(t.supplier, t.nation, on, left_prefix="ds1_", right_prefix="ds2_")


@query("join_suffixes", """SELECT a.user_id, a.event_id AS event_id_left, b.event_id AS event_id_right FROM
 (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) a JOIN
 (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) b USING (user_id)""")
def join_suffixes(t: Tables):
    newest = t.events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    oldest = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return joins.join(newest, oldest, "user_id")


@query("join_chain", """SELECT r_name, count(o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY r_name""")
def join_chain(t: Tables):
    df = joins.join(t.orders, t.customer, [{"left": "o_custkey", "right": "c_custkey"}])
    df = rows.filter_rows(df, [{"column": "c_acctbal", "operator": "gt", "value": 0.0}])
    df = joins.join(df, t.nation, [{"left": "c_nationkey", "right": "n_nationkey"}])
    df = joins.join(df, t.region, [{"left": "n_regionkey", "right": "r_regionkey"}])
    return agg.aggregate(df, ["r_name"], [{"column": "o_orderkey", "function": "count", "alias": "orders"}])


@query("join_check", _SIDES + """, lk AS (SELECT cust AS k, count(*) AS n FROM l GROUP BY 1),
 rk AS (SELECT custkey AS k, count(*) AS n FROM r GROUP BY 1)
 SELECT (SELECT sum(n)::BIGINT FROM lk) AS left_rows, (SELECT sum(n)::BIGINT FROM rk) AS right_rows,
 (SELECT count(*) FROM lk) AS left_distinct_keys, (SELECT count(*) FROM rk) AS right_distinct_keys,
 (SELECT coalesce(sum(n), 0)::BIGINT FROM lk WHERE k IS NULL) AS left_null_keys,
 (SELECT coalesce(sum(n), 0)::BIGINT FROM rk WHERE k IS NULL) AS right_null_keys,
 (SELECT count(*) FROM lk WHERE n > 1) AS left_duplicate_keys, (SELECT count(*) FROM rk WHERE n > 1) AS right_duplicate_keys,
 (SELECT sum(lk.n)::BIGINT FROM lk JOIN rk ON lk.k IS NOT DISTINCT FROM rk.k) AS left_matched_rows,
 (SELECT sum(lk.n * rk.n)::BIGINT FROM lk JOIN rk ON lk.k IS NOT DISTINCT FROM rk.k) AS inner_rows,
 (SELECT sum(lk.n) FROM lk JOIN rk ON lk.k IS NOT DISTINCT FROM rk.k)::DOUBLE / (SELECT sum(n) FROM lk)::DOUBLE AS match_rate,
 (SELECT sum(n) FROM lk)::DOUBLE * (SELECT sum(n) FROM rk)::DOUBLE AS cross_rows""")
def join_check(t: Tables):
    return joins.join_check(*_sides(t), [{"left": "cust", "right": "custkey"}])


@query("semi_join", "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(t: Tables):
    big = t.orders.filter(F.col("o_totalprice") > 300000)
    return joins.join(t.customer, big, [{"left": "c_custkey", "right": "o_custkey"}], "semi")


@query("anti_join", "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(t: Tables):
    big = t.orders.filter(F.col("o_totalprice") > 300000)
    return joins.join(t.customer, big, [{"left": "c_custkey", "right": "o_custkey"}], "anti")


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t: Tables):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


_PAIR = "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' {op} SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 1000"


def _pair(t: Tables):
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_suppkey").alias("id"))
    return [returned, t.supplier.filter(F.col("s_acctbal") > 1000).select(F.col("s_suppkey").alias("id"))]


for _kind in ("union", "intersect", "except"):
    for _all in (False, True):
        query(_kind + ("_all" if _all else ""), _PAIR.format(op=_kind.upper() + (" ALL" if _all else "")))(
            lambda t, kind=_kind, all_rows=_all: rows.set_operation(_pair(t), kind, all_rows)
        )


@query("sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def sort(t: Tables):
    return rows.sort(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "DESC")


@query("limit_offset", """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total_count FROM customer
 ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50""")
def limit_offset(t: Tables):
    return rows.page(t.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"], page=3, with_total=True)


@query("page", """SELECT l_shipdate, l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS total_count FROM lineitem
 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 25 OFFSET 2975""")
def page(t: Tables):
    """A deep page in falling order; many rows share a day."""
    df = t.lineitem.select("l_shipdate", "l_orderkey", "l_linenumber")
    return rows.page(df, ["-l_shipdate", "-l_orderkey", "-l_linenumber"], page=120, with_total=True, shallow=0)


@query("table_view", """SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part WHERE contains(p_name, 'ring')) AS total_count FROM part
 WHERE contains(p_name, 'ring') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5 OFFSET 5""")
def table_view(t: Tables):
    """Second page of the parts found; prices repeat, ties go by the whole row."""
    price = F.col("p_retailprice")
    df = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("p_partkey"), "p_name", price)
    found = rows.table_view(df, "p_name", "ring", "p_retailprice", "DESC", 2, 5, shallow=0)
    return found.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("page_after", "SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def page_after(t: Tables):
    return rows.page_after(t.orders, "o_orderkey", 500)


@query("search_like", "SELECT * FROM part WHERE p_name LIKE '%ring%'")
def search_like(t: Tables):
    return rows.search(t.part, "p_name", "ring")


@query("top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(t: Tables):
    return rows.top_n(t.orders, [F.desc("o_totalprice"), "o_orderkey"], 20)


def _sql_query(name: str, text: str, tables: list[str], spark_text: str | None = None) -> None:
    def run(t: Tables):
        return sql.run_sql(t.spark, spark_text or text, {n: getattr(t, n) for n in tables})

    query(name, text)(run)


_sql_query("run_sql", "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_mktsegment", ["customer"])
_sql_query("sql_project_filter", """SELECT p_partkey, p_size * 2 + 1 AS a, p_size % 7 AS b, p_retailprice / 4 AS c, p_name AS label FROM part
 WHERE (p_size BETWEEN 5 AND 30 OR p_brand IN ('Brand#1', 'Brand#2')) AND NOT p_name LIKE '%red%' AND p_type IS NOT NULL""", ["part"])
_sql_query("sql_case_cast", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
 CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(o_orderdate AS DATE) AS day FROM orders""", ["orders"])
_sql_query("sql_join", """SELECT n.n_name, r.r_name, s.s_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey
 LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000""", ["nation", "region", "supplier"])
_sql_query("sql_group_having", """SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, min(o_totalprice) AS low, round(sum(o_totalprice), 2) AS total,
 avg(o_orderkey) AS mean, round(stddev(o_orderkey % 100), 4) AS spread, round(variance(o_orderkey % 100), 4) AS var FROM orders
 GROUP BY o_custkey HAVING count(*) > 5""", ["orders"])
_sql_query("sql_string_agg", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus",
           ["orders"], "SELECT o_orderstatus, listagg(DISTINCT o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus")
_sql_query("sql_setops", """(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey FROM supplier""", ["orders", "customer", "supplier"])
_sql_query("sql_exists", """SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)
 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_mktsegment = 'BUILDING')
 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""", ["supplier", "lineitem", "customer", "nation"])
_sql_query("sql_order_limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 40 OFFSET 10", ["customer"])
_sql_query("sql_cte", """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
 big AS (SELECT o_custkey FROM spend WHERE total > 1000000) SELECT c_name, c_mktsegment FROM customer JOIN big ON c_custkey = o_custkey""", ["customer", "orders"])


@query("step_sql", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 5 GROUP BY event_type")
def step_sql(t: Tables):
    text = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM source_data WHERE value > 5 GROUP BY event_type"
    return sql.step_sql(t.events, text)


@query("step_python", "SELECT o_orderkey, o_totalprice * 2 AS scaled FROM orders")
def step_python(t: Tables):
    def scale(df, factor):
        return df.select("o_orderkey", (F.col("o_totalprice") * factor).alias("scaled"))

    return sql.step_python(t.orders, scale, factor=2.0)


@query("step_pandas", "SELECT c_custkey, upper(c_mktsegment) AS segment, length(c_name) AS n FROM customer")
def step_pandas(t: Tables):
    def shape(part):
        return part.assign(segment=part["c_mktsegment"].str.upper(), n=part["c_name"].str.len())[["c_custkey", "segment", "n"]]

    df = t.customer.select("c_custkey", "c_mktsegment", "c_name")
    return sql.step_pandas(df, shape, "c_custkey long, segment string, n long")


@query("register_udf", "SELECT p_partkey, p_retailprice * 2 AS doubled FROM part")
def register_udf(t: Tables):
    name = fresh_name("doubled")
    sql.register_udf(t.spark, name, lambda s: s * 2, "double")
    return sql.run_sql(t.spark, f"SELECT p_partkey, {name}(p_retailprice) AS doubled FROM part", {"part": t.part})


@query("list_tables", """SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS row_count UNION ALL
 SELECT 'orders', (SELECT count(*) FROM orders) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem)""")
def list_tables(t: Tables):
    views = {fresh_name(n): n for n in ("customer", "orders", "lineitem")}
    for view, name in views.items():
        getattr(t, name).createOrReplaceTempView(view)
    found = [x["name"] for x in sql.list_tables(t.spark) if x["name"] in views]
    rows_of = [(views[v], sql.describe_table(t.spark, v)["row_count"]) for v in found]
    for view in views:
        t.spark.catalog.dropTempView(view)
    return t.spark.createDataFrame(rows_of, "name string, row_count long")


@query("describe_table", """SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
 WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type, true AS nullable, (SELECT count(*) FROM customer) AS row_count
 FROM (DESCRIBE customer) d(column_name, data_type, a, b, c, e)""")
def describe_table(t: Tables):
    view = fresh_name("customer")
    t.customer.createOrReplaceTempView(view)
    info = sql.describe_table(t.spark, view)
    t.spark.catalog.dropTempView(view)
    columns = [(c["name"], c["type"], c["nullable"], info["row_count"]) for c in info["columns"]]
    return t.spark.createDataFrame(columns, "name string, type string, nullable boolean, row_count long")
