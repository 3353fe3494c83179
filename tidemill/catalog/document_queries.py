"""Queries for documents, envelopes, key-value dumps and change events."""

from pyspark.sql import functions as F

from tidemill.catalog.registry import Tables, nulled, query
from tidemill.operators import changes
from tidemill.operators.columns import flatten_struct
from tidemill.operators.inspect import nested_array_inventory
from tidemill.sources import envelopes as env


@query("flatten_struct", """SELECT o_orderkey AS "order.key", o_orderdate AS "order.placed.at", o_orderstatus AS "order.placed.status",
 c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey""")
def flatten(t: Tables):
    nested = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.struct(
            F.col("o_orderkey").alias("key"),
            F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status")).alias("placed"),
        ).alias("order"), F.col("c_name").alias("customer"),
    )
    return flatten_struct(nested)


def _messages(t: Tables):
    body = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).when(F.col("event_id") % 7 != 0, F.col("props"))
    return t.events.select(
        F.col("event_id").alias("offset"), (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_type").alias("key"), body.alias("value"),
    )


_MESSAGES = """WITH m AS (SELECT event_id AS "offset", (event_id % 4)::INTEGER AS "partition", event_type AS key,
 CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 7 <> 0 THEN props END AS value FROM events) """


@query("parse_payload", _MESSAGES + """SELECT "offset", CASE WHEN json_valid(value) THEN (value::JSON ->> 'k')::BIGINT END AS k,
 CASE WHEN NOT json_valid(value) THEN value END AS raw FROM m""")
def parse_payload(t: Tables):
    parsed = _messages(t).select("offset", env.parse_payload(F.col("value")).alias("v"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    return parsed.select(
        "offset", F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.when(~is_object, F.try_variant_get("v", "$", "string")).alias("raw"),
    )


@query("flatten_envelope", _MESSAGES + """SELECT *, CASE WHEN json_valid(value) THEN (value::JSON ->> 'k')::BIGINT END AS value_k FROM m""")
def flatten_envelope(t: Tables):
    return env.flatten_envelope(_messages(t), "value", "k bigint")


@query("flatten_discovered", _MESSAGES + """SELECT *, CASE WHEN json_valid(value) THEN value::JSON ->> 'k' END AS body_k FROM m""")
def flatten_discovered(t: Tables):
    return env.flatten_discovered(_messages(t), "value", prefix="body_")


def _responses(t: Tables):
    """API responses made of order lines: two records each, under ``items`` or ``results``."""
    def record(number, quantity):
        return F.struct(F.col("l_partkey"), number.alias("l_linenumber"), quantity.alias("l_quantity"))

    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    records = F.array(record(number, quantity), record(number + 10, quantity * 2))
    odd = F.col("l_orderkey") % 2 == 1
    return t.lineitem.select(
        F.when(odd, records).alias("results"), F.when(~odd, records).alias("items"),
        F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey")).alias("total"),
    )


@query("unwrap_response", """SELECT l_partkey, l_linenumber, l_quantity FROM lineitem UNION ALL
 SELECT l_partkey, l_linenumber + 10, l_quantity * 2 FROM lineitem""")
def unwrap_response(t: Tables):
    return env.unwrap_response(_responses(t))


@query("response_total", "SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_partkey ELSE 2 END AS total FROM lineitem")
def response_total(t: Tables):
    return env.response_total(_responses(t))


@query("document_hits", "SELECT doc_id, lang, doc_id::VARCHAR AS _id, n_chars / 2 AS _score, source AS _index FROM documents")
def document_hits(t: Tables):
    hit = F.struct(
        F.struct("doc_id", "lang").alias("_source"), F.col("doc_id").cast("string").alias("_id"),
        (F.col("n_chars") / 2).alias("_score"), F.col("source").alias("_index"),
    )
    return env.document_hits(t.documents.select(F.struct(F.array(hit).alias("hits")).alias("hits")))


@query("stringify_ids", """SELECT lower(hex(c_name)) AS _id, c_custkey::VARCHAR AS owner, concat('x', c_custkey, ',', 'y', c_custkey) AS refs,
 c_name FROM customer""")
def stringify_ids(t: Tables):
    key = F.col("c_custkey").cast("string")

    def oid(col):
        return F.struct(col.alias("$oid"))

    docs = t.customer.select(
        F.col("c_name").cast("binary").alias("_id"), F.struct(oid(key).alias("ref"), F.lit(1).alias("v")).alias("owner"),
        F.array(oid(F.concat(F.lit("x"), key)), oid(F.concat(F.lit("y"), key))).alias("refs"), "c_name",
    )
    return env.stringify_ids(docs).select(
        "_id", F.col("owner.ref").alias("owner"), F.array_join("refs", ",").alias("refs"), "c_name"
    )


@query("explode_hash", """SELECT c_custkey AS key, -1 AS ttl, f.field, f.value, 'hash' AS type, coalesce(length(f.value), 0)::INTEGER AS size FROM customer,
 LATERAL (SELECT 'name' AS field, c_name AS value UNION ALL SELECT 'segment', c_mktsegment) f""")
def explode_hash(t: Tables):
    value = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return env.explode_hash(t.customer.select(F.col("c_custkey").alias("key"), F.lit(-1).alias("ttl"), value.alias("value")))


_WORDS = "SELECT p_partkey AS key, string_split(p_name || ' ' || p_type || ' ' || p_type, ' ') AS w FROM part"


def _word_lists(t: Tables):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_type"), " ")
    return t.part.select(F.col("p_partkey").alias("key"), words.alias("value"))


@query("explode_list", f"""SELECT key, (i - 1)::INTEGER AS index, w[i] AS value, 'list' AS type, length(w[i])::INTEGER AS size
 FROM (SELECT key, w, unnest(range(1, len(w) + 1)) AS i FROM ({_WORDS}))""")
def explode_list(t: Tables):
    return env.explode_list(_word_lists(t))


@query("explode_set", f"""SELECT key, value, 'set' AS type, length(value)::INTEGER AS size FROM
 (SELECT DISTINCT key, unnest(w) AS value FROM ({_WORDS}))""")
def explode_set(t: Tables):
    return env.explode_set(_word_lists(t))


@query("explode_zset", """SELECT p_partkey AS key, f.value, f.score, 'zset' AS type, length(f.value)::INTEGER AS size FROM part,
 LATERAL (SELECT p_name AS value, p_retailprice AS score UNION ALL SELECT p_brand, p_size::DOUBLE) f""")
def explode_zset(t: Tables):
    pairs = F.array(
        F.struct(F.col("p_name").alias("value"), F.col("p_retailprice").alias("score")),
        F.struct(F.col("p_brand").alias("value"), F.col("p_size").cast("double").alias("score")),
    )
    return env.explode_zset(t.part.select(F.col("p_partkey").alias("key"), pairs.alias("value")))


@query("dump_rows", """WITH d AS (SELECT p_partkey AS key, ['string', 'hash', 'list', 'set', 'zset', 'stream'][1 + p_partkey % 6] AS type, p_name, p_brand, p_type,
 p_retailprice, string_split(p_name || ' ' || p_type || ' ' || p_type, ' ') AS w FROM part)
 SELECT key, type, NULL AS field, NULL::INTEGER AS index, CASE WHEN key % 4 <> 0 THEN p_name END AS value, NULL::DOUBLE AS score, -1 AS ttl,
  coalesce(length(CASE WHEN key % 4 <> 0 THEN p_name END), 0)::INTEGER AS size FROM d WHERE type = 'string'
 UNION ALL SELECT key, type, f.field, NULL, f.value, NULL, -1, length(f.value)::INTEGER FROM d,
  LATERAL (SELECT 'brand' AS field, p_brand AS value UNION ALL SELECT 'type', p_type) f WHERE type = 'hash'
 UNION ALL SELECT key, type, NULL, (i - 1)::INTEGER, w[i], NULL, -1, length(w[i])::INTEGER FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d WHERE type = 'list')
 UNION ALL SELECT key, type, NULL, NULL, value, NULL, -1, length(value)::INTEGER FROM (SELECT DISTINCT key, type, unnest(w) AS value FROM d WHERE type = 'set')
 UNION ALL SELECT key, type, NULL, NULL, p_name, p_retailprice, -1, length(p_name)::INTEGER FROM d WHERE type = 'zset'""")
def dump_rows(t: Tables):
    """A dump in which every part is a key, of the five types in turn and of one that is not known."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_type"), " ")
    kinds = F.array(*[F.lit(k) for k in ("string", "hash", "list", "set", "zset", "stream")])
    return env.dump_rows(t.part.select(
        F.col("p_partkey").alias("key"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("type"), F.lit(-1).alias("ttl"),
        nulled("p_name", "p_partkey", 4).alias("string"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("hash"),
        words.alias("list"), words.alias("set"),
        F.array(F.struct(F.col("p_name").alias("value"), F.col("p_retailprice").alias("score"))).alias("zset")))


@query("value_size", """SELECT doc_id, coalesce(length(CASE WHEN doc_id % 9 <> 0 THEN text END), 0)::INTEGER AS size,
 length(n_chars::VARCHAR)::INTEGER AS number_size FROM documents""")
def value_size(t: Tables):
    df = t.documents.select("doc_id", nulled("text", "doc_id", 9).alias("text"), "n_chars")
    return df.select("doc_id", env.value_size(F.col("text")).alias("size"), env.value_size(F.col("n_chars")).alias("number_size"))


def _document_log(t: Tables):
    kind = F.col("event_type")
    op = (F.when(kind == "signup", "insert").when(kind == "purchase", "replace").when(kind == "click", "update")
          .when(kind == "view", "invalidate").otherwise("delete"))
    return t.events.select(
        op.alias("operationType"),
        F.struct(F.col("user_id").alias("_id"), kind.alias("kind"), F.col("event_id").alias("ref")).alias("fullDocument"),
        F.struct(F.col("user_id").alias("_id")).alias("documentKey"),
        F.struct(F.create_map(F.lit("kind"), F.lit("clicked"), F.lit("note"), F.lit("new")).alias("updatedFields")).alias("updateDescription"),
        F.col("ts").alias("clusterTime"),
    )


@query("change_event_document", """SELECT user_id::VARCHAR AS _id,
 CASE WHEN event_type IN ('signup', 'purchase') THEN event_type WHEN event_type = 'click' THEN 'clicked' END AS kind,
 CASE WHEN event_type IN ('signup', 'purchase') THEN event_id::VARCHAR END AS ref,
 CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'replace' WHEN 'click' THEN 'update' ELSE 'delete' END AS _change_operation,
 ts AS _change_timestamp FROM events WHERE event_type <> 'view'""")
def change_event_document(t: Tables):
    rows = env.change_event_document(_document_log(t))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("_id", "ref")}).drop("_updated_fields")  # the SQL has texts


@query("change_event_document_fields", """SELECT user_id AS _id, CASE WHEN event_type = 'click' THEN 'new' END AS note,
 CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END AS ref, ts AS _change_timestamp FROM events WHERE event_type <> 'view'""")
def change_event_document_fields(t: Tables):
    rows = env.change_event_document(_document_log(t))
    return rows.select("_id", F.col("_updated_fields")["note"].alias("note"), "ref", "_change_timestamp")


@query("change_event_rows", """SELECT user_id AS id, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS amount,
 CASE WHEN event_type = 'click' THEN (concat('{"id":', user_id, '}')) END AS _before_values,
 CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'update' ELSE 'delete' END AS _change_operation,
 ts AS _change_timestamp, 'events' AS _table_name, 'log.1' AS _log_file, event_id AS _log_pos
 FROM events WHERE event_type <> 'view'""")
def change_event_rows(t: Tables):
    kind = F.col("event_type")
    op = (F.when(kind == "signup", "insert").when(kind == "click", "update").when(kind == "view", "rotate").otherwise("delete"))

    def image(amount):
        return F.struct(F.col("user_id").alias("id"), amount.alias("amount"))

    log = t.events.select(
        op.alias("op"), "ts", F.lit("events").alias("table"), image(F.col("value")).alias("values"),
        image(F.lit(None).cast("double")).alias("before_values"), image(F.col("value") * 2).alias("after_values"),
        F.lit("log.1").alias("log_file"), F.col("event_id").alias("log_pos"),
    )
    return env.change_event_rows(log)


@query("nested_array_inventory", """SELECT 'items' AS path, 2 * count(*) AS record_count, 3 AS field_count FROM lineitem WHERE l_orderkey % 2 = 0
 UNION ALL SELECT 'results', 2 * count(*), 3 FROM lineitem WHERE l_orderkey % 2 = 1""")
def nested_inventory(t: Tables):
    return nested_array_inventory(_responses(t))


def change_log(t: Tables):
    """Events as a change log of users: errors delete, everything else sets the value."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return t.events.select("user_id", "event_id", "value", op.alias("op"))


_LATEST = """WITH latest AS (SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value,
 arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END, event_id) AS op FROM events GROUP BY user_id) """


@query("current_state", _LATEST + "SELECT * FROM latest WHERE op <> 'delete'")
def current_state(t: Tables):
    return changes.current_state(change_log(t), ["user_id"], ["event_id"])


@query("apply_changes", _LATEST + """SELECT user_id, value FROM latest WHERE op <> 'delete' UNION ALL
 SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM latest)""")
def apply_changes(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return changes.apply_changes(base, change_log(t), ["user_id"], ["event_id"])
