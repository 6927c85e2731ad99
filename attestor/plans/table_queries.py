"""Queries over activity, conversations and tables, with DuckDB SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import activity as A
from ..operators import changes, ingest, redline, relations, verify
from ..sources import files, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def searches(spark: SparkSession, d: str) -> DataFrame:
    """Events as searches: their type asked for, in two spellings, with a number of results."""
    e = table(spark, d, "events")
    asked = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")), F.lit(" "), (F.col("user_id") % 7).cast("string"))
    return e.select("event_id", F.col("user_id"), asked.alias("query"), F.floor("value").alias("result_count"), F.col("ts").alias("created_at"))


SEARCH_SQL = "s AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END || ' ' || (user_id % 7) AS query, floor(value) AS result_count, ts AS created_at FROM events)"


@query(f"WITH {SEARCH_SQL} SELECT lower(trim(query)) AS query, count(*)::BIGINT AS count, round_even(avg(result_count), 1)::DOUBLE AS avg_results FROM s GROUP BY ALL ORDER BY count DESC, 1 LIMIT 10")
def search_analytics(spark: SparkSession, d: str) -> DataFrame:
    return A.search_analytics(searches(spark, d))


@query(f"WITH {SEARCH_SQL} SELECT lower(trim(query)) AS query, count(*)::BIGINT AS count FROM s GROUP BY 1 ORDER BY count DESC, min((created_at, event_id)) LIMIT 10")
def search_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return A.first_seen_analytics(searches(spark, d))


@query(f"WITH {SEARCH_SQL} SELECT count(*)::BIGINT AS total, coalesce(round_even(avg(result_count), 1), 0)::DOUBLE AS avg_results FROM s")
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.search_totals(searches(spark, d))


def audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"), "value")


NOW, NOW_SQL = "timestamp_ntz'2024-01-29 13:00:00'", "TIMESTAMP '2024-01-29 13:00:00'"


@query(f"SELECT event_type AS action, count(*)::BIGINT AS count FROM events WHERE ts >= date_trunc('day', {NOW_SQL}) - INTERVAL 7 DAY GROUP BY ALL")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Actions since midnight, seven days before a fixed now."""
    return A.action_counts(audit(spark, d), A.since(7, F.expr(NOW)))


@query("SELECT event_id, event_type AS action, ts AS created_at FROM events WHERE event_type = 'click' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    rows = A.matching(audit(spark, d), action="click", user_id=7, value=None)
    return A.page(rows, "created_at", "event_id", 10, 50).select("event_id", "action", "created_at")


@query("SELECT event_id, user_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return A.page(audit(spark, d), "created_at", "event_id", 0, 20).select("event_id", "user_id", "created_at")


@query("SELECT user_id, event_id, place::INT AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 50")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return A.newest_of_each(audit(spark, d), "user_id", "created_at", "event_id", 50).select("user_id", "event_id", "place")


@query(f"SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts >= {NOW_SQL} - INTERVAL 20 DAY GROUP BY ALL")
def ttl_retained(spark: SparkSession, d: str) -> DataFrame:
    rows = A.retained(audit(spark, d), F.expr(NOW), 20)
    return rows.groupBy(F.col("action").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type AS key, count(*)::BIGINT AS count, count(*) > 5 AS over FROM events GROUP BY ALL")
def tumbling_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.rate_windows(audit(spark, d).withColumnRenamed("action", "key"), 60, 5)


@query("""SELECT 'status' AS kind, o_orderstatus AS value, count(*)::BIGINT AS count FROM orders GROUP BY ALL UNION ALL SELECT 'type', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM orders""")
def stats_by_status_type(spark: SparkSession, d: str) -> DataFrame:
    return A.status_and_type(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("file_type")))


@query("SELECT conv_id, count(*)::BIGINT AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@query("""SELECT conv_id, md5(string_agg(turn || ':' || role || ':' || text || '<' || array_to_string(q, ',') || '>', chr(10) ORDER BY turn)) AS nested
FROM (SELECT *, list_sort(list_transform(range(0, turn + 9), lambda i: 'Q' || (i + 1))) AS q FROM conversations) GROUP BY conv_id""")
def conversation_nested(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their messages and the messages' quotes, quotes in order of their names as text."""
    m = table(spark, d, "conversations").withColumn("message_id", F.xxhash64("conv_id", "turn", "role", "text"))
    q = m.select("message_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turn") + 8)).alias("i")).select("message_id", F.concat(F.lit("Q"), (F.col("i") + 1).cast("string")).alias("ref"), F.lit("t").alias("text"), F.lit(True).alias("verified"))
    rows = relations.nested_conversations(m.select("conv_id").distinct(), m, q)
    line = F.transform("messages", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"], F.lit(":"), x["text"], F.lit("<"), F.array_join(F.transform(x["quotes"], lambda y: y["ref"]), ","), F.lit(">")))
    return rows.select("conv_id", F.md5(F.array_join(line, "\n")).alias("nested"))


@query("""SELECT c.conv_id, count(m.turn)::BIGINT AS messages FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 0) c LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.role <> 'system' GROUP BY c.conv_id""")
def conversations_of_document(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    convs = m.select("conv_id").distinct()
    links = convs.withColumn("doc_id", F.col("conv_id") % 5)
    return relations.of_document(convs, links, m.where("role <> 'system'"), 0).select("conv_id", "messages")


@query("""SELECT o_orderkey, coalesce(c_name, 'Unknown document') AS doc_a_name, coalesce(p_name, 'Unknown document') AS doc_b_name FROM orders
LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0 LEFT JOIN part ON p_partkey = o_orderkey % 5000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def comparison_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty rows with the names of what they compare."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("doc_a"), (F.col("o_orderkey") % 5000).alias("doc_b"))
    newest = A.page(rows, "o_orderdate", "o_orderkey", 0, 50)
    named = relations.with_names(newest, table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name")), ["doc_a"])
    named = relations.with_names(named, table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name")), ["doc_b"])
    return named.select("o_orderkey", "doc_a_name", "doc_b_name")


@query("""SELECT o_custkey, count(*)::BIGINT AS asked, count(l)::BIGINT AS found, bool_and(coalesce(l = 'F', false)) AS ready FROM (
  SELECT DISTINCT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS l FROM orders) GROUP BY o_custkey""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    docs = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise(F.col("o_orderstatus")).alias("status"))
    return relations.all_ready(o.select("o_custkey", F.col("o_orderkey").alias("doc_id")), docs, "o_custkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_sort(list_distinct(list(l_linestatus || l_returnflag))) = ['FA', 'FR']")
def exact_set_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_linestatus", "l_returnflag").alias("m"))
    return relations.same_set(rows, "l_orderkey", "m", F.array(F.lit("FR"), F.lit("FA"), F.lit("FR")))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return relations.latest_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return relations.upsert(table(spark, d, "supplier").select("s_suppkey", "s_name"), rows, ["s_suppkey"])


@query("SELECT c_custkey AS s_suppkey, c_name AS s_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return relations.insert_absent(table(spark, d, "supplier").select("s_suppkey", "s_name"), rows.unionByName(rows), ["s_suppkey"])


@query("""SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 0""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    left = relations.cascade({"orders": (table(spark, d, "orders"), "o_custkey"), "customer": (table(spark, d, "customer"), "c_custkey")}, gone, "c_custkey")
    one = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("orders").unionByName(one("customer"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new' || p_partkey ELSE p_brand END AS p_brand FROM part")
def field_update(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    values = p.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("new"), "p_partkey").alias("p_brand"))
    return relations.updated(p, values, ["p_partkey"], "p_brand")


def reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items as sections of an order, of which those of a discount of 10% were not read; orders as documents, some with unreadable pages."""
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("idx"), (F.col("l_discount") < 0.095).alias("ok"))
    bad = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("n"))
    return chunks, bad


COVERAGE_SQL = """cov AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber)::BIGINT AS total, count(DISTINCT CASE WHEN l_discount < 0.095 THEN l_linenumber END)::BIGINT AS read,
  coalesce(array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (l_discount >= 0.095)), ','), '') AS failed, (any_value(o_orderkey) % 3)::BIGINT AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey),
c AS (SELECT *, read = total AND failed = '' AND bad = 0 AS complete FROM cov)"""


@query(f"WITH {COVERAGE_SQL} SELECT doc_id, total AS chunks_total, read AS chunks_read, failed, complete FROM c")
def coverage_fold(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(*reads(spark, d)).select("doc_id", "chunks_total", "chunks_read", F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed"), "complete")


@query(f"""WITH {COVERAGE_SQL} SELECT doc_id, CASE WHEN complete THEN 'I couldn''t find it in the document (doc' || doc_id || ', ' || CASE WHEN total = 1 THEN '1 section' ELSE 'all ' || total || ' sections' END || ' read).'
  ELSE 'I couldn''t find it in the sections I could read (' || read || ' of ' || total || ' sections read from doc' || doc_id || '). Absence is not confirmed.' || CASE WHEN bad > 0 THEN ' Note: ' || bad || CASE WHEN bad = 1 THEN ' page' ELSE ' pages' END || ' had no selectable text and could not be searched.' ELSE '' END END AS message FROM c""")
def not_found_message(spark: SparkSession, d: str) -> DataFrame:
    rows = A.coverage(*reads(spark, d))
    return rows.select("doc_id", A.not_found(F.concat(F.lit("doc"), "doc_id"), F.col("chunks_read"), F.col("chunks_total"), F.col("complete"), F.col("unreadable_pages")).alias("message"))


@query("""SELECT conv_id, 'AI composition was temporarily unavailable. Showing the verified evidence collected from the document:' || chr(10) || chr(10) || CASE WHEN count(*) = 1 THEN
  any_value('According to ' || role || CASE WHEN turn > 0 THEN ' (page ' || turn || ')' ELSE '' END || ':' || chr(10) || '"' || text || '" [Q' || turn || ']')
  ELSE 'The following verified passages directly address this question:' || chr(10) || chr(10) || string_agg('• [Q' || turn || '] (' || role || CASE WHEN turn > 0 THEN ' (page ' || turn || ')' ELSE '' END || '):' || chr(10) || '"' || text || '"', chr(10) || chr(10) ORDER BY turn) END AS answer FROM conversations GROUP BY conv_id""")
def evidence_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("Q"), "turn").alias("ref"), F.col("role").alias("name"), "text", F.col("turn").alias("page"))
    return A.evidence_answer(rows, "conv_id")


@query("""SELECT conv_id, turn, ref, ref IN ('Q1', 'Q2') AS verified FROM (SELECT conv_id, turn, unnest(['Q' || turn, 'Q1', 'Q9']) AS ref FROM conversations)""")
def cited_refs(spark: SparkSession, d: str) -> DataFrame:
    """References in one and in several to a bracket, held to the verified quotes."""
    m = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" [Q"), "turn", F.lit("] [Q1, Q9] [x]")).alias("text")).withColumn("message_id", F.concat_ws("-", "conv_id", "turn"))
    known = m.select("message_id", F.explode(F.array(F.lit("Q1"), F.lit("Q2"))).alias("ref"), F.lit(True).alias("verified"))
    return relations.cited(m, known).join(m.select("message_id", "conv_id", "turn"), "message_id").select("conv_id", "turn", "ref", "verified")


@query("""SELECT conv_id, turn, n::INT AS n, CASE WHEN n BETWEEN 1 AND 2 THEN 'c' || n END AS citation FROM (SELECT conv_id, turn, unnest(list_distinct([turn, 2, 5])) AS n FROM conversations)""")
def numeric_cites(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "turn", F.lit("] [2] and [5], [x]")).alias("text"), F.array(F.lit("c1"), F.lit("c2")).alias("citations")).withColumn("message_id", F.concat_ws("-", "conv_id", "turn"))
    return relations.numeric_cites(m).join(m.select("message_id", "conv_id", "turn"), "message_id").select("conv_id", "turn", "n", "citation")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, 'demo' FROM nation WHERE n_nationkey % 4 = 0")
def live_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return relations.live_or_fallback(n.where("n_nationkey % 4 <> 0"), n.withColumn("n_name", F.lit("demo")), ["n_nationkey"])


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey IN (7, 32, 33)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderkey").isin(7, 32, 33)).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT doc_id, sha256(text) AS sha256, lang, source FROM documents")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "lang", "source")


@query("""SELECT conv_id, turn, '"' || replace(role, '"', '""') || '",' || turn || ',' || round(conv_id % 100)::INT || '%,"' || replace(left(text, 500), '"', '""') || '"' AS row FROM conversations""")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", sinks.csv_row(F.col("role"), F.col("turn"), F.col("conv_id") % 100 / 100, F.col("text")).alias("row"))


@query("""SELECT conv_id, string_agg(n || '.' || chr(10) || 'Source: ' || role || ', Page ' || turn || chr(10) || 'Query: q' || turn || chr(10) || text || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Note: even' ELSE '' END, chr(10) ORDER BY turn) AS memo
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def memo_export(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("q"), "turn").alias("query"), F.col("role").alias("document_name"), F.col("turn").alias("page"), "text", F.when(F.col("turn") % 2 == 0, "even").otherwise("").alias("note"))
    return sinks.memo(rows, "conv_id")


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, json_keys(props)[1] AS first_key FROM events""")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties parsed from JSON as a map."""
    m = F.from_json("props", "map<string,string>")
    key = F.get(F.map_keys(m), F.lit(0))
    return table(spark, d, "events").select("event_id", F.element_at(m, key).alias("first_value"), key.alias("first_key"))


@query("SELECT conv_id, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, 'rest' || conv_id AS rest FROM conversations GROUP BY conv_id")
def ndjson_events(spark: SparkSession, d: str) -> DataFrame:
    """Turns written one event to a line, with a broken line and an unfinished one, and read again."""
    rows = table(spark, d, "conversations")
    line = sinks.event_line(F.lit("token").alias("type"), F.col("text").alias("text"))
    buffers = rows.groupBy("conv_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list(line)), ""), F.lit('{"type": broken\n'), F.lit("rest"), "conv_id").alias("buffer"))
    events = files.parsed_events(buffers, "conv_id", schemas.ANSWER_EVENT)
    counts = events.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("event.text")).cast("long").alias("chars"))
    return counts.join(buffers.select("conv_id", files.rest_of(F.col("buffer")).alias("rest")), "conv_id")


@query("SELECT user_id, max(value) FILTER (event_type = 'click')::DOUBLE AS click, max(value) FILTER (event_type = 'view')::DOUBLE AS view FROM events GROUP BY user_id")
def by_type_map(spark: SparkSession, d: str) -> DataFrame:
    rows = relations.by_type(table(spark, d, "events"), "user_id", "event_type", "value")
    get = lambda k: F.try_element_at("by_type", F.lit(k))
    return rows.select("user_id", get("click").alias("click"), get("view").alias("view"))


@query("""SELECT o_custkey, bool_or(o_orderstatus NOT IN ('F')) AS any,
  coalesce(string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) FILTER (o_orderstatus NOT IN ('F')), '') AS text FROM orders GROUP BY o_custkey""")
def unfinished_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "READY").otherwise(F.col("o_orderstatus")).alias("status")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("document_id"), status, F.col("o_orderpriority").alias("stage"))
    return A.unfinished(rows, "o_custkey")


@query("SELECT bool_and(n_nationkey <> 3) FILTER (n_name <> (SELECT n_name FROM nation WHERE n_nationkey = 3)) AS healthy FROM nation")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    skip = [r[0] for r in n.where("n_nationkey = 3").select("n_name").limit(1).collect()]
    return A.healthy(n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") != 3).alias("ok")), skip[0] if skip else "")


@query("""SELECT c_custkey, '***' || right(c_name, 4) AS shown, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'new' END AS stored FROM customer""")
def masked_secret(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    given = F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, "").otherwise(T.masked(F.col("c_name")))).otherwise("new")
    return c.select("c_custkey", T.masked(F.col("c_name")).alias("shown"), T.kept_secret(given, F.col("c_name")).alias("stored"))


@query("""SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago FROM (SELECT event_id, floor(epoch(TIMESTAMP '2024-02-02 00:00:00' - ts) / 60)::BIGINT AS m FROM events)""")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", T.relative_time(F.col("ts").cast("timestamp"), F.expr("timestamp'2024-02-02 00:00:00'")).alias("ago"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'EMPTY_FILE' WHEN doc_id % 6 = 1 THEN 'EXECUTABLE' WHEN doc_id % 6 = 2 THEN 'UNSUPPORTED_TYPE' WHEN doc_id % 6 = 3 THEN 'INVALID_DOCX'
  WHEN doc_id % 6 = 4 THEN 'CORRUPT_PDF' END AS error FROM documents""")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    """Texts as uploads of several kinds, most of them not what they claim."""
    k = F.col("doc_id") % 6
    made = F.when(k == 0, "").when(k == 1, F.concat(F.lit("MZ"), "text")).when(k == 4, F.concat(F.lit("%PDF-1.4"), "text")).when(k == 5, F.concat(F.lit("%PDF-1.4" + " " * 60), "text", F.lit("%%EOF"))).otherwise(F.col("text"))
    name = F.when(k == 2, "a.exe").when(k == 3, "a.docx").otherwise("a.pdf")
    return table(spark, d, "documents").select("doc_id", ingest.upload_error(name, made.cast("binary")).alias("error"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' WHEN doc_id % 7 = 0 THEN 'FAILED' WHEN doc_id % 3 = 0 THEN 'EXTRACTING' ELSE 'READY' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'EMPTY_FILE' WHEN doc_id % 7 = 0 THEN 'SCANNED_PDF' END AS error_code FROM documents")
def document_status(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(i % 5 == 0, "EMPTY_FILE").alias("upload_error"), (i % 7 == 0).alias("scanned"), F.when(i % 3 != 0, F.col("n_chars")).alias("char_count"))
    return ingest.status_of(rows).select("doc_id", "status", "error_code")


@query("SELECT doc_id, substr(hex(encode(text)), 201, 200) AS part FROM documents WHERE strlen(text) > 100")
def blob_range(spark: SparkSession, d: str) -> DataFrame:
    """Bytes 100 to 199 of the texts that have them, whatever characters they fall into."""
    part = files.byte_range(F.col("text").cast("binary"), F.lit(100), F.lit(199))
    return table(spark, d, "documents").select("doc_id", F.hex(part).alias("part")).where("part is not null")


@query("SELECT o_orderpriority AS label, count(*)::BIGINT AS proposed, count(*) FILTER (o_orderstatus <> 'F')::BIGINT AS dropped FROM orders GROUP BY ALL")
def edit_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") == "F").alias("verified"))
    return redline.edit_counts(rows, "label")


@query("SELECT event_type, count(*)::BIGINT AS n, count(*) / max(count(*)) OVER () AS share FROM events GROUP BY event_type")
def chart_scale(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return A.shares_of_greatest(counts, "event_type")


@query("SELECT DISTINCT matter FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN ' ' ELSE 'matter ' || o_custkey END AS matter FROM orders) WHERE trim(matter) <> ''")
def distinct_matters(spark: SparkSession, d: str) -> DataFrame:
    matter = F.when(F.col("o_custkey") % 3 == 1, " ").when(F.col("o_custkey") % 3 == 2, F.concat(F.lit("matter "), "o_custkey"))
    return A.filled_values(table(spark, d, "orders").select(matter.alias("matter")), "matter")


@query("SELECT c_custkey FROM customer WHERE lower(c_name) = lower(CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name || '.' END)")
def equal_any_case(spark: SparkSession, d: str) -> DataFrame:
    """Names held to themselves in capitals, or with one more character that a pattern would let pass."""
    asked = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat("c_name", F.lit(".")))
    return table(spark, d, "customer").where(A.same_any_case(F.col("c_name"), asked)).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def bookmarks_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return A.owned_by_id(table(spark, d, "orders"), ids, "o_custkey", F.col("o_orderstatus") == "F").select("o_orderkey")


@query("""SELECT pair_id, order_idx, significance, category FROM (SELECT o_custkey AS pair_id, o_orderkey AS order_idx, 'payment' AS category, CASE o_orderstatus WHEN 'F' THEN 'MODIFIED' ELSE 'ADDED' END AS type,
  ['HIGH', 'MEDIUM', 'LOW', 'COSMETIC'][o_orderkey % 4 + 1] AS significance FROM orders) WHERE type = 'MODIFIED' AND significance <> 'LOW'
ORDER BY list_position(['HIGH', 'MEDIUM', 'COSMETIC'], significance), pair_id, order_idx LIMIT 50""")
def changes_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """The first page of changes, from the most significant on."""
    levels = F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW", "COSMETIC")))
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("order_idx"), F.lit("payment").alias("category"), F.when(F.col("o_orderstatus") == "F", "MODIFIED").otherwise("ADDED").alias("type"),
        F.element_at(levels, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("significance"),
    )
    return changes.filtered(rows, ["high", "medium ", "cosmetic"], ["modified"], ["Payment"]).limit(50).select("pair_id", "order_idx", "significance", "category")


READS_SQL = "reads AS (SELECT o_custkey, o_orderkey, 'order ' || o_orderkey AS name, o_orderkey % 3 AS read, o_orderkey % 3 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_orderkey % 2 END AS total FROM orders)"


def partly_read(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of which some sections were read."""
    read = F.col("o_orderkey") % 3
    total = read + F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(F.col("o_orderkey") % 2)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("order "), "o_orderkey").alias("name"), read.alias("read"), total.alias("total"))
    return rows.withColumn("complete", F.col("read") == F.col("total"))


@query(f"""WITH {READS_SQL} SELECT o_orderkey, CASE WHEN read = total THEN 'Complete: all ' || total || CASE total WHEN 1 THEN ' section' ELSE ' sections' END || ' read'
  ELSE 'Partial: ' || read || ' of ' || total || CASE total WHEN 1 THEN ' section' ELSE ' sections' END || ' read' || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '; 1 page had no selectable text' ELSE '; 2 pages had no selectable text' END END AS text FROM reads""")
def coverage_text(spark: SparkSession, d: str) -> DataFrame:
    text = A.coverage_text(F.col("read"), F.col("total"), F.col("complete"), F.col("o_custkey") % 3)
    return partly_read(spark, d).select("o_orderkey", text.alias("text"))


@query(f"""WITH {READS_SQL} SELECT o_custkey, CASE WHEN bool_and(read = total) THEN 'I couldn''t find a passage that answers this in any of the documents ('
    || string_agg(name || ' (' || total || CASE total WHEN 1 THEN ' section)' ELSE ' sections)' END, ', ' ORDER BY o_orderkey) || ' all read).'
  ELSE 'I couldn''t find relevant passages in the sections I could read across the documents (' || string_agg(name || ': ' || read || '/' || total || ' sections read', '; ' ORDER BY o_orderkey) || '). Absence is not confirmed.' END AS message
FROM reads GROUP BY o_custkey""")
def not_found_in_all(spark: SparkSession, d: str) -> DataFrame:
    return A.not_found_in_all(partly_read(spark, d).withColumnRenamed("o_orderkey", "ord"), "o_custkey")


@query("SELECT event_id, least(75, floor(15 + (event_id % 40) / 40 * 60 + 0.5))::INT AS progress, (event_id % 7 + 1) % 7 AS next, (event_id % 7 + 6) % 7 AS previous, replace(lower(event_type || ' Case No ' || event_id), ' ', '-') AS slug, CASE (TIMESTAMP '2024-01-30'::DATE - ts::DATE) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def viewer_values(spark: SparkSession, d: str) -> DataFrame:
    """Progress of a read page, steps in a cycle of occurrences, slugs and day labels."""
    i = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", T.progress(i % 40, F.lit(40)).alias("progress"), T.stepped(i % 7, F.lit(7), 1).alias("next"), T.stepped(i % 7, F.lit(7), -1).alias("previous"),
        T.plain_slug(F.concat("event_type", F.lit(" Case No "), i.cast("string"))).alias("slug"), redline.day_label(F.col("ts"), F.lit("2024-01-30").cast("date")).alias("day"),
    )


@query("""SELECT event_id, (event_id % 100)::INT AS k, 'event ' || event_id AS name, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS kind FROM events""")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects out of replies with code fences, words around them or a list around them."""
    i = F.col("event_id")
    body = F.concat(F.lit('{"k": '), (i % 100).cast("string"), F.lit(', "name": "event '), i.cast("string"), F.lit('"'), F.when(i % 3 == 2, "").otherwise(F.concat(F.lit(', "kind": "'), "event_type", F.lit('"'))), F.lit("}"))
    reply = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```  "))).when(i % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" - done."))).otherwise(F.concat(F.lit(" "), body))
    found = F.from_json(T.outermost_json(T.unfenced(reply)), "k int, name string, kind string")
    return table(spark, d, "events").select("event_id", found.alias("f")).select("event_id", "f.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id % 50 || '-' || (event_id % 50 + 5 + event_id % 3) || CASE WHEN event_id % 4 = 1 THEN ';90-95' ELSE '' END END AS ranges FROM events""")
def range_params(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of a viewer's address, of which one in four is no range."""
    i = F.col("event_id")
    first = F.concat((i % 50).cast("string"), F.lit("-"), (i % 50 + 5 + i % 3).cast("string"))
    param = F.when(i % 4 == 0, first).when(i % 4 == 1, F.concat(first, F.lit(",90-95"))).when(i % 4 == 2, F.concat(F.lit(" "), first, F.lit(" "))).otherwise(F.concat(first, F.lit(",7-7")))
    parsed = verify.parsed_ranges(param)
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(parsed, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ";").alias("ranges"))


@query("""WITH r AS (SELECT c_custkey, (['viewer', 'Paralegal', 'lawyer', 'ADMIN', 'guest'])[(c_custkey % 5 + 1)::INT] AS role FROM customer)
SELECT c_custkey, lower(role) IN ('lawyer', 'admin') AS may FROM r""")
def role_ranks(spark: SparkSession, d: str) -> DataFrame:
    role = F.get(F.array(*map(F.lit, ("viewer", "Paralegal", "lawyer", "ADMIN", "guest"))), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, d, "customer").select("c_custkey", A.role_at_least(role, "lawyer").alias("may"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar')")
def contains_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.containing(table(spark, d, "part"), "p_name", "AR").select("p_partkey", "p_name")


CHANGES_SQL = """ch AS (SELECT l_orderkey AS pair_id, l_linenumber::INT AS order_idx, (['COSMETIC', 'LOW', 'MEDIUM', 'HIGH'])[(l_quantity::INT % 4 + 1)::INT] AS significance FROM lineitem),
re AS (SELECT pair_id, order_idx, (['low', 'HIGH', NULL, 'MEDIUM'])[((pair_id + order_idx) % 4 + 1)::INT] AS s, 'reply ' || order_idx AS t FROM ch WHERE pair_id % 2 = 0)"""


@query(f"""WITH {CHANGES_SQL}, rank AS (SELECT ch.*, s, t, list_position(['COSMETIC', 'LOW', 'MEDIUM', 'HIGH'], significance) AS floor, list_position(['COSMETIC', 'LOW', 'MEDIUM', 'HIGH'], upper(s)) AS said FROM ch LEFT JOIN re USING (pair_id, order_idx))
SELECT pair_id, order_idx, CASE WHEN s IS NULL THEN significance ELSE (['COSMETIC', 'LOW', 'MEDIUM', 'HIGH'])[greatest(said, floor)] END AS significance, coalesce(t, 'title') AS title, CASE WHEN t IS NULL THEN 'DETERMINISTIC' ELSE 'AI' END AS summary_source, (order_idx // 3)::INT AS batch FROM rank""")
def replies_merged(spark: SparkSession, d: str) -> DataFrame:
    """Changes with replies for every other pair: no reply lowers a significance. In batches of three."""
    levels = lambda *v: F.array(*map(F.lit, v))
    q = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("order_idx"), F.get(levels("COSMETIC", "LOW", "MEDIUM", "HIGH"), q % 4).alias("significance"), F.lit("title").alias("title"), F.lit("summary").alias("summary"))
    which = ((F.col("pair_id") + F.col("order_idx")) % 4).cast("int")
    replies = rows.where("pair_id % 2 = 0").select("pair_id", "order_idx", F.get(levels("low", "HIGH", None, "MEDIUM"), which).alias("significance"), *(F.concat(F.lit("reply "), F.col("order_idx").cast("string")).alias(c) for c in ("title", "summary")))
    return changes.batches(changes.with_replies(rows, replies), 3).select("pair_id", "order_idx", "significance", "title", "summary_source", "batch")
