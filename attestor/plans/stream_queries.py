"""Queries that run as streams, over keyed tables and over files, all of which are made from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..operators import ingest
from ..sources import document_source, sinks
from ..sources.tables import KeyedTable
from ..streaming import citations, events, jobs

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream gives for what is there now, written below path."""
    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows", format="parquet").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@query("SELECT event_id, ts AS created_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def ttl_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events that are kept and have not ended, from the changes that a stream of events gives."""
    made = run_to_end(events.retention_changes(events.event_stream(spark, f"{d}/events.parquet*"), 10), folder(spark, "ttl"))
    left = made.groupBy("event_id", "created_at").agg(F.sum(F.when(F.col("change") == "kept", 1).otherwise(-1)).alias("n")).where("n > 0")
    return left.select("event_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("""WITH m AS (SELECT conv_id * 1000 + turn AS message_id, translate(coalesce(text, ''), '[]', '()') AS t FROM conversations),
p AS (SELECT message_id, left(t, (length(t) // 2)::INT) AS a, substr(t, (length(t) // 2)::INT + 1) || ' [Q1] [Q9] x ' AS b FROM m)
SELECT message_id, CASE WHEN message_id % 7 = 0 OR message_id % 5 = 0 THEN 'STOPPED' ELSE 'COMPLETE' END AS status,
  md5(CASE WHEN message_id % 7 = 0 THEN a ELSE a || replace(b, '[Q9]', '') END) AS content FROM p""")
def stopped_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as streamed answers in two tokens. Some are stopped by hand before the second, some never get their last token and stop with time."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.translate(F.coalesce("text", F.lit("")), "[]", "()").alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    second = F.concat(F.substring(F.col("t"), half + 1, F.length("t")), F.lit(" [Q1] [Q9] x [Q"))
    token = lambda n, text, last, stop: F.struct(F.lit(n).cast("long").alias("seq"), text.alias("token"), last.alias("last"), stop.alias("stop"))
    no = F.lit(False)
    tokens = F.array(token(0, F.left("t", half), no, no), token(1, second, F.col("message_id") % 5 != 0, F.col("message_id") % 7 == 0))
    start = F.expr("timestamp '2024-01-01 00:00:00'")
    made = rows.select("message_id", F.explode(tokens).alias("k")).select("message_id", "k.*", (start + F.make_dt_interval(secs=F.col("k.seq"))).alias("at"))
    # A later message moves the time on.
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("message_id"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("token"), F.lit(True).alias("last"), no.alias("stop"), (start + F.make_dt_interval(F.lit(1))).alias("at"))
    path = folder(spark, "answers")
    whole = made.unionByName(clock).withColumn("verified", F.array(F.lit("Q1")))
    whole.write.parquet(f"{path}/tokens")
    done = run_to_end(citations.messages(spark.readStream.schema(whole.schema).parquet(f"{path}/tokens")), path)
    return done.where("content is not null and message_id >= 0").select("message_id", "status", F.md5("content").alias("content"))


@query("""WITH c AS (SELECT user_id, event_id, ts, event_type IN ('purchase', 'error') AS done FROM events),
s AS (SELECT *, lag(done) OVER (PARTITION BY user_id ORDER BY date_trunc('milliseconds', ts), NOT done, event_id) AS before FROM c)
SELECT user_id::VARCHAR AS job_id, date_trunc('milliseconds', ts) AS at, 'run' AS action, 1 AS attempt FROM s WHERE NOT done AND coalesce(before, true)""")
def job_orders(spark: SparkSession, d: str) -> DataFrame:
    """Events as commands: purchases and errors end a user's job, all others submit it. A job in flight is not handed out again."""
    path = folder(spark, "jobs")
    done = F.col("event_type").isin("purchase", "error")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("job_id"), F.when(done, "done").otherwise("submit").alias("command"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("payload"))
    rows.write.parquet(f"{path}/commands")
    made = jobs.orders(spark.readStream.schema(jobs.COMMANDS).parquet(f"{path}/commands"), lanes=16, slots=1 << 30, lease_seconds=10**9)
    return run_to_end(made, path).select("job_id", F.col("at").cast("timestamp_ntz").alias("at"), "action", "attempt")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_totalprice < 50000 AND o_orderkey % 7 <> 0)
UNION ALL SELECT -1 - o_orderkey, 'N' FROM orders WHERE o_orderkey % 11 = 0""")
def keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a keyed table: some merged, some added, then the cheap ones deleted by a condition."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    table = KeyedTable(spark, folder(spark, "orders"), ("o_orderkey",), 16)
    table.create(rows)
    many = F.lit(1e9)
    changed = rows.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), many.alias("o_totalprice"))
    table.merge(changed.unionByName(rows.where("o_orderkey % 11 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), many.alias("o_totalprice"))))
    table.delete(F.col("o_totalprice") < 50000)
    return table.read().select("o_orderkey", "o_orderstatus")


@query(r"""WITH p AS (SELECT doc_id // 20 AS file, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', '', 'g')) AS seen FROM documents),
f AS (SELECT file, count(*) AS pages, sum(n) + 2 * (count(*) - 1) AS chars, sum(seen) < 50 OR (count(*) >= 3 AND bool_and(seen < 5)) AS scanned FROM p GROUP BY file)
SELECT file::BIGINT AS file, CASE WHEN scanned THEN 'FAILED' ELSE 'READY' END AS status, CASE WHEN NOT scanned THEN pages END::INT AS page_count, CASE WHEN NOT scanned THEN chars END::BIGINT AS char_count,
  CASE WHEN NOT scanned THEN ceil(chars / 4) END::BIGINT AS token_estimate, CASE WHEN scanned THEN 'NO_TEXT_LAYER' END AS error_code FROM f""")
def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Twenty texts each as the pages of one file of page items, read back and ingested."""
    path = folder(spark, "files")
    zero = F.lit(0.0)
    item = F.struct(F.coalesce("text", F.lit("")).alias("str"), F.array(F.lit(10.0), zero, zero, F.lit(10.0), F.lit(50.0), F.lit(700.0)).alias("transform"), F.lit(500.0).alias("width"), F.lit(10.0).alias("height"), F.lit(False).alias("has_eol"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.floor(F.col("doc_id") / 20).alias("file"), (F.col("doc_id") % 20 + 1).alias("page_no"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.array(item).alias("items"))
    rows.repartition("file").write.partitionBy("file").json(path)
    documents, _ = ingest.ingested(document_source.read_documents(spark, path))
    return documents.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), "status", "page_count", "char_count", F.col("token_estimate").cast("long").alias("token_estimate"), "error_code")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a log by day as a stream, counted from the log."""
    path = folder(spark, "log")
    events.append_log(events.event_stream(spark, f"{d}/events.parquet*"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines by a stream and read back."""
    path = folder(spark, "lines")
    stream = events.event_stream(spark, f"{d}/events.parquet*").select("event_id", "user_id", "event_type", "value")
    events.event_lines(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).json(f"{path}/rows")


@query("SELECT o_orderstatus, count(*)::BIGINT * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS n, sum(o_orderkey)::BIGINT * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 2 END AS keys FROM orders GROUP BY o_orderstatus")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status: all appended twice, then the finished ones replaced by themselves with other keys."""
    path = folder(spark, "partitions")
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    sinks.append(rows, path, ["o_orderstatus"])
    sinks.append(rows, path, ["o_orderstatus"])
    sinks.replace_partitions(rows.where("o_orderstatus = 'F'").withColumn("o_orderkey", -F.col("o_orderkey")), path, ["o_orderstatus"])
    return spark.read.schema(rows.schema).parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
