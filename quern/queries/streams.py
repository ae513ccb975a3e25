"""Batch forms of the streaming operators, over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import read
from quern.streaming import changes, conversations, markers, timers


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps below 30 minutes."""
    return changes.sessions(read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_type").alias("type")), "30 minutes").select(
        F.col("path").alias("user_id"), "started", "ended", "events"
    )


def last_event_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and session, ties to the larger id."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    return changes.coalesced(rows, "30 minutes").select(F.col("path").alias("user_id"), "started", F.col("type").alias("event_type"), "events")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"), F.max(k).alias("most"))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def sticky_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation the longest proper prefix of its messages that is a prefix of an earlier conversation too."""
    return conversations.longest_known_prefix(read(spark, sf_dir, "conversations"))


def tool_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's last message asks for: a fresh user turn, or nothing."""
    return conversations.triggers(read(spark, sf_dir, "conversations"))


def first_line_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", conversations.marker(F.col("text"), "(The|De|In)").alias("marker"))


def live_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation, taken as a request at the second of its id, the longest proper prefix of it that a
    conversation of three messages or more upgraded less than 300 seconds before."""
    prefixes = conversations.prefixes(read(spark, sf_dir, "conversations"))
    return timers.live_prefixes(timers.requests_of(prefixes, F.size("keys") >= 2), 300)


def marker_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict after every word of what replies that begin with a marker of some form have said so far."""
    head = (
        F.when(F.col("role") == "user", F.concat(F.lit("\n<<<NEEDS_PRO: "), F.substring("text", 1, 40), F.lit(">>>\nmore")))
        .when(F.col("role") == "assistant", F.concat(F.lit("<<<NEEDS_FLASH"), F.when(F.length("text") > 200, ">>> so").otherwise(": >>> no")))
        .otherwise(F.concat(F.lit("<<<NEEDS"), "text"))
    )
    rows = read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("stream"), F.split(head, "(?<= )").alias("words"))
    pieces = rows.select("stream", F.posexplode("words").alias("seq", "piece"))
    return markers.verdicts(pieces.withColumn("seq", F.col("seq").cast("long"))).groupBy("stream").agg(
        F.max_by("verdict", "seq").alias("verdict"), F.count_if(F.col("verdict") == markers.MORE).alias("waited")
    )


QUERIES = {
    f.__name__: f
    for f in (
        debounce_sessions, last_event_wins, json_props, tumbling_counts, sticky_prefix, tool_triggers, first_line_markers, live_prefixes,
        marker_verdicts,
    )
}  # fmt: skip

_SESSIONS = """
    e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM e)
"""
ORACLE_SQL = {
    "debounce_sessions": f"""
        WITH {_SESSIONS} SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, session
    """,
    "last_event_wins": f"""
        WITH {_SESSIONS} SELECT user_id, min(ts) AS started, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events
        FROM s GROUP BY user_id, session
    """,
    "json_props": """
        SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k, max(k) AS most
        FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
    """,
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sticky_prefix": """
        WITH c AS (SELECT conv_id, turn, role || chr(1) || substr(text, 1, 200) AS m FROM conversations),
        p AS (SELECT conv_id, turn, row_number() OVER w AS n, string_agg(m, chr(2)) OVER w AS prefix
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        k AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS size, min(conv_id) OVER (PARTITION BY prefix) AS first FROM p)
        SELECT conv_id, max(CASE WHEN n < size AND first < conv_id THEN n ELSE 0 END) AS known, max(size) AS messages FROM k GROUP BY conv_id
    """,
    "tool_triggers": """
        SELECT conv_id, CASE WHEN arg_max(role, turn) = 'user' THEN 'user-turn' END AS trigger FROM conversations GROUP BY conv_id
    """,
    "first_line_markers": r"""
        SELECT conv_id, turn, regexp_extract(regexp_replace(text, '^(\s*\n)+', ''), '^(The|De|In)\b', 1) AS marker FROM conversations
    """,
    "live_prefixes": """
        WITH c AS (SELECT conv_id, turn, role || chr(1) || substr(text, 1, 200) AS m FROM conversations),
        p AS (SELECT conv_id, row_number() OVER w AS n, string_agg(m, chr(2)) OVER w AS prefix
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        s AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS size FROM p),
        l AS (SELECT a.conv_id, max(a.n) AS known
              FROM s a JOIN s k ON a.prefix = k.prefix AND a.n < a.size AND k.n = k.size - 1 AND k.n >= 2
                           AND k.conv_id < a.conv_id AND a.conv_id < k.conv_id + 300
              GROUP BY a.conv_id)
        SELECT d.conv_id AS request, coalesce(known, 0)::INTEGER AS known
        FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN l USING (conv_id)
    """,
    "marker_verdicts": r"""
        WITH h AS (
            SELECT conv_id || '/' || turn AS stream,
                   CASE WHEN role = 'user' THEN chr(10) || '<<<NEEDS_PRO: ' || substr(text, 1, 40) || '>>>' || chr(10) || 'more'
                        WHEN role = 'assistant' THEN '<<<NEEDS_FLASH' || CASE WHEN length(text) > 200 THEN '>>> so' ELSE ': >>> no' END
                        ELSE '<<<NEEDS' || text END AS t
            FROM conversations),
        w AS (SELECT stream, t, string_split(t, ' ') AS ws FROM h),
        e AS (
            SELECT stream, generate_subscripts(ws, 1) AS k, array_to_string(ws[1:generate_subscripts(ws, 1)], ' ')
                   || CASE WHEN generate_subscripts(ws, 1) < len(ws) THEN ' ' ELSE '' END AS t FROM w),
        v AS (
            SELECT stream, k, CASE
                WHEN regexp_matches(t, '^[
]*<<<NEEDS_PRO(>>>|:[^>
]*[^>\s][^>
]*>>>)') THEN 'matched-pro'
                WHEN regexp_matches(t, '^[
]*<<<NEEDS_FLASH(>>>|:[^>
]*[^>\s][^>
]*>>>)') THEN 'matched-flash'
                WHEN regexp_matches(t, '^[
]*(<?<?<?|<<<N|<<<NE|<<<NEE|<<<NEED|<<<NEEDS|<<<NEEDS_|<<<NEEDS_P|<<<NEEDS_PR|<<<NEEDS_F|<<<NEEDS_FL|<<<NEEDS_FLA|<<<NEEDS_FLAS|<<<NEEDS_(PRO|FLASH)(>?>?|:[^>
]*>?>?|:[	- ]*>>>))$') THEN 'need-more'
                ELSE 'no-marker' END AS verdict
            FROM e)
        SELECT stream, arg_max(verdict, k) AS verdict, count_if(verdict = 'need-more') AS waited FROM v GROUP BY stream
    """,
}
