"""The answer of every registered query in SQL, straight from the tables."""

from __future__ import annotations

_LIST = "[l_linenumber::BIGINT, l_quantity::BIGINT, l_suppkey, l_partkey, l_orderkey]"
_LINE_SUMS = f"SELECT l_orderkey, list_sum({_LIST})::BIGINT AS sum FROM lineitem"
_ITEMS = f"""
    SELECT l_orderkey, l_linenumber, (pos - 1)::INTEGER AS pos, numbers[pos]::BIGINT AS item
    FROM (
        SELECT l_orderkey, l_linenumber, numbers, unnest(range(1, len(numbers) + 1)) AS pos
        FROM (SELECT l_orderkey, l_linenumber, {_LIST} AS numbers FROM lineitem)
    )
"""
_SECONDS = "epoch_us(ts)::DOUBLE / 1e6"
_CONTENT = "'Message ' || event_id"
_PARTITION = "(user_id % 8)::INTEGER"
_MESSAGES = f"""
    SELECT event_id AS message_id, {_SECONDS} AS event_time, {_CONTENT} AS content FROM events
"""
_SIGNED = """
    SELECT event_id,
           CASE WHEN event_type = 'error' THEN -epoch_us(ts) ELSE epoch_us(ts) END::BIGINT AS sum
    FROM events
"""
_DENSE = f"""
    SELECT *, {_PARTITION} AS partition,
           row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS "offset"
    FROM events
"""
_DELAYED = f"""
    SELECT event_id, event_type, {_SECONDS} + value / 1000.0::DOUBLE AS received_time,
           ({_SECONDS} + value / 1000.0::DOUBLE) - {_SECONDS} AS latency
    FROM events
"""
_WORDS = "list_transform(string_split(text, ' '), lambda w: length(w))"
_LAG = f"""
    WITH dense AS ({_DENSE}),
    ends AS (SELECT partition, max("offset") + 1 AS "end" FROM dense GROUP BY partition),
    committed AS (
        SELECT event_type AS "group", partition, max("offset") + 1 AS committed
        FROM dense GROUP BY ALL
        UNION ALL
        SELECT 'ahead', partition, "end" + 100 FROM ends
    ),
    lag AS (
        SELECT "group", sum(greatest(0, "end" - committed))::BIGINT AS total_lag
        FROM committed JOIN ends USING (partition) GROUP BY "group"
    )
"""
_MONITOR = f"""
    SELECT {_PARTITION} AS partition, event_id AS "offset",
           CASE WHEN event_type <> 'signup' THEN event_id END AS message_id,
           CASE WHEN event_type <> 'signup' THEN {_SECONDS} END AS event_time,
           CASE WHEN event_type <> 'signup' THEN {_CONTENT} END AS content,
           CASE WHEN event_type <> 'signup' THEN {_SECONDS} + event_id % 10 - {_SECONDS} END AS latency,
           CASE WHEN event_type = 'signup' THEN 'truncated' END AS error
    FROM events
"""
_TAIL = """
    SELECT time_bucket(INTERVAL '5 seconds', l_shipdate) AS window_start,
           count(*)::BIGINT AS n, (count(*) // 5)::BIGINT AS per_sec,
           count(*) / 5.0::DOUBLE AS rate
    FROM lineitem GROUP BY 1
"""
_GENERATED_LISTS = """
    SELECT count(*)::BIGINT AS lists, 0::BIGINT AS unreadable, 2::BIGINT AS shortest,
           5::BIGINT AS longest, 0::BIGINT AS smallest_item, 99::BIGINT AS largest_item
    FROM orders
"""
_GENERATED_MESSAGES = """
    SELECT o_orderkey AS message_id, 1704067200.0::DOUBLE + o_orderkey * 2 AS event_time,
           'Message ' || o_orderkey AS content,
           make_timestamp((1704067200 + o_orderkey * 2) * 1000000) AS timestamp
    FROM orders
"""
_ELAPSED = "(epoch_us(max({ts})) - epoch_us(min({ts})))::DOUBLE / 1e6"
_EVENTS_ELAPSED = _ELAPSED.format(ts="ts")
_LINES_ELAPSED = _ELAPSED.format(ts="l_shipdate")

ORACLES: dict[str, str] = {
    "stream_sum": _LINE_SUMS,
    "stream_sum_sql_engine": _LINE_SUMS,
    "stream_sum_tables": _LINE_SUMS,
    "stream_sum_streaming": _LINE_SUMS,
    "stream_sum_resumed": _LINE_SUMS,
    "stream_sum_by_key": f"""
        SELECT l_orderkey, count(*)::BIGINT AS records, sum(sum)::BIGINT AS sum
        FROM ({_LINE_SUMS}) GROUP BY l_orderkey
    """,
    "stream_sum_documents": f"""
        SELECT doc_id, list_sum({_WORDS})::BIGINT AS sum FROM documents
    """,
    "independent_groups": f"""
        SELECT "group", count(*)::BIGINT AS records, sum(sum)::BIGINT AS total
        FROM ({_LINE_SUMS}), (VALUES ('first'), ('second')) AS g("group") GROUP BY "group"
    """,
    "backlog": f"""
        SELECT count(*)::BIGINT AS total, {_LINES_ELAPSED} AS seconds,
               count(*) / ({_LINES_ELAPSED}) AS per_sec,
               (SELECT sum(sum)::BIGINT FROM ({_LINE_SUMS})) AS sum_of_sums
        FROM lineitem
    """,
    "int_list_items": _ITEMS,
    "int_list_items_sql_engine": _ITEMS,
    "list_sums": f"""
        SELECT doc_id, len({_WORDS})::INTEGER AS items, list_sum({_WORDS})::BIGINT AS sum
        FROM documents
    """,
    "fused_list_sums": f"""
        SELECT l_orderkey, l_linenumber, list_sum({_LIST})::BIGINT AS sum FROM lineitem
    """,
    "sum_codec": _SIGNED,
    "sum_codec_sql_engine": _SIGNED,
    "messages": _MESSAGES,
    "messages_sql_engine": _MESSAGES,
    "document_contents": """
        SELECT doc_id AS message_id, n_chars::BIGINT AS declared_chars,
               length(text)::BIGINT AS chars, md5(text) AS digest
        FROM documents
    """,
    "typed_messages": f"""
        SELECT event_id AS note_id, {_SECONDS} AS sent_at, {_CONTENT} AS body FROM events
    """,
    "typed_lists": f"""
        SELECT l_orderkey, l_linenumber, array_to_string({_LIST}, ',') AS basket FROM lineitem
    """,
    "typed_records": """
        SELECT event_id AS id, event_type AS kind,
               CASE WHEN event_type <> 'view' THEN props END AS note, value AS weight,
               event_type = 'error' AS alert,
               CASE WHEN event_type = 'click' THEN '' ELSE user_id || ',' || -event_id END AS links,
               CASE WHEN event_type <> 'signup' THEN epoch_us(ts) END AS sent
        FROM events
    """,
    "typed_sums": f"SELECT l_orderkey, sum AS total FROM ({_LINE_SUMS})",
    "null_payloads": """
        SELECT event_type, count(*)::BIGINT AS n,
               count(*) FILTER (WHERE event_type = 'error')::BIGINT AS null_values,
               count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS "left"
        FROM events GROUP BY event_type
    """,
    "observed_rows": """
        SELECT count(*)::BIGINT AS n,
               count(*) FILTER (WHERE event_type = 'error')::BIGINT AS null_value
        FROM events
    """,
    "quarantine": f"""
        SELECT 'events' AS topic, {_PARTITION} AS partition, event_id AS "offset",
               'truncated' AS error,
               (CASE WHEN event_id < 64 THEN 1 WHEN event_id < 8192 THEN 2
                     WHEN event_id < 1048576 THEN 3 ELSE 4 END
                + 8 + 1 + length({_CONTENT}) - 1)::INTEGER AS size
        FROM events WHERE event_type = 'signup'
    """,
    "quarantine_rest": f"""
        SELECT {_PARTITION} AS partition, event_id AS "offset", event_id AS message_id,
               {_CONTENT} AS content
        FROM events WHERE event_type <> 'signup'
    """,
    "field_defaults": f"""
        SELECT event_id,
               CASE WHEN event_type = 'view' THEN 0 ELSE event_id END::BIGINT AS message_id,
               CASE WHEN event_type = 'click' THEN 0.0 ELSE {_SECONDS} END::DOUBLE AS event_time,
               CASE WHEN event_type = 'error' THEN 'Unknown' ELSE {_CONTENT} END AS content
        FROM events
    """,
    "field_defaults_received": f"""
        SELECT event_id,
               CASE WHEN event_type <> 'view' THEN event_id END AS message_id,
               {_SECONDS} + CASE WHEN event_type = 'click' THEN 2.0 ELSE 0.0 END::DOUBLE
                   AS event_time,
               CASE WHEN event_type <> 'error' THEN {_CONTENT} END AS content
        FROM events
    """,
    "latency": f"SELECT event_id, received_time, latency FROM ({_DELAYED})",
    "latency_by_type": f"""
        SELECT event_type, count(*)::BIGINT AS n,
               sum(round(latency * 1e6)::BIGINT)::BIGINT AS total_micros, max(latency) AS worst
        FROM ({_DELAYED}) GROUP BY event_type
    """,
    "report_lines": """
        SELECT event_id,
               printf('New message: [ID=%d] Message %d at %.3f', event_id, event_id, sent) AS line,
               printf('Latency: %.3f seconds', floor(value)) AS latency_line
        FROM (SELECT event_id, value, (epoch_us(ts) // 1000)::DOUBLE / 1000.0 AS sent FROM events)
    """,
    "report_lines_rounded": """
        SELECT event_id,
               'New message: [ID=' || event_id || '] Message ' || event_id || ' at '
                   || regexp_replace(printf('%.3f', sent), '0{1,2}$', '') AS line,
               'Latency: ' || floor(value)::BIGINT || '.0 seconds' AS latency_line
        FROM (SELECT event_id, value, (epoch_us(ts) // 1000)::DOUBLE / 1000.0 AS sent FROM events)
    """,
    "throughput_5s": """
        SELECT time_bucket(INTERVAL '5 seconds', ts) AS window_start, count(*)::BIGINT AS n,
               (count(*) // 5)::BIGINT AS per_sec, count(*) / 5.0::DOUBLE AS rate
        FROM events GROUP BY 1
    """,
    "throughput_by_worker": f"""
        SELECT {_PARTITION} AS partition, count(*)::BIGINT AS n, {_EVENTS_ELAPSED} AS seconds,
               floor(count(*) / ({_EVENTS_ELAPSED}))::BIGINT AS per_sec
        FROM events GROUP BY 1
        HAVING count(*) >= 100 AND {_EVENTS_ELAPSED} >= 5
    """,
    "throughput_by_worker_daily": f"""
        WITH RECURSIVE days AS (
            SELECT {_PARTITION} AS partition, date_trunc('day', ts)::TIMESTAMP AS day,
                   count(*) AS n, epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high,
                   row_number() OVER (PARTITION BY {_PARTITION}
                                      ORDER BY min(ts)) AS place
            FROM events GROUP BY 1, 2
        ), run AS (
            SELECT *, n >= 2 AND high - low >= 5000000 AS done FROM days WHERE place = 1
            UNION ALL
            SELECT *, n >= 2 AND high - low >= 5000000 AS done FROM (
                SELECT d.partition, CASE WHEN r.done THEN d.day ELSE r.day END AS day,
                       CASE WHEN r.done THEN d.n ELSE r.n + d.n END AS n,
                       CASE WHEN r.done THEN d.low ELSE r.low END AS low, d.high, d.place
                FROM run r JOIN days d ON d.partition = r.partition AND d.place = r.place + 1
            )
        )
        SELECT partition, day AS window_start, n::BIGINT AS n,
               (high - low)::DOUBLE / 1e6 AS seconds,
               floor(n / ((high - low)::DOUBLE / 1e6))::BIGINT AS per_sec
        FROM run WHERE done
    """,
    "throughput_every_100_by_gaps": f"""
        SELECT partition, ("offset" // 100)::BIGINT AS report, count(*)::BIGINT AS n,
               max(event_id)::BIGINT AS last_offset, {_EVENTS_ELAPSED} AS seconds
        FROM ({_DENSE}) GROUP BY 1, 2 HAVING count(*) = 100
    """,
    "throughput_every_100": f"""
        SELECT partition, ("offset" // 100)::BIGINT AS report, count(*)::BIGINT AS n,
               max("offset")::BIGINT AS last_offset, {_EVENTS_ELAPSED} AS seconds
        FROM ({_DENSE}) GROUP BY 1, 2 HAVING count(*) = 100
    """,
    "hourly_progress": """
        WITH hours AS (
            SELECT date_trunc('hour', ts)::TIMESTAMP AS tick, count(*) AS n
            FROM events GROUP BY 1
        )
        SELECT tick, (sum(n) OVER (ORDER BY tick))::BIGINT AS done,
               ((sum(n) OVER (ORDER BY tick))::BIGINT * 100
                   // (SELECT count(*) FROM events))::BIGINT AS pct
        FROM hours
    """,
    "one_run": f"""
        SELECT count(*)::BIGINT AS total, {_EVENTS_ELAPSED} AS seconds,
               count(*) / ({_EVENTS_ELAPSED}) AS per_sec
        FROM events
    """,
    "row_counts": f"""
        SELECT 'events' AS topic, {_PARTITION} AS partition, count(*)::BIGINT AS n,
               0::BIGINT AS null_values
        FROM events GROUP BY 2
    """,
    "lag": f'{_LAG} SELECT "group", total_lag, true AS found FROM lag',
    "lag_unknown_group": f"""
        {_LAG}
        SELECT g."group", total_lag, total_lag IS NOT NULL AS found,
               CASE WHEN total_lag IS NOT NULL
                    THEN 'Group: ' || g."group" || ' | Total Lag: ' || total_lag || ' messages'
                    ELSE 'Group ''' || g."group" || ''' not found or has no offsets...'
               END AS line
        FROM (SELECT DISTINCT "group" FROM committed UNION SELECT n_name FROM nation) AS g
        LEFT JOIN lag ON lag."group" = g."group"
    """,
    "lag_of_running_job": """
        SELECT 'monitor' AS "group", count(*)::BIGINT AS total_lag, true AS found
        FROM events WHERE event_type = 'click'
    """,
    "lag_monitor_look": """
        WITH lag AS (SELECT count(*)::BIGINT AS n FROM events WHERE event_type = 'click')
        SELECT 'monitor' AS "group", n AS total_lag, true AS found,
               'Group: monitor | Total Lag: ' || n || ' messages' AS line
        FROM lag
        UNION ALL
        SELECT r_name, NULL, false,
               'Group ' || chr(39) || r_name || chr(39) || ' not found or has no offsets...'
        FROM region
    """,
    "backlog_progress": """
        SELECT count(*)::BIGINT AS done, 100::BIGINT AS pct, 0::BIGINT AS steps_back,
               count(*)::BIGINT AS read
        FROM lineitem
    """,
    "dense_offsets": f'SELECT partition, "offset", event_id FROM ({_DENSE})',
    "key_layout": """
        SELECT count(*)::BIGINT AS records, count(DISTINCT user_id)::BIGINT AS keys,
               0::BIGINT AS split_keys, 0::BIGINT AS stray_keys
        FROM events
    """,
    "bounded_read": f"""
        SELECT partition, "offset", event_id AS message_id FROM ({_DENSE})
        WHERE (partition = 0 AND "offset" >= 10)
           OR (partition = 3 AND "offset" >= 20 AND "offset" < 90)
           OR (partition = 5 AND "offset" < 70)
    """,
    "first_5000": f"""
        SELECT {_PARTITION} AS partition, event_id AS "offset", event_id AS message_id
        FROM events ORDER BY 1, 2 LIMIT 5000
    """,
    "first_5000_streaming": """
        SELECT 0::INTEGER AS partition, event_id AS "offset", event_id AS message_id
        FROM events ORDER BY 2 LIMIT 5000
    """,
    "latest_start": f"SELECT event_id AS message_id, {_CONTENT} AS content FROM events",
    "repeated_delivery": f"""
        SELECT {_PARTITION} AS partition, event_id AS "offset", event_id AS message_id,
               {_CONTENT} AS content
        FROM events
    """,
    "interop_union": f"""
        SELECT topic, count(*)::BIGINT AS n, 0::BIGINT AS unreadable,
               min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id,
               sum(length(content))::BIGINT AS chars
        FROM (
            SELECT 'events' AS topic, event_id AS id, {_CONTENT} AS content FROM events
            UNION ALL SELECT 'orders', o_orderkey, 'Message ' || o_orderkey FROM orders
            UNION ALL SELECT 'documents', doc_id, text FROM documents
        ) GROUP BY topic
    """,
    "generated_lists": _GENERATED_LISTS,
    "generated_lists_streaming": _GENERATED_LISTS,
    "generated_messages": _GENERATED_MESSAGES,
    "message_feed_streaming": _GENERATED_MESSAGES,
    "message_monitor": _MONITOR,
    "message_monitor_streaming": _MONITOR,
    "result_tail": _TAIL,
    "result_tail_streaming": _TAIL,
}
