"""Common table expressions of the check SQL: the views of ``plans.views`` in plain SQL."""

UUID = "'00000000-0000-4000-{}-' || lpad(CAST({} AS VARCHAR), 12, '0')"

EV = f"""ev AS (
  SELECT event_id AS n, user_id, {UUID.format('8000', 'event_id')} AS event_id,
         ts + to_seconds(event_id % 5) AS received_at, ts AS event_time,
         'svc-' || (user_id % 8) AS source, event_type AS level,
         event_type || ' ' || event_id AS message,
         CASE event_type
           WHEN 'signup' THEN '{{"email": "user' || user_id || '@example.com", "plan": "basic", "user": ' || user_id || '}}'
           WHEN 'purchase' THEN '{{"amount": ' || event_id || ', "credit_card": "4000-' || event_id || '"}}'
           WHEN 'error' THEN '{{"detail": {{"email": "a@example.com"}}, "user": ' || user_id || '}}'
           WHEN 'view' THEN '[' || event_id || ', {{"email": "b@example.com"}}]'
           ELSE props END AS metadata,
         CASE event_type
           WHEN 'signup' THEN '{{"email":"[REDACTED]","plan":"basic","user":' || user_id || '}}'
           WHEN 'purchase' THEN '{{"amount":' || event_id || ',"credit_card":"[REDACTED]"}}' END AS cleaned
  FROM events)"""

# Metadata as JSON without blanks, which is how it leaves a decode.
COMPACT = "replace(metadata, ' ', '')"
REDACTED = f"coalesce(cleaned, {COMPACT})"

TEXTS = f"""texts AS (
  SELECT {UUID.format('8001', 'doc_id')} AS event_id, source, lang AS level, text AS message FROM documents
  UNION ALL
  SELECT {UUID.format('8002', 'conv_id * 1000 + turn')}, 'chat', role, text FROM conversations
  UNION ALL
  SELECT {UUID.format('8003', 'page_id')}, url, '', html FROM pages)"""

# What decoding the raw lines must give, line by line.
DECODED = f"""decoded AS (
  SELECT CASE WHEN status = 'ok' AND c <> 7 THEN event_id WHEN status = 'ok' THEN '' END AS event_id,
         CASE WHEN status <> 'ok' OR c IN (5, 7) THEN NULL
              WHEN c = 9 THEN event_time - INTERVAL 2 HOUR ELSE event_time END AS event_time,
         CASE WHEN status = 'ok' THEN CASE WHEN c = 7 THEN '' ELSE source END END AS source,
         CASE WHEN status = 'ok' THEN CASE WHEN c = 7 THEN '' ELSE level END END AS level,
         CASE WHEN status = 'ok' THEN CASE WHEN c = 7 THEN '' ELSE message END END AS message,
         CASE WHEN status = 'ok' AND c <> 7 THEN {COMPACT} END AS metadata,
         CASE WHEN status = 'ok' AND c <> 7 THEN {REDACTED} END AS redacted,
         status = 'ok' AND c <> 7 AND cleaned IS NOT NULL AS hit,
         status AS parse_status
  FROM (SELECT *, n % 50 AS c,
               CASE WHEN n % 50 IN (0, 1, 4, 8, 10, 12) THEN 'error_parse' ELSE 'ok' END AS status
        FROM ev WHERE n % 50 <> 2)
  UNION ALL
  SELECT event_id, NULL, source, level, message, NULL, NULL, FALSE, 'ok' FROM texts)"""

VERSIONS = """base AS (
  SELECT *, CAST(floor((day(event_time) - 1) / 8) AS BIGINT) AS batch_id,
         epoch_us(event_time) // 1000 AS ms, n AS seq FROM ev),
versions AS (
  SELECT * FROM base
  UNION ALL
  SELECT * REPLACE (message || ' again' AS message, 4 AS batch_id) FROM base WHERE level = 'signup'
  UNION ALL
  SELECT * REPLACE ('00000000-0000-4000-8000-ffffffffffff' AS event_id) FROM base
  WHERE level IN ('click', 'view'))"""

KEYS = """api_keys AS (
  SELECT 'key-' || c_custkey AS key, c_acctbal >= 0 AS is_active,
         CASE WHEN c_custkey % 3 <> 0
              THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 60 AS INTEGER)) END AS expires_at
  FROM customer),
valid_keys AS (
  SELECT key FROM api_keys
  WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01'))"""

# Body limit of the request queries, in bytes: the default one.
BODY_LIMIT = 1_048_576

# Requests with the sizes and kinds of their body's parts instead of the body.
REQUESTS = f"""requests AS (
  SELECT n AS request_id, received_at,
         CASE WHEN n % 25 = 0 THEN 'GET' ELSE 'POST' END AS method, '/ingest' AS path,
         CASE WHEN n % 20 = 1 THEN '' ELSE 'key-' || user_id END AS api_key,
         CASE WHEN n % 10 <= 5 THEN 'json' WHEN n % 10 <= 8 THEN 'ndjson' ELSE 'error_media_type' END AS media,
         n % 7 = 0 AS bad, n * 37 % 1000 AS duration_ms,
         26 + strlen(message) + strlen(metadata) AS g,
         26 + strlen(message) * (n % 20 + 1) + strlen(metadata) AS d,
         12 + strlen(CAST(n AS VARCHAR)) AS b
  FROM ev),
sized AS (
  SELECT *, CASE WHEN media <> 'json' THEN 3 * g + b + 5 WHEN bad THEN b ELSE d END AS bytes,
         EXISTS (SELECT 1 FROM valid_keys WHERE key = api_key AND api_key <> '') AS authenticated
  FROM requests),
outcomes AS (
  SELECT *, CASE WHEN method <> 'POST' THEN 'method_not_allowed' WHEN NOT authenticated THEN 'unauthorized'
                 WHEN media = 'error_media_type' THEN 'error_media_type' WHEN bytes > {BODY_LIMIT} THEN 'error_size'
                 WHEN media = 'json' AND bad THEN 'error_parse' ELSE 'accepted' END AS label
  FROM sized),
answered AS (
  SELECT *, CASE label WHEN 'method_not_allowed' THEN 405 WHEN 'unauthorized' THEN 401
                       WHEN 'error_media_type' THEN 415 WHEN 'error_size' THEN 413
                       WHEN 'error_parse' THEN 400 ELSE 202 END AS status
  FROM outcomes)"""

QUEUE = """log_buffer AS (
  SELECT event_id AS id, received_at, event_time, source, level, message, metadata,
         CASE n % 3 WHEN 1 THEN 'g1' WHEN 2 THEN 'g2' END AS consumer_group,
         level = 'click' AS acknowledged
  FROM ev),
log_dlq AS (
  SELECT event_id AS id, TIMESTAMP '2024-01-31' AS failed_at, 'earlier' AS reason,
         event_time, source, level, message, metadata
  FROM ev WHERE level = 'signup' OR (level = 'error' AND day(event_time) <= 10))"""

# Two streams and two groups; ids repeat between them. ``mine`` is the group the operations name.
DELIVERIES = """deliveries AS (
  SELECT 'log_events' AS stream, 'log-processors' AS grp, 'c' || (user_id % 4) AS consumer,
         epoch_us(event_time) // 1000 AS ms, n AS seq, event_time AS delivered_at, n % 3 + 1 AS delivery_count,
         CASE WHEN level <> 'error' THEN event_time END AS acked_at, n, event_id, message
  FROM ev
  UNION ALL
  SELECT 'log_events', 'auditors', 'c' || (user_id % 3), epoch_us(event_time) // 1000, n, event_time, 1,
         CASE WHEN level <> 'view' THEN event_time END, n, event_id, message
  FROM ev WHERE n % 2 = 0
  UNION ALL
  SELECT 'other_events', 'log-processors', 'c' || (user_id % 4), epoch_us(event_time) // 1000, n, event_time, 2,
         CASE WHEN level <> 'error' THEN event_time END, n, event_id, message
  FROM ev WHERE n % 3 = 0),
mine AS (SELECT * FROM deliveries WHERE stream = 'log_events' AND grp = 'log-processors')"""

AS_OF = "TIMESTAMP '2024-02-01'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
