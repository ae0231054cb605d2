"""The adapter's mappings stated in SQL, for checks in another engine."""

from __future__ import annotations

from tillspark.sources.adapter import BROKEN, BROKEN_EVERY

ISO_MS = "'%Y-%m-%dT%H:%M:%S.000Z'"

RECEIPTS = f"""receipts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'needs_review'
      ELSE 'queued' END AS status,
    strftime(o_orderdate, {ISO_MS}) AS "capturedAt",
    CASE WHEN o_orderkey % 37 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END
      AS "transactionDate",
    CASE WHEN o_orderkey % 19 <> 0 THEN upper(n_name) END AS "merchantRaw",
    CASE WHEN o_orderkey % 17 <> 0 THEN n_name END AS "merchantNormalized",
    'EUR' AS currency,
    CASE WHEN o_orderkey % 23 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END
      AS "totalMinor",
    CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE c_mktsegment END AS "categoryId",
    sha256(CAST(o_orderkey AS VARCHAR)) AS "imageHash",
    o_orderstatus = 'F' AS "userConfirmed",
    strftime(o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS INTEGER)), {ISO_MS})
      AS "updatedAt",
    'dev-' || (o_custkey % 4) AS "updatedByDevice"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

ITEMS = f"""items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), CAST(round(l_extendedprice * 100) AS BIGINT),
      CAST(l_quantity AS BIGINT)) AS id,
    CAST(l_orderkey AS VARCHAR) AS "receiptId",
    upper(p_name) AS "rawName",
    CASE WHEN l_partkey % 29 = 0 THEN '' ELSE p_name END AS "normalizedName",
    CASE WHEN l_partkey % 43 <> 0 THEN l_quantity END AS quantity,
    CASE WHEN l_partkey % 31 <> 0 THEN
      CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) END AS "unitPriceMinor",
    CAST(round(l_extendedprice * 100) AS BIGINT) AS "totalPriceMinor",
    p_type AS "categoryId",
    l_linenumber - 1 AS position,
    l_returnflag = 'R' AND l_linenumber = 1 AS "userEdited",
    strftime(l_shipdate, {ISO_MS}) AS "updatedAt",
    'dev-' || (l_suppkey % 4) AS "updatedByDevice"
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

INCOMING = """incoming AS (
  SELECT CASE WHEN event_id % 50 = 7 THEN 'settings' WHEN event_id % 3 = 0 THEN 'receipt_items'
      ELSE 'receipts' END AS collection_name,
    CAST(user_id AS VARCHAR) AS document_id,
    event_id + 1 AS server_sequence,
    event_type = 'error' AS is_deleted,
    CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing'
      WHEN 'purchase' THEN 'needs_review' WHEN 'signup' THEN 'confirmed' ELSE 'failed' END
      AS status,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "updatedAt",
    'dev-' || (CAST(json_extract(props, '$.k') AS INTEGER) % 4) AS "updatedByDevice"
  FROM events),
documents_in AS (
  SELECT *, '{"_deleted":' || CAST(is_deleted AS VARCHAR) || ',"id":"' || document_id
    || '","status":"' || status || '","updatedAt":"' || "updatedAt"
    || '","updatedByDevice":"' || "updatedByDevice" || '"}' AS document_json
  FROM incoming),
changes AS (
  SELECT * FROM documents_in WHERE collection_name IN ('receipts', 'receipt_items'))"""

PUSHED = """pushed AS (
  SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS document_id,
    CAST(floor(value) AS BIGINT) % 4 AS value, event_type = 'error' AS is_deleted
  FROM events)"""

ATTEMPTS = """attempts AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS ord, epoch_us(ts) AS at_micros,
    event_type IN ('error', 'click', 'view') AS failed
  FROM events)"""

JOBS = """jobs AS (
  SELECT 'job-' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS receipt_id,
    sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'old-' || o_orderkey
      ELSE CAST(o_orderkey AS VARCHAR) END) AS image_hash,
    'ollama' AS provider_id, 'en-GB' AS locale, 'EUR' AS currency,
    ['pending', 'processing', 'completed', 'failed'][CAST(o_orderkey % 4 + 1 AS INTEGER)]
      AS status,
    CAST(o_orderkey % 7 AS INTEGER) AS attempts,
    CASE WHEN o_orderkey % 6 < 4 THEN
      strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S.000000Z') END
      AS next_attempt_at,
    CASE WHEN o_orderkey % 4 = 3 THEN 'worker_error' END AS last_error_code,
    CASE WHEN o_orderkey % 4 = 3 THEN 'AI extraction failed' END AS last_error_message,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') AS created_at,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') AS updated_at
  FROM orders)"""
SOME_JOBS = JOBS.removesuffix(")") + " WHERE o_orderkey % 3 = 0)"

CLIENT_JOBS = f"""client_jobs AS (
  SELECT 'up-' || o_orderkey AS id,
    CASE o_orderkey % 10 WHEN 4 THEN 'ai-extraction' WHEN 6 THEN 'ai-insight'
      ELSE 'image-upload' END AS type,
    CASE WHEN o_orderkey % 14 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS "receiptId",
    ['pending', 'processing', 'completed', 'failed'][CAST((o_orderkey // 2) % 4 + 1 AS INTEGER)]
      AS status,
    CAST(o_orderkey % 9 AS INTEGER) AS attempts,
    CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, {ISO_MS}) END
      AS "nextAttemptAt",
    CASE WHEN o_orderkey % 6 = 0 THEN '503' END AS "lastErrorCode",
    CASE WHEN o_orderkey % 6 = 0 THEN 'unavailable before' END AS "lastErrorMessage",
    strftime(o_orderdate, {ISO_MS}) AS "createdAt",
    strftime(o_orderdate, {ISO_MS}) AS "updatedAt"
  FROM orders)"""

IMAGES = f"""images AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS id,
    CAST(CASE WHEN o_orderkey % 12 = 1 THEN o_orderkey + 1 ELSE o_orderkey END AS VARCHAR)
      AS "receiptId",
    'image/jpeg' AS "mimeType",
    CAST(o_orderkey % 4000 + 1 AS INTEGER) AS width,
    CAST(o_orderkey % 3000 * 2 + 1 AS INTEGER) AS height,
    o_orderkey % 100000 + 1000 AS "sizeBytes",
    CASE WHEN o_orderkey % 3 = 0 THEN 'uploaded' ELSE 'pending' END AS "remoteStatus",
    CAST(NULL AS VARCHAR) AS "remoteFileId",
    strftime(o_orderdate, {ISO_MS}) AS "createdAt"
  FROM orders)"""
SOME_IMAGES = IMAGES.removesuffix(")") + " WHERE o_orderkey % 4 <> 0)"

UPLOADS = r"""uploads AS (
  SELECT doc_id AS upload_id, sha256(content) AS hash, octet_length(content) AS size_bytes,
    doc_id % 4 <> 1 AS is_jpeg,
    doc_id % 10 = 0 AS wrong_hash,
    CASE WHEN doc_id % 13 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS "mimeType",
    CASE WHEN doc_id % 26 = 0 THEN 'image/jpeg' WHEN doc_id % 13 = 0 THEN 'image/png'
      ELSE 'image/jpeg' END AS "contentType",
    doc_id % 17 = 0 AS bad_receipt, doc_id % 19 = 0 AS bad_locale,
    doc_id % 23 = 0 AS bad_currency
  FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN encode(text)
      ELSE '\xFF\xD8\xFF'::BLOB || encode(text) END AS content FROM documents))"""

URLS = r"""urls AS (
  SELECT page_id, CASE WHEN host IS NULL THEN url
    ELSE regexp_extract(url, '^(https?)://', 1) || '://' || host || '/v1/' END AS url
  FROM (SELECT page_id, url, CASE page_id % 10 WHEN 1 THEN '192.168.1.100:11434'
      WHEN 2 THEN '169.254.169.254' WHEN 3 THEN 'printer.local' WHEN 4 THEN '10.300.0.1'
      WHEN 5 THEN '224.0.0.251' WHEN 6 THEN 'user:pw@localhost' END AS host FROM pages))"""

SETTINGS = """settings AS (
  SELECT 's-' || c_custkey AS id,
    ['it-IT', 'FR_ca', ' de-DE ', 'pt-BR', 'auto', 'es', ''][CAST(c_custkey % 7 + 1 AS INTEGER)]
      AS locale,
    'EUR' AS "defaultCurrency", CAST(NULL AS VARCHAR) AS "selectedAiProvider",
    20e0 AS "insightMinimumPercent", CAST(1000 AS BIGINT) AS "insightMinimumMinor",
    CASE WHEN c_custkey % 2 = 0 THEN '{"observations":[]}' END AS "aiSummary",
    c_custkey % 2 = 0 AS "syncEnabled", 'token' AS "syncToken"
  FROM customer)"""

_RULES = "['" + "', '".join(rule for rule, _, _ in BROKEN) + "']"
_CATEGORY = 1 + [rule for rule, _, _ in BROKEN].index("category")
_ITEMS = 1 + [rule for rule, _, _ in BROKEN].index("items")

EXTRACTIONS = f"""line_counts AS (
  SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
replies AS (
  SELECT o_orderkey AS okey, CAST(o_orderkey AS VARCHAR) AS receipt_id,
    'job-' || o_orderkey AS job_id,
    upper(o_orderpriority) AS merchant_raw, o_orderpriority AS merchant_normalized,
    CASE WHEN o_orderkey % 31 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS tx_date,
    CAST(round(o_totalprice * 100) AS BIGINT)
      * CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 1 END AS total,
    o_orderkey % 7 = 0 AS cut, o_orderkey % 29 = 0 AS extra,
    CAST(o_orderkey % {BROKEN_EVERY} AS INTEGER) AS rule, coalesce(lines, 0) AS lines
  FROM orders LEFT JOIN line_counts ON l_orderkey = o_orderkey),
extractions AS (
  SELECT *, CASE WHEN cut THEN 'not_json_object' ELSE concat_ws(',',
      CASE WHEN extra THEN 'extra_key' END, nullif(shared, '')) END AS violations,
    CASE WHEN cut THEN 'not_json_object' ELSE shared END AS client_violations
  FROM (SELECT *, concat_ws(',',
      CASE WHEN rule BETWEEN 1 AND {_CATEGORY - 1} THEN {_RULES}[rule] END,
      CASE WHEN total < 0 THEN 'total' END,
      CASE WHEN rule BETWEEN {_CATEGORY} AND {len(BROKEN)}
        AND (rule <> {_ITEMS} OR lines > 0) THEN {_RULES}[rule] END) AS shared FROM replies))"""


def sql(query: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + query
