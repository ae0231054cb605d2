"""Registered job queue queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tillspark.functions.dates import iso_micros, iso_millis
from tillspark.operators import queue, uploads
from tillspark.plans import views
from tillspark.sources import adapter

NOW = datetime(1998, 6, 15, 12, 0, 0)
STAMP, STAMP_MS = iso_micros(NOW), iso_millis(NOW)
JOB_COLUMNS = ("id", "receipt_id", "image_hash", "provider_id", "locale", "currency", "status",
               "attempts", "next_attempt_at", "last_error_code", "last_error_message",
               "created_at", "updated_at")


def _jobs(s, d):
    return adapter.extraction_jobs(s, d)


def _requests(s, d):
    """Upload requests of half the receipts; some receipts change their image and repeat it."""
    base = adapter.receipts(s, d).select(
        F.col("id").cast("long").alias("key"), F.col("id").alias("receipt_id"),
        F.col("imageHash").alias("image_hash")).where(F.col("key") % 4 < 2)
    copies = F.when(F.col("key") % 20 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))) \
        .otherwise(F.array(F.lit(0)))
    rows = base.withColumn("n", F.explode(copies))
    renewed = F.sha2(F.concat(F.lit("new-"), "receipt_id"), 256)
    locales = F.array(F.lit("it-IT"), F.lit("fr-FR"), F.lit("de-DE"))
    return rows.select(
        "receipt_id", F.when(F.col("n") == 0, F.col("image_hash")).otherwise(renewed)
        .alias("image_hash"), F.get(locales, "n").alias("locale"), F.lit("CHF").alias("currency"),
        (F.col("key") * 3 + F.col("n")).alias("ord"))


def _failures(s, d):
    kinds = F.array(*[F.lit(f[0]) for f in queue.FAILURES], F.lit("unheard_of"))
    return _jobs(s, d).where(F.col("status") == "processing").select(
        "id", F.get(kinds, (F.col("receipt_id").cast("long") % 9).cast("int")).alias("failure"))


def _results(s, d):
    codes = F.array(F.lit(None), F.lit("503"), F.lit("network"), F.lit("413"),
                    F.lit("job_failed"))
    number = F.substring("id", 4, 20).cast("long")
    return adapter.client_jobs(s, d).where(F.col("status") == "processing").select(
        "id", F.get(codes, (F.floor(number / 2) % 5).cast("int")).alias("error_code"),
        F.repeat(F.lit("broken "), F.lit(60)).alias("message"))


def _enqueue(s, d):
    new_id = F.concat(F.lit("new-"), F.col("receipt_id"))
    return queue.enqueue(adapter.extraction_jobs(s, d, gaps=True), _requests(s, d), "openai", NOW, new_id, 5000)


def _uploads(s, d):
    """Due jobs and their uploads; every fifth image lacks its bytes."""
    due = queue.client_due(adapter.client_jobs(s, d), NOW)
    images = adapter.images(s, d)
    requests = queue.upload_requests(due, images, adapter.receipts(s, d), "it-IT", "EUR")
    stored = images.where(F.col("sizeBytes") % 5 != 0).select(F.col("id").alias("hash"))
    return due, images, uploads.ready_uploads(requests, stored)


def _uploaded(s, d):
    """Answers to the uploads that were sent: files, unavailable servers, refused files."""
    due, images, requests = _uploads(s, d)
    codes = F.array(F.lit(None), F.lit("503"), F.lit(None), F.lit("413"))
    code = F.get(codes, (F.floor(F.substring("id", 4, 20).cast("long") / 2) % 4).cast("int"))
    responses = requests.where(F.col("problem").isNull()).select(
        "id", F.when(code.isNull(), F.col("sha256")).alias("file_id"), code.alias("error_code"),
        F.when(code.isNotNull(), "refused").alias("message"))
    return uploads.upload_results(due, images, requests, responses, NOW)


QUERIES = {
    "uploads_begun": lambda s, d: uploads.uploading(*_uploads(s, d)[1:]).select(
        "id", "receiptId", "remoteStatus"),
    "upload_results": lambda s, d: _uploaded(s, d)[1],
    "upload_outcomes": lambda s, d: _uploaded(s, d)[0],
    "job_enqueue": _enqueue,
    "job_due": lambda s, d: queue.due(_jobs(s, d), NOW),
    "job_claim": lambda s, d: queue.claim(_jobs(s, d), NOW, 50),
    "job_claimed_table": lambda s, d: queue.apply_updates(
        _jobs(s, d), queue.claim(_jobs(s, d), NOW, 50)).select("id", "status", "updated_at"),
    "job_requeue": lambda s, d: queue.requeue_interrupted(_jobs(s, d), NOW),
    "job_retry": lambda s, d: queue.retry(
        _jobs(s, d), adapter.receipts(s, d).where(F.col("status") == "queued").select(
            F.col("id").alias("receipt_id")), "openai", NOW).select(*JOB_COLUMNS),
    "job_retarget": lambda s, d: queue.retarget(_jobs(s, d), "openai", NOW),
    "job_failure": lambda s, d: queue.fail(_jobs(s, d), _failures(s, d), NOW),
    "job_entries": lambda s, d: queue.job_entries(_jobs(s, d)),
    "receipt_jobs": lambda s, d: queue.receipt_jobs(
        adapter.receipts(s, d).select("id", "status"),
        adapter.extraction_jobs(s, d, gaps=True)),
    "client_backoff": lambda s, d: adapter.client_jobs(s, d).select(
        "id", "attempts", queue.backoff_minutes(F.col("attempts")).alias("minutes")),
    "client_due": lambda s, d: queue.client_due(adapter.client_jobs(s, d), NOW).select(
        "id", "type", "status", "attempts", "nextAttemptAt"),
    "client_requeue": lambda s, d: queue.client_requeue_interrupted(
        adapter.client_jobs(s, d), NOW).select("id", "status", "nextAttemptAt", "updatedAt"),
    "client_outcome": lambda s, d: queue.client_outcome(
        adapter.client_jobs(s, d), _results(s, d), NOW),
    "upload_requests": lambda s, d: queue.upload_requests(
        queue.client_due(adapter.client_jobs(s, d), NOW), adapter.images(s, d),
        adapter.receipts(s, d), "it-IT", "EUR"),
}

_ALL = ", ".join(JOB_COLUMNS)
_DUE = (f"status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= '{STAMP}')")
_CLIENT_DUE = (f"(status = 'pending' OR (status = 'failed' AND attempts < 5)) AND "
               f"(\"nextAttemptAt\" IS NULL OR \"nextAttemptAt\" <= '{STAMP_MS}')")
_CLAIMED = f"claimed AS (SELECT * FROM jobs WHERE {_DUE} ORDER BY created_at, id LIMIT 50)"

_RETRY_AT = {2: "1998-06-15T12:00:02Z", 10: "1998-06-15T12:00:10Z", 30: "1998-06-15T12:00:30Z"}
_RULES = "(VALUES " + ", ".join(
    f"({i}, '{code}', '{message}', {int(counted)}, '{_RETRY_AT[delay]}')"
    for i, (_, code, message, delay, counted) in enumerate(
        (*queue.FAILURES, queue.FAILURES[-1]))
) + ") AS rules(pos, code, message, counted, retry_at)"

_WANTED = """wanted AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id, o_orderkey % 20 = 0 AS renewed,
    sha256(CASE WHEN o_orderkey % 20 = 0 THEN 'new-' || o_orderkey
      ELSE CAST(o_orderkey AS VARCHAR) END) AS want_hash,
    CASE WHEN o_orderkey % 20 = 0 THEN 'fr-FR' ELSE 'it-IT' END AS want_locale
  FROM orders WHERE o_orderkey % 4 < 2),
merged AS (
  SELECT coalesce(j.receipt_id, w.receipt_id) AS rid, j.* EXCLUDE (receipt_id), w.want_hash,
    w.want_locale, w.receipt_id IS NOT NULL AND (j.id IS NULL OR w.renewed
      OR w.want_hash <> j.image_hash) AS reset
  FROM jobs j FULL JOIN wanted w ON j.receipt_id = w.receipt_id)"""


def _reset(value: str, name: str) -> str:
    return f"CASE WHEN reset THEN {value} ELSE {name} END AS {name}"


_SENT = f"""requested AS (
  SELECT j.*, i.id AS image, CAST(substr(j.id, 4) AS BIGINT) AS number,
    CASE WHEN i.id IS NULL THEN 'Image metadata is missing'
      WHEN r.id IS NULL THEN 'Receipt metadata is missing'
      WHEN i."sizeBytes" % 5 = 0 THEN 'Full image attachment is missing' END AS problem
  FROM client_jobs j
  LEFT JOIN (SELECT "receiptId", min(id) AS id, arg_min("sizeBytes", id) AS "sizeBytes"
    FROM images GROUP BY 1) i ON i."receiptId" = j."receiptId"
  LEFT JOIN receipts r ON r.id = j."receiptId"
  WHERE type = 'image-upload' AND {_CLIENT_DUE.replace("status", "j.status")}),
answered AS (
  SELECT *, attempts + CASE WHEN code IS NULL THEN 0 ELSE 1 END AS tries FROM (
    SELECT *, CASE WHEN problem IS NOT NULL THEN 'job_failed'
      ELSE [NULL, '503', NULL, '413'][CAST((number // 2) % 4 + 1 AS INTEGER)] END AS code
    FROM requested)),
ended AS (SELECT *, code <> '503' AND tries >= 5 AS terminal FROM answered)"""

ORACLE = {
    "uploads_begun": views.sql(
        """SELECT i.id, i."receiptId", CASE WHEN i.id IN (SELECT image FROM requested
    WHERE problem IS NULL) THEN 'uploading' ELSE "remoteStatus" END AS "remoteStatus"
FROM images i""", views.CLIENT_JOBS, views.IMAGES, views.RECEIPTS, _SENT),
    "upload_results": views.sql(
        """SELECT i.* REPLACE (CASE WHEN e.id IS NULL THEN "remoteStatus" WHEN code IS NULL
    THEN 'uploaded' WHEN terminal THEN 'failed' ELSE 'pending' END AS "remoteStatus",
  CASE WHEN e.id IS NOT NULL AND code IS NULL THEN i.id END AS "remoteFileId")
FROM images i LEFT JOIN ended e ON e.image = i.id""",
        views.CLIENT_JOBS, views.IMAGES, views.RECEIPTS, _SENT),
    "upload_outcomes": views.sql(
        f"""SELECT id, type, "receiptId", CASE WHEN code IS NULL THEN 'completed' WHEN terminal
    THEN 'failed' ELSE 'pending' END AS status, tries AS attempts,
  CASE WHEN code IS NOT NULL AND NOT terminal THEN strftime(TIMESTAMP '1998-06-15 12:00:00'
    + to_minutes([1, 1, 2, 4, 8, 16, 32, 60, 60, 60][tries + 1]), {views.ISO_MS}) END
    AS "nextAttemptAt",
  code AS "lastErrorCode", CASE WHEN code IS NOT NULL THEN coalesce(problem, 'refused') END
    AS "lastErrorMessage", "createdAt", '{STAMP_MS}' AS "updatedAt" FROM ended""",
        views.CLIENT_JOBS, views.IMAGES, views.RECEIPTS, _SENT),
    "job_enqueue": views.sql(
        f"""SELECT coalesce(id, 'new-' || rid) AS id, rid AS receipt_id,
  {_reset("want_hash", "image_hash")}, {_reset("'openai'", "provider_id")},
  {_reset("want_locale", "locale")}, {_reset("'CHF'", "currency")},
  {_reset("'pending'", "status")}, {_reset("0", "attempts")},
  {_reset("NULL", "next_attempt_at")}, {_reset("NULL", "last_error_code")},
  {_reset("NULL", "last_error_message")}, coalesce(created_at, '{STAMP}') AS created_at,
  {_reset(f"'{STAMP}'", "updated_at")} FROM merged""", views.SOME_JOBS, _WANTED),
    "job_due": views.sql(f"SELECT * FROM jobs WHERE {_DUE}", views.JOBS),
    "job_claim": views.sql(
        f"""SELECT * REPLACE ('processing' AS status, '{STAMP}' AS updated_at)
FROM claimed""", views.JOBS, _CLAIMED),
    "job_claimed_table": views.sql(
        f"""SELECT id, CASE WHEN id IN (SELECT id FROM claimed) THEN 'processing' ELSE status END
    AS status,
  CASE WHEN id IN (SELECT id FROM claimed) THEN '{STAMP}' ELSE updated_at END AS updated_at
FROM jobs""", views.JOBS, _CLAIMED),
    "job_requeue": views.sql(
        f"""SELECT * REPLACE (CASE WHEN status = 'processing' THEN 'pending' ELSE status END
    AS status,
  CASE WHEN status <> 'processing' THEN next_attempt_at END AS next_attempt_at,
  CASE WHEN status = 'processing' THEN '{STAMP}' ELSE updated_at END AS updated_at)
FROM jobs""", views.JOBS),
    "job_retry": views.sql(
        f"""SELECT j.* REPLACE ('openai' AS provider_id, 'pending' AS status, 0 AS attempts,
  CAST(NULL AS VARCHAR) AS next_attempt_at, CAST(NULL AS VARCHAR) AS last_error_code,
  CAST(NULL AS VARCHAR) AS last_error_message, '{STAMP}' AS updated_at)
FROM jobs j JOIN orders ON o_orderkey = CAST(receipt_id AS BIGINT)
WHERE o_orderstatus NOT IN ('F', 'O')""", views.JOBS),
    "job_retarget": views.sql(
        f"""SELECT * REPLACE (
  CASE WHEN status = 'pending' THEN 'openai' ELSE provider_id END AS provider_id,
  CASE WHEN status <> 'pending' THEN next_attempt_at END AS next_attempt_at,
  CASE WHEN status = 'pending' THEN '{STAMP}' ELSE updated_at END AS updated_at)
FROM jobs""", views.JOBS),
    "job_failure": views.sql(
        f"""SELECT j.* REPLACE (
  CASE WHEN counted = 1 AND attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status,
  attempts + counted AS attempts,
  CASE WHEN counted = 1 AND attempts + 1 >= 5 THEN NULL ELSE retry_at END AS next_attempt_at,
  code AS last_error_code, message AS last_error_message, '{STAMP}' AS updated_at)
FROM jobs j JOIN {_RULES} ON pos = CAST(receipt_id AS BIGINT) % 9
WHERE status = 'processing'""", views.JOBS),
    "job_entries": views.sql(
        """SELECT id, receipt_id AS "receiptId", status, attempts,
  next_attempt_at AS "nextAttemptAt", last_error_code AS "lastErrorCode" FROM jobs""",
        views.JOBS),
    "receipt_jobs": views.sql(
        """SELECT r.id, r.status, j.id AS "jobId", j.status AS "jobStatus", j.attempts,
  j.last_error_code AS "lastErrorCode"
FROM receipts r LEFT JOIN jobs j ON j.receipt_id = r.id""", views.RECEIPTS, views.SOME_JOBS),
    "client_backoff": views.sql(
        """SELECT id, attempts,
  [1, 1, 2, 4, 8, 16, 32, 60, 60][attempts + 1] AS minutes FROM client_jobs""",
        views.CLIENT_JOBS),
    "client_due": views.sql(
        f"""SELECT id, type, status, attempts, "nextAttemptAt" FROM client_jobs
WHERE {_CLIENT_DUE}""", views.CLIENT_JOBS),
    "client_requeue": views.sql(
        f"""SELECT id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status,
  CASE WHEN status <> 'processing' THEN "nextAttemptAt" END AS "nextAttemptAt",
  CASE WHEN status = 'processing' THEN '{STAMP_MS}' ELSE "updatedAt" END AS "updatedAt"
FROM client_jobs""", views.CLIENT_JOBS),
    "client_outcome": views.sql(
        f"""SELECT id, type, "receiptId",
  CASE WHEN done THEN 'completed' WHEN terminal THEN 'failed' ELSE 'pending' END AS status,
  tries AS attempts,
  CASE WHEN failed AND NOT terminal THEN strftime(TIMESTAMP '1998-06-15 12:00:00'
      + to_minutes([1, 1, 2, 4, 8, 16, 32, 60, 60, 60][tries + 1]), {views.ISO_MS})
    WHEN NOT failed AND NOT done THEN "nextAttemptAt" END AS "nextAttemptAt",
  CASE WHEN failed THEN CASE code WHEN 'network' THEN 'job_failed' ELSE code END
    WHEN NOT done AND CAST(substr(id, 4) AS BIGINT) % 6 = 0 THEN '503' END AS "lastErrorCode",
  CASE WHEN failed THEN left(repeat('broken ', 60), 300)
    WHEN NOT done AND CAST(substr(id, 4) AS BIGINT) % 6 = 0 THEN 'unavailable before' END
    AS "lastErrorMessage",
  "createdAt", '{STAMP_MS}' AS "updatedAt",
  CASE WHEN terminal THEN 'failed' WHEN failed THEN 'pending' WHEN done THEN 'uploaded' END
    AS "imageStatus"
FROM (SELECT *, failed AND code NOT IN ('503', 'network') AND tries >= 5 AS terminal
  FROM (SELECT *, type = 'image-upload' AND code IS NOT NULL AS failed,
      type = 'image-upload' AND code IS NULL AS done,
      attempts + CASE WHEN type = 'image-upload' AND code IS NOT NULL THEN 1 ELSE 0 END AS tries
    FROM (SELECT *, [NULL, '503', 'network', '413', 'job_failed'][
        CAST((CAST(substr(id, 4) AS BIGINT) // 2) % 5 + 1 AS INTEGER)] AS code
      FROM client_jobs WHERE status = 'processing')))""", views.CLIENT_JOBS),
    "upload_requests": views.sql(
        f"""SELECT j.id, j."receiptId", i.id AS sha256, i."mimeType", 'it-IT' AS locale,
  coalesce(r.currency, 'EUR') AS currency,
  CASE WHEN i.id IS NULL THEN 'Image metadata is missing'
    WHEN r.id IS NULL THEN 'Receipt metadata is missing' END AS problem
FROM client_jobs j
LEFT JOIN (SELECT "receiptId", min(id) AS id, min("mimeType") AS "mimeType" FROM images
  GROUP BY 1) i ON i."receiptId" = j."receiptId"
LEFT JOIN receipts r ON r.id = j."receiptId"
WHERE type = 'image-upload' AND {_CLIENT_DUE.replace("status", "j.status")}""",
        views.CLIENT_JOBS, views.IMAGES, views.RECEIPTS),
}
