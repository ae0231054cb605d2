"""Registered intake, image and address queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tillspark.functions.urls import audit_endpoints
from tillspark.model import FULL_SIDE, THUMBNAIL_SIDE
from tillspark.operators import intake, uploads
from tillspark.plans import views
from tillspark.session import cut_lineage
from tillspark.sources import adapter

NOW = datetime(2001, 8, 15, 9, 30, 0, 250000)


def _checked(s, d):
    return intake.checked_uploads(adapter.uploads(s, d))


def _stored(s, d):
    """Hashes stored before: those of every third document."""
    return _checked(s, d).where(F.col("upload_id") % 3 == 0).select("hash").distinct()


def _results(s, d):
    return intake.store_results(_checked(s, d), _stored(s, d))


def _enqueued(s, d):
    """Stored uploads, two or three to a receipt, on jobs of which some have the same file."""
    number = F.floor(F.col("upload_id") / 3).cast("string")
    accepted = cut_lineage(_results(s, d), "accepted").withColumn(
        "receiptId", F.concat(F.lit("r_"), number))
    first = accepted.groupBy("receiptId").agg(
        F.min("upload_id").alias("key"), F.min_by("fileId", "upload_id").alias("file"))
    made = F.lit("2001-01-01T00:00:00Z")
    jobs = first.where(F.col("key") % 4 < 2).select(
        F.concat(F.lit("job-"), "receiptId").alias("id"), F.col("receiptId").alias("receipt_id"),
        F.when(F.col("key") % 4 == 0, F.col("file")).otherwise("old").alias("image_hash"),
        F.lit("ollama").alias("provider_id"), F.lit("en-GB").alias("locale"),
        F.lit("CHF").alias("currency"), F.lit("completed").alias("status"),
        F.lit(2).alias("attempts"), F.lit(None).cast("string").alias("next_attempt_at"),
        F.lit(None).cast("string").alias("last_error_code"),
        F.lit(None).cast("string").alias("last_error_message"), made.alias("created_at"),
        made.alias("updated_at"))
    return uploads.enqueue_uploads(jobs, accepted, "openai", NOW,
                                   F.concat(F.lit("new-"), F.col("receipt_id")), 5000)


def _lookup(s, d):
    """Bytes of the claimed hash of each upload, in a store of every second one."""
    full = F.lit("full").alias("variant")
    store = adapter.uploads(s, d).where(F.col("upload_id") % 2 == 0).select(
        F.sha2("content", 256).alias("hash"), full, "content").dropDuplicates(["hash"])
    asked = adapter.uploads(s, d).select("upload_id", F.lower("sha256").alias("hash"), full)
    return intake.image_bytes(asked, store).select(
        "upload_id", F.octet_length("content").cast("long").alias("bytes"))


def _sizes(s, d):
    sized = adapter.images(s, d).withColumns({
        "full": intake.output_size(F.col("width"), F.col("height"), FULL_SIDE),
        "thumb": intake.output_size(F.col("width"), F.col("height"), THUMBNAIL_SIDE)})
    return sized.select(
        "id", F.col("full.width").alias("fullWidth"), F.col("full.height").alias("fullHeight"),
        F.col("thumb.width").alias("thumbWidth"), F.col("thumb.height").alias("thumbHeight"))


def _arrivals(s, d):
    """Two variants for every second order, of known and unknown images."""
    receipts = adapter.receipts(s, d).select("id", "imageHash")
    key = F.col("id").cast("long")
    rows = receipts.where(key % 2 == 0).withColumn(
        "variant", F.explode(F.array(F.lit("thumbnail"), F.lit("full"))))
    full = F.col("variant") == "full"
    return rows.where(~full | (key % 6 != 0)).select(
        F.col("imageHash").alias("id"), F.col("id").alias("receiptId"), "variant",
        (key + F.when(full, 5000).otherwise(50)).alias("sizeBytes"),
        (key * 2 + full.cast("int")).alias("ord"))


QUERIES = {
    "upload_jobs": lambda s, d: _enqueued(s, d)[0],
    "upload_replies": lambda s, d: _enqueued(s, d)[1],
    "content_store": _results,
    "content_written": lambda s, d: intake.new_content(_checked(s, d), _results(s, d)).select(
        "prefix", "hash", F.octet_length("content").cast("long").alias("bytes")),
    "upload_rejects": lambda s, d: intake.rejected_uploads(_checked(s, d)).select(
        "upload_id", F.array_join("violations", ",").alias("violations")),
    "image_lookup": _lookup,
    "output_size": _sizes,
    "image_upsert": lambda s, d: intake.upsert_remote_images(
        adapter.images(s, d, gaps=True), _arrivals(s, d), NOW),
    "url_audit": lambda s, d: audit_endpoints(adapter.urls(s, d)),
}

_BROKEN = """concat_ws(',', CASE WHEN bad_receipt THEN 'receipt_id' END,
  CASE WHEN bad_locale THEN 'locale' END, CASE WHEN bad_currency THEN 'currency' END,
  CASE WHEN "contentType" <> "mimeType" THEN 'type_mismatch' END,
  CASE WHEN "mimeType" <> 'image/jpeg' THEN 'not_jpeg_type' END,
  CASE WHEN NOT is_jpeg THEN 'not_jpeg_bytes' END,
  CASE WHEN wrong_hash THEN 'hash_mismatch' END)"""

_RESULTS = f"""judged AS (SELECT *, {_BROKEN} AS violations FROM uploads),
results AS (
  SELECT upload_id, 'r_' || upload_id AS "receiptId", hash AS "fileId", size_bytes AS size,
    substr(hash, 1, 2) || '/' || hash || '.jpg' AS path,
    upload_id > min(upload_id) OVER (PARTITION BY hash)
      OR hash IN (SELECT hash FROM uploads WHERE upload_id % 3 = 0) AS "alreadyExisted",
    'it-IT' AS locale, 'EUR' AS currency
  FROM judged WHERE violations = '')"""


def _scaled(side: str, maximum: int) -> str:
    return (f"CAST(greatest(1, CAST(floor({side} * least(1e0, {float(maximum)}e0 / "
            f"greatest(width, height)) + 0.5e0) AS BIGINT)) AS INTEGER)")


_ENQUEUED = """accepted AS (
  SELECT upload_id, 'r_' || (upload_id // 3) AS "receiptId", "fileId", "alreadyExisted"
  FROM results),
wanted AS (
  SELECT "receiptId", min(upload_id) AS key, arg_min("fileId", upload_id) AS first_file,
    arg_max("fileId", upload_id) AS last_file, count(DISTINCT "fileId") AS files
  FROM accepted GROUP BY 1),
queued AS (
  SELECT *, CASE WHEN key % 4 < 2 THEN 'job-' ELSE 'new-' END || "receiptId" AS id,
    key % 4 < 2 AS known, key % 4 > 0 OR files > 1 AS reset FROM wanted)"""

ORACLE = {
    "upload_jobs": views.sql(
        """SELECT id, "receiptId" AS receipt_id, last_file AS image_hash,
  CASE WHEN reset THEN 'openai' ELSE 'ollama' END AS provider_id,
  CASE WHEN reset THEN 'it-IT' ELSE 'en-GB' END AS locale,
  CASE WHEN reset THEN 'EUR' ELSE 'CHF' END AS currency,
  CASE WHEN reset THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN reset THEN 0 ELSE 2 END AS attempts, CAST(NULL AS VARCHAR) AS next_attempt_at,
  CAST(NULL AS VARCHAR) AS last_error_code, CAST(NULL AS VARCHAR) AS last_error_message,
  CASE WHEN known THEN '2001-01-01T00:00:00Z' ELSE '2001-08-15T09:30:00.250000Z' END
    AS created_at,
  CASE WHEN reset THEN '2001-08-15T09:30:00.250000Z' ELSE '2001-01-01T00:00:00Z' END
    AS updated_at FROM queued""", views.UPLOADS, _RESULTS, _ENQUEUED),
    "upload_replies": views.sql(
        """SELECT a.*, q.id AS "jobId", CASE WHEN reset THEN 'pending' ELSE 'completed' END
  AS status, CASE WHEN reset THEN 0 ELSE 2 END AS attempts
FROM accepted a JOIN queued q ON q."receiptId" = a."receiptId" """,
        views.UPLOADS, _RESULTS, _ENQUEUED),
    "content_store": views.sql("SELECT * FROM results", views.UPLOADS, _RESULTS),
    "content_written": views.sql(
        """SELECT substr("fileId", 1, 2) AS prefix, "fileId" AS hash, size AS bytes
FROM results WHERE NOT "alreadyExisted" """, views.UPLOADS, _RESULTS),
    "upload_rejects": views.sql(
        "SELECT upload_id, violations FROM judged WHERE violations <> ''",
        views.UPLOADS, _RESULTS),
    "image_lookup": views.sql(
        """SELECT u.upload_id, s.size_bytes AS bytes FROM uploads u
LEFT JOIN (SELECT DISTINCT hash, size_bytes FROM uploads WHERE upload_id % 2 = 0) s
  ON s.hash = u.hash AND NOT u.wrong_hash""", views.UPLOADS),
    "output_size": views.sql(
        f"""SELECT id, {_scaled("width", FULL_SIDE)} AS "fullWidth",
  {_scaled("height", FULL_SIDE)} AS "fullHeight",
  {_scaled("width", THUMBNAIL_SIDE)} AS "thumbWidth",
  {_scaled("height", THUMBNAIL_SIDE)} AS "thumbHeight" FROM images""", views.IMAGES),
    "image_upsert": views.sql(
        """SELECT coalesce(i.id, a.id) AS id, coalesce(i."receiptId", a.rid) AS "receiptId",
  'image/jpeg' AS "mimeType", coalesce(width, 0) AS width, coalesce(height, 0) AS height,
  coalesce(a.full_size, i."sizeBytes", 0) AS "sizeBytes",
  coalesce(i."remoteStatus", 'remote') AS "remoteStatus",
  CASE WHEN i.id IS NULL THEN a.id END AS "remoteFileId",
  coalesce(i."createdAt", '2001-08-15T09:30:00.250Z') AS "createdAt"
FROM images i FULL JOIN (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS id, CAST(o_orderkey AS VARCHAR) AS rid,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey + 5000 END AS full_size
  FROM orders WHERE o_orderkey % 2 = 0) a ON a.id = i.id""", views.SOME_IMAGES),
    "url_audit": views.sql(
        """SELECT page_id, cleaned AS url, CASE
    WHEN page_id % 10 = 6 OR contains(cleaned, '?') OR contains(cleaned, '#')
      THEN 'not_plain_http_url'
    WHEN page_id % 10 = 2 THEN 'metadata_service'
    WHEN page_id % 10 = 5 THEN 'reserved_address'
    WHEN cleaned LIKE 'http://%' AND page_id % 10 NOT IN (1, 3) THEN 'public_cleartext'
  END AS violation
FROM (SELECT page_id, rtrim(url, '/') AS cleaned FROM urls)""", views.URLS),
}
