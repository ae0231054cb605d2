"""Job table transforms: server extraction jobs and client upload jobs.

Each function takes the whole table (and a frame of events) and returns the new rows; ``now``
is always a parameter.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.functions.dates import iso_micros, iso_millis
from tillspark.functions.text import cut
from tillspark.model import ERROR_MESSAGE_MAX, EXTRACTION_JOBS, MAX_ATTEMPTS
from tillspark.operators.ordered import CHUNK_WIDTH, with_previous

# Failure class, code, message, delay in seconds, counted as an attempt.
# A key missing from a reply is a lookup failure, so it is not counted.
FAILURES = (
    ("not_ready", "receipt_not_ready", "Waiting for receipt synchronization", 2, False),
    ("lookup", "provider_unavailable", "Waiting for an active AI provider", 30, False),
    ("missing_key", "provider_unavailable", "Waiting for an active AI provider", 30, False),
    ("http", "provider_unavailable", "AI provider is temporarily unavailable", 30, True),
    ("timeout", "provider_unavailable", "AI provider is temporarily unavailable", 30, True),
    ("invalid", "invalid_response", "AI provider returned an invalid response", 30, True),
    ("file", "image_unavailable", "Uploaded receipt image is unavailable", 10, True),
    ("other", "worker_error", "AI extraction failed", 30, True),
)
# Error codes of an unavailable server, which never end a client job.
AVAILABILITY_CODES = ("429", "502", "503", "504", "network")


def _null() -> Column:
    return F.lit(None).cast("string")


def enqueue(jobs: DataFrame, requests: DataFrame, provider_id: str, now: datetime,
            new_id: Column | None = None, width: int = CHUNK_WIDTH) -> DataFrame:
    """One job for each receipt; a new image hash resets it, the same hash is a no-op.

    ``requests``: receipt_id, image_hash, locale, currency, ord. Several requests of one
    receipt apply in order: only those whose hash differs from the one before matter, and
    the last of them sets the job.
    """
    stamp = F.lit(iso_micros(now))
    marked = with_previous(requests, ["receipt_id"], "ord", F.col("image_hash"), "hash_before",
                           width)
    turns = marked.where(F.col("hash_before").isNull()
                         | (F.col("hash_before") != F.col("image_hash")))
    wanted = turns.groupBy("receipt_id").agg(
        F.max_by(F.struct("image_hash", "locale", "currency"), F.col("ord")).alias("want"),
        F.count(F.lit(1)).alias("turns"))
    merged = jobs.join(wanted, "receipt_id", "full_outer")
    is_new = F.col("id").isNull()
    reset = F.col("want").isNotNull() & (
        is_new | (F.col("turns") > 1) | (F.col("want.image_hash") != F.col("image_hash")))

    def changed(value: Column, name: str) -> Column:
        return F.when(reset, value).otherwise(F.col(name)).alias(name)

    return merged.select(
        F.coalesce("id", new_id if new_id is not None else F.uuid()).alias("id"), "receipt_id",
        changed(F.col("want.image_hash"), "image_hash"),
        changed(F.lit(provider_id), "provider_id"),
        changed(F.col("want.locale"), "locale"), changed(F.col("want.currency"), "currency"),
        changed(F.lit("pending"), "status"), changed(F.lit(0), "attempts"),
        changed(_null(), "next_attempt_at"), changed(_null(), "last_error_code"),
        changed(_null(), "last_error_message"),
        F.coalesce("created_at", stamp).alias("created_at"), changed(stamp, "updated_at"))


def due(jobs: DataFrame, now: datetime) -> DataFrame:
    """Pending jobs whose next attempt is unset or has come."""
    return jobs.where((F.col("status") == "pending") & (
        F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= iso_micros(now))))


def claim(jobs: DataFrame, now: datetime, limit: int = 1) -> DataFrame:
    """The oldest due jobs, set to processing."""
    oldest = due(jobs, now).orderBy("created_at", "id").limit(limit)
    return oldest.withColumns({"status": F.lit("processing"),
                               "updated_at": F.lit(iso_micros(now))})


def apply_updates(jobs: DataFrame, updated: DataFrame, key: str = "id") -> DataFrame:
    """The table with some rows replaced."""
    return jobs.join(updated.select(key), key, "left_anti").unionByName(
        updated.select(*jobs.columns))


def requeue_interrupted(jobs: DataFrame, now: datetime) -> DataFrame:
    """Jobs left in processing go back to pending."""
    hit = F.col("status").eqNullSafe("processing")
    return jobs.withColumns({
        "status": F.when(hit, "pending").otherwise(F.col("status")),
        "next_attempt_at": F.when(~hit, F.col("next_attempt_at")),
        "updated_at": F.when(hit, iso_micros(now)).otherwise(F.col("updated_at"))})


def retry(jobs: DataFrame, receipt_ids: DataFrame, provider_id: str, now: datetime) -> DataFrame:
    """The jobs of the named receipts, reset by hand."""
    return jobs.join(receipt_ids.select("receipt_id").distinct(), "receipt_id",
                     "left_semi").withColumns({
        "provider_id": F.lit(provider_id), "status": F.lit("pending"), "attempts": F.lit(0),
        "next_attempt_at": _null(), "last_error_code": _null(), "last_error_message": _null(),
        "updated_at": F.lit(iso_micros(now))})


def retarget(jobs: DataFrame, provider_id: str, now: datetime) -> DataFrame:
    """All pending jobs move to a provider and become due."""
    hit = F.col("status").eqNullSafe("pending")
    return jobs.withColumns({
        "provider_id": F.when(hit, provider_id).otherwise(F.col("provider_id")),
        "next_attempt_at": F.when(~hit, F.col("next_attempt_at")),
        "updated_at": F.when(hit, iso_micros(now)).otherwise(F.col("updated_at"))})


def failure_rules(spark: SparkSession, now: datetime) -> DataFrame:
    rows = [(kind, code, message, counted, iso_micros(now + timedelta(seconds=delay)))
            for kind, code, message, delay, counted in FAILURES]
    return spark.createDataFrame(
        rows, "failure string, code string, message string, counted boolean, retry_at string")


def fail(jobs: DataFrame, failures: DataFrame, now: datetime,
         max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Outcome of failed jobs. ``failures``: id, failure, and optionally message.

    An unknown class counts as ``other``.
    """
    rules = F.broadcast(failure_rules(jobs.sparkSession, now))
    known = F.when(F.col("failure").isin(*[f[0] for f in FAILURES]), F.col("failure")) \
        .otherwise("other")
    judged = jobs.join(failures.select("id", known.alias("failure")), "id").join(rules, "failure")
    attempts = F.col("attempts") + F.col("counted").cast("int")
    terminal = F.col("counted") & (attempts >= max_attempts)
    return judged.withColumns({
        "status": F.when(terminal, "failed").otherwise("pending"), "attempts": attempts,
        "next_attempt_at": F.when(~terminal, F.col("retry_at")),
        "last_error_code": F.col("code"),
        "last_error_message": cut(F.col("message"), ERROR_MESSAGE_MAX),
        "updated_at": F.lit(iso_micros(now))}).select(*EXTRACTION_JOBS.names)


def job_entries(jobs: DataFrame) -> DataFrame:
    """The projection shown to clients."""
    return jobs.select(
        "id", F.col("receipt_id").alias("receiptId"), "status", "attempts",
        F.col("next_attempt_at").alias("nextAttemptAt"),
        F.col("last_error_code").alias("lastErrorCode"))


def receipt_jobs(receipts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Receipts with the client's view of their job, null when there is none."""
    entries = job_entries(jobs).select(
        F.col("receiptId").alias("id"), F.col("id").alias("jobId"),
        F.col("status").alias("jobStatus"), "attempts", "lastErrorCode")
    return receipts.join(entries, "id", "left")


def backoff_minutes(attempts: Column) -> Column:
    """1, 2, 4, 8, 16, 32, then 60 minutes."""
    exponent = F.least(F.lit(6), F.greatest(F.lit(0), attempts - 1))
    return F.least(F.lit(60), F.pow(F.lit(2.0), exponent).cast("int"))


def client_due(jobs: DataFrame, now: datetime) -> DataFrame:
    """Pending jobs and failed ones with attempts left, once their time has come."""
    open_job = (F.col("status") == "pending") | (
        (F.col("status") == "failed") & (F.col("attempts") < MAX_ATTEMPTS))
    return jobs.where(open_job & (
        (F.coalesce("nextAttemptAt", F.lit("")) == "")
        | (F.col("nextAttemptAt") <= iso_millis(now))))


def client_requeue_interrupted(jobs: DataFrame, now: datetime) -> DataFrame:
    hit = F.col("status").eqNullSafe("processing")
    return jobs.withColumns({
        "status": F.when(hit, "pending").otherwise(F.col("status")),
        "nextAttemptAt": F.when(~hit, F.col("nextAttemptAt")),
        "updatedAt": F.when(hit, iso_millis(now)).otherwise(F.col("updatedAt"))})


def client_outcome(jobs: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """Jobs after a run. ``results``: id, error_code (null when it went well), message.

    Only uploads do work; other types go back to pending without a penalty. Adds
    ``imageStatus``, the remote status of the image of a failed upload.
    """
    stamp = F.lit(iso_millis(now))
    ran = jobs.join(results, "id")
    upload = F.col("type") == "image-upload"
    failed = upload & F.col("error_code").isNotNull()
    done = upload & F.col("error_code").isNull()
    attempts = F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts"))
    unavailable = F.col("error_code").isin(*AVAILABILITY_CODES)
    terminal = failed & ~unavailable & (attempts >= MAX_ATTEMPTS)
    wait = F.make_dt_interval(mins=backoff_minutes(attempts))
    retry_at = F.date_format(F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") + wait,
                             "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return ran.select(
        "id", "type", "receiptId",
        F.when(done, "completed").when(terminal, "failed").otherwise("pending")
        .alias("status"),
        attempts.alias("attempts"),
        F.when(failed & ~terminal, retry_at)
        .when(~failed & ~done, F.col("nextAttemptAt")).alias("nextAttemptAt"),
        F.when(failed, F.when(F.col("error_code") == "network", "job_failed")
               .otherwise(F.col("error_code")))
        .when(~done, F.col("lastErrorCode")).alias("lastErrorCode"),
        F.when(failed, cut(F.col("message"), ERROR_MESSAGE_MAX))
        .when(~done, F.col("lastErrorMessage")).alias("lastErrorMessage"),
        "createdAt", stamp.alias("updatedAt"),
        F.when(terminal, "failed").when(failed, "pending").when(done, "uploaded")
        .alias("imageStatus"))


def upload_requests(jobs: DataFrame, images: DataFrame, receipts: DataFrame, locale: str,
                    default_currency: str) -> DataFrame:
    """What each due upload sends, or why it cannot."""
    image = images.groupBy("receiptId").agg(
        F.min_by(F.struct("id", "mimeType"), F.col("id")).alias("image"))
    head = receipts.select(F.col("id").alias("receiptId"), "currency",
                           F.lit(True).alias("known"))
    joined = (jobs.where(F.col("type") == "image-upload").join(image, "receiptId", "left")
              .join(head, "receiptId", "left"))
    return joined.select(
        "id", "receiptId", F.col("image.id").alias("sha256"),
        F.col("image.mimeType").alias("mimeType"), F.lit(locale).alias("locale"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit(default_currency)).alias("currency"),
        F.when(F.col("image").isNull(), "Image metadata is missing")
        .when(F.col("known").isNull(), "Receipt metadata is missing").alias("problem"))
