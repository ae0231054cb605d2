"""Uploads from the due job to the queued extraction: states of jobs and images on the client,
accepted files and their extraction jobs on the server."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.model import CLIENT_JOBS, IMAGES
from tillspark.operators import queue
from tillspark.operators.ordered import CHUNK_WIDTH

MISSING_BYTES = "Full image attachment is missing"


def ready_uploads(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Upload requests with the last problem: an image without its full bytes.

    ``stored``: hashes whose bytes are there. An earlier problem of a request stays.
    """
    there = stored.select(F.col("hash").alias("sha256")).distinct().withColumn(
        "_there", F.lit(True))
    return requests.join(there, "sha256", "left").withColumn(
        "problem", F.coalesce("problem", F.when(F.col("_there").isNull(), MISSING_BYTES))) \
        .select(*requests.columns)


def uploading(images: DataFrame, requests: DataFrame) -> DataFrame:
    """The images after their uploads began: those without a problem are ``uploading``."""
    begun = requests.where(F.col("problem").isNull()).select(
        F.col("sha256").alias("id")).distinct().withColumn("_begun", F.lit(True))
    return images.join(begun, "id", "left").withColumn(
        "remoteStatus", F.when(F.col("_begun"), "uploading").otherwise(F.col("remoteStatus"))) \
        .select(*IMAGES.names)


def upload_results(jobs: DataFrame, images: DataFrame, requests: DataFrame, responses: DataFrame,
                   now: datetime) -> tuple[DataFrame, DataFrame]:
    """(the jobs that ran, all images) after the server answered.

    ``jobs``: the due jobs. ``requests``: their uploads with problems, which never reach the server
    and count as ``job_failed``. ``responses``: id of the job, file_id, error_code, message; a job
    without one keeps its state. An uploaded image gets its remote file id; of several jobs of one
    image the one with the greatest id counts, as they run in that order.
    """
    blocked = requests.where(F.col("problem").isNotNull()).select(
        "id", F.lit("job_failed").alias("error_code"), F.col("problem").alias("message"))
    sent = requests.where(F.col("problem").isNull()).select("id", "sha256")
    answered = responses.join(sent.select("id"), "id", "left_semi")
    results = blocked.unionByName(answered.select("id", "error_code", "message"))
    outcome = queue.client_outcome(jobs.where(F.col("type") == "image-upload"), results, now)

    files = answered.where(F.col("error_code").isNull()).select("id", "file_id")
    ended = (outcome.select("id", "imageStatus")
             .join(requests.where(F.col("sha256").isNotNull()).select("id", "sha256"), "id")
             .join(files, "id", "left"))
    last = ended.groupBy(F.col("sha256").alias("id")).agg(
        F.max_by("imageStatus", "id").alias("_status"),
        F.max_by("file_id", F.when(F.col("file_id").isNotNull(), F.col("id"))).alias("_file"))
    after = images.join(last, "id", "left").withColumns({
        "remoteStatus": F.coalesce("_status", "remoteStatus"),
        "remoteFileId": F.coalesce("_file", "remoteFileId")}).select(*IMAGES.names)
    return outcome.select(*CLIENT_JOBS.names), after


def enqueue_uploads(jobs: DataFrame, accepted: DataFrame, provider_id: str, now: datetime,
                    new_id: Column | None = None, width: int = CHUNK_WIDTH
                    ) -> tuple[DataFrame, DataFrame]:
    """(extraction jobs afterwards, the reply to each accepted upload).

    ``accepted``: rows of ``intake.store_results``; their uploads apply in the order of
    ``upload_id``. A reply shows the job of its receipt as it is after the whole batch.
    """
    requests = accepted.select(
        F.col("receiptId").alias("receipt_id"), F.col("fileId").alias("image_hash"), "locale",
        "currency", F.col("upload_id").alias("ord"))
    after = queue.enqueue(jobs, requests, provider_id, now, new_id, width)
    entries = queue.job_entries(after).select(
        F.col("id").alias("jobId"), "receiptId", "status", "attempts")
    replies = accepted.select("upload_id", "receiptId", "fileId", "alreadyExisted").join(
        entries, "receiptId")
    return after, replies
