"""States of client uploads and the extraction jobs of accepted files."""

from datetime import datetime

from tillspark import model
from tillspark.operators import queue, uploads

NOW = datetime(2026, 7, 14, 12)
REQUEST = ("id string, receiptId string, sha256 string, mimeType string, locale string, "
           "currency string, problem string")


def _jobs(spark, *rows):
    return spark.createDataFrame(
        [(i, kind, r, "pending", attempts, None, None, None, "t", "t")
         for i, kind, r, attempts in rows], model.CLIENT_JOBS)


def _images(spark, *rows):
    return spark.createDataFrame([(i, r, "image/jpeg", 1, 1, 10, "pending", None, "t")
                                  for i, r in rows], model.IMAGES)


def _requests(spark, *rows):
    return spark.createDataFrame([(i, r, h, "image/jpeg", "it-IT", "EUR", p)
                                  for i, r, h, p in rows], REQUEST)


def test_missing_bytes_come_after_other_problems(spark):
    asked = _requests(spark, ("1", "r1", "h1", None), ("2", "r2", "h2", None),
                      ("3", "r3", None, "Image metadata is missing"))
    stored = spark.createDataFrame([("h1",), ("h1",)], "hash string")
    ready = uploads.ready_uploads(asked, stored)
    assert ready.columns == asked.columns
    assert {r.id: r.problem for r in ready.collect()} == {
        "1": None, "2": uploads.MISSING_BYTES, "3": "Image metadata is missing"}
    images = _images(spark, ("h1", "r1"), ("h2", "r2"), ("h9", "r9"))
    assert {r.id: r.remoteStatus for r in uploads.uploading(images, ready).collect()} == {
        "h1": "uploading", "h2": "pending", "h9": "pending"}


def test_results_set_jobs_and_images(spark):
    jobs = _jobs(spark, ("1", "image-upload", "r1", 0), ("2", "image-upload", "r2", 4),
                 ("3", "image-upload", "r3", 9), ("4", "image-upload", None, 0),
                 ("5", "ai-insight", "r1", 0), ("6", "image-upload", "r6", 0))
    images = _images(spark, *[(f"h{n}", f"r{n}") for n in (1, 2, 3, 6, 9)])
    asked = _requests(spark, ("1", "r1", "h1", None), ("2", "r2", "h2", uploads.MISSING_BYTES),
                      ("3", "r3", "h3", None), ("4", None, None, "Image metadata is missing"),
                      ("6", "r6", "h6", None))
    responses = spark.createDataFrame(
        [("1", "f1", None, None), ("2", "never", None, None), ("3", None, "503", "busy")],
        "id string, file_id string, error_code string, message string")
    ran, after = uploads.upload_results(jobs, images, asked, responses, NOW)
    assert {r.id: (r.status, r.attempts, r.lastErrorCode, r.lastErrorMessage)
            for r in ran.collect()} == {
        "1": ("completed", 0, None, None),
        "2": ("failed", 5, "job_failed", uploads.MISSING_BYTES),
        "3": ("pending", 10, "503", "busy"),
        "4": ("pending", 1, "job_failed", "Image metadata is missing")}
    assert {r.id: (r.remoteStatus, r.remoteFileId) for r in after.collect()} == {
        "h1": ("uploaded", "f1"), "h2": ("failed", None), "h3": ("pending", None),
        "h6": ("pending", None), "h9": ("pending", None)}


def test_the_last_job_of_an_image_sets_its_state(spark):
    jobs = _jobs(spark, ("1", "image-upload", "r1", 0), ("2", "image-upload", "r1", 0))
    asked = _requests(spark, ("1", "r1", "h1", None), ("2", "r1", "h1", None))
    responses = spark.createDataFrame([("1", "f1", None, None), ("2", None, "503", "busy")],
                                      "id string, file_id string, error_code string, "
                                      "message string")
    image = uploads.upload_results(jobs, _images(spark, ("h1", "r1")), asked, responses,
                                   NOW)[1].first()
    assert (image.remoteStatus, image.remoteFileId) == ("pending", "f1")


def test_accepted_uploads_become_jobs(spark):
    accepted = spark.createDataFrame(
        [(1, "r1", "a", 1, "p", False, "it-IT", "EUR"), (2, "r1", "a", 1, "p", True, "de-DE", "EUR"),
         (3, "r2", "b", 1, "p", False, "fr-FR", "CHF")],
        "upload_id long, receiptId string, fileId string, size long, path string, "
        "alreadyExisted boolean, locale string, currency string")
    empty = spark.createDataFrame([], model.EXTRACTION_JOBS)
    jobs, replies = uploads.enqueue_uploads(empty, accepted, "openai", NOW)
    found = {r.receipt_id: (r.image_hash, r.locale, r.currency, r.status) for r in jobs.collect()}
    assert found == {"r1": ("a", "it-IT", "EUR", "pending"), "r2": ("b", "fr-FR", "CHF", "pending")}
    assert sorted((r.upload_id, r.alreadyExisted, r.status) for r in replies.collect()) == [
        (1, False, "pending"), (2, True, "pending"), (3, False, "pending")]
    assert queue.job_entries(jobs).count() == 2
