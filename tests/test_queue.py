from datetime import datetime

from tillspark.operators import queue

NOW = datetime(2026, 7, 14, 12)


def test_a_job_without_a_status_keeps_its_time(spark):
    jobs = spark.createDataFrame(
        [("a", None, "2026-01-01", "2026-01-01", "p"), ("b", "processing", "2026-01-01", "x", "p"),
         ("c", "pending", "2026-01-01", "x", "p")],
        "id string, status string, next_attempt_at string, updated_at string, provider_id string")
    back = {r.id: r for r in queue.requeue_interrupted(jobs, NOW).collect()}
    assert (back["a"].status, back["a"].next_attempt_at) == (None, "2026-01-01")
    assert (back["b"].status, back["b"].next_attempt_at) == ("pending", None)
    moved = {r.id: r for r in queue.retarget(jobs, "q", NOW).collect()}
    assert (moved["a"].provider_id, moved["a"].next_attempt_at) == ("p", "2026-01-01")
    assert (moved["c"].provider_id, moved["c"].next_attempt_at) == ("q", None)
    client = jobs.withColumnsRenamed({"next_attempt_at": "nextAttemptAt",
                                      "updated_at": "updatedAt"})
    back = {r.id: r for r in queue.client_requeue_interrupted(client, NOW).collect()}
    assert (back["a"].status, back["a"].nextAttemptAt) == (None, "2026-01-01")
    assert (back["b"].status, back["b"].nextAttemptAt) == ("pending", None)
