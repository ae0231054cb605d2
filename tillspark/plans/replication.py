"""Registered replication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.operators import push, replication
from tillspark.operators.ordered import with_previous
from tillspark.plans import views
from tillspark.session import work_dir
from tillspark.sources import adapter, pages

CHECKPOINT, BATCH = 2000, 100
LAST_SEQUENCE = 1_000_000
STAMP = "2024-02-01T00:00:00.000000Z"
WIDTH = 700


def _changes(s, d):
    return adapter.changes(s, d).drop("owner_id")


def _document(code, document):
    """State ``code`` (value, plus 10 when deleted) as a document."""
    return F.concat(F.lit('{"_deleted":'), (code >= 10).cast("string"), F.lit(',"id":"'),
                    document, F.lit('","value":'), (code % 10).cast("string"), F.lit("}"))


def pushed_rows(s, d):
    """Each event pushes a document; it assumes the state the event before it pushed."""
    values = adapter.push_values(s, d).withColumn(
        "code", F.col("value") + F.when(F.col("is_deleted"), 10).otherwise(0))
    steps = with_previous(values, ["document_id"], "ord", F.col("code"), "before", WIDTH)
    before, document = F.col("before"), F.col("document_id")
    reordered = F.concat(F.lit('{ "value": '), (before % 10).cast("string"),
                         F.lit(', "id": "'), document, F.lit('", "_deleted": '),
                         (before >= 10).cast("string"), F.lit(" }"))
    assumed = (
        F.when(F.col("ord") % 35 == 3, "{}")
        .when((F.col("ord") % 5 == 0) & before.isNotNull(),
              F.concat(F.lit('{"id":"'), document, F.lit('","value":-1}')))
        .when(F.col("ord") % 2 == 0, reordered).otherwise(_document(before, document)))
    return steps.select("ord", "document_id", assumed.alias("assumed_json"),
                        _document(F.col("code"), document).alias("new_json"))


def masters(s, d):
    """Every second document is stored already."""
    documents = adapter.push_values(s, d).select("document_id").distinct()
    return documents.where(F.col("document_id").cast("long") % 2 == 0).select(
        "document_id", _document(F.lit(0), F.col("document_id")).alias("document_json"))


def _accepted(*sizes):
    def run(s, d):
        decided = push.push(pushed_rows(s, d), masters(s, d), *sizes)
        return push.accepted_changes(decided, "receipts", LAST_SEQUENCE, STAMP).select(
            "document_id", "document_json", "server_sequence", "is_deleted")
    return run


def _conflicts(*sizes):
    def run(s, d):
        rows, stored = pushed_rows(s, d), masters(s, d)
        return push.conflicts(push.push(rows, stored, *sizes), rows, stored)
    return run


def _rejected_batch(s, d):
    blank = F.when(F.col("ord") % 1009 != 5, F.col("document_id"))
    return push.batch_faults(pushed_rows(s, d).withColumn("document_id", blank), "receipts")


def _pairs(s, d):
    incoming = adapter.incoming_documents(s, d)
    parsed = adapter.parsed_changes(incoming)
    version = F.struct("updatedAt", "updatedByDevice", "status")
    paired = with_previous(parsed, ["document_id"], "server_sequence", version, "remote",
                           WIDTH, following=True).where(F.col("remote").isNotNull())
    same_time = F.col("remote").withField("updatedAt", F.col("updatedAt"))
    event = F.col("server_sequence") - 1
    return paired.select(
        "document_id", "server_sequence", version.alias("local"),
        F.when(event % 7 == 0, same_time).otherwise(F.col("remote")).alias("remote"))


def _winner(s, d):
    return replication.lww_pairs(_pairs(s, d)).select(
        "document_id", "server_sequence", "winner",
        F.col("document.updatedAt").alias("updatedAt"),
        F.col("document.updatedByDevice").alias("updatedByDevice"),
        F.col("document.status").alias("status"))


def _lww_versions(s, d):
    parsed = adapter.parsed_changes(adapter.changes(s, d))
    versions = parsed.withColumn("is_local", F.col("server_sequence") % 2 == 0)
    return replication.lww_versions(versions, replication.DOCUMENT_KEYS).select(
        "collection_name", "document_id", "updatedAt", "updatedByDevice", "status")


def _transitions(s, d):
    return replication.status_transitions(
        adapter.parsed_changes(adapter.changes(s, d)), WIDTH).select(
        "collection_name", "document_id", "server_sequence", "status", "previousStatus")


def _written(s, d):
    incoming = adapter.changes(s, d).withColumn("position", F.col("server_sequence") - 1)
    return replication.write_documents(incoming, LAST_SEQUENCE, "position", STAMP).select(
        "collection_name", "document_id", "document_json", "server_sequence", "is_deleted")


def _clustered_page(s, d):
    """State of the first three quarters of the log is stored by sequence, the rest is the tail."""
    changes, root = _changes(s, d), work_dir(s, "pages")
    last = changes.agg(F.max("server_sequence").alias("last")).head()["last"] or 0
    pages.store(changes, root, last * 3 // 4, 1000)
    return pages.pull(changes, root, "receipts", CHECKPOINT, BATCH)


QUERIES = {
    "current_state": lambda s, d: replication.current_state(_changes(s, d)),
    "tombstones": lambda s, d: replication.tombstones(_changes(s, d)),
    "pull_page": lambda s, d: replication.pull(_changes(s, d), "receipts", CHECKPOINT, BATCH),
    "pull_page_clustered": _clustered_page,
    "pull_checkpoint": lambda s, d: replication.next_checkpoint(
        replication.pull(_changes(s, d), "receipts", CHECKPOINT, BATCH), CHECKPOINT),
    "rejected_writes": lambda s, d: replication.rejected_writes(
        adapter.incoming_documents(s, d)).select("collection_name", "document_id",
                                                 "server_sequence", "reason"),
    "write_documents": _written,
    "push_accept": _accepted(),
    "push_conflicts": _conflicts(),
    "push_accept_chunked": _accepted(5000),
    "push_conflicts_chunked": _conflicts(5000),
    "push_rejected_batch": _rejected_batch,
    "lww_winner": _winner,
    "lww_versions": _lww_versions,
    "conflict_audit": lambda s, d: replication.conflict_audit(
        replication.lww_pairs(_pairs(s, d)), F.lit("receipts"), F.col("document_id"), STAMP),
    "status_transitions": _transitions,
}

_CURRENT = """current AS (
  SELECT * EXCLUDE (back, status, "updatedByDevice", "updatedAt"), "updatedAt" AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY collection_name, document_id
    ORDER BY server_sequence DESC) AS back, first_value("updatedAt") OVER (
      PARTITION BY collection_name, document_id ORDER BY server_sequence) AS created_at
    FROM changes) WHERE back = 1)"""

_PAGE = f"""page AS (SELECT * FROM current WHERE collection_name = 'receipts'
  AND server_sequence > {CHECKPOINT} ORDER BY server_sequence LIMIT {BATCH})"""

_WALK = """coded AS (
  SELECT *, value + CASE WHEN is_deleted THEN 10 ELSE 0 END AS code FROM pushed),
steps AS (
  SELECT ord, document_id, code, row_number() OVER w AS rn,
    CASE WHEN ord % 35 = 3 THEN -99
      WHEN ord % 5 = 0 AND lag(code) OVER w IS NOT NULL THEN -1
      ELSE coalesce(lag(code) OVER w, -99) END AS assumed
  FROM coded WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
walk AS (
  SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS ord,
    CAST(CASE WHEN CAST(document_id AS BIGINT) % 2 = 0 THEN 0 ELSE -99 END AS BIGINT) AS state,
    CAST(NULL AS BIGINT) AS met, FALSE AS accepted, CAST(NULL AS BIGINT) AS code
  FROM pushed
  UNION ALL
  SELECT s.document_id, s.rn, s.ord, CASE WHEN s.assumed = w.state THEN s.code ELSE w.state END,
    w.state, s.assumed = w.state, s.code
  FROM walk w JOIN steps s ON s.document_id = w.document_id AND s.rn = w.rn + 1)"""


def _json(code: str) -> str:
    return (f"""'{{"_deleted":' || CAST({code} >= 10 AS VARCHAR) || ',"id":"' || document_id"""
            f""" || '","value":' || ({code} % 10) || '}}'""")


_ACCEPTED = views.sql(
    f"""SELECT document_id, {_json("code")} AS document_json,
  {LAST_SEQUENCE} + ord + 1 AS server_sequence, code >= 10 AS is_deleted
FROM walk WHERE accepted""", views.PUSHED, _WALK).replace("WITH ", "WITH RECURSIVE ", 1)
_CONFLICTS = views.sql(
    f"""SELECT ord, document_id, {_json("met")} AS master_json
FROM walk WHERE NOT accepted AND rn > 0 AND met <> -99""",
    views.PUSHED, _WALK).replace("WITH ", "WITH RECURSIVE ", 1)

_PAIRS = """paired AS (
  SELECT document_id, server_sequence, "updatedAt" AS lt, "updatedByDevice" AS ld, status AS ls,
    CASE WHEN (server_sequence - 1) % 7 = 0 THEN "updatedAt" ELSE lead("updatedAt") OVER w END
      AS rt, lead("updatedByDevice") OVER w AS rd, lead(status) OVER w AS rs
  FROM incoming WINDOW w AS (PARTITION BY document_id ORDER BY server_sequence)),
won AS (SELECT *, lt > rt OR (lt = rt AND ld >= rd) AS local_wins FROM paired
  WHERE rd IS NOT NULL)"""

DOCUMENT_READS = views.sql(
    """SELECT * FROM current WHERE collection_name = 'receipts'
AND document_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""", views.INCOMING, _CURRENT)

ORACLE = {
    "current_state": views.sql("SELECT * FROM current", views.INCOMING, _CURRENT),
    "tombstones": views.sql("SELECT * FROM current WHERE is_deleted", views.INCOMING, _CURRENT),
    "pull_page": views.sql("SELECT * EXCLUDE (created_at) FROM page", views.INCOMING, _CURRENT, _PAGE),
    "pull_page_clustered": views.sql(
        "SELECT * EXCLUDE (created_at) FROM page", views.INCOMING, _CURRENT, _PAGE),
    "pull_checkpoint": views.sql(
        f"SELECT coalesce(max(server_sequence), {CHECKPOINT}) AS sequence FROM page",
        views.INCOMING, _CURRENT, _PAGE),
    "rejected_writes": views.sql(
        """SELECT collection_name, document_id, server_sequence, 'unknown_collection' AS reason
FROM incoming WHERE collection_name = 'settings'""", views.INCOMING),
    "write_documents": views.sql(
        f"""SELECT collection_name, document_id, document_json,
  {LAST_SEQUENCE} + server_sequence AS server_sequence, is_deleted FROM changes""",
        views.INCOMING),
    "push_accept": _ACCEPTED,
    "push_conflicts": _CONFLICTS,
    "push_accept_chunked": _ACCEPTED,
    "push_conflicts_chunked": _CONFLICTS,
    "push_rejected_batch": """SELECT event_id AS ord, 'blank_id' AS reason FROM events
WHERE event_id % 1009 = 5""",
    "lww_winner": views.sql(
        """SELECT document_id, server_sequence,
  CASE WHEN local_wins THEN 'local' ELSE 'remote' END AS winner,
  CASE WHEN local_wins THEN lt ELSE rt END AS "updatedAt",
  CASE WHEN local_wins THEN ld ELSE rd END AS "updatedByDevice",
  CASE WHEN local_wins THEN ls ELSE rs END AS status FROM won""", views.INCOMING, _PAIRS),
    "lww_versions": views.sql(
        """SELECT collection_name, document_id, "updatedAt", "updatedByDevice", status
FROM (SELECT *, row_number() OVER (PARTITION BY collection_name, document_id ORDER BY
  "updatedAt" DESC, "updatedByDevice" DESC, server_sequence % 2) AS back FROM changes)
WHERE back = 1""", views.INCOMING),
    "conflict_audit": views.sql(
        f"""SELECT 'sync-conflict' AS type, 'receipts' AS collection,
  document_id AS "documentId", '{STAMP}' AS "resolvedAt",
  CASE WHEN local_wins THEN ld ELSE rd END AS "winnerDevice" FROM won""",
        views.INCOMING, _PAIRS),
    "status_transitions": views.sql(
        """SELECT collection_name, document_id, server_sequence, status,
  before AS "previousStatus"
FROM (SELECT *, lag(status) OVER (PARTITION BY collection_name, document_id
  ORDER BY server_sequence) AS before FROM changes)
WHERE status = 'needs_review' AND before IN ('queued', 'processing')""", views.INCOMING),
}
