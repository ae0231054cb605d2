"""Change log operators: current state, pull, conflict resolution and log writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions.text import canonical_json
from tillspark.model import (OWNER_ID, PULL_BATCH_DEFAULT, PULL_BATCH_MAX,
                             REPLICATED_COLLECTIONS)
from tillspark.operators.ordered import CHUNK_WIDTH, latest, with_previous

DOCUMENT_KEYS = ["collection_name", "document_id"]
# A log may have a column that is a function of the document and that its rows are dealt out by.
SHARD = "_shard"


def current_state(changes: DataFrame) -> DataFrame:
    """Newest version of each document, tombstones included.

    ``created_at``, where the log has it, is the one of the document's first version. Rows that
    are dealt out by shard are not shuffled again.
    """
    dealt = [SHARD] if SHARD in changes.columns else []
    if "created_at" not in changes.columns:
        return latest(changes, [*dealt, *DOCUMENT_KEYS], "server_sequence").drop(SHARD)
    rest = [c for c in changes.columns if c not in (SHARD, *DOCUMENT_KEYS, "created_at")]
    return changes.groupBy(*dealt, *DOCUMENT_KEYS).agg(
        F.max_by(F.struct(*rest), "server_sequence").alias("_row"),
        F.min_by("created_at", "server_sequence").alias("created_at"),
    ).select(*DOCUMENT_KEYS, "_row.*", "created_at")


def tombstones(changes: DataFrame) -> DataFrame:
    return current_state(changes).where(F.col("is_deleted"))


def pull(changes: DataFrame, collection: str, checkpoint: int = 0,
         batch_size: int = PULL_BATCH_DEFAULT) -> DataFrame:
    """The next page after a checkpoint: each document once, at its newest version.

    A document belongs to the page iff it has a version past the checkpoint, and its newest
    version is then past it too. So the sequence filter can run before the newest version is
    taken and prunes the log scan to its tail. A page has no creation times, which the tail
    does not know.
    """
    if not 1 <= batch_size <= PULL_BATCH_MAX:
        raise ValueError(f"batch_size must be in 1..{PULL_BATCH_MAX}")
    if checkpoint < 0:
        raise ValueError("checkpoint must not be negative")
    tail = changes.where((F.col("collection_name") == collection)
                         & (F.col("server_sequence") > checkpoint))
    return current_state(tail.drop("created_at")).orderBy("server_sequence").limit(batch_size)


def next_checkpoint(page: DataFrame, checkpoint: int) -> DataFrame:
    """Last sequence of a page, unchanged when the page is empty."""
    return page.agg(F.coalesce(F.max("server_sequence"), F.lit(checkpoint).cast("long"))
                    .alias("sequence"))


def known_collection(collection: Column) -> Column:
    return F.coalesce(collection.isin(*REPLICATED_COLLECTIONS), F.lit(False))


def rejected_writes(writes: DataFrame) -> DataFrame:
    """Rows that make the whole batch they came with invalid."""
    reason = (F.when(~known_collection(F.col("collection_name")), "unknown_collection")
              .when(F.coalesce("document_id", F.lit("")) == "", "blank_id"))
    return writes.withColumn("reason", reason).where(F.col("reason").isNotNull())


def require_valid(writes: DataFrame) -> None:
    """All or nothing: raises before anything is written when one row is invalid."""
    if not rejected_writes(writes).isEmpty():
        raise ValueError("Every replicated document needs a known collection and an id")


def write_documents(documents: DataFrame, last_sequence: int, order: str,
                    timestamp: str, canonical: bool = False) -> DataFrame:
    """Unconditional upserts as log rows.

    ``order`` is the dense position of a document in its batch; sequences follow it, so no
    row has to wait for a counter. ``canonical`` documents are not parsed once more. The column
    that rows are dealt out by stays.
    """
    document = F.col("document_json")
    dealt = [SHARD] if SHARD in documents.columns else []
    return documents.select(
        F.lit(OWNER_ID).alias("owner_id"), "collection_name", "document_id",
        document if canonical else canonical_json(document).alias("document_json"),
        (F.lit(last_sequence).cast("long") + F.col(order) + 1).alias("server_sequence"),
        F.coalesce(F.get_json_object("document_json", "$._deleted") == "true", F.lit(False))
        .alias("is_deleted"),
        F.lit(timestamp).alias("created_at"), F.lit(timestamp).alias("updated_at"), *dealt)


def later(left_time: Column, left_device: Column, right_time: Column,
          right_device: Column) -> Column:
    """True when the left version wins: later text stamp, then greater device; ties keep it."""
    lt, rt = F.coalesce(left_time, F.lit("")), F.coalesce(right_time, F.lit(""))
    ld, rd = F.coalesce(left_device, F.lit("")), F.coalesce(right_device, F.lit(""))
    return (lt > rt) | ((lt == rt) & (ld >= rd))


def lww_pairs(pairs: DataFrame) -> DataFrame:
    """Picks ``local`` or ``remote`` struct of each row; adds the side as ``winner``."""
    local_wins = later(F.col("local.updatedAt"), F.col("local.updatedByDevice"),
                       F.col("remote.updatedAt"), F.col("remote.updatedByDevice"))
    return pairs.withColumns({
        "winner": F.when(local_wins, "local").otherwise("remote"),
        "document": F.when(local_wins, F.col("local")).otherwise(F.col("remote")),
    })


def lww_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Winner among any number of versions; ``is_local`` breaks full ties."""
    order = F.struct(F.coalesce("updatedAt", F.lit("")),
                     F.coalesce("updatedByDevice", F.lit("")), F.col("is_local"))
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def conflict_audit(resolved: DataFrame, collection: Column, document_id: Column,
                   resolved_at: str) -> DataFrame:
    """One audit row for each resolved conflict."""
    device = F.coalesce(F.col("document.updatedByDevice"), F.lit(""))
    return resolved.select(
        F.lit("sync-conflict").alias("type"), collection.alias("collection"),
        document_id.alias("documentId"), F.lit(resolved_at).alias("resolvedAt"),
        device.alias("winnerDevice"))


def status_transitions(versions: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Versions that move a receipt from queued or processing to needs_review."""
    before = with_previous(
        versions, DOCUMENT_KEYS, "server_sequence", F.col("status"), "previousStatus", width)
    return before.where((F.col("status") == "needs_review")
                        & F.col("previousStatus").isin("queued", "processing"))
