"""Compare-and-set push of many rows at once.

A row is accepted when its assumed state equals the state its document has at that moment,
and then sets the new one. Rows of one document depend on each other, documents do not.

Rows are cut in chunks of consecutive order numbers. Each row is a function from the state before
to the state after; a chunk is the composition of its rows, kept as a table of
(entry state, exit state) that leaves every other state as it is. Neighbouring chunks are
composed by an equi-join on the state between them, in a binary tree for each document, until two
tables are left; going back down the tree gives the entry state of each chunk, and all chunks are
then replayed in parallel. No task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillspark.functions.text import canonical_json, sha256_hex
from tillspark.model import OWNER_ID, REPLICATED_COLLECTIONS
from tillspark.session import cut_lineage

NO_STATE = "none"
CHUNK_ROWS = 1_000_000
TABLE_ROWS = 10_000
_CHUNK = ["document_id", "chunk"]


def state_key(document_json: Column) -> Column:
    """Identity of a state; null and the empty object both mean that there is none."""
    canonical = canonical_json(document_json)
    return F.when(document_json.isNull() | (canonical == "{}"), NO_STATE).otherwise(
        sha256_hex(canonical))


def _state(key: Column) -> Column:
    """A state's identity as bytes, half as long as its text; none for no state."""
    return F.unhex(F.when(key == NO_STATE, "").otherwise(key))


def batch_faults(rows: DataFrame, collection: str) -> DataFrame:
    """(ord, reason) of the rows that make the whole batch invalid."""
    known = collection in REPLICATED_COLLECTIONS
    reason = F.lit("unknown_collection") if not known else F.when(
        F.coalesce("document_id", F.lit("")) == "", "blank_id")
    return rows.select("ord", reason.alias("reason")).where(F.col("reason").isNotNull())


def push(rows: DataFrame, masters: DataFrame, chunk_rows: int = CHUNK_ROWS,
         collection: str = "receipts") -> DataFrame:
    """Decides every pushed row of a batch; a batch with any invalid row is refused whole.

    Chunks span ``chunk_rows`` order numbers. A document within one chunk needs no tree.

    ``rows``: ord (unique, in push order), document_id, assumed_json, new_json.
    ``masters``: document_id, document_json, one row for each stored document.
    Returns ord, document_id, new_json, accepted, and ``writer``: the ord of the row that
    had set the state met by this one, null for the stored master.
    """
    if collection not in REPLICATED_COLLECTIONS or not batch_faults(rows, collection).isEmpty():
        raise ValueError("Every pushed document needs a known collection and an id")
    keyed = rows.select(
        "ord", "document_id", _state(state_key(F.col("assumed_json"))).alias("assumed"),
        _state(state_key(F.col("new_json"))).alias("new"))
    stored = masters.select("document_id",
                            _state(state_key(F.col("document_json"))).alias("master"))
    decided = _decided(keyed, stored, chunk_rows)
    return decided.join(rows.select("ord", "document_id", "new_json"), ["ord", "document_id"])


def accepted_changes(decided: DataFrame, collection: str, last_sequence: int,
                     timestamp: str) -> DataFrame:
    """Log rows of the accepted pushes; the sequence follows the push order."""
    return decided.where("accepted").select(
        F.lit(OWNER_ID).alias("owner_id"), F.lit(collection).alias("collection_name"),
        "document_id", canonical_json(F.col("new_json")).alias("document_json"),
        (F.lit(last_sequence).cast("long") + F.col("ord") + 1).alias("server_sequence"),
        F.coalesce(F.get_json_object("new_json", "$._deleted") == "true", F.lit(False))
        .alias("is_deleted"),
        F.lit(timestamp).alias("created_at"), F.lit(timestamp).alias("updated_at"))


def conflicts(decided: DataFrame, rows: DataFrame, masters: DataFrame) -> DataFrame:
    """The state that each rejected row met; a document without a state gives nothing.

    The writer's order number is part of the join key, so a hot document stays spread.
    """
    rejected = decided.where(~F.col("accepted")).select("ord", "document_id", "writer")
    by_push = rejected.where(F.col("writer").isNotNull()).join(
        rows.select(F.col("ord").alias("writer"), "document_id",
                    canonical_json(F.col("new_json")).alias("master_json")),
        ["writer", "document_id"])
    by_master = rejected.where(F.col("writer").isNull()).join(
        masters.select("document_id",
                       canonical_json(F.col("document_json")).alias("master_json")),
        "document_id")
    columns = ["ord", "document_id", "master_json"]
    return by_push.select(*columns).unionByName(by_master.select(*columns))


def _chunk_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, exit) table of each chunk from rows sorted by chunk and descending order.

    Walking backwards, a row with assumed ``a`` and new ``n`` sends ``a`` to wherever ``n``
    goes from there on. Tables of many chunks share a frame: most chunks are a few rows.
    """
    names = ("document_id", "chunk", "entry", "exit", "exit_writer")
    chunk, table, ready = None, {}, []

    def close():
        ready.extend((*chunk, entry, exit_, writer) for entry, (exit_, writer) in table.items())

    for batch in batches:
        for document, number, order, assumed, new in zip(
                *(batch[c].tolist() for c in ("document_id", "chunk", "ord", "assumed", "new"))):
            if (document, number) != chunk:
                if chunk is not None:
                    close()
                if len(ready) >= TABLE_ROWS:
                    yield pd.DataFrame(ready, columns=names)
                    ready = []
                chunk, table = (document, number), {}
            table[assumed] = table.get(new, (new, order))
    if chunk is not None:
        close()
    if ready:
        yield pd.DataFrame(ready, columns=names)


def _compose(level: DataFrame) -> DataFrame:
    """Tables of node pairs (2k, 2k+1) from the tables of the nodes."""
    at = ["document_id", "pair", "entry"]
    sided = level.withColumn("pair", F.shiftright("node", 1)).withColumn(
        "last", F.shiftright("last", 1))
    left = sided.where(F.col("node") % 2 == 0).alias("l")
    right = sided.where(F.col("node") % 2 == 1).drop("node").alias("r")
    same = ((F.col("l.document_id") == F.col("r.document_id"))
            & (F.col("l.pair") == F.col("r.pair")) & (F.col("l.exit") == F.col("r.entry")))
    through = left.join(right, same, "left").select(
        "l.document_id", F.col("l.pair").alias("node"), "l.last", "l.entry",
        F.coalesce("r.exit", "l.exit").alias("exit"),
        F.coalesce("r.exit_writer", "l.exit_writer").alias("exit_writer"))
    fresh = right.join(left.select(*at), at, "left_anti").select(
        "document_id", F.col("pair").alias("node"), "last", "entry", "exit", "exit_writer")
    return through.unionByName(fresh)


def _descend(parents: DataFrame, level: DataFrame, height: int) -> DataFrame:
    """Entry states of the nodes of ``level`` from those of the pairs above: the left node is
    entered as the pair is, the right one as the left one is left."""
    left = parents.withColumn("node", F.col("node") * 2)
    right = left.where(F.col("node") < F.shiftright("last", height)).join(
        level.where(F.col("node") % 2 == 0).select(
            "document_id", "node", "entry", "exit", "exit_writer"),
        ["document_id", "node", "entry"], "left").select(
        "document_id", (F.col("node") + 1).alias("node"), "last",
        F.coalesce("exit", "entry").alias("entry"),
        F.coalesce("exit_writer", "entry_writer").alias("entry_writer"))
    return left.unionByName(right)


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides rows sorted by chunk and order, after the entry of their chunk; holds one state,
    whatever the chunk's size."""
    state, writer = None, None
    for batch in batches:
        accepted, writers = [], []
        columns = [batch[c].tolist() for c in ("is_entry", "ord", "assumed", "new", "entry")]
        entry_writers = batch["entry_writer"].astype("Int64").astype(object).tolist()
        for is_entry, order, assumed, new, entry, entry_writer in zip(*columns, entry_writers):
            if is_entry:
                state, writer = entry, entry_writer
                continue
            hit = assumed == state
            accepted.append(hit)
            writers.append(writer)
            if hit:
                state, writer = new, order
        rows = batch[~batch["is_entry"]]
        yield pd.DataFrame({
            "document_id": rows["document_id"].tolist(), "ord": rows["ord"].tolist(),
            "accepted": accepted, "writer": pd.array(writers, dtype="Int64")})


def _entries(tables: DataFrame, stored: DataFrame) -> DataFrame:
    """Entry state of each chunk: document_id, chunk, entry, entry_writer.

    The chunks in which a document has rows are the leaves of its own tree, numbered without
    gaps, so a document takes part in as many levels as its own chunks need.
    """
    place = Window.partitionBy("document_id")
    chunks = tables.select(*_CHUNK).distinct().select(
        *_CHUNK, (F.row_number().over(place.orderBy("chunk")) - 1).alias("node"),
        (F.count("*").over(place) - 1).cast("int").alias("last"))
    chunks = cut_lineage(chunks, "push-chunks")
    leaves = tables.join(chunks.where("last > 0"), _CHUNK).select(
        "document_id", "node", "last", "entry", "exit", "exit_writer")
    levels = [cut_lineage(leaves, "push-level")]
    depth = int(chunks.agg(F.max("last")).first()[0] or 0).bit_length()
    for _ in range(depth - 1):
        levels.append(cut_lineage(_compose(levels[-1].where("last > 1")), "push-level"))
    roots = chunks.where("node = 0").select("document_id", "node", "last").join(
        stored, "document_id", "left").select(
        "document_id", "node", "last", F.coalesce("master", _state(F.lit(NO_STATE)))
        .alias("entry"), F.lit(None).cast("long").alias("entry_writer"))
    roots = cut_lineage(roots, "push-entry")
    entries = roots.where(F.shiftright("last", depth) > 0)  # none
    for height, level in reversed(list(enumerate(levels[:depth]))):
        begun = roots.where(F.shiftright("last", height) == 1)
        entries = cut_lineage(_descend(entries.unionByName(begun), level, height), "push-entry")
    entries = entries.unionByName(roots.where("last = 0"))
    return chunks.join(entries.drop("last"), ["document_id", "node"]).select(
        *_CHUNK, "entry", "entry_writer")


def _decided(keyed: DataFrame, stored: DataFrame, chunk_rows: int) -> DataFrame:
    chunked = cut_lineage(keyed.withColumn(
        "chunk", F.floor(F.col("ord") / chunk_rows).cast("long")), "push-rows")
    tables = (chunked.repartition(*_CHUNK)
              .sortWithinPartitions("document_id", "chunk", F.desc("ord"))
              .mapInPandas(_chunk_tables, "document_id string, chunk long, entry binary, "
                                          "exit binary, exit_writer long"))
    entries = _entries(cut_lineage(tables, "push-tables"), stored)
    none = F.lit(None)
    both = chunked.select("*", none.cast("binary").alias("entry"),
                          none.cast("long").alias("entry_writer"), F.lit(False).alias("is_entry"))
    both = both.unionByName(entries.select(
        *_CHUNK, F.lit(-1).cast("long").alias("ord"), none.cast("binary").alias("assumed"),
        none.cast("binary").alias("new"), "entry", "entry_writer", F.lit(True).alias("is_entry")))
    return (both.repartition(*_CHUNK)
            .sortWithinPartitions("document_id", "chunk", F.desc("is_entry"), "ord")
            .mapInPandas(_replayed, "document_id string, ord long, accepted boolean, "
                                    "writer long"))
