"""Registered archive queries."""

from __future__ import annotations

from tillspark.functions.catalogue import catalogue_sql
from tillspark.operators import archive
from tillspark.plans import views
from tillspark.session import work_dir
from tillspark.sources import adapter, search_index, tables

NOW = adapter.NOW
COLUMNS = ["id", "status", "transactionDate", "merchantNormalized", "categoryId",
           "totalMinor", "updatedAt"]


def _search(**filters):
    def run(spark, sf_dir):
        found = archive.search(adapter.receipts(spark, sf_dir),
                               adapter.receipt_items(spark, sf_dir), NOW, **filters)
        return found.select(*COLUMNS)
    return run


_INDEXES: dict[tuple[str, str], str] = {}


def _indexed(**filters):
    """The index is built once for each application and data folder, and kept."""
    def run(s, d):
        key = (s.sparkContext.applicationId, d)
        receipts, items = adapter.receipts(s, d), adapter.receipt_items(s, d)
        if key not in _INDEXES:
            root = work_dir(s, "search-index")
            search_index.build(receipts, items, root)
            _INDEXES[key] = root
        return search_index.search(receipts, items, _INDEXES[key], NOW, **filters).select(*COLUMNS)
    return run


QUERIES = {
    "archive_search_indexed": _indexed(query=" Red Widget "),
    "archive_search_merchant_indexed": _indexed(query="nation_3 nation"),
    "archive_search_short_indexed": _indexed(query="n_"),
    "archive_combined_indexed": _indexed(query="ring", category="MACHINERY", period="year"),
    "archive_search": _search(query=" Red Widget "),
    "archive_search_merchant": _search(query="nation_3 nation"),
    "archive_category": _search(category="BUILDING"),
    "archive_month": _search(period="month"),
    "archive_previous": _search(period="previous"),
    "archive_year": _search(period="year"),
    "archive_combined": _search(query="ring", category="MACHINERY", period="year"),
    "archive_newest": lambda s, d: tables.newest_first(
        adapter.receipts(s, d).select(*COLUMNS)),
    "archive_size": lambda s, d: archive.archive_size(adapter.receipts(s, d)),
    "receipt_detail": lambda s, d: archive.receipt_detail(
        adapter.receipts(s, d), adapter.receipt_items(s, d)),
    "pending_count": lambda s, d: archive.pending_count(
        adapter.receipts(s, d), adapter.client_jobs(s, d)),
    "status_labels": lambda s, d: archive.status_labels(
        adapter.receipts(s, d).select("id", "status"), "it"),
}

_SELECT = "SELECT " + ", ".join(f'"{c}"' for c in COLUMNS) + " FROM receipts r"


def _matches(query: str) -> str:
    return f"""(contains(lower(coalesce("merchantNormalized", '') || ' '
    || coalesce("merchantRaw", '')), '{query}')
  OR id IN (SELECT "receiptId" FROM items
    WHERE contains(lower("normalizedName" || ' ' || "rawName"), '{query}')))"""


def _where(condition: str) -> str:
    return views.sql(f"{_SELECT} WHERE {condition}", views.RECEIPTS, views.ITEMS)


def _prefix(prefix: str) -> str:
    return f"""("transactionDate" IS NULL OR "transactionDate" LIKE '{prefix}%')"""


_COMBINED = _where(
    f"{_matches('ring')} AND \"categoryId\" = 'MACHINERY' AND {_prefix('2001-')}")

ORACLE = {
    "archive_search_indexed": _where(_matches("red widget")),
    "archive_search_merchant_indexed": _where(_matches("nation_3 nation")),
    "archive_search_short_indexed": _where(_matches("n_")),
    "archive_combined_indexed": _COMBINED,
    "archive_search": _where(_matches("red widget")),
    "archive_search_merchant": _where(_matches("nation_3 nation")),
    "archive_category": _where("\"categoryId\" = 'BUILDING'"),
    "archive_month": _where(_prefix("2001-07-")),
    "archive_previous": _where(_prefix("2001-06-")),
    "archive_year": _where(_prefix("2001-")),
    "archive_combined": _COMBINED,
    "archive_newest": views.sql(_SELECT, views.RECEIPTS),
    "archive_size": views.sql("SELECT count(*) AS receipts FROM receipts", views.RECEIPTS),
    "receipt_detail": views.sql(
        """SELECT r.id, r.status, r."transactionDate", r."merchantNormalized", r.currency,
  r."totalMinor", i.id AS "itemId", i.position,
  CASE WHEN i.id IS NOT NULL THEN trim(coalesce(nullif(i."normalizedName", ''), i."rawName", ''))
    END AS name, i.quantity, i."unitPriceMinor", i."totalPriceMinor", i."userEdited"
FROM receipts r LEFT JOIN items i ON i."receiptId" = r.id""", views.RECEIPTS, views.ITEMS),
    "pending_count": views.sql(
        """SELECT count(*) AS pending FROM (
  SELECT id FROM receipts WHERE status IN ('queued', 'processing')
  UNION SELECT coalesce("receiptId", id) FROM client_jobs
    WHERE status IN ('pending', 'processing'))""", views.RECEIPTS, views.CLIENT_JOBS),
    "status_labels": views.sql(
        f"""SELECT id, status, coalesce(text, status) AS "statusLabel" FROM receipts
LEFT JOIN {catalogue_sql("status.")} ON lang = 'it' AND key = 'status.' || status""",
        views.RECEIPTS),
}
