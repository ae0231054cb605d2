"""Readers, writers and the adapter that maps the driver's tables to receipts."""
