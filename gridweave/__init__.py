"""Reconciliation of engineering drawings, and other large-table work, as Spark jobs."""
