"""Reconciliation of overlapping, messy records as Spark DataFrame operators."""
