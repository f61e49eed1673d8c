"""Fact reconciliation for document collections, written as Spark DataFrame jobs."""
