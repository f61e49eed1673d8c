"""Incremental versions of intake, reconciliation and admission with Structured Streaming."""
