"""Readers, the trace generator and the table store."""
