"""Readers and writers: request logs, reference files, test tables, reports."""
