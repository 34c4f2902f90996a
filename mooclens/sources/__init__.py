"""Readers and writers (CSV logs, score files, sparse rows) and test fixtures."""
