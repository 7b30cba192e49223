"""Lifecycle inputs derived from the test tables, the registered queries, their SQL."""
