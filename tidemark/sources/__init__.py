"""Readers and writers: registry JSON, catalogs, specs, source trees, documents."""
