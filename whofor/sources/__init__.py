"""Readers and writers: manifests, feature tables, event logs, vectors, sessions."""
