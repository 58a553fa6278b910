"""Structured Streaming: folder ingest, sessions with expiry, status and audit of jobs."""
