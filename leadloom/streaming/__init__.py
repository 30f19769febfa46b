"""Structured Streaming: ingestion of responses and incremental duplicate scans."""
