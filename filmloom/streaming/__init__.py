"""Structured Streaming: keyed job state, telemetry, requests, sinks."""
