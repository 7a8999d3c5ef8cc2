"""Structured Streaming: session state, telemetry and event windows."""
