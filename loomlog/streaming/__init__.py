"""Structured Streaming: subscriptions, stateful appends, late-event counts."""
