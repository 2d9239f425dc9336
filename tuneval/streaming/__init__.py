"""Structured Streaming jobs (re-aimed polling loops: L1, L2)."""
