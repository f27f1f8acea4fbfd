"""Streaming of lexmill."""
