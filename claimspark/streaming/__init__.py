"""Restartable harvest as a Structured Streaming job."""
