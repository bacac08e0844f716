"""Streaming load of snapshots."""
