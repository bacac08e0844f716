"""Operators on quads, snapshots and update operations."""
