"""Incremental cohort cube over a stream of event files (same cube, stream source)."""

from .cube_stream import cube_stream, latest_snapshot, read_cube_snapshot

__all__ = ["cube_stream", "latest_snapshot", "read_cube_snapshot"]
