"""Streaming operators; importing registers their runs over what has arrived."""

from chainweave.streaming import operators  # noqa: F401
