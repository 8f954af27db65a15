"""Writing audit outputs (the dashboard feed) to files or catalog tables."""

from .feed import write_feed, save_table, materialize

__all__ = ["write_feed", "save_table", "materialize"]
