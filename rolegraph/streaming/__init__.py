"""The store's log as a stream."""
