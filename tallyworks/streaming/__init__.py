"""Streaming forms of imports and window joins: additions, as the batch operators have no stream."""
