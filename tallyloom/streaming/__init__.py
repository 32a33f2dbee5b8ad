"""Structured Streaming over the events table: an extension, as the batch operators need no stream."""
