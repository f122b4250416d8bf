"""Streams: an index that follows a folder of meetings."""
