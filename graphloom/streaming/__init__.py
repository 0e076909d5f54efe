"""Streams: the change log of files."""
