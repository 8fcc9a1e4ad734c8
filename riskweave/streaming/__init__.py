"""Streams: the scan is a map and takes a streaming DataFrame as it is; sinks that must not repeat are here."""
