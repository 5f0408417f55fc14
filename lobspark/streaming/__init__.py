"""Structured Streaming forms of the sources, the kernel and the sinks."""
