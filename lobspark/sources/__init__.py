"""Readers, decoders, sinks and the archive's life cycle."""
