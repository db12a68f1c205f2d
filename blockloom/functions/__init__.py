"""Part of the block engine."""
