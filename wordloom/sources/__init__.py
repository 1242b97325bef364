"""Part of the engine: sources."""
