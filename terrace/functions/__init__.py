"""Part of the terrain engine."""
