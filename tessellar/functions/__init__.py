"""Part of tessellar."""
