"""Part of terrella."""
