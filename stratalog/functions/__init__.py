"""Part of stratalog; see the README."""
