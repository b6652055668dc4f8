"""User-facing analyses."""
