"""Stream forms of the scorer (extension, not reference coverage)."""
