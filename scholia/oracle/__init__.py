"""SQL that computes the expected answers from the rendering rules, never by parsing."""
