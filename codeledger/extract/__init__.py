"""Front end: source text to typed facts."""
