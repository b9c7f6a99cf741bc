"""Column expressions: text presence, Markdown, outlines, wrapping."""
