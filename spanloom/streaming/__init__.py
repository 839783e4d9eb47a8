"""The extraction plan on streams."""
