"""HTML parsing, selection and extraction."""
