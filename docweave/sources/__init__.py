"""Readers: bytes, text, markup and structured JSON to rows."""
