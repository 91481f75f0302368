"""Readers of sidecars, slide files and chunked image stores."""
