"""Streaming of quillmark."""
