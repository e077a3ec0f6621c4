"""Operators of quillmark."""
