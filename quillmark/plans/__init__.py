"""Plans of quillmark."""
