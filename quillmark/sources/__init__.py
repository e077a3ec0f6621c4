"""Sources of quillmark."""
