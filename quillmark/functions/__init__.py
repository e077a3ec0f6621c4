"""Functions of quillmark."""
