"""Part of rowloom."""
