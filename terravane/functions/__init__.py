"""Column expressions: vectors, geodesy, equirectangular geometry, boxes, text."""
