"""Column functions: one row in, one value out, no shuffle."""
