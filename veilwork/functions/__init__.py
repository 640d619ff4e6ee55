"""Column expressions: everything here is a Column in, Column out helper."""
