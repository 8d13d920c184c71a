"""Column-level functions: no DataFrame in, no shuffle out."""
