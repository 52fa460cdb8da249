"""Column-level functions: the transformation glossary and its term reader."""
