"""Column functions: hashing, vectors, divergences."""
