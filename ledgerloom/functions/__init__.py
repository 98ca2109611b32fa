"""Column builders: parsing, cleaning, checksums and similarity."""
