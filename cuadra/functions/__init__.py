"""Column functions: parsing, normalizing, masking, identities."""
