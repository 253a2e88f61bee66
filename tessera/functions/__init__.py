"""Types and their functions: parsing, text, order and hash."""
