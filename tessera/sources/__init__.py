"""Catalog, table formats and the folders they live in."""
