"""Operators on tables of files, lines, blobs and catalogs."""
