"""Readers, writers and the tables the library keeps."""
