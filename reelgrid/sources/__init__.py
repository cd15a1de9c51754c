"""Readers, writers and the mapping from the driver tables to the data model."""
