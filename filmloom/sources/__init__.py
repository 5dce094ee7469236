"""Readers, writers and the tables derived from a data folder."""
