"""Readers, writers and the mapping from the supplied tables onto the domain."""
