"""Readers, writers and the JPEG coefficient codec."""
