"""Blocks and pixels, there and back."""
