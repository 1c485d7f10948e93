"""Streams of JPEG files: an extension, as the operators themselves know no time."""
