"""Errors that operators and sources raise."""


class BlockError(Exception):
    """Any error of this library."""


class InvalidImageError(BlockError):
    """A file that is missing, cut off or not an image."""


class UnsupportedFormatError(BlockError):
    """A valid file of a kind that is not handled."""


class BlockBoundaryError(BlockError):
    """A size that is no multiple of the block."""


class CodecError(BlockError):
    """Entropy-coded data that cannot be read or written."""
