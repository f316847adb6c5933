"""Errors that geometry planning and resampling raise."""


class DimensionError(ValueError):
    """Geometries of different rank or shape are combined."""


class IncompatibleAreas(ValueError):
    """Two areas do not fit together or do not meet."""


class InvalidArea(ValueError):
    """An area definition that means nothing."""


class AreaNotFound(KeyError):
    """No area of that name in the given files."""


class EmptyResult(ValueError):
    """No source or target location is usable."""
