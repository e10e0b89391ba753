"""Errors raised while a plan is built, or by a check of its data."""


class SeriesError(ValueError):
    """Input that is no series: empty, of unequal lengths, or without its columns."""


class ImputationError(ValueError):
    """A strategy left a missing value."""


class GraphError(ValueError):
    """A graph that can't be built or asked for."""
