"""Geostatistical domain segmentation on Spark: spatial joins, autocorrelation, ensembles, consensus, kriging."""

__version__ = "0.1.0"


def version() -> str:
    """The version of this package."""
    return __version__
