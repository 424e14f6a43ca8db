"""All registered queries. Importing the modules fills the registry."""

from querylume.catalog import (  # noqa: F401
    basics, cleaning, dashboards, files, quality, streams, summaries, trends,
)
from querylume.catalog.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
