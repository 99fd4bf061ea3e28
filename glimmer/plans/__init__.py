"""Queries over a library, by theme; importing this package registers all of them."""

from glimmer.plans import curation, details, wholes, library, places, reports, sequences, similarity, views, wholes, writes
from glimmer.plans.registry import QUERIES as ALL

__all__ = ["ALL", "curation", "details", "library", "places", "reports", "sequences", "similarity", "views", "wholes", "writes"]
