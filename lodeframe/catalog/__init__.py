"""Every registered query of the package."""

from __future__ import annotations

from functools import lru_cache

from lodeframe.catalog.base import Catalog


@lru_cache(maxsize=1)
def catalog() -> Catalog:
    from lodeframe.catalog import cleaning, detectors, insights, profiles, queries, sources, templates

    c = Catalog()
    for family in (queries, templates, cleaning, profiles, detectors, insights, sources):
        family.register(c)
    return c
