"""Queries over the driver tables, one module per family. Importing this package registers them."""

from . import entities, evaluation, identity, library, linkage, matching, passages, relational, scoring, search, series, sources, streaming, terms, verification  # noqa: F401
