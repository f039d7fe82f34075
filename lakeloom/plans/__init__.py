"""Query registration and the catalogue of registered queries."""


def load() -> dict:
    """All registered queries by name."""
    from ..operators import bibliography, catalog, checks, concepts, evidence, export, extensions, families, identifiers, layout, order, queue, revisions, schema, scripts, spatial, tables, text  # noqa: F401
    from .registry import REGISTRY

    return REGISTRY
