"""Concept-graph analytics as DataFrame operators."""

__version__ = "0.2.0"

_PUBLIC = {"Engine": "weftmark.plans.engine", "GraphView": "weftmark.operators.graph", "Pipeline": "weftmark.plans.pipeline", "ingest_stream": "weftmark.streaming.ingest"}
__all__ = [*_PUBLIC, "__version__"]


def __getattr__(name: str):
    """Public names, loaded when first asked for, so that workers import only what they run."""
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(_PUBLIC[name]), name)
