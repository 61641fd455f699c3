"""Named stages. A stage is a function on frames; ``register`` adds one of your own."""

from __future__ import annotations

from collections.abc import Callable

from weftmark.operators import extract, induce, metrics, resolve, score, segment


class RegistryError(LookupError):
    """An unknown or repeated name."""


PORTS: dict[str, dict[str, Callable | None]] = {
    "segmenter": dict(segment.SEGMENTERS),
    "extractor": {"token": extract.token, "gazetteer": extract.gazetteer, "gold-mentions": extract.gold_mentions, "noun-chunk": extract.noun_chunk},
    "scorer": dict(score.SCORERS),
    "resolver": dict(resolve.RESOLVERS),
    "relation_inducer": {"co-occurrence": induce.co_occurrence, "compound": induce.compound, "hearst": induce.hearst, "union": induce.union},
    "graph_integrator": {"in-memory": None},
    "concept_store": {"in-memory": None},
    "embedder": {"hashing": None, "sentence-transformer": None},
    "dataset": {"toy": None, "inspec": None, "mention-clusters": None, "taxonomy": None},
    "metric": {"label-f1": metrics.label_f1, "edge-f1": metrics.edge_f1, "redundancy": metrics.redundancy, "hierarchy-sanity": metrics.hierarchy_sanity},
    "document_metric": {"f1-at-k": metrics.f1_at_k, "clustering": metrics.clustering, "coherence": metrics.coherence},
}


def check(port: str, name: str) -> None:
    """Raises unless the port has the name; the message lists what it has."""
    if port not in PORTS:
        raise RegistryError(f"unknown port {port!r} (known: {', '.join(sorted(PORTS))})")
    if name not in PORTS[port]:
        raise RegistryError(f"unknown {port} {name!r} (known: {', '.join(sorted(PORTS[port]))})")


def get(port: str, name: str) -> Callable | None:
    check(port, name)
    return PORTS[port][name]


def register(port: str, name: str) -> Callable[[Callable], Callable]:
    """Decorator that adds a stage under a new name."""
    if port not in PORTS:
        raise RegistryError(f"unknown port {port!r} (known: {', '.join(sorted(PORTS))})")

    def add(f: Callable) -> Callable:
        if name in PORTS[port]:
            raise RegistryError(f"{port} {name!r} is already registered")
        PORTS[port][name] = f
        return f

    return add
