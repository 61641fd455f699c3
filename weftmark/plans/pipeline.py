"""A configuration as one chain of frames: segment, extract, score, resolve, induce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.functions import vectors
from weftmark.operators import induce, score
from weftmark.plans import registry
from weftmark.plans.config import Choice, Config
from weftmark.runtime import materialize
from weftmark.sources import readers


@dataclass
class Outcome:
    """What one batch gave; all frames carry doc_pos."""

    units: DataFrame
    selected: DataFrame
    resolutions: DataFrame
    induced: DataFrame


class Pipeline:
    """The stages of a configuration. Unknown parameters and missing optional packages are errors here, not later."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        if config["embedder"].name == "sentence-transformer":
            # hashing in its place would give another graph under the same name
            raise ImportError("the sentence-transformer embedder needs the optional package sentence-transformers and its model, which this build does not run; use hashing")
        self.dim = int(config["embedder"].params.get("dim", vectors.DIM))
        self._dictionary: DataFrame | None = None
        e = config["extractor"]
        if e.name == "noun-chunk":
            registry.get("extractor", "noun-chunk")(spark.createDataFrame([], "doc_pos long, doc_id string, unit_order int, unit_id string, text string"), **e.params)
        elif e.name == "gazetteer":
            self._dictionary = readers.taxonomy(spark, e.params["root"], e.params["gold"]).truth["terms"]
        elif e.name == "gold-mentions":
            self._dictionary = readers.mention_clusters(spark, e.params["root"], e.params.get("split", "test")).truth["gold"]
        self._members(config["relation_inducer"])

    def _members(self, stage: Choice) -> list[tuple[str, dict]]:
        """Inducers in order; a union is taken apart."""
        if stage.name != "union":
            registry.check("relation_inducer", stage.name)
            return [(stage.name, stage.params)]
        out = []
        for member in stage.params["members"]:
            registry.check("relation_inducer", member["name"])
            out.append((member["name"], member.get("params", {})))
        return out

    def _extract(self, units: DataFrame) -> DataFrame:
        e = self.config["extractor"]
        run = registry.get("extractor", e.name)
        return run(units, self._dictionary) if self._dictionary is not None else run(units, **e.params)

    def _score(self, rows: DataFrame, units: DataFrame) -> DataFrame:
        s = self.config["scorer"]
        params = dict(s.params)
        for old, new in (("mask_token", "mask"), ("denoise_lambda", "denoise")):
            if old in params:
                params[new] = params.pop(old)
        if s.name in ("embedding-cosine", "mderank", "hcuke"):
            return registry.get("scorer", s.name)(rows, units, dim=self.dim, **params)
        return registry.get("scorer", s.name)(rows, **params)

    def _resolve(self, rows: DataFrame, prior: DataFrame | None) -> DataFrame:
        r = self.config["resolver"]
        if r.name == "embedding-nn":
            return registry.get("resolver", r.name)(rows, prior=prior, dim=self.dim, **r.params)
        return registry.get("resolver", r.name)(rows, prior=prior, **r.params)

    def _induce(self, resolutions: DataFrame, units: DataFrame) -> DataFrame:
        found = []
        for name, params in self._members(self.config["relation_inducer"]):
            run = registry.get("relation_inducer", name)
            found.append(run(resolutions, units, **params) if name == "hearst" else run(resolutions, **params))
        return induce.union(found)

    def run(self, documents: DataFrame, prior: DataFrame | None = None) -> Outcome:
        """Process documents (doc_pos, doc_id, text) on top of prior concepts (id, label).

        All stages of a document share its partitioning by doc_pos; the resolver alone looks across documents.
        """
        docs = documents.select("doc_pos", "doc_id", "text").repartition("doc_pos")
        units = materialize(registry.get("segmenter", self.config["segmenter"].name)(docs, **self.config["segmenter"].params))
        scored = materialize(self._score(self._extract(units), units).filter("selected"))
        resolutions = materialize(self._resolve(scored, prior))
        return Outcome(units, scored, resolutions, materialize(self._induce(resolutions, units)))
