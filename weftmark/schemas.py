"""Schemas of the engine's tables."""

from __future__ import annotations

DOCUMENTS = "doc_pos long, doc_id string, kind string, text string, timestamp double, metadata map<string,string>"
UNITS = "doc_pos long, doc_id string, unit_id string, unit_order int, kind string, speaker string, text string"
CONCEPTS = "id string, label string, embedding array<double>, first_seen string, updated_at string"
RELATIONS = "type string, source_id string, target_id string, confidence double, provenance string"
CLUSTER_RECORD = "id string, kind string, text string, mentions array<struct<start:int,end:int,surface:string,cluster:string>>"
KEYPHRASE_RECORD = "id string, text string, keyphrases array<string>"
TAXONOMY_RECORD = "id string, kind string, term string, text string"
