"""Constants that set the engine's semantics, in one frozen object."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    # fixed values: sizes, limits and thresholds of the pipeline
    chunk_size: int = 1500
    chunk_overlap: int = 150
    top_k_chunks: int = 5
    graph_top_k_chunks: int = 10
    max_chunk_chars: int = 1200
    top_k_communities: int = 3
    min_community_similarity: float = 0.35
    top_k_concepts: int = 10
    min_concept_relevance: float = 0.3
    max_hops: int = 2
    max_entities: int = 25
    max_relationships_for_llm: int = 20
    max_boundary_edges: int = 30
    flat_top_k: int = 7
    flat_extra_chunks: int = 3
    flat_relationships: int = 10
    flat_extract_chars: int = 2000
    judge_chunks: int = 6
    entity_dedup_threshold: float = 0.95
    extraction_batch: int = 3
    concept_batch: int = 25
    entity_text_chars: int = 6000
    entity_description_chars: int = 80
    calls_per_minute: int = 28

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Config:
        """Defaults, overridden by LOAM_* environment variables, then by loam.* session settings."""
        values = {}
        for f in fields(cls):
            raw = os.environ.get(f"LOAM_{f.name.upper()}")
            raw = (spark.conf.get(f"loam.{f.name}", raw) if raw is not None else spark.conf.get(f"loam.{f.name}", None)) if spark else raw
            if raw is not None:
                values[f.name] = type(f.default)(raw)
        return cls(**values)


DEFAULT = Config()
