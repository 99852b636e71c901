"""Settings and catalogues."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Corpora and retrievers by the name of their set.
CORPORA = {
    "PubMed": ("pubmed",),
    "Textbooks": ("textbooks",),
    "StatPearls": ("statpearls",),
    "Wikipedia": ("wikipedia",),
    "MedText": ("textbooks", "statpearls"),
    "MedCorp": ("pubmed", "textbooks", "statpearls", "wikipedia"),
}
RETRIEVERS = {
    "BM25": ("bm25",),
    "Contriever": ("facebook/contriever",),
    "SPECTER": ("allenai/specter",),
    "MedCPT": ("ncbi/MedCPT-Query-Encoder",),
    "RRF-2": ("bm25", "ncbi/MedCPT-Query-Encoder"),
    "RRF-4": ("bm25", "facebook/contriever", "allenai/specter", "ncbi/MedCPT-Query-Encoder"),
}

#: Part of a model's name, its window and the tokens of context it is given; the first that fits holds.
WINDOWS = (
    ("gpt-3.5", 16384, 15000),
    ("gpt-4", 32768, 30000),
    ("gemini-1.5", 1048576, 1040384),
    ("gemini", 30720, 28672),
    ("mixtral", 32768, 30000),
    ("llama-2", 4096, 3072),
    ("llama-3.1", 131072, 128000),
    ("llama-3.2", 131072, 128000),
    ("llama-3", 8192, 7168),
    ("meditron", 4096, 3072),
    ("", 2048, 1024),
)


def window(model: str) -> tuple[int, int]:
    """Window and context tokens of a model."""
    return next((size, context) for part, size, context in WINDOWS if part in model.lower())


def metric(encoder: str) -> str:
    """The score of an encoder's vectors: distance for the citation-trained one, else inner product."""
    return "l2" if "specter" in encoder.lower() else "ip"


def members(catalogue: dict[str, tuple[str, ...]], name: str) -> tuple[str, ...]:
    if name not in catalogue:
        raise ValueError(f"unknown name {name!r}; known: {', '.join(sorted(catalogue))}")
    return catalogue[name]


@dataclass(frozen=True)
class Settings:
    sample_size: int = 2000
    seed: int = 1508
    embed_dim: int = 768
    embed_batch: int = 32
    embed_max_length: int = 512
    top_k: int = 8
    max_chunks_per_doc: int = 3
    score_floor: float = 0.33
    attribution_floor: float = 0.20
    relevance_threshold: float = 0.4

    @classmethod
    def from_env(cls, prefix: str = "SKEINWORK_") -> Settings:
        """Defaults, overridden by environment variables of the fields' names."""
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[str(f.type)](os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ})
