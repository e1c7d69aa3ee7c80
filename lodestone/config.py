"""Engine settings: one frozen record, whose values become literals of a plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

REFUSAL = "I could not find the answer to your question in the provided documents."
ROUTES = ("question_bank", "hybrid", "vector_rag", "refused")
#: The vocabulary of question types and levels that roll-ups fill up with zeros.
QUESTION_TYPES = ("factual", "definitional", "conceptual", "causal", "comparative", "quantitative", "procedural", "multi_hop", "application", "critical")
HARD_TYPES = ("multi_hop", "critical", "application")
DIFFICULTIES = ("basic", "intermediate", "advanced")


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and sizes of all operators."""

    chunk_target: int = 3600
    chunk_overlap: int = 400
    chunk_min: int = 250
    parent_window: int = 3
    qa_min_chunk: int = 60
    min_answer: int = 40
    evidence_jaccard: float = 0.75
    min_evidence_tokens: int = 3
    max_evidence: int = 3
    question_threshold: float = 0.72
    question_margin: float = 0.08
    floor_ratio: float = 0.85
    vector_threshold: float = 0.45
    adaptive_ratio: float = 0.92
    adaptive: bool = True
    question_k: int = 12
    vector_k: int = 8
    overfetch: int = 4
    dense_weight: float = 0.65
    rrf_k: int = 60
    answer_jaccard: float = 0.9
    gate_weight: float = 0.3
    hybrid: bool = True
    hybrid_ceiling: float = 0.85
    groundedness_min: float = 1.0
    skip_audit: bool = True
    skip_audit_from: float = 0.85
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    ocr_min_chars: int = 80
    ocr_rtl_ratio: float = 0.15
    ocr_confidence: float = 0.5
    page_size: int = 50
    metrics_window: int = 500

    @classmethod
    def from_env(cls, prefix: str = "LODESTONE_", **more) -> "EngineConfig":
        """Defaults, overridden by environment variables and then by arguments."""
        out = cls()
        for f in fields(cls):
            if (value := os.environ.get(prefix + f.name.upper())) is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: value.lower() in ("1", "true", "yes") if kind is bool else kind(value)})
        return replace(out, **more)
