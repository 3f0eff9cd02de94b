"""Every tunable in one frozen record, with the fingerprint that names a configuration."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    # Defaults that decide results.
    generation_model: str = "gpt-4o-mini"
    guard_model: str = "gpt-4o-mini"
    embed_model: str = "text-embedding-3-large"
    embed_dim: int = 3072
    table: str = "medic-guidelines"
    index_version: str = "v1"

    chunk_target_tokens: int = 320
    chunk_overlap_tokens: int = 48
    chunk_min_tokens: int = 60
    chunk_drop_below_tokens: int = 10

    retrieve_k: int = 20
    rerank_top_n: int = 6
    rrf_k: int = 60
    confidence_threshold: float = 7.5
    corrective_enabled: bool = True
    corrective_threshold: float = 6.0
    corrective_k: int = 40
    corrective_blend_weight: float = 0.2

    blend_enabled: bool = True
    blend_n: int = 1
    blend_weight: float = 0.5
    blend_model: str | None = None
    blend_version: str = "v1"
    guardrails_version: str = "v3"

    response_ttl_s: int = 24 * 3600
    embedding_ttl_s: int = 30 * 24 * 3600
    blend_ttl_s: int = 7 * 24 * 3600
    rate_limit_per_window: int = 5
    rate_limit_window_s: int = 3600
    history_max_items: int = 200

    @property
    def fingerprint(self) -> str:
        """Sixteen hex digits naming everything that can change an answer to a fixed question."""
        parts = (
            self.generation_model, self.guard_model, self.embed_model, self.embed_dim,
            self.index_version, self.table, self.retrieve_k, self.rerank_top_n,
            self.confidence_threshold, self.guardrails_version, self.blend_enabled,
            self.blend_n, self.blend_weight, self.blend_model, self.blend_version,
            self.corrective_enabled, self.corrective_threshold, self.corrective_k,
            self.corrective_blend_weight,
        )
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]

    def calibrated(self, path: str | Path) -> "Settings":
        """These settings with the thresholds a calibration file holds, where it exists."""
        path = Path(path)
        if not path.exists():
            return self
        stored = json.loads(path.read_text())
        known = ("confidence_threshold", "corrective_threshold")
        return replace(self, **{k: float(stored[k]) for k in known if k in stored})


def write_calibration(path: str | Path, confidence: float, corrective: float, scores: dict) -> None:
    """Store measured thresholds. Both keys are kept, so the corrective band cannot vanish unseen."""
    payload = {
        "confidence_threshold": confidence,
        "corrective_threshold": corrective,
        "scores": scores,
    }
    Path(path).write_text(json.dumps(payload, indent=2))
