"""Corrections by hand: a JSON array of {hash, override_cluster_uid}, each an identity of full confidence."""

from __future__ import annotations

import json
from pathlib import Path

from palimpsest.kb.store import KnowledgeStore


def apply_corrections(kb: KnowledgeStore, path: str) -> int:
    """Number of entries applied. Entries without both texts are passed over, the last one of a hash counts; a file that
    is not an array is an error. The file is written by hand, so it is read on the driver."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(told, list):
        raise ValueError("corrections must be a JSON array")
    pairs = [(e.get("hash"), e.get("override_cluster_uid")) for e in told if isinstance(e, dict)]
    good = [(h, uid) for h, uid in pairs if isinstance(h, str) and isinstance(uid, str) and h and uid]
    if good:
        rows = [(h, uid, 1.0) for h, uid in dict(good).items()]
        kb.upsert("identities", kb.spark.createDataFrame(rows, "hash string, cluster_uid string, confidence double"))
    return len(good)
