"""Feedback from a run into the knowledge store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.kb import rules
from palimpsest.kb.store import KnowledgeStore
from palimpsest.operators.consistency import Report


@dataclass
class Feedback:
    identities_updated: int = 0
    projects_updated: int = 0
    contradictions_resolved: int = 0
    igs: float = 1.0


def _learn(kb: KnowledgeStore, observations: DataFrame, report: Report | None) -> Feedback:
    out = Feedback()
    keys = observations.select(F.concat_ws(":", "snapshot_id", "path").alias("hash"), "cluster_uid")
    sure = rules.confident_identities(keys, kb.tables["frequencies"])
    out.identities_updated = sure.count()
    if out.identities_updated:
        kb.upsert("identities", sure)
    if report is not None and not report.passes:
        found = rules.candidates(report.conflicts, observations, kb.tables["identities"])
        told = rules.resolved(found, kb.tables["identities"], kb.tables["frequencies"])
        out.contradictions_resolved = told.count()
        if out.contradictions_resolved:
            kb.upsert("contradictions", told)
    out.igs = rules.growth_score(kb.tables["contradictions"]).first()["igs"]
    return out


def analyze(kb: KnowledgeStore, observations: DataFrame, report: Report | None = None) -> Feedback:
    return _learn(kb, observations, report)


def analyze_with_project(kb: KnowledgeStore, observations: DataFrame, prints: DataFrame, report: Report | None = None) -> Feedback:
    """The same after counting the prints' hashes; prints(uid, hash, weight) that are accepted replace stored ones."""
    kb.add_frequencies(prints.select("hash"))
    good = rules.accepted_projects(prints, kb.tables["projects"]).select("uid")
    n = good.count()
    if n:
        kb.upsert("projects", prints.join(good, "uid", "left_semi").withColumn("last_seen", F.current_timestamp().cast("string")))
    out = _learn(kb, observations, report)
    out.projects_updated = n
    return out
