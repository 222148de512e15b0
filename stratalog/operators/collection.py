"""Garbage collection: rows that nothing has a reason to keep, kind by kind.

A rule is a conjunction of states, presences and absences, so it is a chain of semi- and anti-joins on the row's key.
Plain reference lists are one union and one anti-join; a reference that the caller forgets would delete live rows, so
``sweep`` asks for the exact list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retention import unreferenced

#: What may refer to a row of each kind.
ROOTS = {
    "content": ("file_digest", "occurrence", "changed", "exclusion_delta", "decision", "decision_occurrence", "decision_artist", "decision_gallery_maximum", "decision_seal", "decision_tombstone", "hash_cache"),
    "publication_identity": ("publication", "selection"),
    "artifact_location": ("prepared", "retained"),
    "artifact_blob": ("location", "prepared", "retained"),
    "name_gid": ("name_access",),
    "upload_time": ("name_gid", "publication_identity"),
    "gallery_identity": ("observation", "expected", "changed", "impacted", "candidate", "candidate_content", "candidate_preference", "candidate_title", "candidate_time", "candidate_seal", "candidate_tombstone", "owner", "content_provenance", "content_witness", "gid_provenance", "gid_witness", "gid_candidate", "gid_tombstone", "winner", "selection", "metadata_seal", "redownload"),
}


def sweep(kind: str, rows: DataFrame, key: str, references: dict[str, DataFrame]) -> DataFrame:
    """Rows that no reference of their kind names (each reference by its first column)."""
    if set(references) != set(ROOTS[kind]):
        raise ValueError(f"{kind} needs exactly the references {', '.join(ROOTS[kind])}")
    return unreferenced(rows, key, [references[name] for name in ROOTS[kind]])


def _keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def analysis_runs(runs: DataFrame, building: DataFrame, candidates: DataFrame, baselines: DataFrame, ancestry: DataFrame, published: DataFrame) -> DataFrame:
    """Ended runs (run, state) that no working build, candidate or published head uses and that are neither a baseline
    nor another run's ancestor.

    building, candidates, baselines, published (run); ancestry (run, ancestor), where a run is its own first ancestor."""
    others = ancestry.where("run <> ancestor").select(F.col("ancestor").alias("run"))
    return unreferenced(runs.where(F.col("state").isin("COMPLETE", "ABANDONED")), "run", [building, candidates, baselines, others, published])


def publication_candidates(candidates: DataFrame, working: DataFrame, artifacts: DataFrame, commits: DataFrame, finalized: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates that are not worked on, hold no open artifact, and whose commit, if any, is finalized and no head.

    working (candidate); artifacts (candidate, state); commits (candidate, receipt); finalized, heads (receipt)."""
    held = artifacts.where(F.col("state").isin("PENDING", "PREPARED")).select("candidate")
    pending = commits.join(_keys(finalized, "receipt"), "receipt", "left_anti").select("candidate")
    current = commits.join(_keys(heads, "receipt"), "receipt", "left_semi").select("candidate")
    return unreferenced(candidates, "candidate", [working.select("candidate"), held, pending, current])


def preparations(rows: DataFrame, bound: DataFrame, committed: DataFrame, ack_heads: DataFrame, acks: DataFrame, events: DataFrame) -> DataFrame:
    """Unbound preparations (preparation, state): committed complete ones, and abandoned ones neither committed nor
    acknowledged.

    bound, committed, ack_heads (preparation); acks (event); events (event, preparation)."""
    free = unreferenced(rows, "preparation", [bound.select("preparation")])
    done = free.where("state = 'COMPLETE'").join(_keys(committed, "preparation"), "preparation", "left_semi")
    heard = events.join(_keys(acks, "event"), "event", "left_semi").select("preparation")
    gone = unreferenced(free.where("state = 'ABANDONED'"), "preparation", [committed.select("preparation"), ack_heads.select("preparation"), heard])
    return done.unionByName(gone.select(*done.columns))


def continued(owners: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Stagings with a request that a request of another staging follows.

    owners (request, staging); predecessors (request, prior)."""
    before, after = owners.select(F.col("request").alias("prior"), "staging"), owners.select("request", F.col("staging").alias("_next"))
    return predecessors.join(before, "prior").join(after, "request").where("staging <> _next").select("staging").distinct()


def stagings(rows: DataFrame, members: DataFrame, owners: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Stagings (staging, state, build, gallery, observation) whose outcome the build holds: SEALED with this observation,
    REUSED with another one; unless another staging continues their requests.

    members (build, gallery, observation): one observation for each gallery of a build."""
    linked = members.select("build", "gallery", F.col("observation").alias("_linked"))
    met = rows.join(linked, ["build", "gallery"])
    same = F.col("observation") == F.col("_linked")
    over = met.where((F.col("state") == "SEALED") & same | (F.col("state") == "REUSED") & ~same).select(*rows.columns)
    return over.join(continued(owners, predecessors), "staging", "left_anti").select(*rows.columns)


def observations(rows: DataFrame, members: DataFrame, staged: DataFrame, live: DataFrame, owners: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Observations (gallery, observation) in no build and in no staging that may still use them or is continued.

    A staging (as in ``stagings``) lets go if it is OPEN or ABANDONED without a live claim, or REUSED with another
    observation linked.  live (staging): stagings with a claim of the current generation whose lease runs on."""
    key = ["gallery", "observation"]
    free = rows.join(_keys(members, *key), key, "left_anti")
    idle = staged.where(F.col("state").isin("OPEN", "ABANDONED")).join(_keys(live, "staging"), "staging", "left_anti").select("staging")
    linked = members.select("build", "gallery", F.col("observation").alias("_linked"))
    moved = staged.where("state = 'REUSED'").join(linked, ["build", "gallery"]).where("observation <> _linked").select("staging")
    using = staged.join(idle.unionByName(moved).distinct(), "staging", "left_anti")
    followed = staged.join(continued(owners, predecessors), "staging", "left_semi")
    return free.join(using.select(*key).unionByName(followed.select(*key)).distinct(), key, "left_anti")


def source_builds(builds: DataFrame, references: list[DataFrame], generations: DataFrame, completed: DataFrame, busy: DataFrame, current: int) -> DataFrame:
    """Ended builds (build, state) without a reference, an unfinished generation that is not superseded, or a busy one.

    references (build first); generations (build, generation); completed, busy (generation): finished ones, and those with
    an owner, a lease or a handoff."""
    open_ = generations.where(F.col("generation") >= current).join(_keys(completed, "generation"), "generation", "left_anti")
    held = generations.join(_keys(busy, "generation"), "generation", "left_semi")
    return unreferenced(builds.where(F.col("state").isin("SEALED", "ABANDONED")), "build", [*references, open_.select("build"), held.select("build")])


def uploads(rows: DataFrame, completed: DataFrame, leased: DataFrame, handed: DataFrame, allocated: DataFrame, mapped: DataFrame, current: int, domain: str) -> DataFrame:
    """Upload claims (value, generation) of superseded or finished generations without a running lease or handoff, whose
    value is allocated: in ``domain``, or by a generation that has a build.

    completed, leased, handed, mapped (generation); allocated (value, domain)."""
    past = rows.where(F.col("generation") != current)
    done = _keys(completed, "generation").withColumn("_done", F.lit(True))
    past = past.join(done, "generation", "left").where((F.col("generation") < current) | F.col("_done")).drop("_done")
    past = unreferenced(past, "generation", [leased.select("generation"), handed.select("generation")])
    built = _keys(mapped, "generation").withColumn("_built", F.lit(True))
    kinds = allocated.groupBy("value").agg(F.max(F.col("domain") == domain).alias("_own"))
    met = past.join(kinds, "value").join(built, "generation", "left")
    return met.where(F.col("_own") | F.col("_built")).select(*rows.columns)
