"""Garbage collection and derived relations on fixtures with a row for each reason to stay."""

import pytest

from stratalog.operators import collection, views


def df(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def ids(frame):
    return sorted(r[0] for r in frame.collect())


@pytest.mark.parametrize("kind", sorted(collection.ROOTS))
def test_each_reference_keeps_its_row(spark, kind):
    names = collection.ROOTS[kind]
    refs = {name: df(spark, "k long", (i,)) for i, name in enumerate(names)}
    rows = df(spark, "k long", *((i,) for i in range(len(names) + 2)))
    assert ids(collection.sweep(kind, rows, "k", refs)) == [len(names), len(names) + 1]
    with pytest.raises(ValueError):
        collection.sweep(kind, rows, "k", dict(list(refs.items())[1:]))


def test_analysis_runs(spark):
    runs = df(spark, "run long, state string", *((i, "COMPLETE") for i in range(1, 7)), (7, "OPEN"), (8, "ABANDONED"))
    one = lambda k: df(spark, "run long", (k,))
    ancestry = df(spark, "run long, ancestor long", (6, 6), (9, 4), (8, 8))
    assert ids(collection.analysis_runs(runs, one(1), one(2), one(3), ancestry, one(5))) == [6, 8]


def test_publication_candidates(spark):
    rows = df(spark, "candidate long", *((i,) for i in range(1, 7)))
    artifacts = df(spark, "candidate long, state string", (2, "PENDING"), (6, "RELEASED"))
    commits = df(spark, "candidate long, receipt long", (3, 30), (4, 40), (5, 50))
    got = collection.publication_candidates(rows, df(spark, "candidate long", (1,)), artifacts, commits, df(spark, "receipt long", (40,), (50,)), df(spark, "receipt long", (40,)))
    assert ids(got) == [5, 6]


def test_preparations(spark):
    rows = df(spark, "preparation long, state string", (1, "COMPLETE"), (2, "COMPLETE"), (3, "ABANDONED"), (4, "ABANDONED"), (5, "ABANDONED"), (6, "ABANDONED"), (7, "COMPLETE"))
    one = lambda *k: df(spark, "preparation long", *((i,) for i in k))
    got = collection.preparations(rows, one(7), one(1, 4, 7), one(5), df(spark, "event long", (60,)), df(spark, "event long, preparation long", (60, 6), (61, 3)))
    assert ids(got) == [1, 3]


def test_stagings_and_observations(spark):
    rows = df(spark, "staging long, state string, build long, gallery long, observation long", (1, "SEALED", 1, 1, 10), (2, "REUSED", 1, 1, 11), (3, "SEALED", 1, 1, 12), (4, "REUSED", 1, 1, 10), (5, "SEALED", 2, 2, 20), (6, "OPEN", 3, 3, 30), (7, "OPEN", 3, 4, 40))
    members = df(spark, "build long, gallery long, observation long", (1, 1, 10), (2, 2, 20))
    owners = df(spark, "request long, staging long", (100, 5), (101, 6), (102, 1), (103, 1))
    before = df(spark, "request long, prior long", (101, 100), (103, 102))
    assert ids(collection.stagings(rows, members, owners, before)) == [1, 2]
    seen = df(spark, "gallery long, observation long", (1, 10), (1, 11), (1, 12), (3, 30), (4, 40), (9, 90))
    got = collection.observations(seen, members, rows, df(spark, "staging long", (7,)), owners, before)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 11), (3, 30), (9, 90)]


def test_source_builds_and_uploads(spark):
    builds = df(spark, "build long, state string", (1, "SEALED"), (2, "SEALED"), (3, "ABANDONED"), (4, "SEALED"), (5, "OPEN"), (6, "SEALED"))
    gens = df(spark, "build long, generation long", (2, 9), (3, 3), (4, 4), (6, 8))
    g = lambda *k: df(spark, "generation long", *((i,) for i in k))
    assert ids(collection.source_builds(builds, [df(spark, "build long", (1,))], gens, g(8), g(4), 7)) == [3, 6]
    rows = df(spark, "value long, generation long", (1, 7), (2, 8), (3, 9), (4, 3), (5, 4), (6, 5), (7, 2), (8, 2))
    domains = df(spark, "value long, domain string", *((i, "root") for i in range(1, 7)), (7, "other"))
    assert ids(collection.uploads(rows, g(9), g(4), g(5), domains, g(1), 7, "root")) == [3, 4]


def test_views(spark):
    batches = {r.start_generation: (r.committed_generation, r.next_processed_count, r.terminal, r.next_state) for r in views.batch_receipts(df(spark, "start_generation long, start_processed_count long, row_count long", (0, 0, 5), (1, 5, 0))).collect()}
    assert batches == {0: (1, 5, 0, "OPEN"), 1: (2, 5, 1, "COMPLETE")}
    got = views.winner_keyset(df(spark, "run long, winner long", (1, 5), (1, 6)), df(spark, "run long, build long", (1, 2)), df(spark, "build long, gallery long, observation long", (2, 5, 50), (2, 6, 60), (3, 5, 51)), df(spark, "gallery long, observation long, gid long", (5, 50, 500), (5, 51, 501), (6, 60, 600)), df(spark, "run long, gid long", (1, 500)))
    assert [tuple(r) for r in got.collect()] == [(1, 500, 5)]
    commits = df(spark, "receipt long, revision long, source_revision long, generation long, committed_at long", (1, 10, 20, 1, 5), (2, 11, 21, 2, 6))
    sources = df(spark, "source_revision long, channel string", (20, "a"), (21, "b"))
    assert [r.receipt for r in views.commit_head(df(spark, "channel string, receipt long", ("a", 1), ("a", 2)), commits, sources).collect()] == [1]
    out = views.receipts(commits, df(spark, "revision long, publication_count long", (10, 3), (11, 4)), sources, df(spark, "receipt long", (1,)), df(spark, "receipt long, committed_at long", (1, 9), (2, 9)))
    assert sorted((r.receipt, r.state, r.finalized_at) for r in out.collect()) == [(1, "PROJECTION_FINALIZED", 9), (2, "DB_COMMITTED", None)]
    assert [tuple(r) for r in views.commit_baseline(df(spark, "owner long, base_receipt long", (7, 2)), commits).collect()] == [(7, 2, 21, 11, 2)]
    assert [(r.revision, r.published_at) for r in views.published_descriptors(df(spark, "revision long", (11,)), commits).collect()] == [(11, 6)]
