"""Semantics that the driver's tables do not show: fixed fixtures and independent second formulations."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import codec
from stratalog.operators import changes, control, decisions, effects, publication, retention, serving
from stratalog.sources import config, ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


F1_OCC = [(1, "a", 2), (2, "a", 1), (2, "b", 1)]
F1_ART = [(1, 1), (1, 2), (2, 2), (2, 3)]


def occ(spark, data):
    return spark.createDataFrame(data, "gallery long, file string, occurrence_count long")


def art(spark, data):
    return spark.createDataFrame(data, "gallery long, artist long")


def test_file_decisions_fixture(spark):
    d = decisions.file_decisions(occ(spark, F1_OCC), art(spark, F1_ART))
    assert rows(d.select("file", "occurrence_count", "artist_count", "maximum_gallery_artist_count")) == [("a", 3, 3, 2), ("b", 1, 2, 2)]
    x = {r.file: r.excluded for r in decisions.exclusions(d, decisions.Policy(1, 3)).collect()}
    assert x == {"a": True, "b": False}


def test_decisions_without_artists_are_never_excluded(spark):
    d = decisions.file_decisions(occ(spark, [(1, "a", 9)]), art(spark, []))
    assert rows(decisions.exclusions(d)) == [("a", 9, 0, 0, False)]


def test_incremental_overlay_equals_full(spark):
    base = decisions.file_decisions(occ(spark, F1_OCC), art(spark, F1_ART))
    target = decisions.file_decisions(occ(spark, [(1, "a", 2), (2, "a", 1), (2, "c", 2)]), art(spark, F1_ART))
    delta = changes.overlay_delta(target, base, "file", ["occurrence_count", "artist_count", "maximum_gallery_artist_count"])
    assert {(r.file, r.action) for r in delta.collect()} == {("c", "shadow"), ("b", "tombstone")}
    assert changes.exact_overlay_violations(target, base, delta, "file", ["occurrence_count", "artist_count", "maximum_gallery_artist_count"]).count() == 0


def nested_resolution(anc, delta):
    out = set()
    for run, a, depth in anc:
        for r, key, action, value in delta:
            nearer = [(d2, act) for (run2, a2, d2) in anc for (r2, k2, act, _) in delta if run2 == run and r2 == a2 and k2 == key and d2 < depth]
            dead = any(r2 == a and k2 == key and act == "tombstone" for r2, k2, act, _ in delta)
            if r == a and action == "shadow" and not nearer and not dead:
                out.add((run, key, value))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_overlay_resolution_equals_nested_form(spark, seed):
    rng = random.Random(seed)
    anc = [(r, a, r - a) for r in range(4) for a in range(r + 1)]
    delta = [(rng.randrange(4), rng.randrange(6), rng.choice(["shadow", "tombstone"]), rng.randrange(100)) for _ in range(14)]
    delta = list({(d[0], d[1], d[2]): d for d in delta}.values())  # a shadow and a tombstone may meet
    got = changes.resolve_overlay(spark.createDataFrame(anc, "run long, ancestor long, depth long"), spark.createDataFrame(delta, "run long, key long, action string, value long"), "key", ["value"])
    assert rows(got) == nested_resolution(anc, delta)


def test_ancestry_compacts():
    chain: list = []
    for i in range(20):
        chain = changes.extend_ancestry(chain, f"r{i}", True)
    assert max(d for d, _ in chain) <= changes.MAX_DEPTH and changes.extend_ancestry(chain, "x", False) == [(0, "x")]


ATOMS = ["prefer", "title_scalars", "download_time", "gid", "scope", "locator"]


@pytest.mark.parametrize("atom", range(6))
def test_owner_comparator_atoms(spark, atom):
    low, high = [1, 1, 1, 1, b"\x7f", b"\x7f"], [1, 1, 1, 1, b"\x7f", b"\x7f"]
    high[atom] = b"\x80" if atom > 3 else 2
    for later in range(atom + 1, 6):  # the greater atom wins whatever follows
        low[later] = b"\xff" if later > 3 else 9
    c = spark.createDataFrame([("c", 10, *low), ("c", 20, *high)], "content_sha256 string, gallery long, prefer int, title_scalars long, download_time long, gid long, scope binary, locator binary")
    assert rows(decisions.content_owners(c)) == [("c", 20)]


def test_last_of_129_candidates_wins(spark):
    c = spark.createDataFrame([("c", i, 1, 1, 1, 1, b"s", bytes([i // 2 + 1, i % 2])) for i in range(129)], "content_sha256 string, gallery long, prefer int, title_scalars long, download_time long, gid long, scope binary, locator binary")
    owners = decisions.content_owners(c)
    assert rows(owners) == [("c", 128)] and rows(decisions.gid_winners(c, owners)) == [(1, 128)]


def test_hashless_galleries_never_win(spark):
    members = spark.createDataFrame([(1, 7), (2, 8)], "gallery long, gid long")
    winners = spark.createDataFrame([(7, 1)], "gid long, winner long")
    content = spark.createDataFrame([(1, "c")], "gallery long, content_sha256 string")
    owners = spark.createDataFrame([("c", 1)], "content_sha256 string, owner long")
    for f in (publication.select_by_joins, publication.select_by_existence):
        assert rows(f(members, winners, content, owners)) == [(1, 7)]


def test_effective_content_ignores_order_and_keeps_repeats(spark):
    a = decisions.effective_content(occ(spark, [(1, "x", 2), (1, "y", 1), (2, "y", 1), (2, "x", 2), (3, "x", 1), (3, "y", 1)]), F.col("file"))
    by = {r.gallery: r.content_sha256 for r in a.collect()}
    assert by[1] == by[2] == hashlib.sha256(b"xxy").hexdigest() != by[3]


CASES = ["same", "scalar", "child_missing_new", "child_missing_old", "child_value", "child_position", "order_only", "absent_both"]


@pytest.mark.parametrize("case", CASES)
def test_changed_item_matrix(spark, case):
    old, new = [("k", "sum", "en", 5)], [("k", "sum", "en", 5)]
    oc, nc = [("k", 0, "n", "artist"), ("k", 1, "m", "group")], [("k", 0, "n", "artist"), ("k", 1, "m", "group")]
    if case == "scalar":
        new = [("k", "other", "en", 5)]
    elif case == "child_missing_new":
        nc = nc[:1]
    elif case == "child_missing_old":
        oc = []
    elif case == "child_value":
        nc = [("k", 0, "z", "artist"), nc[1]]
    elif case == "child_position":
        nc = [("k", 3, "n", "artist"), nc[1]]
    elif case == "order_only":
        nc = nc[::-1]
    elif case == "absent_both":
        oc, nc = [], []
    item, child = "key string, summary string, language string, modified long", "key string, position long, name string, role string"
    got = publication.changed_items(spark.createDataFrame(old, item), spark.createDataFrame(new, item), ["summary", "language", "modified"], {"contributor": (spark.createDataFrame(oc, child), spark.createDataFrame(nc, child), ["position", "name", "role"])})
    assert (got.count() == 1) == (case not in ("same", "order_only", "absent_both"))


def test_artifact_operations_two_ways(spark):
    old = spark.createDataFrame([(k, s) for k, s in zip("abcd", "1234", strict=True)], "key string, semantics string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("e", "5")], "key string, semantics string")
    want = [("a", "DELETE"), ("b", "UNCHANGED"), ("c", "REBUILD"), ("d", "DELETE"), ("e", "CREATE")]
    assert rows(publication.artifact_operations(old, new)) == want == rows(publication.artifact_operations_by_existence(old, new))


def test_titles_contributors_language(spark):
    p = spark.createDataFrame([(1, "b", "x"), (2, "A", "x"), (3, "", "Straße")], "key long, src string, leaf string")
    p = p.withColumn("title", publication.display_title(F.col("src"), F.col("leaf")))
    assert [r.key for r in publication.catalog_order(p).orderBy("position").collect()] == [2, 1, 3]
    assert bytes(p.select(codec.casefold(F.col("title")).alias("f")).where("title like 'Str%'").first().f) == b"strasse"
    tags = spark.createDataFrame([(1, 0, "language", "en"), (1, 1, "artist", "x"), (1, 2, "group", "x"), (1, 3, "artist", "x"), (2, 0, "parody", "q")], "publication long, position long, namespace string, value string")
    up = spark.createDataFrame([(1, "u"), (2, "")], "publication long, uploader string")
    assert rows(publication.contributors(tags, up)) == [(1, 0, "u", "uploader"), (1, 1, "x", "artist"), (1, 2, "x", "group")]
    assert rows(publication.languages(p.select(F.col("key").alias("publication")), tags)) == [(1, "en"), (2, "und"), (3, "und")]


def test_row_numbers_are_dense(spark):
    df = spark.range(997).select((F.col("id") * 7919 % 1009).alias("x"))
    got = publication.row_numbers(df, ["x"], 7).orderBy("position").collect()
    assert [r.position for r in got] == list(range(997)) and [r.x for r in got] == sorted(r.x for r in got)


def test_pending_redownload_pages(spark):
    schedule = spark.createDataFrame([(90, 7), (95, 9), (100, 8), (105, 10), (110, 11)], "redownload_at long, gallery long")
    catalog = spark.createDataFrame([(42, 7), (43, 8), (44, 10), (45, 11)], "gid long, gallery long")
    one = lambda *g: spark.createDataFrame([(x,) for x in g], "gid long")
    pages, after = [], None
    while True:
        got, after = serving.redownload_page(schedule, catalog, one(43), one(44), 106, after, 1)
        pages.append((got, after))
        if after is None:
            break
    assert pages == [([42], (90, 7)), ([], (95, 9)), ([], (100, 8)), ([], None)]


def test_candidate_states(spark):
    s = lambda data, schema: spark.createDataFrame(data, schema)
    cat, sched = s([(42, 7), (43, 8)], "gid long, gallery long"), s([(7, 90), (8, 110)], "gallery long, redownload_at long")
    none, req = s([], "gid long"), s([(44,)], "gid long")
    asked = s([(44,), (42,), (43,), (42,)], "gid long")
    assert rows(serving.candidate_states(asked, cat, sched, none, none, req, 100)) == [(42, True, True, False), (43, True, False, False), (44, False, False, True)]
    assert rows(serving.candidate_states(asked, cat, sched, s([(42,)], "gid long"), none, req, 100))[0] == (42, True, False, False)


def test_acknowledgement(spark):
    ev = spark.createDataFrame([(i,) for i in range(5)], "sequence_no long")
    assert rows(effects.acknowledged_range(ev, -1, 1)) == [(0,), (1,)] and rows(effects.acknowledged_range(ev, 1, 3)) == [(2,), (3,)]
    assert effects.acknowledged_range(ev, 3, 3).count() == 0
    with pytest.raises(ValueError):
        effects.acknowledged_range(ev, 3, 2)


def test_hash_chain(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "o long, p string")
    h = hashlib.sha256(b"").hexdigest()
    for p in "abc":
        h = hashlib.sha256((h + p).encode()).hexdigest()
    assert rows(effects.hash_chain(df, "o", F.col("p"))) == [(3, h)]


def test_retention(spark):
    blobs = spark.createDataFrame([(bytes([i]) * 32,) for i in range(12)], "sha binary")
    refs = [spark.createDataFrame([(bytes([i]) * 32,)], "ref binary") for i in range(11)]
    left = retention.unreferenced(blobs, "sha", refs).withColumn("shard", retention.digest_shard(F.col("sha")))
    assert [(bytes(r.sha), r.shard) for r in left.collect()] == [(b"\x0b" * 32, 11)]


def test_codecs_equal_hashlib(spark):
    df = spark.createDataFrame([(7, b"n\xff.JPG", [b"b" * 32, b"a" * 32, b"a" * 32])], "gid long, name binary, digests array<binary>")
    u32, u64 = lambda n: n.to_bytes(4, "big"), lambda n: n.to_bytes(8, "big")
    r = df.select(
        codec.publication_key(F.col("gid"), namespace="ns").alias("pk"),
        codec.file_key(F.col("name"), namespace="ns").alias("fk"),
        codec.effective_content_digest(F.col("digests"), namespace="ns").alias("ec"),
        codec.source_scope_key("fs", F.lit(b"r" * 32), 3, namespace="ns").alias("sk"),
        codec.source_relative_locator_digest(F.array(F.lit(b"a"), F.lit(b"bc")), namespace="ns").alias("loc"),
    ).first()
    sha = lambda b: hashlib.sha256(b).digest()
    value = lambda domain, p: sha(b"ns-canonical-value\0" + u32(1) + u32(len(domain)) + domain + u64(len(p)) + p)
    assert bytes(r.pk) == sha(b"ns-publication-key\0" + u32(1) + u64(7))
    assert bytes(r.fk) == sha(b"ns-file-key\0" + u32(1) + u32(6) + b"n\xff.JPG")
    assert bytes(r.ec) == value(b"effective_content_v1", b"ns-effective-content\0" + u32(1) + u64(3) + b"a" * 64 + b"b" * 32)
    assert bytes(r.sk) == sha(b"ns-source-scope-key\0" + u32(1) + u32(2) + b"fs" + b"r" * 32 + u32(3))
    assert bytes(r.loc) == value(b"source_relative_locator_v1", b"ns-source-relative-locator\0" + u32(1) + u32(2) + u32(1) + b"a" + u32(2) + b"bc")


def test_names_and_urns(spark):
    texts = ["urn:stratalog:gallery:42", "urn:stratalog:gallery:042", "urn:stratalog:gallery:0", "urn:stratalog:gallery:9223372036854775808", "urn:other:42", "urn:stratalog:gallery:4 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(codec.decode_publication_id(F.col("t"))).collect()] == [42, None, None, None, None, None]
    names = spark.createDataFrame([("x.GIF",), ("x.jpeg",), ("x.tar.png",), ("x",), ("galleryinfo.txt",)], "n string")
    assert [tuple(r) for r in names.select(codec.transform_kind(F.col("n")), codec.file_role(F.col("n"))).collect()] == [("GIF_NORMALIZE", "CONTENT"), ("JPEG_NORMALIZE", "CONTENT"), ("JPEG_NORMALIZE", "CONTENT"), ("RAW_COPY", "CONTENT"), ("RAW_COPY", "METADATA")]
    tags = spark.createDataFrame([(["Already Uploaded"],), (["already uploaded "],), ([],)], "v array<string>")
    assert [r[0] for r in tags.select(codec.already_uploaded(F.col("v"))).collect()] == [True, False, False]
    valid = spark.createDataFrame([(b"ok",), (b"..",), (b"a/b",), (b"",), (b"z\0",), (b"x" * 256,)], "b binary")
    assert [r[0] for r in valid.select(codec.valid_name(F.col("b"))).collect()] == [True, False, False, False, False, False]


def test_ingest_operators(spark):
    known = spark.createDataFrame([("a", 5)], "key string, id long")
    assert rows(ingest.allocate(spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "key string"), known, "key", "id")) == [("a", 5), ("b", 6), ("c", 7)]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    merged, clash = ingest.insert_or_compare(old, spark.createDataFrame([("b", 3), ("a", 1), ("c", 4)], "k string, v long"), "k", "v")
    assert rows(merged) == [("a", 1), ("b", 2), ("c", 4)] and rows(clash) == [("b",)]


def test_control_states(spark, tmp_path):
    f = control.Fence().claim("a", 0, 10)
    with pytest.raises(control.Conflict):
        f.claim("b", 5, 10)
    g = f.claim("b", 10, 10)
    assert g.generation == 2
    with pytest.raises(control.Conflict):
        g.complete("a", 1, 11)
    gate = control.Gate()
    for i in range(control.SLOTS):
        gate = gate.share(f"o{i}", 0, 10)
    for call in (lambda: gate.share("x", 5, 1), lambda: gate.close("x", 5, 1)):
        with pytest.raises(control.Conflict):
            call()
    assert gate.close("x", 10, 5).exclusive == ("x", 15)
    ids, nxt = control.Allocator(3, 6).take(2)
    assert list(ids) == [4, 5]
    with pytest.raises(control.Conflict):
        nxt.take(2)
    assert control.advance_epoch("EMPTY", "c", "c") == "BUILDING" and control.next_action([("a", "COMPLETE"), ("b", "OPEN")]) == "b"
    store = control.VersionedCatalog(spark, f"file://{tmp_path}/cat")
    assert store.publish("main", 0, {"t": spark.range(3)}) == 1
    with pytest.raises(control.Conflict):
        store.publish("main", 0, {"t": spark.range(3)})
    assert store.publish("main", 1, {"t": spark.range(5)}) == 2
    assert store.read("main", "t").count() == 5 and store.read("main", "t", 1).count() == 3


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"db": {"host": "${H}", "port": 1}, "name": "x-${H}"}')
    allowed = {"db": {"host": str, "port": int}, "name": str}
    assert config.load(str(p), allowed, {"H": "h"}) == {"db": {"host": "h", "port": 1}, "name": "x-${H}"}
    for bad, env in (('{"nope": 1}', {}), ('{"db": {"host": "${M}"}}', {}), ('{"db": {"port": true}}', {}), ('{"name": "a", "name": "b"}', {})):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(p), allowed, env)


def test_stream_folds_like_batch(spark, tmp_path):
    from stratalog.streaming.incremental import DecisionStream

    data = [(g, f, a) for g, f, a in itertools.product(range(4), "xyz", (1, 2)) if (g + a) % 3]
    src = f"{tmp_path}/src"
    spark.createDataFrame(data, "gallery long, file string, artist long").repartition(4).write.parquet(src)
    s = DecisionStream(spark, f"file://{tmp_path}/state")
    stream = spark.readStream.schema("gallery long, file string, artist long").option("maxFilesPerTrigger", 2).parquet(src)
    q = s.start(stream, f"{tmp_path}/cp")
    q.awaitTermination(60)
    last = q.lastProgress["batchId"]
    o, a = s.current(last)
    full = spark.createDataFrame(data, "gallery long, file string, artist long")
    want = decisions.file_decisions(decisions.occurrence_counts(full), full.select("gallery", "artist").distinct())
    assert rows(decisions.file_decisions(o, a)) == rows(want)


def test_whole_casefold_order_takes_all_rows_and_accents(spark, tmp_path):
    from stratalog.plans import registry

    texts = [("de", "Straße b"), ("de", "STRASSE a"), ("fr", "Éclair"), ("fr", "éclair"), ("es", "ñandú"), ("en", "x" * 24 + "b"), ("en", "x" * 24 + "a"), (None, "Ωmega"), ("en", "")]
    rows = [(i, lang, text) for i, (lang, text) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.position for r in registry.WHOLE["op104_casefold_order_whole"](spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[2].casefold().encode(), r[0]))
    assert got == {r[0]: k for k, r in enumerate(order)}
    folded = {r.doc_id: r.folded for r in registry.QUERIES["codec_roles_whole"](spark, str(tmp_path)).collect()}
    assert folded[0] == "straße b" and folded[2] == "Éclair" and folded[5] == "x" * 24 + "b" and len(folded) == len(rows)


def test_codec_roles_lowers_letters_beyond_ascii_as_its_sql(spark, tmp_path):
    import duckdb

    from stratalog.functions import codec
    from stratalog.plans import registry

    texts = ["Éan de aiê La", "ÑJA TAIE", "ΑΣ ΣΑΣ. İI ẞ Ǆǅ", "𐐀𝐀 " + "É" * 20, "", None, "Straße"]
    spark.createDataFrame([(i, "en", x) for i, x in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["codec_roles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE["codec_roles"]).fetchall())
    letters = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
    folded = spark.createDataFrame([(letters,)], "t string").select(codec.simple_lower("t")).first()[0]
    assert folded == con.execute("SELECT lower(?)", [letters]).fetchone()[0]
