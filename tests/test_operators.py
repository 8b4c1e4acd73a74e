"""Goldens and properties of single operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallframe.functions import text as X
from recallframe.functions import vectors
from recallframe.functions.rng import SplitMix64
from recallframe.operators import context, evaluation, lifecycle, projection, retrieval, validation
from recallframe.sources import datasets, ports
from recallframe.sources.snapshots import Conflict, Snapshots
from recallframe.streaming import ingest

NOW = 1_000_000


def cards(spark, rows):
    """Cards of one scope from dicts with id and some fields."""
    base = {"tenant_id": "t", "user_id": "u", "kind": "semantic", "category": "", "memory_key": "", "value": "", "person": "", "relationship": "", "backstory": "", "version": 1, "status": "active", "created_us": 0, "expires_us": None}
    names = [c.split()[0] for c in datasets.CARD_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], datasets.CARD_SCHEMA)


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", "t", "u", t) for i, t in enumerate(texts)], "query_id string, tenant_id string, user_id string, text string")


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    got = column(spark, "偏好无糖拿铁 Buses glass_bus Cats 42", X.tokens)
    assert {"偏好", "无糖", "拿铁", "偏", "buse", "glass", "bus", "cats", "42"} <= set(got)
    assert sorted(column(spark, "中 文", X.tokens)) == ["中", "文"]
    assert column(spark, None, X.tokens) == [] and column(spark, "cats", X.tokens) == ["cats"] and column(spark, "horses", X.tokens) == ["horse"]
    assert column(spark, "class corpus", X.tokens) == ["class", "corpus"]
    assert column(spark, "偏好 Abc", X.lexemes) == ["偏好", "abc"]


LEXEMES = {
    "see http://Example.com/stuff/index.html?a=1 now": ["see", "example.com/stuff/index.html?a=1", "example.com", "/stuff/index.html?a=1", "now"],
    "www.example.org:8080 end.": ["www.example.org:8080", "end"],
    "mail jo.do+x@mail.example.com, thanks": ["mail", "jo.do+x@mail.example.com", "thanks"],
    "up-to-date état-Nation foo-2b jb-1": ["up-to-date", "up", "to", "date", "état-nation", "état", "nation", "foo-2b", "foo", "2b", "jb", "-1"],
    "1.5 -12.25 +3 8.3.0 1.5e-7 2024-01-02 12abc": ["1.5", "-12.25", "+3", "8.3.0", "1.5e-7", "2024", "-01", "-02", "12abc"],
    "and/or /usr/local/lib.txt ~/x": ["and/or", "/usr/local/lib.txt", "~/x"],
    "<a href='x-y'>caf\u00e9 &amp; t\u00e9</a> a < b & c;": ["caf\u00e9", "t\u00e9", "a", "b", "c"],
    "snake_case don't A.b": ["snake", "case", "don", "t", "a.b"],
    "\u504f\u597d\u65e0\u7cd6 ab\u504f": ["\u504f\u597d\u65e0\u7cd6", "ab\u504f"],
    "example.com\u00e9 1e5x": ["example", "com\u00e9", "1e5x"],
    "": [], "-- ... //": [],
}


def test_lexemes(spark):
    got = spark.createDataFrame(list(enumerate(LEXEMES)), "i int, x string").select("i", X.lexemes(F.col("x")).alias("y")).orderBy("i").collect()
    assert {text: r.y for text, r in zip(LEXEMES, got)} == LEXEMES
    assert column(spark, None, X.lexemes) == []


def test_lexemes_of_long_texts(spark):
    sizes = spark.createDataFrame([(t * (1_000_000 // len(t)),) for t in ("a", "a-", "a.", "/a", "<a", "1.", "a@", "é", "偏")], "x string")
    got = [r.n for r in sizes.select(F.size(X.lexemes(F.col("x"))).alias("n")).collect()]
    assert got[0] == got[7] == got[8] == 1 and min(got) > 0


def test_rarest_overlap_and_arms(spark):
    docs = spark.createDataFrame([("c1", "the red fox"), ("c2", "the blue fox"), ("c3", "the the cat"), ("c4", None)], "candidate_id string, text string")
    queries = spark.createDataFrame([("q1", "the red fox"), ("q2", "dog"), ("q3", None), ("q4", "the")], "query_id string, text string")
    hits = retrieval.rarest_overlap(queries, docs, 2, 10)
    assert sorted((r.query_id, r.candidate_id, r.rank) for r in hits.collect()) == [("q1", "c1", 1), ("q1", "c2", 2), ("q4", "c1", 1), ("q4", "c2", 2), ("q4", "c3", 3)]
    gold = spark.createDataFrame([("q1", "c2", 2), ("q2", "c3", 1)], "query_id string, candidate_id string, relevance int")
    arms = hits.withColumn("arm", F.lit("x")).unionByName(hits.where("rank > 1").withColumn("arm", F.lit("y")))
    rows = evaluation.quality(arms, gold, 1, 10, ["x", "y", "z"])
    assert sorted((r.arm, r.query_id, r.recall, r.mrr) for r in rows.collect()) == [(a, q, 0.0, 0.5 if q == "q1" and a != "z" else 0.0) for a in "xyz" for q in ("q1", "q2")]
    assert {r.arm: r.mrr for r in evaluation.arm_aggregate(rows, "arm").collect()} == {"x": 0.25, "y": 0.25, "z": 0.0}


def test_trim_and_quote(spark):
    assert column(spark, " \t x　y \u0085", X.trim_space) == "x　y"
    assert column(spark, 'a"b\\c\n\t', X.quoted) == '"a\\"b\\\\c\\n\\t"'


def test_document_hash(spark):
    row = {"id": "m", "category": "旅行偏好", "memory_key": "座位", "value": "靠窗", "person": "小明", "relationship": "本人", "backstory": "容易晕车\n需要看窗外"}
    # fixed value: the published hash of this document
    want = "70ac7524c8e7f76d793e0193b4aa43e7bc2b926aa4c3edd1869436fdf18a23b5"
    assert cards(spark, [row]).select(F.sha2(X.card_document(), 256).alias("h")).first()["h"] == want


def test_vector_fingerprint_and_validity(spark):
    # fixed value: the published hash of this vector
    want = "2ae6147499e414cb29b626701532c534f03728e8c6e58500d2d943f94649a1f6"
    assert ports.vector_sha256([1, -2.5, 0, -0.0]) == want
    assert column(spark, [1.0, -2.5, 0.0, -0.0], vectors.fingerprint, "array<float>") == want
    for v, ok in (([1.0, 0.0], True), ([0.0, 0.0], False), ([1.0], False), ([float("nan"), 1.0], False), ([float("inf"), 1.0], False)):
        assert column(spark, v, lambda c: vectors.is_valid(c, 2), "array<float>") is ok
    both = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine_arrow("a", "b").alias("y")).first()
    assert both.x == pytest.approx(0.8) and both.y == pytest.approx(0.8)


def test_space_id():
    a = ports.space_id("p", "m", 4, "d", "q", "f")
    assert a.startswith("space_v1_") and len(a) == 73 and a != ports.space_id("p", "m", 5, "d", "q", "f")
    with pytest.raises(ValueError):
        ports.space_id(" ", "m", 4, "d", "q", "f")


def test_generator():
    # fixed values: published outputs for this seed
    draws = SplitMix64(2026081901)
    assert [draws.next() for _ in range(3)] == [16810279466179616732, 7151007997394725314, 18259025032012800547]
    draws = SplitMix64(2026081901)
    assert [draws.below(4) for _ in range(12)] == [0, 2, 3, 3, 2, 3, 1, 0, 2, 1, 3, 2]
    assert SplitMix64(1663341877513419478).below(4611686018427387905) == 3657680391930858827


def test_bm25(spark):
    rows = [{"id": "one", "memory_key": "seat_preference", "value": "window seat", "category": "travel"}, {"id": "two", "memory_key": "meal_preference", "value": "vegetarian meal", "category": "travel"}]
    hits = retrieval.bm25(asked(spark, "preferred vegetarian meal", "!!!", ""), cards(spark, rows), 2, NOW).collect()
    assert [(h.query_id, h.id) for h in hits] == [("q0", "two")]
    # tf, length and document frequency by hand: key counts thrice, value twice
    length, n = 6 + 4 + 1, 2
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    norm = 1.2 * (0.25 + 0.75 * length / length)
    want = idf * 5 * 2.2 / (5 + norm) + idf * 2 * 2.2 / (2 + norm)
    assert hits[0].score == pytest.approx(want, abs=1e-6)
    assert retrieval.bm25(asked(spark, "meal"), cards(spark, rows), 0, NOW).count() == 0


def test_expiry_and_ties(spark):
    rows = [{"id": i, "value": "tea", "expires_us": NOW + d} for i, d in (("past", -1), ("now", 0), ("future", 1))]
    rows += [{"id": "gone", "value": "tea", "status": "superseded"}, {"id": "newer", "value": "tea", "created_us": 5}, {"id": "b", "value": "tea"}]
    for search in (retrieval.bm25, retrieval.full_text):
        got = [h.id for h in search(asked(spark, "tea"), cards(spark, rows), 10, NOW).orderBy("rank").collect()]
        assert got == ["newer", "b", "future"]


def test_full_text_weights(spark):
    rows = [{"id": i, f: "amber"} for i, f in (("key", "memory_key"), ("value", "value"), ("category", "category"), ("backstory", "backstory"))]
    hits = retrieval.full_text(asked(spark, "amber & !amber | ('"), cards(spark, rows), 10, NOW).orderBy("rank").collect()
    assert [(h.id, h.score) for h in hits] == [("key", 1.0), ("value", 0.4), ("category", 0.2), ("backstory", 0.1)]


def test_fusion(spark):
    frame = lambda ids: spark.createDataFrame([("q", x, 0, i + 1) for i, x in enumerate(ids)], "query_id string, id string, created_us long, rank int")
    got = retrieval.reciprocal_rank_fusion(frame("abc"), frame("bda"), 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", pytest.approx(1 / 62 + 1 / 61)), ("a", pytest.approx(1 / 61 + 1 / 63)), ("d", pytest.approx(1 / 62)), ("c", pytest.approx(1 / 63))]
    assert [retrieval.branch_depth(n) for n in (1, 5, 6, 20, 90)] == [20, 20, 24, 80, 100]


def test_versions_against_a_sequential_fold(spark):
    rng = random.Random(11)
    candidates, reviews, erasures = [], [], []
    for i in range(150):
        t = rng.choice("ab")
        candidates.append((t, "u", f"c{i}", rng.choice(["x", " X "]), "k", str(rng.randrange(3)), "", "", rng.randrange(60)))
        reviews.append((t, "u", f"c{i}", "approve" if rng.random() < 0.8 else "reject", rng.randrange(60), i * 2))
    erasures = [("a", "u", 101), ("a", "u", 201)]
    chains, want = {}, {}
    done = {(r[5], 0): r for r in reviews} | {(e[2], 1): e for e in erasures}
    of = {c[2]: c for c in candidates}
    for (seq, is_erasure), row in sorted(done.items()):
        if is_erasure:
            for key in [k for k in chains if k[0] == row[0]]:
                del chains[key]
            for v in want.values():
                v[3] = v[3] or v[4] == row[0]
        elif row[3] == "approve":
            c = of[row[2]]
            key = (row[0], c[3].strip().lower(), c[5])
            n, before, last = chains.get(key, (0, None, None))
            created = max(row[4], c[8]) if before is None else max(row[4], c[8], before + 1)
            if last:
                want[last][2] = created
            chains[key] = (n + 1, created, row[2])
            want[row[2]] = [n + 1, created, None, False, row[0]]
    c = spark.createDataFrame([(*x[:8], x[8]) for x in candidates], "tenant_id string, user_id string, id string, kind string, category string, memory_key string, person string, relationship string, created_us long")
    r = spark.createDataFrame(reviews, "tenant_id string, user_id string, candidate_id string, decision string, reviewed_us long, commit_seq long")
    e = spark.createDataFrame(erasures, "tenant_id string, user_id string, commit_seq long")
    got = {x.id: [x.version, x.card_created_us, x.superseded_us, x.erased, x.tenant_id] for x in lifecycle.card_versions(c, r, e).collect()}
    assert got == want


def test_quality(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "c", 3)], "query_id string, candidate_id string, rank int")
    gold = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1), ("p", "z", 1)], "query_id string, candidate_id string, relevance int")
    got = {r.query_id: r for r in evaluation.quality(hits, gold, 5, 10).collect()}
    assert got["q"].ndcg == pytest.approx((7 + 1 / math.log2(4)) / (7 + 3 / math.log2(3) + 1 / math.log2(4)), abs=1e-8)
    assert got["q"].recall == pytest.approx(2 / 3, abs=1e-8) and got["q"].mrr == 1 and not got["q"].passed
    assert (got["p"].recall, got["p"].mrr, got["p"].ndcg, got["p"].passed) == (0, 0, 0, False)


def test_bootstrap(spark):
    rows = [("arm", "a", 0.0, 0.0, 0.1, 0), ("arm", "b", 0.0, 0.5, 0.3, 0), ("arm", "c", 1.0, 0.5, 0.7, 0), ("arm", "d", 1.0, 1.0, 0.9, 1)]
    df = spark.createDataFrame(rows, "arm string, query_id string, recall double, mrr double, ndcg double, passed int")
    got = {r.metric: (r.lower, r.upper) for r in evaluation.bootstrap(df).collect()}
    # fixed values: published intervals for these samples
    assert got == {"recall": (0, 1), "mrr": (0.125, 0.875), "ndcg": (0.19999999999999998, 0.8), "pass_rate": (0, 0.75)}


def test_retry_backoff_and_rules(spark):
    jobs = spark.createDataFrame([(i, "retry", n, "provider_timeout" if n < 9 else "provider_rejected") for i, n in enumerate((1, 2, 4, 5, 9))], "id int, state string, attempt_count int, last_error_code string")
    got = [(r.state, r.available_us) for r in projection.retry_schedule(jobs, 0).orderBy("id").collect()]
    assert got == [("retry", 1_000_000), ("retry", 2_000_000), ("retry", 8_000_000), ("dead", None), ("dead", None)]
    evidence = spark.createDataFrame([("ok", "text", "user", "s"), ("b\x01d", "  ", "robot", "")], "id string, content string, actor string, session_id string")
    broken = {(r.id, r.rule) for r in validation.violations(evidence, validation.evidence_rules(), "id").collect()}
    assert broken == {("b\x01d", x) for x in ("blank_content", "unknown_actor", "id_characters", "blank_session")}


def test_dataset_and_end_to_end(spark):
    memory = {"kind": "semantic", "category": "travel", "key": "seat", "value": "window seat", "person": "self", "relationship": "self", "backstory": "", "evidence": "I like a window seat"}
    data = {"schema_version": "1", "id": "d", "version": "1", "description": "", "cases": [{"id": "c", "query": "which seat", "memories": [memory, memory | {"key": "meal", "value": "tea"}], "gold_keys": ["seat"]}]}
    loaded = datasets.load_cases(json.dumps(data).encode())
    queries, corpus, gold = datasets.case_frames(spark, loaded, 0)
    hits = retrieval.bm25(queries, corpus, 5, NOW).withColumnRenamed("id", "candidate_id")
    assert evaluation.arm_aggregate(evaluation.quality(hits, gold, 5, 10)).first().pass_rate == 1
    for change in ({"extra": 1}, {"schema_version": "2"}, {"cases": []}, {"cases": data["cases"] * 2}):
        with pytest.raises(datasets.DatasetError):
            datasets.load_cases(json.dumps(data | change).encode())
    for raw in (b'{"id": 1} x', b'{"id": 1, "id": 2}', b"\xff"):
        with pytest.raises(datasets.DatasetError):
            datasets.parse(raw)


def test_timeline():
    ok = [{"op": "evidence.append", "as": "e", "scope": "s", "session_id": "x", "at": "2026-01-01", "actor": "user", "content": "c"}, {"op": "candidate.propose", "as": "c", "scope": "s", "at": "2026-01-02", "source_event_ids": ["e"], "memory": {}, "extractor": "m", "extractor_version": "1"}]
    assert len(datasets.load_timeline(json.dumps(ok).encode())) == 2
    for bad in (ok[::-1], [ok[1]], [{"op": "nope", "at": ""}], [ok[0] | {"more": 1}]):
        with pytest.raises(datasets.DatasetError):
            datasets.load_timeline(json.dumps(bad).encode())


def test_dense_pipeline(spark):
    embedder = ports.HashEmbedder(8)
    kind = ports.Space("p", "m", 8, "d", "q")
    space = kind.id(ports.vector_sha256(embedder.embed(["probe"])[0]))
    corpus = cards(spark, [{"id": "a", "value": "green tea"}, {"id": "b", "value": "black coffee"}])
    stored = ports.embed_frame(corpus.select("tenant_id", "user_id", F.col("id").alias("memory_id"), "value"), "value", embedder)
    search = lambda q: retrieval.vector_search(q, corpus, stored, 1, NOW)
    got = ports.dense_search(asked(spark, "  green tea ", "  "), embedder, "probe", space, kind, search).collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0)]
    with pytest.raises(ports.Unavailable):
        ports.dense_search(asked(spark, "x"), embedder, "other", space, kind, search)
    with pytest.raises(ports.Unavailable):
        ports.dense_search(asked(spark, "x"), ports.HashEmbedder(9), "probe", space, kind, search)


def test_vectors_by_blocks(spark, monkeypatch):
    """One scope holds nearly all queries and cards: blocks give the hits, scores and ranks of the plain join, in groups of bounded size."""
    rng = np.random.default_rng(3)
    owner = lambda i: "u" if i % 50 else "v"
    some = [[float(x) for x in rng.integers(-3, 4, 6)] for _ in range(60)]
    kept = [v for v in some if any(v)]
    held = [("t", owner(i), f"c{i}", 1000 + i % 7, kept[i % len(kept)] if i % 90 else None) for i in range(1500)]
    wanted = [(f"q{i}", "t", owner(i), kept[i * 7 % len(kept)]) for i in range(700)]
    pool = spark.createDataFrame(held, "tenant_id string, user_id string, id string, created_us long, v array<float>")
    queries = spark.createDataFrame(wanted, "query_id string, tenant_id string, user_id string, vector array<float>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 64)
    monkeypatch.setattr(retrieval, "CARD_BLOCK", 128)
    order = [F.desc("score"), F.desc("created_us"), F.col("id")]
    plain = queries.join(pool, ["tenant_id", "user_id"]).select("query_id", "id", "created_us", vectors.cosine(F.col("vector"), F.col("v")).alias("score"))
    want = sorted(map(tuple, retrieval.ranked(plain, 5, *order).collect()))
    got = retrieval.block_hits(queries, pool, 5)
    assert sorted(map(tuple, retrieval.ranked(got, 5, *order).collect())) == want and len(want) == 3500
    dealt = retrieval._dealt(queries, ("__q", 64, "query_id"), ("__c", 128, pool)).groupBy("tenant_id", "user_id", "__q", "__c").count()
    assert dealt.count() > 100 and dealt.agg(F.max("count")).first()[0] <= 2 * 64
    assert retrieval.block_hits(queries.limit(0), pool, 5).count() == 0 == retrieval.block_hits(queries, pool.limit(0), 5).count()


def test_many_queries_of_one_scope(spark, monkeypatch):
    """Whole searches of more queries than are broadcast and of fewer agree."""
    corpus = cards(spark, [{"id": f"m{i}", "value": f"word{i % 9} word{i % 5}"} for i in range(60)])
    held = ports.embed_frame(corpus.select("tenant_id", "user_id", F.col("id").alias("memory_id"), "value"), "value", ports.HashEmbedder(8))
    scope = corpus.select("tenant_id", "user_id").first()
    many = held.select(F.col("memory_id").alias("query_id"), F.lit(scope[0]).alias("tenant_id"), F.lit(scope[1]).alias("user_id"), F.col("embedding").alias("vector"))
    few = sorted(map(tuple, retrieval.vector_search(many, corpus, held, 3, NOW).collect()))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 10)
    assert sorted(map(tuple, retrieval.vector_search(many, corpus, held, 3, NOW).collect())) == few and len(few) == 180


def test_snapshots(spark, tmp_path):
    first, second = Snapshots(spark, f"file://{tmp_path}/s"), Snapshots(spark, f"file://{tmp_path}/s")
    assert first.version() == 0 and first.commit({"t": spark.range(3)}, 0) == 1
    with pytest.raises(Conflict):
        second.commit({"t": spark.range(9)}, 0)
    assert second.commit({"t": spark.range(5)}, 1) == 2
    assert first.read("t").count() == 5 and first.read("t", 1).count() == 3


def test_streams(spark, tmp_path):
    rows = [("t", "u", "a", "one"), ("t", "u", "b", "two"), ("t", "u", "a", "again")]
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, "tenant_id string, user_id string, id string, content string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("tenant_id string, user_id string, id string, content string").parquet(source)
    ingest.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    events = [("j", "enqueue", None, 1), ("j", "claim", "w", 2), ("j", "finish", "w", 3), ("k", "enqueue", None, 1), ("k", "claim", "w", 2), ("k", "claim", "v", 40_000_000), ("k", "finish", "w", 40_000_001), ("x", "claim", "w", 1)]
    schema = "job_id string, event string, owner string, at_us long"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/jobs")
    live = ingest.job_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/jobs"))
    live.writeStream.outputMode("update").format("memory").queryName("jobs_out").trigger(availableNow=True).start().awaitTermination()
    want = {("j", "succeeded", 1, None), ("k", "leased", 2, "v")}
    assert {(r.job_id, r.state, r.attempts, r.owner) for r in spark.table("jobs_out").collect()} == want
    batch = ingest.replay_jobs(spark.createDataFrame(events, schema)).collect()
    assert {(r.job_id, r.state, r.attempts, r.owner) for r in batch} == want


def test_error_codes(spark):
    from recallframe.functions.errors import provider_error_code, status_of

    got = [column(spark, s, provider_error_code, "int") for s in (None, 408, 429, 503, 404, 302)]
    assert got == ["transport", "provider_timeout", "provider_rate_limited", "provider_unavailable", "provider_rejected", "invalid_response"]
    assert [status_of(e) for e in (Conflict(), datasets.DatasetError(), ports.Unavailable(), TimeoutError())] == [409, 500, 503, 504]


def test_first_review_decides_and_later_rows_outlive_an_erasure(spark):
    scope = "tenant_id string, user_id string, "
    reviews = spark.createDataFrame([("t", "u", "c1", "reject", 5, 1), ("t", "u", "c1", "approve", 6, 2), ("t", "u", "c2", "approve", 7, 3), ("t", "u", "c2", "approve", 8, 4)], scope + "candidate_id string, decision string, reviewed_us long, commit_seq long")
    got = {r.candidate_id: (r.decision, r.reviewed_us) for r in lifecycle.first_reviews(reviews).collect()}
    assert got == {"c1": ("reject", 5), "c2": ("approve", 7)}
    rows = spark.createDataFrame([("t", "u", "a", 1), ("t", "u", "b", 9), ("t", "v", "c", 1)], scope + "id string, commit_seq long")
    marks = spark.createDataFrame([("t", "u", 4), ("t", "u", 5)], scope + "commit_seq long")
    assert sorted(r.id for r in lifecycle.forget(rows, marks).collect()) == ["b", "c"]
    assert [r.id for r in lifecycle.erased(rows, marks).collect()] == ["a"]
    assert [r.id for r in lifecycle.forget(rows.drop("commit_seq"), marks).collect()] == ["c"]


def test_bounded_draws_are_the_generator_s():
    from recallframe.functions.rng import SplitMix64, bounded_draws

    for bound in (1, 3, 20, (1 << 63) + 1):
        one, many = SplitMix64(7), bounded_draws(7, bound)
        want = [one.below(bound) for _ in range(300)]
        assert [int(x) for x in [*many(100), *many(200)]] == want if bound < 1 << 62 else len(many(50)) == 50


def test_leases_are_fenced_by_owner_version_and_time(spark):
    jobs = spark.createDataFrame([(i, "leased", "w", 3, 10 + i, "transport", 0) for i in range(4)], "id long, state string, lease_owner string, lease_version long, lease_until_us long, last_error_code string, available_us long")
    asked = spark.createDataFrame([(0, "w", 3, "retry", "provider_timeout", 5), (1, "w", 2, "dead", None, None), (2, "x", 3, "dead", None, None), (3, "w", 3, "cancel", None, None)], "id long, lease_owner string, lease_version long, verb string, code string, backoff_us long")
    got = {r.id: (r.outcome, r.state, r.last_error_code, r.available_us) for r in projection.transition(jobs, asked, 10).collect()}
    assert got == {0: ("lease_lost", "leased", "transport", 0), 1: ("lease_lost", "leased", "transport", 0), 2: ("lease_lost", "leased", "transport", 0), 3: ("applied", "cancelled", "transport", 10)}
    assert projection.transition(jobs, asked, 9).where("id = 0").select("outcome", "state", "last_error_code", "available_us").first() == ("applied", "retry", "provider_timeout", 14)


def test_policy_of_empty_and_forbidden(spark):
    from recallframe.operators import evaluation

    queries = spark.createDataFrame([("a", "t", "u"), ("b", "t", "u"), ("c", "t", "u")], "query_id string, tenant_id string, user_id string")
    cards = spark.createDataFrame([("m1", "t", "u", "active", None, "c1")], "id string, tenant_id string, user_id string, status string, expires_us long, candidate_id string")
    links = spark.createDataFrame([("t", "u", "c1")], "tenant_id string, user_id string, candidate_id string")
    hits = spark.createDataFrame([("a", "t", "u", "m1", 1), ("b", "t", "u", "m1", 1)], "query_id string, tenant_id string, user_id string, id string, rank int")
    empty = queries.where("query_id in ('b', 'c')")
    rows = evaluation.policy(hits, queries, cards, links, hits.limit(0), 5, 10, require_empty=empty)
    got = {r.query_id: r for r in rows.collect()}
    assert {k: (r.require_empty_failure, r.passed) for k, r in got.items()} == {"a": (False, True), "b": (True, False), "c": (False, True)}
    (total,) = evaluation.policy_totals(rows.selectExpr("*", "'x' AS arm")).collect()
    assert (total.query_count, total.require_empty_failures, total.all_passed) == (3, 1, False)


def test_grounding_of_one_batch_each(spark):
    from recallframe.operators import validation

    scope = "tenant_id string, user_id string, "
    evidence = spark.createDataFrame([("t", "u", "e1", "said so"), ("t", "u", "e2", "x" * 70_000), ("t", "u", "e3", "")], scope + "id string, content string")
    cases = {  # batch: proposals of (candidate, identity), supports of (candidate, evidence, quote), accepted
        "fine": ([("c1", "i1"), ("c2", "i2")], [("c1", "e1", "said"), ("c2", "e1", "so")], True),
        "unsaid": ([("c1", "i1")], [("c1", "e1", "never")], False),
        "missing": ([("c1", "i1")], [("c1", "e9", "said")], False),
        "null quote": ([("c1", "i1")], [("c1", "e1", None)], False),
        "twice": ([("c1", "i1")], [("c1", "e1", "said"), ("c1", "e1", "so")], False),
        "one identity": ([("c1", "i1"), ("c2", "i1")], [("c1", "e1", "said"), ("c2", "e1", "so")], False),
        "no support": ([("c1", "i1"), ("c2", "i2")], [("c1", "e1", "said")], False),
        "none at all": ([("c1", "i1")], [], False),
        "long evidence": ([("c1", "i1")], [("c1", "e2", "x")], False),
        "many": ([(f"c{i}", f"i{i}") for i in range(11)], [(f"c{i}", "e1", "said") for i in range(11)], False),
        "ten": ([(f"c{i}", f"i{i}") for i in range(10)], [(f"c{i}", "e1", "said") for i in range(10)], True),
    }
    proposals = spark.createDataFrame([("t", "u", b, *p) for b, (ps, _, _) in cases.items() for p in ps], scope + "batch_id string, candidate_id string, identity_key string")
    supports = spark.createDataFrame([("t", "u", b, *x) for b, (_, xs, _) in cases.items() for x in xs], scope + "batch_id string, candidate_id string, evidence_id string, quote string")
    got = {r.batch_id: r.accepted for r in validation.grounding(supports, evidence, proposals).collect()}
    assert got == {b: ok for b, (_, _, ok) in cases.items()}


def test_json_maps(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": ""}), (2, {}), (3, None)], "id int, m map<string,string>")
    coded = rows.withColumn("j", X.json_map(F.col("m"))).withColumn("back", X.map_of_json(F.col("j")))
    assert [(r.j, r.back) for r in coded.orderBy("id").collect()] == [('{"a":"x","b":""}', {"a": "x", "b": ""}), ("{}", {}), ("{}", {})]
    odd = spark.createDataFrame([("nonsense",), (None,)], "j string").select(X.map_of_json(F.col("j")).alias("m"))
    assert [r.m for r in odd.collect()] == [{}, {}]


def test_first_missing(spark):
    evidence = spark.createDataFrame([("t", "u", "a", "x"), ("t", "v", "b", "y")], "tenant_id string, user_id string, id string, content string")
    requests = spark.createDataFrame(
        [("1", "t", "u", ["a", "a"]), ("2", "t", "u", ["a", "b", "c"]), ("3", "t", "u", []), ("4", "t", "u", None), ("5", "t", "u", ["a", None])],
        "request_id string, tenant_id string, user_id string, ids array<string>",
    )
    assert sorted(tuple(r) for r in context.first_missing(requests, evidence).collect()) == [("2", "t", "u", 1, "b"), ("5", "t", "u", 1, None)]


def test_bm25_of_several_scopes(spark):
    rows = [dict(id="a", value="red apple apple"), dict(id="b", value="red pear"), dict(id="c", value="")]
    corpus = cards(spark, rows)
    other = corpus.withColumn("user_id", F.lit("else")).withColumn("id", F.concat(F.lit("x"), "id"))
    alone = retrieval.bm25(asked(spark, "red apple", ""), corpus, 5, NOW).collect()
    both = retrieval.bm25(asked(spark, "red apple", ""), corpus.unionByName(other), 5, NOW).collect()
    assert alone and alone == both
