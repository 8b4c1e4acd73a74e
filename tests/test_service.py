import pytest

from recallframe.operators import retrieval
from recallframe.operators.context import Untrusted
from recallframe.service import LOGS, Invalid, MemoryService, NotFound
from recallframe.sources.snapshots import Conflict


def test_from_evidence_to_erasure(spark, tmp_path):
    service = MemoryService(spark, f"file://{tmp_path}/state")
    frame = lambda log, *rows: spark.createDataFrame(list(rows), LOGS[log])
    evidence = frame("evidence", ("t", "u", "e1", "s", "user", "I like green tea", 1), ("t", "v", "e1", "s", "user", "coffee", 1))
    assert service.append_evidence(evidence) == 1
    with pytest.raises(Conflict):
        service.append_evidence(evidence)
    with pytest.raises(Invalid):
        service.append_evidence(frame("evidence", ("t", "u", "e2", "s", "robot", "x", 1)))
    candidate = lambda i, value: frame("candidates", ("t", "u", i, "semantic", "drink", "tea", value, "", "", "", 2, None))
    link = lambda i, e="e1": frame("links", ("t", "u", i, e, 0))
    service.propose(candidate("c1", "green tea"), link("c1"))
    with pytest.raises(Invalid):
        service.propose(candidate("c9", "tea"), link("c9", "missing"))
    queries = spark.createDataFrame([("q", "t", "u", "which tea"), ("p", "t", "v", "which tea")], "query_id string, tenant_id string, user_id string, text string")
    items = lambda: {r.query_id: [(i["value"], [s["evidence_id"] for s in i["sources"]]) for i in r["items"]] for r in service.context_packs(queries, 100).collect()}
    assert items() == {"q": [], "p": []}  # nothing is served before its approval
    review = lambda i, n, d="approve": frame("reviews", ("t", "u", i, d, 5, n))
    service.review(review("c1", 1))
    assert items() == {"q": [("green tea", ["e1"])], "p": []}
    with pytest.raises(Conflict):
        service.review(review("c1", 2))
    with pytest.raises(NotFound):
        service.review(review("nope", 2))
    service.propose(candidate("c2", "black tea"), link("c2"))
    service.review(review("c2", 2))
    assert items()["q"] == [("black tea", ["e1"])]
    assert sorted((c.version, c.status) for c in service.cards().collect()) == [(1, "superseded"), (2, "active")]
    receipt = service.forget_user(frame("erasures", ("t", "u", 3))).first()
    assert (receipt.evidence_deleted, receipt.candidates_deleted, receipt.cards_deleted) == (1, 2, 2)
    assert items() == {"q": [], "p": []} and service.cards().count() == 0
    with pytest.raises(Invalid):
        service.context_packs(queries, 100, 21)


def _frames(spark):
    return lambda log, *rows: spark.createDataFrame(list(rows), LOGS[log])


def _filled(spark, folder, *scopes):
    """A service with one approved card c1 of each scope, all of the same ids."""
    service, frame = MemoryService(spark, folder), _frames(spark)
    service.append_evidence(frame("evidence", *[(*s, "e1", "s", "user", f"tea of {s}", 1) for s in scopes]))
    service.propose(frame("candidates", *[(*s, "c1", "semantic", "drink", "tea", f"tea of {s}", "", "", "", 2, None) for s in scopes]), frame("links", *[(*s, "c1", "e1", 0) for s in scopes]))
    service.review(frame("reviews", *[(*s, "c1", "approve", 5, 1) for s in scopes]))
    return service


QUERY = "query_id string, tenant_id string, user_id string, text string"


def test_scopes_with_the_same_ids_keep_apart(spark, tmp_path):
    service = _filled(spark, f"file://{tmp_path}/state", ("a", "u"), ("b", "u"))
    asked = spark.createDataFrame([("qa", "a", "u", "tea"), ("qb", "b", "u", "tea")], QUERY)
    for search in (retrieval.full_text, retrieval.bm25):
        packs = {r.query_id: r["items"] for r in service.context_packs(asked, 100, search=search).collect()}
        for q in ("a", "b"):
            (item,) = packs[f"q{q}"]
            assert item["value"] == f"tea of ('{q}', 'u')" and [s["content"] for s in item["sources"]] == [f"tea of ('{q}', 'u')"]


def test_packs_are_built_anew_if_their_scope_changes(spark, tmp_path):
    service, frame = _filled(spark, f"file://{tmp_path}/state", ("a", "u"), ("b", "u")), _frames(spark)
    asked = spark.createDataFrame([("q", "a", "u", "tea")], QUERY)
    calls = []

    def meanwhile(change):
        def search(queries, cards, limit, at):
            rows = retrieval.full_text(queries, cards, limit, at).select("query_id", "id", "created_us", "score", "rank").collect()
            hits = spark.createDataFrame(rows, "query_id string, id string, created_us long, score double, rank int")
            calls.append(1)
            change(len(calls))
            return hits

        return search

    def other(n):  # another scope's revision doesn't matter, nor does new evidence
        if n == 1:
            service.forget_user(frame("erasures", ("b", "u", 2)))
            service.append_evidence(frame("evidence", ("a", "u", "e2", "s", "user", "more", 1)))

    assert len(service.context_packs(asked, 100, search=meanwhile(other)).first()["items"]) == 1 and len(calls) == 1

    def once(n):
        if n == 2:
            service.forget_user(frame("erasures", ("a", "u", 3)))

    assert service.context_packs(asked, 100, search=meanwhile(once)).first()["items"] == [] and len(calls) == 3

    def always(n):
        service.forget_user(frame("erasures", ("a", "u", 10 + n)))

    with pytest.raises(Conflict):
        service.context_packs(asked, 100, search=meanwhile(always))
    assert len(calls) == 6
    assert [r.context_revision for r in service.revisions(asked).collect()] == [1 + 1 + 3]


def test_hits_that_may_not_be_served_refuse_the_pack(spark, tmp_path):
    service = _filled(spark, f"file://{tmp_path}/state", ("a", "u"), ("b", "u"))
    asked = spark.createDataFrame([("q", "a", "u", "tea")], QUERY)
    hit = "query_id string, tenant_id string, user_id string, id string, created_us long, score double, rank int"
    for tenant, id_ in (("b", "m1"), ("a", "nowhere")):
        with pytest.raises(Untrusted):
            service.context_packs(asked, 100, search=lambda *_, t=tenant, i=id_: spark.createDataFrame([("q", t, "u", i, 1, 1.0, 1)], hit))
    assert len(service.context_packs(asked, 100, search=lambda *_: spark.createDataFrame([("q", "a", "u", "m1", 1, 1.0, 1)], hit)).first()["items"]) == 1


def test_writers_of_one_version(spark, tmp_path, monkeypatch):
    first, frame = _filled(spark, f"file://{tmp_path}/state", ("a", "u")), _frames(spark)
    second = MemoryService(spark, f"file://{tmp_path}/state")
    rows = frame("evidence", ("a", "u", "e2", "s", "user", "x", 1))
    refuse = second._refuse
    # the other one commits between check and commit
    monkeypatch.setattr(second, "_refuse", lambda broken: (refuse(broken), first.append_evidence(rows)))
    with pytest.raises(Conflict):
        second.append_evidence(rows)
    assert first.snapshots.read("evidence").where("id = 'e2'").count() == 1
    before = first.snapshots.version()
    assert first.forget_user(frame("erasures").limit(0)).count() == 0 and first.snapshots.version() == before
    assert first.forget_user(frame("erasures", ("x", "y", 9))).first().cards_deleted == 0


def test_a_commit_that_breaks_off_leaves_the_last_version(spark, tmp_path, monkeypatch):
    from recallframe import session
    from recallframe.sources import snapshots

    folder = f"file://{tmp_path}/s"
    one = snapshots.Snapshots(spark, folder)
    one.commit({"t": spark.range(3), "u": spark.range(1)}, 0)

    def broken(*_):
        raise RuntimeError("lost")

    for at in ("before the version is named", "between draft and name"):
        with monkeypatch.context() as m:
            m.setattr(snapshots, "publish", broken)
            if at.startswith("between"):
                session.delete(spark, f"{folder}/markers.drafts")
                path = one._path(f"{folder}/markers.drafts/half")
                out = one._fs.create(path, False)
                out.write(bytearray(b'{"t": ['))
                out.close()
            with pytest.raises(RuntimeError):
                one.commit({"t": spark.range(9)}, 1)
        assert one.version() == 1 and one.read("t").count() == 3
    assert one.commit({}, 1, added={"t": spark.range(2)}) == 2 and one.read("t").count() == 5 and one.read("u").count() == 1 and one.read("t", 1).count() == 3


def test_published_files_are_whole_and_never_replaced(spark, tmp_path):
    from recallframe.session import publish, published

    path = f"file://{tmp_path}/marks/one"
    assert publish(spark, path, "first") and not publish(spark, path, "second") and published(spark, path) == "first"
    assert sorted(p.name for p in (tmp_path / "marks").iterdir()) == ["one"] and not [p for p in (tmp_path / "marks.drafts").iterdir() if not p.name.endswith(".crc")]
