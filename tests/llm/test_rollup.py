import uuid
from collections import Counter

import public_tokenizers as P

from recallframe.llm import bpe, queries, rollup
from recallframe.session import shared_dir

SF = "/root/testdata/sf0.001"


def test_op9_against_recount(spark):
    own = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    low = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    want = Counter()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if d.doc_id not in low:
            for t, n in (("byte_bpe_50k", len(own.encode(d.text)) // 4), ("utf8_bytes_v1", len(d.text.encode()))):
                want.update({(d.source, d.lang, t, "d"): 1, (d.source, d.lang, t, "t"): n, (d.source, d.lang, t, "c"): len(d.text)})
    got = Counter()
    for r in queries.op9_token_counts(spark, SF).collect():
        got.update({(r.source, r.lang, r.tokenizer, "d"): r.n_docs, (r.source, r.lang, r.tokenizer, "t"): r.n_tokens, (r.source, r.lang, r.tokenizer, "c"): r.n_chars})
    assert got == want


def test_commits_and_compaction(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    totals = rollup.Rollup(spark, folder)
    assert totals.totals().count() == 0
    rows = spark.createDataFrame([("a", "en", "v1", 5, 9, "x")] * 3 + [(None, None, "v1", None, 2, "x")], "source string, lang string, tokenizer string, n_tokens long, n_chars long, extra string")
    assert totals.commit("one", rollup.inserted(rows)) and not totals.commit("one", rollup.inserted(rows))
    assert not rollup.Rollup(spark, folder).commit("one", rollup.inserted(rows))
    read = lambda: sorted(map(tuple, totals.totals().collect()), key=str)
    assert read() == [("a", "en", "v1", 3, 15, 27), (None, None, "v1", 1, 0, 2)]
    one = rows.limit(1)
    totals.commit("two", rollup.revised(one, spark.createDataFrame([("b", "en", "v2", 7, 9)], "source string, lang string, tokenizer string, n_tokens long, n_chars long")))
    before = read()
    totals.compact()
    assert read() == before and not totals.commit("two", rollup.inserted(rows)) and totals.committed("one") and totals.committed("two")
    totals.commit("three", rollup.deleted(rows.where("source is null")))
    totals.commit("empty", rollup.inserted(rows.limit(0)))
    assert all(r[0] is not None for r in read())
    totals.compact()
    assert all(r[0] is not None for r in read()) and all(map(totals.committed, ("one", "two", "three", "empty")))
    totals.compact()
    assert totals._names("open") == [] and len(totals._names("rows")) == 2  # the newest base and the one before


ROWS = "source string, lang string, tokenizer string, n_tokens long, n_chars long"


def test_a_broken_batch_is_written_anew(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    totals = rollup.Rollup(spark, folder)
    rows = rollup.inserted(spark.createDataFrame([("a", "en", "v1", 5, 9)], ROWS))
    totals.commit("one", rows)
    totals._fs.delete(totals._at("open", "one"), False)  # as if the run had ended before its mark
    assert totals.totals().count() == 0 and totals.commit("one", rows)
    assert [r.n_tokens for r in totals.totals().collect()] == [5]


def test_one_of_two_writers_wins_and_compaction_counts_no_batch_twice(spark, monkeypatch):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    first, second = rollup.Rollup(spark, folder), rollup.Rollup(spark, folder)
    rows = rollup.inserted(spark.createDataFrame([("a", "en", "v1", 5, 9)], ROWS))
    # the second writer looks before the first one's mark is there
    monkeypatch.setattr(second, "committed", lambda _: False)
    assert first.commit("one", rows) and not second.commit("one", rows)
    tokens = lambda: sum(r.n_tokens for r in first.totals().collect())
    assert tokens() == 5
    # a batch is committed between a compaction's listing and its base
    sums = second._sum
    monkeypatch.setattr(second, "_sum", lambda names: first.commit("two", rows) and sums(names))
    assert second.compact() and tokens() == 10
    monkeypatch.undo()
    # of two compactions from one base one counts
    monkeypatch.setattr(second, "_sum", lambda names: first.compact() and sums(names))
    assert not second.compact() and tokens() == 10
    monkeypatch.undo()
    assert first.compact() and tokens() == 10 and not first.commit("two", rows) and tokens() == 10


def test_a_writer_that_breaks_off_leaves_no_mark(spark, monkeypatch):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    totals = rollup.Rollup(spark, folder)
    rows = rollup.inserted(spark.createDataFrame([("a", "en", "v1", 5, 9)], ROWS))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rollup, "publish", broken)
        try:
            totals.commit("one", rows)
        except RuntimeError:
            pass
    assert not totals.committed("one") and totals.totals().count() == 0
    assert totals.commit("one", rows) and [r.n_tokens for r in totals.totals().collect()] == [5]
    # a second writer whose first look comes before the mark and whose second comes after it is folded
    late = rollup.Rollup(spark, folder)
    monkeypatch.setattr(late, "committed", lambda _: False)
    totals.compact()
    totals.compact()
    assert not late.commit("one", rows) and [r.n_tokens for r in totals.totals().collect()] == [5] and totals._names("open") == []
