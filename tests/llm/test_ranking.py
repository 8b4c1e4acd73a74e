import math
import random
import re
from collections import Counter

import duckdb

from recallframe.llm import queries, ranking

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item, rank, doc, score) of all items, every document scored."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, bag in bags:
            n = sum(bag.values())
            m = 10 + 90 * n * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    for text in ("Ünï A_b-c 9x y z", "", "...", "ABC\x7fdef\u0080g"):
        assert [t.decode() for t in ranking.terms_of(text.encode())] == terms(text)
    assert ranking.terms_of(None) == []


def test_op12_against_brute_force_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    docs, items = (con.execute(f"SELECT {c}, text FROM {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    got = queries.op12_ranking(spark, SF)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows(got) == brute(docs, items, 10) == sorted(con.execute(ranking.ORACLE).fetchall(), key=str)


def test_limits_lose_nothing(spark, monkeypatch):
    # small shards, several of them in a task; frequent and rare words, many ties
    rng = random.Random(2)
    monkeypatch.setattr(ranking, "SHARD", 16)
    words = [f"w{int(x)}" for x in (rng.paretovariate(0.6) for _ in range(4000))]
    docs = [(i, " ".join(rng.choice(words[:500]) for _ in range(rng.randrange(1, 30)))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(50)] + [(7, docs[7][1])] * 3
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(30)] + [(99, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ranking.search(frame, asked, 5)) == brute(docs, items, 5)
    monkeypatch.setattr(ranking, "BLOCK", 7)  # several blocks of queries
    assert rows(ranking.search(frame, asked, 5)) == brute(docs, items, 5)


def test_fewer_accumulators_than_documents():
    import numpy as np

    # term 0 in one document, term 1 in all: the rare one's score can't be reached
    n, offsets = np.full(100, 10), np.concatenate(([0], 2 + np.arange(100)))
    terms_, tf = np.array([0, *[1] * 100]), np.ones(101, int)
    shard = ranking.Shard(n, offsets, terms_, tf, np.array([9000, 5]), 100, 1000)
    found, scores = shard.search([0, 1], 1, 1)
    assert found.tolist() == [0] and scores.tolist() == [9005 * (10**9 // (1000 + 8 * 100))]
    assert len(shard.search([0, 1], 2, 1)[0]) == 100 and not len(shard.search([1], 1, 10**18)[0])


def test_odd_tables(spark):
    schema = "doc_id long, text string, rank int, score long"
    docs = [(None, "Apple pie", 1, 1), (2, None, 1, 1), (3, "", 1, 1), (4, "!!! ---", 1, 1), (5, "apple APPLE", 1, 1), (5, "apple APPLE", 1, 1), (6, "x" * 100_000 + " pie", 1, 1)]
    frame = spark.createDataFrame(docs, schema)
    items = [(1, "Apple"), (1, "pie?"), (None, "apple pie"), (2, None), (3, "..."), (4, "none"), (5, "x" * 100_000)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    plain = [d[:2] for d in docs]
    assert rows(ranking.search(frame, asked, 10)) == brute(plain, items, 10)
    assert ranking.search(frame.limit(0), asked, 10).count() == 0 and ranking.search(frame, asked.limit(0), 10).count() == 0
