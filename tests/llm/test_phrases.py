import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from recallframe.llm import phrases, queries

SF = "/root/testdata/sf0.01"


def grams_of(text, most):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        words = re.findall(r"[^\x20\x09]+", piece)
        for n in range(1, most + 1):
            for i in range(len(words) - n + 1):
                yield tuple(words[i : i + n])


def brute(docs, least, most, reported):
    out = []
    for lang in {x or "und" for x, _ in docs}:
        f = Counter(g for own, t in docs if (own or "und") == lang for g in grams_of(t, most))
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = [g for g, c in f.items() if c >= least and len(g) > 1]
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p in found:
            if not any(inside(p, q) and f[q] >= f[p] for q in found):
                score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(sorted(rows)[:reported])]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_op13_against_brute_force_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op13_phrases(spark, SF)
    assert dict(got.dtypes) == {"lang": "string", "rank": "int", "phrase": "string", **{c: "bigint" for c in ("a", "l", "r", "n", "score")}}
    want = brute(con.execute("SELECT lang, text FROM documents").fetchall(), 100, 5, 2000)
    assert want and rows(got) == want == sorted(con.execute(phrases.ORACLE).fetchall())


@pytest.mark.parametrize("depth", [2, 3, 5, 6])
def test_walks_count_all_ngrams(depth):
    rng = np.random.default_rng(depth)
    for n, vocabulary in ((1, 2), (2, 3), (40, 3), (500, 5), (2000, 40)):
        sequence = np.concatenate(([0], rng.integers(0, vocabulary, n), [0]))
        want = {}
        for size in range(2, depth + 1):
            windows = Counter(tuple(sequence[i : i + size].tolist()) for i in range(len(sequence) - size + 1))
            want |= {w: c for w, c in windows.items() if 0 not in w}
        got = {}
        for words, count in phrases.walk(sequence, depth):
            own = dict(zip(map(tuple, words.tolist()), count.tolist(), strict=True))
            assert len(own) == len(count)  # each n-gram once
            got |= own
        assert got == want


def test_many_shards(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(phrases, "SHARD", 300)
    monkeypatch.setattr(phrases, "HELD", 700)
    words = ["a", "B", "c", "dd", "é", "a"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", " "]) for _ in range(rng.randrange(40)))
    docs = [(rng.choice(["en", "en", "fr", None]), text()) for _ in range(300)]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    for least, most in ((20, 5), (3, 3), (15, 2)):
        want = brute(docs, least, most, 50)
        assert want and rows(phrases.collocations(frame, least=least, most_words=most, reported=50)) == want


def test_odd_tables(spark):
    schema = "lang string, text string, n long, shard long, phrase string"
    odd = [("en", None, 1, 1, "x"), ("en", "", 1, 1, "x"), (None, " \t\n", 1, 1, "x"), ("und", "a b", 1, 1, "x"), (None, "A B a b", 1, 1, "x"), ("en", "x y. " * 30_000, 1, 1, "x"), ("en", "x" * 100_000, 1, 1, "x"), ("xx", "\x00 \x1c \x00 \x1c", 1, 1, "x")]
    odd += [("fr", "même ligne", 1, 1, "x")] * 4
    frame = spark.createDataFrame(odd, schema)
    want = brute([r[:2] for r in odd], 2, 5, 10)
    assert rows(phrases.collocations(frame, least=2, reported=10)) == want
    assert phrases.collocations(frame.limit(0)).count() == 0 and phrases.collocations(frame, least=10**6).count() == 0


def test_pairs_meet_as_lists(spark):
    """A shard hands on a row for each part, however many of its pairs may be frequent, and no pair or count is lost."""
    rng = np.random.default_rng(8)
    sequences = [np.concatenate(([0], rng.integers(0, 60, 5000), [0])) for _ in range(6)]
    rows = [(i, len(s), phrases._packed(s)) for i, s in enumerate(sequences)]
    frame = spark.createDataFrame(rows, "shard long, n int, ids binary").repartition(3)
    every = np.packbits(np.ones(1 << phrases.BUCKETS, bool)).tobytes()
    each = [Counter((a << 32 | b) for a, b in zip(s.tolist(), s[1:].tolist(), strict=False) if a and b) for s in sequences]
    total = sum(each, Counter())
    want = {p: n for p, n in total.items() if n >= 8}
    got = phrases.frequent_pairs(frame, every, 4, 8).collect()
    assert 0 < len(want) < len(total) and len(got) <= 4 * (len(sequences) + 1)
    assert {p: n for r in got if r.shard is None for p, n in zip(r.pairs, r.f, strict=True)} == want
    for i, own in enumerate(each):
        mine = [p for r in got if r.shard == i for p in r.pairs]
        assert sorted(mine) == sorted(p for p in own if p in want)
