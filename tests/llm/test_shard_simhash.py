import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from recallframe.llm import queries, shard, simhash
from recallframe.llm.components import components


def test_permutation_is_one_and_inverts():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = shard.permute(np.arange(n), n, seed=9)
        assert sorted(p.tolist()) == list(range(n))
        assert (shard.permute(p, n, 9, inverse=True) == np.arange(n)).all()


def test_shards_of_frames(spark):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else "x" * (i % 4), 99) for i in range(300)] + [(5, "same", 1)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard.assign(df, ["doc_id", "text"], 16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 500 and {len(v) for v in by.values()} <= {31, 32}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shard.assign(df.limit(0), ["doc_id"], 16).count() == 0


def test_row_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "doc_id long").repartition(7)
    numbered, n = shard.number_rows(df, ["doc_id"])
    assert n == 1000 and all(r.doc_id == r.row_number for r in numbered.collect())


def test_op2_over_the_table(spark):
    got = queries.op2_shard(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = {d: k for k, d in enumerate(sorted(docs))}
    p = shard.permute(np.arange(len(docs)), len(docs), 1)
    assert len(got) == len(docs)
    for r in got:
        b = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        assert (r.shard, r.slot) == (p[order[r.doc_id]] % 16, p[order[r.doc_id]] // 16)


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(prints):
    ids = list(prints)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


def test_op8_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in sorted(docs.items())}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def test_fingerprints_of_odd_texts(spark):
    texts = [None, "", " \n", "One", "one  TWO", "Ää B c d", "a b c " * 500, "a b c " * 500]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def test_links_with_small_and_large_buckets(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for i in range(500):
        x = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(x), 5) for i, x in prints.items()], "doc_id long, fp long, component_id int")
    want = brute_components(prints)
    for bucket in (simhash.BUCKET, 1, 4):
        simhash.BUCKET, old = bucket, simhash.BUCKET
        try:
            distinct = df.select("fp").distinct()
            edges = simhash.links(distinct, bucket=bucket)
            labels = {r.node: r.label for r in components(edges.select(edges.a.alias("u"), edges.b.alias("v"))).collect()}
        finally:
            simhash.BUCKET = old
        least = {}
        for i, x in prints.items():
            k = labels.get(signed(x), signed(x))
            least[k] = min(least.get(k, i), i)
        assert {i: least[labels.get(signed(x), signed(x))] for i, x in prints.items()} == want
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == want
    odd = spark.createDataFrame([(1, None), (1, None), (None, 3), (4, 3), (9, 3)], "doc_id long, fp long")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(odd).collect()) == [("1", 1), ("1", 1), ("4", 4), ("9", 4), ("None", 4)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_op2_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLES["op2_shard"])
    columns = [c[0] for c in want.description]
    got = queries.op2_shard(spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
