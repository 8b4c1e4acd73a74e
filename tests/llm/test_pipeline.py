import re

import corpus_pipeline as P
from recallframe.llm import bpe, queries, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe_encoding"]
    for name, stage in P.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert name == "bpe_encoding" or frames[-1].columns == columns
    rows = [f.collect() for f in frames]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [[r.doc_id for r in x] for x in rows]
    # toxicity: clean documents stay, rejected ones are those of the scores
    assert set(ids[1]) <= set(ids[0]) and sum(labels.get(d) == 0 for d in ids[1]) >= 0.9 * sum(v == 0 for v in labels.values())
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(ids[1]) == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    # line dedup: all rows stay, texts only lose lines
    before, after = {r.doc_id: r for r in rows[1]}, {r.doc_id: r for r in rows[2]}
    assert set(before) == set(after)
    for d, r in after.items():
        assert set(r.text.split("\n")) <= set(before[d].text.split("\n")) | {""} and r.n_chars == len(r.text)
    # near-dedup: texts are as they were, every gone document has a near copy that stays
    assert set(ids[3]) <= set(ids[2]) and len(set(ids[3])) == len(ids[3])
    stay = [(d, shingles(after[d].text)) for d in ids[3]]
    for d in set(ids[2]) - set(ids[3]):
        s = shingles(after[d].text)
        assert any(len(s & t) >= 0.6 * len(s | t) for _, t in stay if s or not t), d
    # mixing: copies of rows, near the targets in sum
    words = lambda x: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in x)
    assert max(ids[4].count(d) for d in ids[4]) <= 2 and abs(words(rows[4]) - 1.5 * words(rows[3])) < 0.05 * words(rows[3])
    # encoding: a row for each row, and an exact round trip
    coder = bpe.codec(queries.RANKS, queries.PATTERN)
    assert sorted((r.doc_id, coder.decode(r.token_ids).decode()) for r in rows[5]) == sorted((r.doc_id, r.text) for r in rows[4])


def test_empty_and_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "same", "en", "s", 4), (1, "same", "en", "s", 4)], docs.schema)
    for name, frame in (("none", docs.limit(0)), ("odd", odd)):
        for stage, f in P.STAGES:
            f(spark, frame, SF).write.parquet(f"{tmp_path}/{name}/{stage}")
            frame = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        assert (frame.count() == 0) == (name == "none")


def test_near_dedup_tells_rows_apart(spark):
    """Null and repeated ids with different texts all stay; near copies and equal rows go."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = lambda k: " ".join(f"d{k}w{i}" for i in range(60))
    rows = [(None, own(k), "en", "s", 9) for k in range(5)] + [(7, own(k), "en", "s", 9) for k in range(10, 16)]
    rows += [(7, own(10) + " more", "en", "s", 9), (None, own(0) + " more", "en", "s", 9), (8, own(20), "en", "s", 9), (8, own(20), "en", "s", 9), (9, own(20), "de", "t", 9)]
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    texts = [r.text.removesuffix(" more") for r in got]
    assert sorted(texts) == sorted({own(k) for k in [*range(5), *range(10, 16), 20]})
    assert next(r.doc_id for r in got if r.text == own(20)) == 8


def test_mixing_with_null_and_repeated_ids(spark):
    """Words meet the targets within one document, whatever the ids."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sizes = [(i * 37) % 90 + 5 for i in range(600)]
    rows = [(None if i % 3 == 0 else i % 7, " ".join(["w"] * n) + f" {i % 11}", "en", f"s{i % 2}", 9) for i, n in enumerate(sizes)]
    got = P.mix_sources(spark, spark.createDataFrame(rows, schema), SF).collect()
    words = lambda x, s: sum(len(r[1].split()) for r in x if r[3] == s)
    total = words(rows, "s0") + words(rows, "s1")
    first = min(2 * words(rows, "s0"), 1.5 * total * 3 / 4)
    assert abs(words(got, "s0") - first) <= 100 and abs(words(got, "s1") - (1.5 * total - first)) <= 100


def test_toxicity_sends_texts_once(spark):
    """The Python workers get the columns of the documents, each once, and rows come back as they were."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9), (None, None, None, None, None), (1, "", "en", "s", 0)], schema)
    got = P.drop_toxic(spark, docs, SF)
    node = got._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().apply(0)
    assert node.children().apply(0).output().size() == len(docs.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
