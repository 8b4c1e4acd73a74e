import itertools
import math
import os
import time
import zlib

import numpy as np

from recallframe.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 5, 3, 7])
    u, moves = rng.normal(size=16), rng.normal(size=(2, 2))
    got, at = toxicity.marginals(u, lengths, moves), 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(u[at + i] for i in range(n) if path[i]) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            on += w * np.array(path)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_long_chains_by_pieces():
    """Chains around and above PIECE tokens, against one step a token."""
    rng = np.random.default_rng(5)
    lengths = np.array([1, 5000, 3, toxicity.PIECE, toxicity.PIECE + 1, 2 * toxicity.PIECE, 2 * toxicity.PIECE + 1, 10])
    u, moves = 3 * rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    m, own, at = np.exp(moves), np.exp(u), 0
    got = toxicity.messages(u, lengths, moves)
    for n in lengths:
        ahead, behind = np.ones(n), np.ones(n)
        for t in range(n):
            r = ahead[t - 1]
            ahead[t] = own[at + t] * (1 if t == 0 else (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0]))
        for t in range(n - 2, -1, -1):
            x = own[at + t + 1] * behind[t + 1]
            behind[t] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
        assert np.allclose(got[0][at : at + n], ahead) and np.allclose(got[1][at : at + n], behind)
        at += n


def test_one_very_long_line():
    began = time.perf_counter()
    p = toxicity.marginals(np.random.default_rng(6).normal(size=1 << 21), np.array([1 << 21]), np.array([[0.5, -0.5], [-0.2, 0.4]]))
    assert len(p) == 1 << 21 and ((p > 0) & (p < 1)).all() and time.perf_counter() - began < 30


def test_held_out_accuracy_and_shape(spark):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(y == p for y, p in held) >= 0.95 * len(held) and any(y for y, _ in held)


def test_held_out_rates(spark):
    """Rates on the labels that aren't learned; some of the misses hold no word that any learned toxic document has."""
    d = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    caught = [r.predicted for r in got if r.toxic == 1]
    flagged = [r.predicted for r in got if r.toxic == 0]
    assert sum(caught) >= 0.89 * len(caught) > 50 and sum(flagged) <= 0.005 * len(flagged)


def test_tags_are_latent():
    """A stem that clean documents hold now and then still tells, by how often a document has it; its unseen inflections as well."""
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("kal", "nor", "fes", "mub", "tir") for b in ("an", "eth", "ist", "oul")]

    def text(n_stem):
        out = list(rng.choice(words, 80)) + [f"grobnat{rng.integers(1000)}" for _ in range(n_stem)]
        rng.shuffle(out)
        return " ".join(out)

    docs = [(text(5), 1) for _ in range(60)] + [(text(int(rng.random() < 0.2)), 0) for _ in range(400)]
    model = toxicity.fit_documents(docs)
    tried = [text(5) for _ in range(20)] + [text(int(i < 10)) for i in range(50)]
    x = np.concatenate([a for a, *_ in toxicity._tagged(tried, model, toxicity.Memo(model.potential, 1000))])
    assert ((x @ model.document > 0) == (np.arange(70) < 20)).all()
    assert model.potential("grobnatest") > 0 > model.potential("kalan")


def test_starting_tags():
    """Shares beyond chance: of 10 toxic and 90 clean documents, 10 against 0, 10 against 9 (a tenth of its toxic rate), as common, and too few."""
    got = toxicity._starts({"only": 10, "often": 10, "same": 5, "few": 2}, {"only": 0, "often": 9, "same": 45, "few": 0}, 10, 90)
    assert got.keys() == {"only", "often"} and got["only"] == 1 and abs(got["often"] - 0.9) < 1e-12


def test_odd_rows_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    long = "the and of " * 60_000
    texts = [None, "", " \n ", "you idiot, you scum and moron and pathetic loser", long, long + "\nidiot scum clown trash worthless idiot"]
    df = spark.createDataFrame([(i or None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score(df, model, spans=True).collect()}
    assert got[None].score == got[1].score == got[2].score < 0.5 and not got[1].spans
    assert got[3].score > 0.5 and got[4].score < 0.5
    assert {texts[3][s.start : s.end] for s in got[3].spans} >= {"idiot,"}
    assert all(s.start > len(long) for s in got[5].spans) and got[5].spans
    assert toxicity.score(df.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (1, "a b")], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, 1)], [(None, 1), (2, 1), (1, None)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_a_task_fits_and_not_the_driver(spark, monkeypatch):
    """Same model as of the sample's texts in the order of ids, made outside of the driver's process."""
    texts = [f"calm words of text {i}" + (" scum" if i % 2 else "") for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got, want = toxicity.train(docs, labels), toxicity.fit_documents([(t, i % 2) for i, t in enumerate(texts)])
    assert got.bias == want.bias and all((getattr(got, f) == getattr(want, f)).all() for f in ("weights", "moves", "document"))
    where = lambda rows: toxicity.Model(np.zeros(4), float(os.getpid()), np.zeros((2, 2)), np.zeros(toxicity.AGGREGATES))
    monkeypatch.setattr(toxicity, "fit_documents", where)
    assert toxicity.train(docs, labels).bias != os.getpid()


def test_only_near_copies_of_one_label_count_once():
    """Unlike documents that share their long words, and a toxic near copy of a clean document, are all learned from."""
    long = [f"vocabulary{i}" for i in range(6)]
    docs = [(" ".join([*long, *(f"d{k}w{i}" for i in range(60))]), 0) for k in range(5)]
    copy = docs[0][0] + " end"
    assert toxicity._unlike([*docs, (copy, 0), (copy, 1), ("", 0), (" ", 0)]) == [*docs, (copy, 1), ("", 0)]


def test_all_lines_are_learned(monkeypatch):
    seen = []
    train = toxicity.train_chain
    monkeypatch.setattr(toxicity, "train_chain", lambda *chains: seen.append(chains[-1].tolist()) or train(*chains))
    docs = [("\n".join(f"d{k} line{i} {'scum' if k % 2 and not i else 'calm'}" for i in range(9)), k % 2) for k in range(40)]
    toxicity.fit_documents(docs)
    assert seen == [[3] * 360]
