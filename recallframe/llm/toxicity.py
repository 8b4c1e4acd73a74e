"""Toxic spans by a linear-chain conditional random field.

Labels are of documents; the tags of tokens (clean, toxic) are latent. Tokens of
clean documents are clean. Tokens of toxic documents start with the share of
toxic documents with their word, or a prefix of it, that chance doesn't explain.
A CRF is trained on these expected tags, and every few rounds they are estimated
anew: the marginal's odds times the factor by which a toxic tag makes a toxic
document likelier. Features are the word and its prefixes, so unseen inflections
of a stem score as well, and stems that clean documents hold now and then count
for what they are. Forward-backward marginals then tag every token of every
text. The document's score is a logistic function of their aggregates, and
tokens with a marginal of one half or more are the offending offsets.

A chain is a line of text. Chains of many documents run side by side: for two
tags, forward and backward messages are one ratio each per step. Long lines run
as pieces, tied by the product of each piece's 2 x 2 steps.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.llm.simhash_wide import shingles_of
from recallframe.llm.text import Memo
from recallframe.session import without

#: Hashed feature space, a bound on the model's size, and prefix lengths in characters.
DIMENSIONS, PREFIXES = 1 << 18, (3, 4, 5, 6)
#: Bound of the training sample: documents of each label and characters of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 20_000
#: A feature starts tags if it is so much commoner in toxic documents that chance would do it with probability CHANCE,
#: or as much as one that a quarter of the toxic documents (LEAST at least) and no clean one has.
CHANCE, LEAST = 1e-8, 3
#: Rounds of training; from the first of AGAIN on, each so many rounds, tags are estimated anew.
ROUNDS, AGAIN = 60, (30, 6)
#: Words of a block that is tagged at once, rows of an Arrow batch that are decoded at once, and words a worker remembers.
BLOCK, SLICE, WORDS_KEPT = 1 << 18, 2048, 150_000
#: Words of a block of chains in training, and words that a chain goes through one after another.
TRAIN_BLOCK, PIECE = 1 << 19, 1 << 10
WORD = re.compile(r"\S+")
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
AGGREGATES = 4


def normal(word: str) -> str:
    return EDGE.sub("", word.lower())


def features(word: str) -> list[str]:
    w = normal(word)
    if not w:
        return []
    return ["w=" + w, *[f"p={w[:n]}" for n in PREFIXES if len(w) > n]]


def slots(word: str) -> np.ndarray:
    return np.array([zlib.crc32(f.encode()) % DIMENSIONS for f in features(word)], np.int64)


@dataclass
class Model:
    """CRF weights (toxic against clean), transition weights [from][to], and the document's logistic weights."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    document: np.ndarray

    def potential(self, word: str) -> float:
        return float(self.weights[slots(word)].sum() + self.bias)


def _through(own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opens: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Per piece of a chain, the 2 x 2 map of its tokens' steps: from (clean, toxic) before the piece to those at its end, up to a factor.

    ``opens`` are the pieces that begin a chain; their first token takes anything to (1, own potential).
    """
    (cc, ct), (tc, tt) = np.exp(moves)
    order = np.argsort(-sizes, kind="stable")
    running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left")
    begins, at = opens[order], starts[order]
    first = own[at]
    out = np.empty((len(order), 2, 2))
    out[:, 0, 0], out[:, 0, 1] = np.where(begins, 1, cc), np.where(begins, 0, tc)
    out[:, 1, 0], out[:, 1, 1] = np.where(begins, first, first * ct), np.where(begins, 0, first * tt)
    for t in range(1, len(running)):
        n = running[t]
        clean, toxic = out[:n, 0].copy(), out[:n, 1]
        out[:n, 0] = cc * clean + tc * toxic
        out[:n, 1] = own[at[:n] + t, None] * (ct * clean + tt * toxic)
        out[:n] /= out[:n].max(axis=(1, 2), keepdims=True)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def _between(own: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chains cut into pieces of ``PIECE`` tokens at most.

    Returns (starts, sizes, opens, ahead, behind): ``ahead`` is the forward ratio of the
    token before a piece and ``behind`` the backward ratio at the piece's last token.
    """
    n_pieces = -(-lengths // PIECE)
    chain = np.repeat(np.arange(len(lengths)), n_pieces)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    sizes = np.minimum(lengths[chain] - nth * PIECE, PIECE)
    places, opens = starts[chain] + nth * PIECE, nth == 0
    ahead, behind = np.ones(len(chain)), np.ones(len(chain))
    long = np.flatnonzero(n_pieces[chain] > 1)
    if len(long):
        maps = np.zeros((len(chain), 2, 2))
        maps[long] = _through(own, places[long], sizes[long], opens[long], moves)
        by_nth = np.argsort(nth[long], kind="stable")
        ends = np.searchsorted(nth[long][by_nth], np.arange(int(nth.max()) + 2))
        steps = [long[by_nth[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for here in steps[1:]:
            m, x = maps[here - 1], ahead[here - 1]
            ahead[here] = np.clip((m[:, 1, 0] + m[:, 1, 1] * x) / (m[:, 0, 0] + m[:, 0, 1] * x), 1e-12, 1e12)
        for here in reversed(steps[1:]):
            m, x = maps[here], behind[here]
            behind[here - 1] = np.clip((m[:, 0, 1] + m[:, 1, 1] * x) / (m[:, 0, 0] + m[:, 1, 0] * x), 1e-12, 1e12)
    return places, sizes, opens, ahead, behind


def messages(potentials: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) of concatenated chains.

    ``potentials`` holds the chains' tokens one chain after another. Forward
    includes the token's own potential, backward doesn't. Chains of more than
    ``PIECE`` tokens go by pieces side by side, once the messages between the
    pieces are known, so the longest chain doesn't set the number of steps.
    """
    forward, backward = np.ones(len(potentials)), np.ones(len(potentials))
    if not len(potentials):
        return forward, backward
    own = np.exp(np.clip(potentials, -30, 30))
    (cc, ct), (tc, tt) = np.exp(moves)
    starts, sizes, opens, ahead, behind = _between(own, np.cumsum(lengths) - lengths, lengths, moves)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, opens, r, q = starts[order], sizes[order], opens[order], ahead[order], behind[order]
    longest = int(sizes[0])
    # pieces that still run at a step come first
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    for t in range(longest):
        n = running[t]
        at = starts[:n] + t
        r = own[at] * (ct + r[:n] * tt) / (cc + r[:n] * tc)
        if t == 0:
            r = np.where(opens, own[at], r)
        np.clip(r, 1e-12, 1e12, out=r)
        forward[at] = r
    backward[starts + sizes - 1] = q
    for t in range(longest - 2, -1, -1):
        n = running[t + 1]
        at = starts[:n] + t
        x = own[at + 1] * q[:n]
        q[:n] = np.clip((tc + tt * x) / (cc + ct * x), 1e-12, 1e12)
        backward[at] = q[:n]
    return forward, backward


def marginals(potentials: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    forward, backward = messages(potentials, lengths, moves)
    odds = forward * backward
    return odds / (1 + odds)


def _blocks(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of chains of about TRAIN_BLOCK tokens."""
    block = (np.cumsum(lengths) - lengths) // TRAIN_BLOCK
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def train_chain(vocabulary: list[str], words: np.ndarray, tags: np.ndarray, free: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Expected log-likelihood with L2 by AdaGrad over all chains.

    ``words`` are places in ``vocabulary``, chain after chain. ``tags`` are
    expected tags; those of ``free`` tokens are estimated anew in place.
    Gradients are summed over blocks of chains, which bounds the memory.
    """
    per_word = [slots(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(per_word), dtype=np.int32), [len(x) for x in per_word])
    used, column = np.unique(np.concatenate(per_word) if per_word else np.zeros(0, np.int64), return_inverse=True)
    n_words = len(per_word)
    del per_word
    column = column.astype(np.int32)
    weights, bias, moves = np.zeros(len(used)), -3.0, np.zeros((2, 2))
    sums = [np.full(len(used), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    ends = np.cumsum(lengths)
    likelier = len(words) / max(int(np.count_nonzero(free)), 1)
    for turn in range(rounds):
        again = turn >= AGAIN[0] and (turn - AGAIN[0]) % AGAIN[1] == 0
        word_potential = np.bincount(owner, weights[column], n_words) + bias
        m = np.exp(moves)
        off, excess, steps_moves = np.zeros(n_words), 0.0, np.zeros((2, 2))
        for first, end in _blocks(lengths):
            part = slice(ends[first] - lengths[first], ends[end - 1])
            own_lengths, own_words = lengths[first:end], words[part]
            inner = np.ones(len(own_words), bool)
            inner[np.cumsum(own_lengths) - 1] = False
            here = np.flatnonzero(inner)
            u = word_potential[own_words]
            forward, backward = messages(u, own_lengths, moves)
            odds = forward * backward
            p = odds / (1 + odds)
            if again:
                tags[part] = np.where(free[part], likelier * odds / (1 + likelier * odds), tags[part])
            gold = tags[part].astype(float)
            off += np.bincount(own_words, gold - p, n_words)
            excess += float((gold - p).sum())
            before, after = (np.stack([1 - g, g]) for g in (gold[here], gold[here + 1]))
            steps_moves += before @ after.T
            own = np.exp(np.clip(u[here + 1], -30, 30)) * backward[here + 1]
            joint = np.stack([np.full(len(here), m[0, 0]), m[0, 1] * own, forward[here] * m[1, 0], forward[here] * m[1, 1] * own])
            joint /= joint.sum(axis=0)
            steps_moves -= joint.sum(axis=1).reshape(2, 2)
        steps = [np.bincount(column, off[owner], len(used)) - l2 * len(words) * 0.01 * weights, excess, steps_moves - 1e-2 * moves]
        for i, step in enumerate(steps):
            sums[i] = sums[i] + step**2
        weights = weights + 0.5 * steps[0] / np.sqrt(sums[0])
        bias += 0.5 * steps[1] / np.sqrt(sums[1])
        moves = moves + 0.2 * steps[2] / np.sqrt(sums[2])
    full = np.zeros(DIMENSIONS)
    full[used] = weights
    return full, bias, moves


def aggregates(p: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Rows of (1, log of expected toxic tokens, largest marginal, expected share) by document."""
    total = np.bincount(owner, p, n_docs)
    count = np.bincount(owner, minlength=n_docs)
    most = np.zeros(n_docs)
    np.maximum.at(most, owner, p)
    return np.stack([np.ones(n_docs), np.log1p(total), most, np.sqrt(total / np.maximum(count, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def _lines(text: str) -> list[list[str]]:
    return [x for line in text.split("\n") if (x := line.split())]


def _unlike(docs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The documents less near copies of earlier ones of their label, which would count a text's words again and again.

    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles.
    Two such sets share one of the first hashes of each, so only these are looked up.
    """
    sets: list[np.ndarray] = []
    found: dict[tuple[int, int], list[int]] = {}
    out = []
    for text, label in docs:
        own = shingles_of(text.encode("utf-8", "surrogatepass"), 5)
        first = own[: len(own) - (4 * len(own) + 4) // 5 + 1].tolist() or [-1]
        others = {i for h in first for i in found.get((label, h), ())}
        if any(9 * len(np.intersect1d(own, sets[i], assume_unique=True)) >= 4 * (len(own) + len(sets[i])) for i in others):
            continue
        for h in first:
            found.setdefault((label, h), []).append(len(sets))
        sets.append(own)
        out.append((text, label))
    return out


def _surprise(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log-likelihood ratio of two rates (documents of each label that have a feature) against a common one."""

    def fit(k: int, n: int, rate: float) -> float:
        return (k * np.log(rate) if k else 0.0) + ((n - k) * np.log(1 - rate) if n > k else 0.0)

    common = (toxic + clean) / (n_toxic + n_clean)
    apart = fit(toxic, n_toxic, toxic / n_toxic) + fit(clean, n_clean, clean / n_clean)
    return 2 * (apart - fit(toxic, n_toxic, common) - fit(clean, n_clean, common))


def _starts(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """By feature, the share of the toxic documents with it that the rate of the clean ones doesn't explain; the surprising ones only."""
    few = min(max(LEAST, n_toxic // 4), n_toxic)
    least = min(-2 * np.log(CHANCE), _surprise(few, 0, n_toxic, n_clean))
    out = {}
    for f, n in toxic.items():
        share = 1 - clean[f] * n_toxic / (n * n_clean)
        if n >= min(LEAST, n_toxic) and share > 0 and _surprise(n, clean[f], n_toxic, n_clean) >= least:
            out[f] = share
    return out


def fit_documents(docs: list[tuple[str, int]]) -> Model:
    """A model of (text, label 0 or 1). Without both labels it scores all the same."""
    docs = _unlike(docs)
    n_toxic = sum(y for _, y in docs)
    none = Model(np.zeros(DIMENSIONS), -10.0, np.zeros((2, 2)), np.zeros(AGGREGATES))
    if not 0 < n_toxic < len(docs):
        share = n_toxic / len(docs) if docs else 0.0
        none.document[0] = 6.0 if share else -6.0
        return none
    known = Memo(features, 1 << 16)
    counts = (Counter(), Counter())
    for text, label in docs:
        counts[label].update({f for w in set(text.split()) for f in known[w]})
    starts = _starts(counts[1], counts[0], n_toxic, len(docs) - n_toxic)
    places: dict[str, int] = {}
    words, tags, free, lengths = array("i"), array("f"), array("b"), array("i")
    for text, label in docs:
        for line in _lines(text):
            words.extend([places.setdefault(w, len(places)) for w in line])
            tags.extend([max((starts.get(f, 0.0) for f in known[w]), default=0.0) if label else 0.0 for w in line])
            free.extend([label] * len(line))
            lengths.append(len(line))
    del known, counts
    if not any(tags):
        none.document[0] = float(np.log(n_toxic / (len(docs) - n_toxic)))
        return none
    weights, bias, moves = train_chain(list(places), np.array(words), np.array(tags), np.array(free, bool), np.array(lengths))
    model = Model(weights.astype(np.float32), bias, moves, np.zeros(AGGREGATES))
    x = np.concatenate([aggregate for aggregate, *_ in _tagged([t for t, _ in docs], model, Memo(model.potential, WORDS_KEPT))])
    model.document = logistic(x, np.array([y for _, y in docs], float))
    return model


def _tagged(texts: list[str], model: Model, potential: Memo):
    """(aggregates, marginals, document of each token) of blocks of the texts in their order."""
    at = 0
    while at < len(texts):
        words: list[str] = []
        lengths, owners = [], []
        first = at
        while at < len(texts) and (len(words) < BLOCK or at == first):
            before = len(words)
            for line in texts[at].split("\n"):
                if x := line.split():
                    words += x
                    lengths.append(len(x))
            owners.append(len(words) - before)
            at += 1
        u = np.fromiter(map(potential.__getitem__, words), float, len(words))
        p = marginals(u, np.array(lengths, np.int64), model.moves)
        owner = np.repeat(np.arange(at - first), owners)
        yield aggregates(p, owner, at - first), p, owner


def _fit(batches):
    """Task: rows (doc_id, __y, __text) to the one row of their model."""
    rows: list[tuple] = []
    for b in batches:
        texts = [t.decode("utf-8", "replace") for t in b.column("__text").cast(pa.binary()).to_pylist()]
        rows += zip(b.column("doc_id").to_pylist(), b.column("__y").to_pylist(), texts, strict=True)
    model = fit_documents([(text, y) for _, y, text in sorted(rows, key=lambda r: r[:2])])
    columns = [pa.array([x], pa.binary()) for x in (model.weights.astype(np.float32).tobytes(), model.moves.tobytes(), model.document.tobytes())]
    yield pa.RecordBatch.from_arrays([columns[0], pa.array([float(model.bias)]), *columns[1:]], ["weights", "bias", "moves", "document"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) mark.

    Learns from at most ``sample_docs`` labels of each kind, those with the
    smallest hash of the doc_id, as far as their documents have a text of up to
    ``sample_chars`` characters. Null ids, other labels and null texts don't
    count; where a doc_id has both labels, both do. The product of the two bounds
    the sample. One task fits it, and the driver gets the model's numbers only.
    """
    usable = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__y"))
    picked = [usable.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample_docs rows at most
    short = docs.select("doc_id", F.col(text).alias("__text")).where(F.length("__text") <= sample_chars)
    rows = short.join(sample, "doc_id").groupBy("doc_id", "__y").agg(F.min("__text").alias("__text"))
    row = rows.coalesce(1).mapInArrow(_fit, "weights binary, bias double, moves binary, document binary").first()
    if row is None:  # Spark may leave out the task where nothing is learned from
        return fit_documents([])
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"], np.frombuffer(row["moves"]).reshape(2, 2), np.frombuffer(row["document"]))


def score(df: DataFrame, model: Model, text: str = "text", spans: bool = False, keep: bool = False) -> DataFrame:
    """``df`` with score (double) and, if asked for, spans instead of its ``text``; with ``keep`` beside it.

    Texts that are null, empty or white space get the score of a text without
    toxic tokens. ``spans`` are structs of start and end offsets in characters
    and the marginal of each offending token. Input columns of these names are
    replaced.
    """
    kept = without(df, "score", "spans")
    fields = [f for f in kept.schema.fields if keep or f.name != text]
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), *([T.StructField("spans", span_type)] if spans else [])])
    sent = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats

    def work(batches):
        own = sent.value
        potential = Memo(own.potential, WORDS_KEPT)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = [(b or b"").decode("utf-8", "replace") for b in batch.column(text).cast(pa.binary()).to_pylist()]
            at = 0
            for x, p, owner in _tagged(texts, own, potential):
                part = batch.slice(at, len(x))
                scores = 1 / (1 + np.exp(-np.clip(x @ own.document, -30, 30)))
                columns = [*[part.column(f.name) for f in fields], pa.array(scores, pa.float64())]
                if spans:
                    found: list[list[dict]] = [[] for _ in range(len(x))]
                    ends = np.searchsorted(owner, np.arange(len(x) + 1))
                    for i in np.unique(owner[p >= 0.5]).tolist():
                        mine = p[ends[i] : ends[i + 1]]
                        places = list(WORD.finditer(texts[at + i]))
                        found[i] = [{"start": places[k].start(), "end": places[k].end(), "p": float(mine[k])} for k in np.flatnonzero(mine >= 0.5)]
                    columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                at += len(x)

    return kept.mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """True where the row's label mustn't be learned: crc32 of the id as text, mod 5, is 0 (null: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned."""
    return labels.where(~held_out(F.col("doc_id")))
