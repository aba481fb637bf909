"""Hidden Markov language model.

Words go to *classes*: the ``OWN`` most frequent training words and the end have a class each, all others one of
``HASHED`` classes by hash. A hidden state emits a class, and the class its word: ``P(word | state) = P(class | state) *
P(word | class)``. The second factor, over all training words, is counted from the corpus ((count + 1) / (class tokens +
class words + 1), the last 1 for a word never seen); the first and the moves between states are trained by Baum-Welch:
every task runs scaled forward and backward over its texts and gives expected counts, which Spark adds up. The likelihood
of a text is exact: scaled forward over the whole of it.

The counts of the ``KNOWN`` most frequent words of at most 64 bytes travel to the tasks (a bounded table), those of all
other words are joined by word, so nothing is left out.

Results: a null text is an empty one and consists of the end. Every row is scored by itself, repeated rows give repeated
rows; a null id is in no held-out fold unless its empty text is. Without training rows all counts are zero. An empty table
gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bytes_words, text_of
from lectern.operators.sizing import cut_lineage

OWN = 4000
HASHED = 95
KNOWN = 60_000
MOST_BYTES = 64
STATES = 6
ROUNDS = 3
END = b" "
_FLUSH = 200_000
_BLOCK = 600_000
N_CLASSES = HASHED + 1 + OWN


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(states: int = STATES, classes: int = N_CLASSES, seed: int = 3) -> Hmm:
    rng = np.random.default_rng(seed)
    part = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(1 + rng.random(shape))
    return Hmm(part(states), part(states, states), part(states, classes))


def _blocks(seqs: list[np.ndarray]):
    """Numbers of sequences, longest first, in blocks of a bounded number of tokens."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lo = total = 0
    for hi, i in enumerate(order):
        total += len(seqs[i])
        if total >= _BLOCK or hi + 1 == len(order):
            yield order[lo : hi + 1]
            lo, total = hi + 1, 0


def _steps(seqs: list[np.ndarray]):
    """Tokens of sequences (longest first) step by step: at each step those of the sequences that still run."""
    lengths = np.array([len(s) for s in seqs])
    active = (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(axis=1) if len(seqs) * lengths[0] < 4_000_000 else np.array(
        [np.searchsorted(-lengths, -t, side="left") for t in range(lengths[0])]
    )
    at = np.concatenate(([0], np.cumsum(active)))
    tokens = np.empty(at[-1], dtype=np.int64)
    for i, s in enumerate(seqs):
        tokens[at[: len(s)] + i] = s
    return tokens, at


def forward(seqs: list[np.ndarray], m: Hmm, keep: bool = False):
    """log10 likelihoods of sequences (longest first); with ``keep`` the scaled forward values and scales too."""
    tokens, at = _steps(seqs)
    seen = m.emit.T[tokens]
    log, alphas, scales = np.zeros(len(seqs)), [], []
    a = np.repeat(m.start[None, :], len(seqs), axis=0)
    for t in range(len(at) - 1):
        n = at[t + 1] - at[t]
        a = (a[:n] @ m.move if t else a[:n]) * seen[at[t] : at[t + 1]]
        c = a.sum(axis=1)
        a /= c[:, None]
        scales.append(c)
        if keep:
            alphas.append(a)
    flat = np.log10(np.concatenate(scales))
    for t in range(len(at) - 1):
        log[: at[t + 1] - at[t]] += flat[at[t] : at[t + 1]]
    return (log, tokens, at, seen, alphas, scales) if keep else log


def expected(seqs: list[np.ndarray], m: Hmm):
    """Expected counts of starts, moves and emissions, and the log10 likelihood."""
    log, tokens, at, seen, alphas, scales = forward(seqs, m, True)
    moves, gammas = np.zeros_like(m.move), [None] * len(alphas)
    b = np.ones_like(alphas[-1])
    gammas[-1] = alphas[-1]
    for t in range(len(alphas) - 2, -1, -1):
        n, n1 = len(alphas[t]), len(alphas[t + 1])
        w = seen[at[t + 1] : at[t + 2]] * b / scales[t + 1][:, None]
        moves += m.move * (alphas[t][:n1].T @ w)
        b = np.ones((n, m.move.shape[0]))
        b[:n1] = w @ m.move.T
        gammas[t] = alphas[t] * b
    g = np.concatenate(gammas)
    emit = np.stack([np.bincount(tokens, weights=g[:, s], minlength=m.emit.shape[1]) for s in range(g.shape[1])])
    return gammas[0].sum(axis=0), moves, emit, float(log.sum())


def _class_of(word: bytes, own: dict[bytes, int]) -> int:
    c = own.get(word)
    return zlib.crc32(word) % HASHED if c is None else c


def _count(batches):
    kept: Counter = Counter()
    for pdf in batches:
        for t in pdf["t"]:
            kept.update(bytes_words(t))
            kept[END] += 1
            if len(kept) > _FLUSH:
                yield pd.DataFrame({"word": list(kept.keys()), "c": list(kept.values())})
                kept.clear()
    if kept:
        yield pd.DataFrame({"word": list(kept.keys()), "c": list(kept.values())})


def _prepare(own: dict[bytes, int], known: dict[bytes, float], below: np.ndarray):
    """Per text: its classes, its sums over known words, and its other words with their numbers."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                part, out = pdf.iloc[lo : lo + 200], []
                for id_, no, held, t in part.itertuples(index=False):
                    words = bytes_words(t)
                    words.append(END)
                    n = Counter(words)
                    classes = {w: _class_of(w, own) for w in n}
                    seq = np.fromiter(map(classes.__getitem__, words), np.uint16, len(words))
                    base = rest = under = 0.0
                    n_known, rare, rare_n = 0, [], []
                    for w, k in n.items():
                        if w not in own:
                            under += k * below[classes[w]]
                        v = known.get(w)
                        if v is None:
                            rare.append(w)
                            rare_n.append(k)
                        else:
                            n_known += k
                            base += k * v
                            rest += 0.0 if w in own else k * v
                    out.append((id_, no, held, len(words), n_known, base, rest, under, seq.tobytes(), rare, rare_n))
                cols = ["id", "no", "held_out", "n_tokens", "n_known", "base", "rest", "under", "seq", "rare", "rare_n"]
                yield pd.DataFrame(out, columns=cols).astype({"id": "Int64"})

    return run


def _sequences(pdf) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint16) for s in pdf["seq"]]


def _expect(m: Hmm):
    def run(batches):
        total = None
        for pdf in batches:
            seqs = _sequences(pdf)
            for block in _blocks(seqs):
                start, moves, emit, log = expected([seqs[i] for i in block], m)
                flat = np.concatenate((start, moves.ravel(), emit.ravel(), [log]))
                total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    return run


def train(seqs: DataFrame, rounds: int = ROUNDS, states: int = STATES, prior: float = 0.01) -> Hmm:
    """Baum-Welch over all rows of ``seqs (seq)``; a fixed number of expected counts comes to the driver per round."""
    m = first_model(states)
    for _ in range(rounds):
        got = seqs.select("seq").mapInPandas(_expect(m), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        if not got:
            return m
        v = np.zeros(states + states * states + states * N_CLASSES + 1)
        for r in got:
            v[r["k"]] = r["v"]
        part = lambda x: (x + prior) / (x + prior).sum(axis=-1, keepdims=True)
        s2 = states + states * states
        m = Hmm(part(v[:states]), part(v[states:s2].reshape(states, states)), part(v[s2:-1].reshape(states, N_CLASSES)))
    return m


def _score(m: Hmm):
    def run(batches):
        for pdf in batches:
            seqs, log = _sequences(pdf), np.zeros(len(pdf))
            for block in _blocks(seqs):
                log[block] = forward([seqs[i] for i in block], m)
            yield pdf.drop(columns="seq").assign(log=log).astype({"id": "Int64"})

    return run


def score(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``; rows where ``held_out`` is true are not learned from."""
    d = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(text).alias("t"))
    counts = cut_lineage(
        d.where("not held_out").select("t").mapInPandas(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    )
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(size[0]), int(size[1])
    short = counts.where((F.octet_length("word") <= MOST_BYTES) & (F.col("word") != END))
    top = short.orderBy(F.desc("c"), "word").limit(KNOWN).collect()
    own = {END: HASHED} | {bytes(r["word"]): HASHED + 1 + i for i, r in enumerate(top[:OWN])}
    ends = counts.where(F.col("word") == END).collect()
    known = {bytes(r["word"]): float(np.log10(r["c"] + 1)) for r in [*top, *ends]}
    # Tokens and words of every hashed class. CRC is the same in both worlds.
    per = counts.withColumn("k", F.pmod(F.crc32("word"), F.lit(HASHED)).cast("int")).groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    tokens, words = np.zeros(HASHED), np.zeros(HASHED)
    for r in per:
        tokens[r["k"]], words[r["k"]] = r["c"], r["n"]
    taken = {bytes(r["word"]): r["c"] for r in [*top[:OWN], *ends]}
    for w, c in taken.items():
        tokens[zlib.crc32(w) % HASHED] -= c
        words[zlib.crc32(w) % HASHED] -= 1
    below = np.log10(tokens + words + 1)
    # Row numbers are kept in the checkpoint, so later steps meet by them.
    numbered = d.select("id", F.monotonically_increasing_id().alias("no"), "held_out", "t")
    kind = (
        "id long, no long, held_out boolean, n_tokens long, n_known long, base double, rest double, under double, seq binary, "
        "rare array<binary>, rare_n array<long>"
    )
    ready = cut_lineage(numbered.mapInPandas(_prepare(own, known, below), kind))
    m = train(ready.where("not held_out"))
    rare = ready.select("no", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("no", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("k"))
    met = rare.join(counts, "word").groupBy("no").agg(
        F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_log")
    )
    done = ready.drop("rare", "rare_n").mapInPandas(
        _score(m), "id long, no long, held_out boolean, n_tokens long, n_known long, base double, rest double, under double, log double"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.join(met, "no", "left").select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_log") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("log") + F.col("rest") + zero("more_log") - F.col("under")).alias("score"),
    )
