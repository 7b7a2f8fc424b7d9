"""Operator 8, LM scoring: a hidden Markov language model over word symbols.

A word that makes up at least 1 / ``OWN_RATE`` of the training tokens is a symbol of its own (so there are at most
``OWN_RATE`` of them); every other word belongs to one of ``CLASSES`` symbols by its last bytes, and has a smoothed
share of its symbol. P(text) = P(symbols) * product of P(word | symbol): a proper distribution, as the base is.

Training: words are counted over all training documents. Latent states start from these counts and seeded random
weights; then each round runs forward-backward over every training document, whole texts at a time, and Spark adds up
the expected counts, until a round raises the likelihood by less than ``SETTLED`` of it. A round takes the documents in
``TURNS`` parts and fits the model after each, and goes somewhat further than the counts say, so that fewer rounds are
needed; the last round is always a plain one. Long texts are cut into
pieces, with what comes before and after each carried across the cuts. Scoring runs the scaled forward recursion over whole texts,
so likelihoods are exact. Words that are rare meet their counts in a join.

Defined cases: a null or empty text is the end alone; a null doc_id counts as training; equal rows are counted and
scored one by one; with no training document every count is 0 and the model is uniform; an empty table gives no
row; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table
from .encode import runs

STATES = 12
#: Training ends with the first round that raises the log-likelihood by less than this share of it.
SETTLED = 1e-4
#: Parts of the documents that training takes by turns; the model is fitted anew after each.
TURNS = 8
#: How much further than by itself a fit moves the expected counts, as a power of their change since the round before.
STRETCH = 1.5
#: Tokens of a piece; the pieces of a long text are handled side by side.
PIECE = 4096
CLASSES = 1024
OWN_RATE = 20_000
#: Words that make up at least 1 / KNOWN_RATE of the training tokens go to every executor with their counts.
KNOWN_RATE = 400_000
#: Tokens that forward-backward handles at once; its memory is this times states.
LANES = 1 << 20
#: Tokens that are held, two bytes each, to choose those of like length from.
HELD = 1 << 22
#: Tokens whose moves and emissions are added up at once.
STRIDE = 1 << 15
#: Tokens of a run; a long piece's product is that of its runs.
RUN = 64
#: Tokens between which probabilities are not brought back to a sum of 1.
SCALED = 3
SUFFIX = 3
#: Weight of the symbols' overall shares in each state's emissions, in tokens.
PRIOR = 50.0


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, each word's number, and the distinct words as bytes. A-Z are lowered and ASCII white
    space splits."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    found = words.filter(full).dictionary_encode()
    return np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts)), found.indices.to_numpy(), found.dictionary.cast(pa.binary())


def trains(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of the same bytes."""
    return int(word_hashes([word])[0])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


# Counting


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.Table]) -> pa.RecordBatch:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([sums.column(k).combine_chunks() for k in ("word", "c_sum")], names=["word", "c"])

    held: list[pa.Table] = []
    for batch in runs(batches):
        trained = pa.array([trains(d) for d in batch.column("doc_id").to_pylist()], pa.bool_())
        _, number, words = split_words(batch.column("text").filter(trained))
        held.append(pa.table([words, np.bincount(number, minlength=len(words))], names=["word", "c"]))
        if sum(x.num_rows for x in held) > 1_000_000:
            yield out(held)
            held = []
    if held:
        yield out(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c, h, class) of every word of the training documents."""
    counts = docs.select("doc_id", "text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    last = F.expr(f"substring(word, greatest(length(word) - {SUFFIX - 1}, 1), {SUFFIX})")
    return stored(counts.select("word", "c", F.xxhash64("word").alias("h"), F.pmod(F.crc32(last), F.lit(CLASSES)).cast("int").alias("class")), "vocabulary")


# The model


class Hmm:
    """Start, transition and emission probabilities; symbols 0 .. n - 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def fresh(cls, states: int, share: np.ndarray) -> Hmm:
        r = np.random.default_rng(20)
        emit = share * r.gamma(1.0, size=(states, len(share)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def _columns(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest first: the order, symbols by time, and where each time begins."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), side="right")
        begin = np.concatenate([[0], np.cumsum(alive)])
        flat = np.empty(int(begin[-1]), np.intp)
        for lane, i in enumerate(order.tolist()):
            flat[begin[: len(texts[i])] + lane] = texts[i]
        return order, flat, begin

    def _emissions(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Row by row of the symbols, each over its largest, so that few steps can't leave the floats; the largest ones."""
        top = self.emit.max(0)
        return np.ascontiguousarray((self.emit / top).T.astype(kind)), top

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 P(symbols) of whole texts, none of them empty, by the scaled forward recursion."""
        pieces, opens, before, _ = self._cut(texts, PIECE, np.float64)
        order, flat, begin = self._columns(pieces)
        (emit, top), ones = self._emissions(np.float64), np.ones((len(self.start), 1))
        total, lanes = np.zeros(len(pieces)), np.append(np.diff(begin), 0).tolist()
        tops, a = np.log10(top), np.where(opens[order][:, None], self.start, before[order] @ self.move)
        for t, (lo, n, stay) in enumerate(zip(begin.tolist(), lanes, lanes[1:], strict=False)):
            now = flat[lo : lo + n]
            if t:
                a = a[:n] @ self.move
            a *= emit.take(now, axis=0, mode="clip")
            total[:n] += tops.take(now, mode="clip")
            if t % SCALED == 0 or stay < n:
                scale = a @ ones
                a /= scale
                total[:n] += np.log10(scale[:, 0])
        out = np.empty(len(pieces))
        out[order] = total
        return np.add.reduceat(out, np.flatnonzero(opens))

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch's expected counts of starts, moves and emissions."""
        return self.forward_backward(texts)[:3]

    def forward_backward(self, texts: list[np.ndarray], piece: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch's expected counts of starts, moves and emissions in whole texts, and their log10-likelihood.

        Texts are cut into pieces of ``piece`` tokens with the probabilities on either side of each cut worked out
        first, so that pieces of one text are handled side by side. Pieces of like length are handled together."""
        pieces, opens, before, later = self._cut(texts, piece or PIECE, np.float32)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        longest = np.argsort(-size, kind="stable")
        group = np.cumsum(size[longest]) // LANES
        parts = []
        for some in np.split(longest, np.flatnonzero(np.diff(group)) + 1):
            given = [pieces[i] for i in some.tolist()], opens[some], before[some], later[some]
            found = self._pieces(*given)
            if not all(np.isfinite(x).all() for x in found):
                found = self._pieces(*given, every=1)
            parts.append(found)
        starts, moves, emits, log = (sum(x) for x in zip(*parts, strict=True))
        return starts, moves, emits, log

    def _cut(self, texts: list[np.ndarray], piece: int, kind: type) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Pieces in order; whether each opens its text; the states' probabilities before it, given the text so far (0
        where it opens one); and at its end those of the rest of the text, to a factor with which both give 1."""
        pieces = [x[i : i + piece] for x in texts for i in range(0, len(x), piece)]
        many = [-(-len(x) // piece) for x in texts]
        opens = np.zeros(len(pieces), bool)
        opens[np.cumsum([0, *many[:-1]])] = True
        last = np.append(opens[1:], True)
        before, later = np.zeros((len(pieces), len(self.start))), np.ones((len(pieces), len(self.start)))
        long = np.flatnonzero(~(opens & last))
        if len(long):
            across = dict(zip(long.tolist(), self._products([pieces[i] for i in long], opens[long], kind), strict=True))
            for i in long.tolist():
                if not last[i]:
                    a = (self.start if opens[i] else before[i]) @ across[i]
                    before[i + 1] = a / a.sum()
            for i in reversed(long.tolist()):
                if not opens[i]:
                    b = across[i] @ later[i]
                    later[i - 1] = b / (before[i] @ b)
        return pieces, opens, before.astype(kind), later.astype(kind)

    def _products(self, pieces: list[np.ndarray], opens: np.ndarray, kind: type) -> np.ndarray:
        """For each piece the matrix, to a factor, that leads from the probabilities before it to those at its end.

        Runs of ``RUN`` tokens have theirs first, all side by side; then neighbours are multiplied until one is left."""
        many = np.array([-(-len(x) // RUN) for x in pieces])
        head = np.cumsum(many) - many
        first = np.zeros(int(many.sum()), bool)
        first[head] = opens
        a = self._runs([x[i : i + RUN] for x in pieces for i in range(0, len(x), RUN)], first, kind)
        while len(a) > len(pieces):
            half = (many + 1) // 2
            start = np.cumsum(half) - half
            left = np.repeat(head - 2 * start, half) + 2 * np.arange(int(half.sum()))
            paired = left + 1 < np.repeat(head + many, half)
            b = a[left]
            b[paired] = b[paired] @ a[left[paired] + 1]
            a, many, head = b / b.sum((1, 2), keepdims=True), half, start
        return a

    def _runs(self, runs: list[np.ndarray], opens: np.ndarray, kind: type) -> np.ndarray:
        order, flat, begin = self._columns(runs)
        k, lanes = len(self.start), np.append(np.diff(begin), 0)
        move, (emit, _), ones = self.move.astype(kind), self._emissions(kind), np.ones((k, 1), kind)
        a = np.where(opens[order][:, None], np.eye(k, dtype=kind)[:, None, :], move[:, None, :])
        out = np.empty((len(runs), k, k))
        for t in range(len(begin) - 1):
            if t:
                a = (a.reshape(-1, k) @ move).reshape(k, -1, k)
            a *= emit[flat[begin[t] : begin[t + 1]]]
            if t % SCALED == 0 or lanes[t + 1] < lanes[t]:
                a /= a.sum(0) @ ones
            if lanes[t + 1] < lanes[t]:
                out[order[lanes[t + 1] : lanes[t]]] = a[:, lanes[t + 1] :].swapaxes(0, 1)
                a = np.ascontiguousarray(a[:, : lanes[t + 1]])
        return out

    def _pieces(self, pieces: list[np.ndarray], opens: np.ndarray, before: np.ndarray, later: np.ndarray, every: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Probabilities are brought back to a sum of 1 at ``every`` so many tokens."""
        every = every or SCALED
        order, flat, begin = self._columns(pieces)
        opens, before, later = opens[order], before[order], later[order]
        k, lanes, at = len(self.start), np.diff(begin), begin.tolist()
        move, (emit, top) = self.move.astype(np.float32), self._emissions(np.float32)
        back_move, ones = np.ascontiguousarray(move.T), np.ones((k, 1), np.float32)
        e = emit.take(flat, axis=0, mode="clip")
        alpha, beta, first, scales = np.empty_like(e), np.empty_like(e), at[1], [np.ones((1, 1), np.float32)]
        np.multiply(np.where(opens[:, None], self.start, before @ move), e[:first], out=alpha[:first])
        for t in range(1, len(at) - 1):
            lo, hi = at[t], at[t + 1]
            behind, now, here = alpha[at[t - 1] : at[t - 1] + hi - lo], alpha[lo:hi], e[lo:hi]
            if t % every == 0:
                scales.append(np.matmul(behind, ones))
                here *= np.reciprocal(scales[-1])
            np.matmul(behind, move, out=now)
            now *= here
        ends = begin[[len(pieces[i]) - 1 for i in order.tolist()]] + np.arange(len(order))
        reached = alpha[ends].astype(np.float64)
        log = np.log10(reached.sum(1)).sum() + np.log10(np.concatenate(scales), dtype=np.float64).sum() + np.bincount(flat, minlength=len(top)) @ np.log10(top)
        beta[ends] = later / (reached * later).sum(1, keepdims=True)
        for t in range(len(at) - 2, 0, -1):
            lo, hi = at[t], at[t + 1]
            here = e[lo:hi]
            here *= beta[lo:hi]
            np.matmul(here, back_move, out=beta[at[t - 1] : at[t - 1] + hi - lo])
        e[:first] *= beta[:first]
        moves = (before.T @ e[:first]).astype(np.float64)
        behind = np.arange(first, at[-1]) - np.repeat(lanes[:-1], lanes[1:])
        for lo in range(0, len(behind), STRIDE):
            one = behind[lo : lo + STRIDE]
            moves += alpha.take(one, axis=0, mode="clip").T @ e[first + lo : first + lo + len(one)]
        emits = np.zeros(self.emit.shape)
        for lo in range(0, len(flat), STRIDE):
            held = np.ascontiguousarray((alpha[lo : lo + STRIDE] * beta[lo : lo + STRIDE]).T, np.float64)
            for s in range(k):
                emits[s] += np.bincount(flat[lo : lo + STRIDE], weights=held[s], minlength=len(top))
        return (alpha[:first] * beta[:first])[opens].sum(0, dtype=np.float64), moves * self.move, emits, float(log)

    @classmethod
    def fitted(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Hmm:
        norm = lambda x: x / x.sum(-1, keepdims=True)
        return cls(norm(starts + 0.1), norm(moves + 0.1), norm(emits + PRIOR * share))


# Symbols


class Lexicon:
    """What every executor knows: frequent words, and each symbol's tokens and distinct words.

    Symbols: classes first, then words of their own, the end last."""

    def __init__(self, words: list[bytes], counts: list[int], class_tokens: np.ndarray, class_words: np.ndarray, docs: int):
        self.end_count = docs
        self.tokens, self.distinct = int(class_tokens.sum() + docs), int(class_words.sum()) + (1 if docs else 0)
        own = [i for i, c in enumerate(counts) if c * OWN_RATE >= self.tokens]
        self.index = {w: i for i, w in enumerate(words)}
        self.count = np.array(counts, np.int64)
        self.symbol = np.array([word_class(w) for w in words], np.int64)
        tokens, distinct = class_tokens.astype(np.float64), class_words.astype(np.float64)
        for i in own:
            tokens[self.symbol[i]] -= counts[i]
            distinct[self.symbol[i]] -= 1
        self.symbol[own] = CLASSES + np.arange(len(own))
        self.end = CLASSES + len(own)
        self.class_log = np.log10(tokens + 0.5 * (distinct + 1))
        share = np.concatenate([tokens, self.count[own], [docs]]) + 0.5
        self.share = share / share.sum()
        self.base_log = np.log10(self.tokens + 0.5 * (self.distinct + 1))

    def inner_log(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(word | symbol)."""
        shared = symbol < CLASSES
        out = np.zeros(len(symbol))
        out[shared] = np.log10(count[shared] + 0.5) - self.class_log[symbol[shared]]
        return out


ENCODED = "doc_id long, train boolean, n long, known long, base double, inner double, symbols binary, rare array<struct<h:long,class:int,tf:int>>"


def _encode(lexicon):
    struct = pa.struct([("h", pa.int64()), ("class", pa.int32()), ("tf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        log_count, inner = np.log10(lex.count + 0.5), lex.inner_log(lex.symbol, lex.count)
        end_log = np.log10(lex.end_count + 0.5)
        for batch in runs(batches):
            docs = batch.column("doc_id").to_pylist()
            size, number, distinct = split_words(batch.column("text"))
            distinct = distinct.to_numpy(zero_copy_only=False).tolist()
            doc = np.repeat(np.arange(len(size)), size)
            place = np.fromiter(map(lex.index.get, distinct, repeat(-1)), np.int64, len(distinct))
            strange = np.flatnonzero(place < 0)
            unknown = [distinct[i] for i in strange.tolist()]
            hashes = word_hashes(unknown)
            classes = (np.fromiter((zlib.crc32(w[-SUFFIX:]) for w in unknown), np.int64, len(unknown)) % CLASSES).astype(np.int32)
            code_of = np.zeros(len(distinct), np.int64)
            code_of[strange] = np.arange(len(strange))
            at = place[number]
            rare = np.flatnonzero(at < 0)
            code = code_of[number[rare]]
            symbol = np.empty(len(at), np.int64)
            common = at >= 0
            symbol[common] = lex.symbol[at[common]]
            symbol[rare] = classes[code] if len(code) else 0
            ends = np.cumsum(size)
            symbols = np.insert(symbol, ends, lex.end).astype("<u2")
            edges = np.concatenate([[0], np.cumsum(size + 1)])
            known_at, known_doc = at[common], doc[common]
            add = lambda x: np.bincount(known_doc, weights=x, minlength=len(size))  # noqa: E731, B023
            pair, tf = np.unique(doc[rare] * max(1, len(unknown)) + code, return_counts=True)
            owner, which = pair // max(1, len(unknown)), pair % max(1, len(unknown))
            bounds = np.searchsorted(owner, np.arange(len(size) + 1)).astype(np.int32)
            fields = [pa.array(hashes[which] if len(which) else [], pa.int64()), pa.array(classes[which] if len(which) else [], pa.int32()), pa.array(tf, pa.int32())]
            rows = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, fields=list(struct)))
            known = add(np.ones(len(known_at))).astype(np.int64) + (1 if lex.end_count else 0)
            cols = [docs, [trains(d) for d in docs], size + 1, known, add(log_count[known_at]) + end_log, add(inner[known_at]), [symbols[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            names = ["doc_id", "train", "n", "known", "base", "inner", "symbols", "rare"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), rows], names=names)

    return run


def _lanes(batches: Iterator[pa.RecordBatch], most: int, column: str = "symbols") -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts in groups of about ``most`` symbols."""
    ids, held, size = [], [], 0
    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(column).to_pylist(), strict=True):
            ids.append(doc)
            held.append(np.frombuffer(raw, "<u2"))
            size += len(held[-1])
            if size >= most:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def _expect(model):
    """One row a task: its expected counts of starts, moves and emissions, state by state, and the likelihood behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, texts in _lanes(batches, HELD):
            *counts, log = model.value.forward_backward(texts)
            flat = np.append(np.concatenate([counts[0][:, None], *counts[1:]], axis=1).reshape(-1), log)
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def expectation(encoded: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over all training documents of ``encoded``, and their
    log10-likelihood. Tasks' sums are added up in two levels, as many groups as groups have members; one row of
    states * (1 + states + symbols) + 1 numbers, whose count the model fixes, reaches the driver."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(model)
    parts = encoded.where("train").select("doc_id", "symbols").mapInArrow(_expect(sent), "sums binary")
    for groups in (max(1, isqrt(slices(spark))), 1):
        parts = parts.repartition(groups).mapInArrow(_added, "sums binary")
    k, symbols = model.emit.shape
    flat = np.zeros((k, 1 + k + symbols))
    found = parts.first()
    if found is None:
        return flat[:, 0], flat[:, 1 : 1 + k], flat[:, 1 + k :], 0.0
    *counts, log = np.frombuffer(found["sums"])
    flat[:] = np.reshape(counts, flat.shape)
    return flat[:, 0], flat[:, 1 : 1 + k], flat[:, 1 + k :], float(log)


def baum_welch(encoded: DataFrame, model: Hmm, share: np.ndarray) -> tuple[Hmm, float]:
    """One plain round over all training documents, and the log10-likelihood of the model that it started from."""
    starts, moves, emits, log = expectation(encoded, model)
    return Hmm.fitted(starts, moves, emits, share), log


def stretched(sums: list[np.ndarray], before: list[np.ndarray], power: float) -> list[np.ndarray]:
    """Counts moved on from those of a round before by their change to a power, each kind with its total as it was."""
    out = []
    for now, old in zip(sums, before, strict=True):
        far = now * np.clip((now + 1e-3) / (old + 1e-3), 0.1, 10) ** (power - 1)
        out.append(far * (now.sum() / far.sum()) if far.any() else now)
    return out


def train(encoded: DataFrame, model: Hmm, share: np.ndarray) -> Hmm:
    """Rounds over all training documents until the likelihood settles. In a round the ``TURNS`` parts of the documents
    come one by one; each part's expected counts take the place of those it gave the round before, and the model is
    fitted to the counts of all parts at once (incremental Baum-Welch), from the third round on to counts that are
    stretched. Only a plain round ends the training: one comes after each stretched round that raises the likelihood too
    little, and all are plain after one that lowers it."""
    parts: dict[int, tuple[np.ndarray, ...]] = {}
    before: dict[int, list[np.ndarray]] = {}
    last, rounds, power, most = -np.inf, 0, 1.0, STRETCH
    while True:
        log = 0.0
        for turn in range(TURNS):
            *parts[turn], found = expectation(encoded.where(F.col("turn") == turn), model)
            log += found
            sums = [sum(x) for x in zip(*parts.values(), strict=True)]
            if sums[0].any():  # else no document has come yet
                model = Hmm.fitted(*(stretched(sums, before[turn], power) if power > 1 else sums), share)
            before[turn] = sums
        rounds += 1
        settled = not log - last > SETTLED * abs(log)
        if settled and power == 1:
            return model
        if log < last:
            most = 1.0
        power = most if rounds > 1 and not settled else 1.0
        last = log


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def both() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                kept.append(batch.select([n for n in names if n != "symbols"]))
                yield batch.select(["doc_id", "symbols"])

        kept: list[pa.RecordBatch] = []
        done = np.zeros(0)
        for _, texts in _lanes(both(), LANES):
            done = np.concatenate([done, model.value.log10(texts)])
            while kept and kept[0].num_rows <= len(done):
                head = kept.pop(0)
                yield head.append_column("symbol_score", pa.array(done[: head.num_rows], pa.float64()))
                done = done[head.num_rows :]

    return run


def build_lexicon(vocab: DataFrame, docs: int) -> Lexicon:
    # One row for each class.
    sums = vocab.groupBy("class").agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).collect()
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        tokens[r["class"]], words[r["class"]] = r["tokens"], r["words"]
    # Counts add up to the tokens, so at most KNOWN_RATE words pass.
    known = vocab.where(F.col("c") * KNOWN_RATE >= int(tokens.sum() + docs)).select("word", "c").toArrow()
    order = sorted(zip(known.column("word").to_pylist(), known.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return Lexicon([w for w, _ in order], [c for _, c in order], tokens, words, docs)


def score(docs: DataFrame, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document row."""
    context = docs.sparkSession.sparkContext
    vocab = vocabulary(docs)
    trained = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, F.lit(True))
    lex = build_lexicon(vocab, docs.where(trained).count())
    encoded = docs.select("doc_id", "text").mapInArrow(_encode(context.broadcast(lex)), ENCODED)
    encoded = stored(encoded.withColumn("turn", F.pmod(F.monotonically_increasing_id(), F.lit(TURNS)).cast("int")), "encoded", by="turn")
    model = Hmm.fresh(states, lex.share)
    if lex.end_count:
        model = train(encoded, model, lex.share)
    scored = encoded.select("doc_id", "train", "n", "known", "base", "inner", "rare", "symbols").mapInArrow(_score(context.broadcast(model)), "doc_id long, train boolean, n long, known long, base double, inner double, rare array<struct<h:long,class:int,tf:int>>, symbol_score double")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    count = F.coalesce("c", F.lit(0))
    class_log = F.element_at(F.array(*(F.lit(float(x)) for x in lex.class_log)), F.col("class") + 1)
    log = F.log10(count + 0.5)
    sums = rare.join(vocab.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.when(count > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * log).alias("more_base"), F.sum(F.col("tf") * (log - class_log)).alias("more_inner"))
    out = scored.drop("rare").join(sums, "row", "left")
    or_none = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + or_none("more_known")).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + or_none("more_base") - F.col("n") * float(lex.base_log)).alias("base_score"), (F.col("symbol_score") + F.col("inner") + or_none("more_inner")).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
