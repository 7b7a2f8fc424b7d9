"""Operator 11, cross-tokenizer alignment: the token ends of two tokenizers merged by merge path.

Both tokenizers cut the same bytes, so each token is an interval and its end says all. Merging a document's A ends and B
ends is a path through a grid; every diagonal of the grid is crossed once, and a binary search on it finds where. Diagonals
``PIECE`` ends apart so cut the merging into pieces of equal work that need nothing of each other but the token that is
still open at their end. Pieces are rows: tokenizing writes them, and tasks that read them back merge whatever pieces they
get, once to count pairs and once to score them, since merging costs less than keeping overlaps would. A piece emits its
overlaps (one for each distinct end) and its groups; the groups that its borders cut are stitched from their fragments,
document by document.

Counts of id pairs are summed over the corpus. Pairs that make up at least 1 / ``KNOWN_RATE`` of all links are at most
``KNOWN_RATE`` and go to every executor, as does the highest count of each B id, whose number the vocabulary bounds; other
pairs meet their counts in a join, where none is frequent.

Defined cases: a text that is null or empty, or that a tokenizer doesn't give back byte by byte (U+2581 in it, say), has
no tokens, zeros and an empty hash; repeated rows and ids are aligned and counted one by one, a null id stays; an empty
table gives no row; other columns are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .encode import CACHE_BYTES, ByteLevel, Encoder, chunks, released

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends that a piece merges, and tokens that a task merges at once.
PIECE, AT_ONCE = 8192, 1 << 18
#: Links that a task gathers before it counts their pairs.
GATHERED = 1 << 21
#: Pairs that make up at least 1 / KNOWN_RATE of all links are known to every executor: 12 bytes each, 24 MB at most.
KNOWN_RATE = 2_000_000
#: A pair is one number: the A id's 16 bits before the B id's.
B_BITS = 16
BREAK = re.compile(r"(?<=[^ ]) (?= *[^ ])")


class Led(ByteLevel):
    """Texts that begin with the blank in front of them; strings of special tokens are ordinary text."""

    def __init__(self, path: str, **limit: int):
        super().__init__(path, **limit)
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(self._alphabet())}
        self.bytes = [bytes(byte_of[c] for c in name) if set(name) <= byte_of.keys() else b"" for name in self.names]

    @staticmethod
    def _alphabet() -> list[str]:
        """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(0x100, 0x200))
        return [chr(b if b in shown else next(others)) for b in range(256)]

    def pieces(self, text: str) -> list[str]:
        first, *rest = super().pieces(text[1:])
        return [" " + first, *rest]


class Pieces(Encoder):
    """A model that puts a blank in front of a text and has no token with a blank behind another character: a blank behind
    a word is where it must cut, and what follows it is a text of its own."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from sentencepiece import SentencePieceProcessor

        self.model, self.limit = SentencePieceProcessor(model_file=path), limit
        found = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(found)]
        self.width = np.array([len(x) for x in self.bytes], np.int64)
        self.empty()

    def pieces(self, text: str) -> list[str]:
        cut = text.split(" ")
        return cut if all(cut) else BREAK.split(text)

    def joins(self, piece: str) -> bool:
        return False

    def _others(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode(new, num_threads=1)
        return np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got], np.int64)


# Pieces


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many A ends and B ends come before each diagonal, both borders included. At a tie the A end comes first, and
    the B end goes with it, so that no border parts them."""
    d = np.arange(piece, len(a) + len(b), piece)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        open_ = lo < hi
        at = np.where(open_, mid, 0)
        before = a[at] <= b[np.where(open_, d - 1 - mid, 0)]
        lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    i, j = lo, d - lo
    tied = (i > 0) & (j < len(b))
    tied[tied] = a[i[tied] - 1] == b[j[tied]]
    j = j + tied
    return np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j, [len(b)]])


TOKENS = "doc long, doc_id long, piece int, pieces int, n_a int, n_b int, lead int, a binary, b binary"
_TOKENS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _tokenize(path_a: str, path_b: str, piece: int):
    """One row for each piece: how many A and B tokens end in it, their ids and that of the token left open, and how far
    its first A token starts behind its first B token."""

    def valid(led: Led, own: Pieces, texts: list[str], a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[bool]:
        for text, x, y in zip(texts, a, b, strict=True):
            want = b" " + text.encode("utf-8", "surrogatepass")
            yield bool(text) and all(b"".join(map(of.bytes.__getitem__, ids.tolist())) == want for of, ids in ((led, x), (own, y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released(Led, path_a) as led, released(Pieces, path_b) as own:
            for batch, texts in chunks(batches):
                there = [i for i, x in enumerate(texts) if x]
                (ids_a, n_a), (ids_b, n_b) = led.encode([" " + texts[i] for i in there]), own.encode([texts[i] for i in there])
                split = lambda ids, n: np.split(ids.astype("<u2"), np.cumsum(n)[:-1]) if len(n) else []
                parts_a, parts_b = split(ids_a, n_a), split(ids_b, n_b)
                rows, owner = [], []
                good = dict(zip(there, zip(valid(led, own, [texts[i] for i in there], parts_a, parts_b), parts_a, parts_b, strict=True), strict=True))
                for i in range(len(texts)):
                    ok, a, b = good.get(i, (False, None, None))
                    if not ok or len(a) + len(b) <= piece:
                        rows.append((0, 1, len(a), len(b), 0, a.tobytes(), b.tobytes()) if ok else (0, 1, 0, 0, 0, b"", b""))
                        owner.append(i)
                        continue
                    ends_a, ends_b = np.cumsum(led.width[a]), np.cumsum(own.width[b])
                    cut_a, cut_b = diagonals(ends_a, ends_b, piece)
                    for k, ((i0, i1), (j0, j1)) in enumerate(zip(pairwise(cut_a.tolist()), pairwise(cut_b.tolist()), strict=True)):
                        lead = int(ends_a[i0 - 1] if i0 else 0) - int(ends_b[j0 - 1] if j0 else 0)
                        rows.append((k, len(cut_a) - 1, i1 - i0, j1 - j0, lead, a[i0 : i1 + 1].tobytes(), b[j0 : j1 + 1].tobytes()))
                        owner.append(i)
                names = [x.split()[0] for x in TOKENS.split(", ")]
                kept = [batch.column(c).take(pa.array(owner, pa.int32())) for c in ("doc", "doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TOKENS, strict=True))], names=names)

    return run


def tokenized(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE) -> DataFrame:
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(numbered.mapInArrow(_tokenize(path_a, path_b, piece), TOKENS), "tokens", codec="zstd")


# Merging


class Widths:
    """Bytes of each token, by id."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b


@cache
def widths_of(path_a: str, path_b: str) -> Widths:
    """Read once a worker."""
    return Widths(Led(path_a).width, Pieces(path_b).width)


class Merged:
    """Many pieces at once, each moved behind the one before it so that ends rise throughout."""

    def __init__(self, widths: Widths, n_a: np.ndarray, n_b: np.ndarray, lead: np.ndarray, a: list[bytes], b: list[bytes]):
        all_a, all_b = (np.frombuffer(b"".join(x), "<u2") for x in (a, b))
        size_a, size_b = (np.array([len(y) // 2 for y in x], np.int64) for x in (a, b))
        wide_a, wide_b = (np.concatenate([[0], np.cumsum(w[x])]) for w, x in ((widths.a, all_a), (widths.b, all_b)))
        at_a, at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (size_a, size_b))
        span = np.maximum(wide_a[at_a[1:]] - wide_a[at_a[:-1]] + lead, wide_b[at_b[1:]] - wide_b[at_b[:-1]]) + 1
        base = np.cumsum(span) - span
        ends_a = wide_a[1:] + np.repeat(base + lead - wide_a[at_a[:-1]], size_a)
        ends_b = wide_b[1:] + np.repeat(base - wide_b[at_b[:-1]], size_b)
        # The token left open at a piece's end is there to be overlapped only.
        own_a = np.arange(len(all_a)) - np.repeat(at_a[:-1], size_a) < np.repeat(n_a, size_a)
        own_b = np.arange(len(all_b)) - np.repeat(at_b[:-1], size_b) < np.repeat(n_b, size_b)
        self.a, self.b, ends, other = all_a[own_a], all_b[own_b], ends_a[own_a], ends_b[own_b]
        over = np.searchsorted(ends_b, ends)
        under = np.searchsorted(ends_a, other)
        self.cut_a, self.cut_b = ends_b[over] == ends, ends_a[under] == other
        pair = lambda x, y: x.astype("<u4") << B_BITS | y
        alone = ~self.cut_b
        self.links_a, self.links_b = pair(self.a, all_b[over]), pair(all_a[under[alone]], self.b[alone])
        self.edge_a, self.edge_b = (np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b))
        self.edge_alone = np.concatenate([[0], np.cumsum(alone)])[self.edge_b]
        self.groups = np.diff(np.concatenate([[0], np.cumsum(self.cut_a)])[self.edge_a])

    def tokens(self, k: int) -> tuple[np.ndarray, ...]:
        """A ids, B ids, and where each closes a group."""
        i, j = slice(*self.edge_a[k : k + 2]), slice(*self.edge_b[k : k + 2])
        return self.a[i], self.b[j], self.cut_a[i], self.cut_b[j]


@cache
def shown() -> np.ndarray:
    """Ids as text behind nothing, a comma, a bar and a semicolon."""
    return np.array([f"{s}{i}" for s in ("", ",", "|", ";") for i in range(1 << 16)], object)


def listed(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
    """Whole groups in order, each its A ids and then its B ids, as places in ``shown``; each begins with a semicolon."""
    first_a, first_b = (np.concatenate([[True], x[:-1]]) for x in (cut_a, cut_b))
    closed_a, closed_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate([[0], closed_b])[group_a]] = np.where(first_a, 3 << 16, 1 << 16) + a
    out[np.arange(len(b)) + closed_a[group_b]] = np.where(first_b, 2 << 16, 1 << 16) + b
    return out


FRAGMENT = "head_a string, head_b string, body string, tail_a string, tail_b string"


def fragments(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[str, ...]:
    """What a piece of a longer document gives for stitching: ids up to its first common end, the groups that it holds
    whole, and the ids behind its last common end. Without a common end all of it is head."""
    plain = lambda ids: ",".join(map(str, ids.tolist()))
    at_a, at_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    if not len(at_a):
        return plain(a), plain(b), "", "", ""
    i, j, k, m = int(at_a[0]), int(at_b[0]), int(at_a[-1]), int(at_b[-1])
    body = "".join(shown()[listed(a[i:k], b[j:m], cut_a[i:k], cut_b[j:m])]) if k > i else ""
    return plain(a[:i]), plain(b[:j]), body[1:], plain(a[k:]), plain(b[m:])


def _digests(m: Merged, single: list[int]) -> dict[int, str]:
    """Hashes of documents of one piece, whose groups are all whole."""
    if not single:
        return {}
    a, b, cut_a, cut_b = (np.concatenate(x) for x in zip(*map(m.tokens, single), strict=True))
    text = shown()[listed(a, b, cut_a, cut_b)].tolist() if len(a) else []
    ends = np.cumsum([m.edge_a[k + 1] - m.edge_a[k] + m.edge_b[k + 1] - m.edge_b[k] for k in single]).tolist()
    return {k: hashlib.sha256("".join(text[lo:hi])[1:].encode()).hexdigest() if hi > lo else "" for k, lo, hi in zip(single, [0, *ends], ends, strict=False)}


def _merge(batches: Iterator[pa.RecordBatch], widths: Widths) -> Iterator[tuple[pa.RecordBatch, Merged]]:
    """Rows of pieces in runs of about AT_ONCE tokens, and what merging gives."""
    for batch in batches:
        sizes = np.cumsum(batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy())
        edges = [0, *(np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1).tolist(), batch.num_rows]
        for lo, hi in pairwise(edges):
            part = batch.slice(lo, hi - lo)
            n_a, n_b, lead = (part.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b", "lead"))
            yield part, Merged(widths, n_a, n_b, lead, part.column("a").to_pylist(), part.column("b").to_pylist())


def _stitch(pieces: pa.Table) -> pa.Table:
    """The hash of one document's groups, out of its pieces' fragments in order."""
    digest, a, b, begun = hashlib.sha256(), [], [], False

    def put(text: str) -> None:
        nonlocal begun
        digest.update(((";" if begun else "") + text).encode())
        begun = True

    for r in sorted(pieces.to_pylist(), key=lambda r: r["piece"]):
        a.append(r["head_a"])
        b.append(r["head_b"])
        if r["n_groups"]:
            put(",".join(filter(None, a)) + "|" + ",".join(filter(None, b)))
            if r["body"]:
                put(r["body"])
            a, b = [r["tail_a"]], [r["tail_b"]]
    return pa.table({"doc": pieces.column("doc").slice(0, 1), "groups_sha256": pa.array([digest.hexdigest()])})


# Counts


def _pairs(path_a: str, path_b: str):
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        link, c = np.unique(np.concatenate([np.zeros(0, "<u4"), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(link.astype(np.int64)), pa.array(c.astype(np.int64))], names=["link", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, m in _merge(batches, widths_of(path_a, path_b)):
            held += [m.links_a, m.links_b]
            if sum(map(len, held)) > GATHERED:
                yield out(held)
        yield out(held)

    return run


class Known:
    """Frequent pairs with their counts, and each B id's highest count."""

    def __init__(self, link: np.ndarray, count: np.ndarray, best: np.ndarray):
        order = np.argsort(link)
        self.link, self.count, self.best = link[order].astype(np.uint32), count[order], best

    def find(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is it known, its count or 0, is that its B id's highest)."""
        if not len(self.link):
            return np.zeros(len(links), bool), np.zeros(len(links), np.int64), np.zeros(len(links), bool)
        at = np.minimum(np.searchsorted(self.link, links), len(self.link) - 1)
        known = self.link[at] == links
        count = np.where(known, self.count[at], 0)
        return known, count, known & (count == self.best[links & ((1 << B_BITS) - 1)])


PARTS = "doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SCORED = f"{PARTS}, rare array<struct<link:long,tf:int>>, piece int, pieces int, {FRAGMENT}"


def _score(path_a: str, path_b: str, known):
    struct = pa.struct([("link", pa.int64()), ("tf", pa.int32())])

    def rated(m: Merged, of: Known, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """For each piece its links, how many are best among the known ones, their counts' sum, and what isn't known."""
        many, best_of, sum_of, rare = 0, 0, 0, []
        for links, edges in ((m.links_a, m.edge_a), (m.links_b, m.edge_alone)):
            there, count, best = of.find(links)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])  # noqa: E731, B023
            many, best_of, sum_of = many + np.diff(edges), best_of + total(best.astype(np.int64)), sum_of + total(count)
            rare.append(np.repeat(np.arange(n), np.diff(edges))[~there] << 32 | links[~there].astype(np.int64))
        pair, tf = np.unique(np.concatenate(rare), return_counts=True)
        bounds = np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32)
        fields = [pa.array(pair & 0xFFFFFFFF, pa.int64()), pa.array(tf, pa.int32())]
        return many, best_of, sum_of, pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, fields=list(struct)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in f"{PARTS}, rare, piece, pieces, {FRAGMENT}".split(", ")]
        for part, m in _merge(batches, widths_of(path_a, path_b)):
            pieces = part.column("pieces").to_pylist()
            digest = _digests(m, [k for k, n in enumerate(pieces) if n == 1])
            cut = [fragments(*m.tokens(k)) if n > 1 else (None,) * 5 for k, n in enumerate(pieces)]
            many, best, total, rare = rated(m, known.value, len(pieces))
            numbers = [*(part.column(c).cast(pa.int64()) for c in ("n_a", "n_b")), *(pa.array(x, pa.int64()) for x in (m.groups, many, best, total))]
            texts = [pa.array(x, pa.string()) for x in zip(*cut, strict=True)]
            columns = [part.column("doc"), part.column("doc_id"), *numbers, pa.array([digest.get(k) for k in range(len(pieces))], pa.string()), rare, part.column("piece"), part.column("pieces"), *texts]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, piece: int = PIECE, known_rate: int = KNOWN_RATE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per document row."""
    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
    spark = docs.sparkSession
    tokens = tokenized(docs, path_a, path_b, piece)
    counts = stored(tokens.mapInArrow(_pairs(path_a, path_b), "link long, c long").groupBy("link").agg(F.sum("c").alias("c")), "pairs")
    b_id = F.col("link").bitwiseAND((1 << B_BITS) - 1).cast("int").alias("b")
    best = counts.groupBy(b_id).agg(F.max("c").alias("best"), F.sum("c").alias("total")).toArrow()  # a row for each B id
    total, highest = sum(best.column("total").to_pylist()), np.zeros(1 << B_BITS, np.int64)
    highest[best.column("b").to_numpy()] = best.column("best").to_numpy()
    often = counts.where(F.col("c") * known_rate >= total).toArrow()  # counts add up to the total: known_rate rows at most
    known = spark.sparkContext.broadcast(Known(often.column("link").to_numpy(), often.column("c").to_numpy(), highest))
    scored = stored(tokens.mapInArrow(_score(path_a, path_b, known), SCORED), "scored", codec="zstd")
    rare = scored.select("doc", F.explode("rare").alias("r")).select("doc", "r.*").join(counts, "link")
    tops = spark.createDataFrame(best.select(["b", "best"]))
    rare = rare.withColumn("b", b_id).join(F.broadcast(tops), "b")
    more = rare.select("doc", F.when(F.col("c") == F.col("best"), F.col("tf")).otherwise(0).cast("long").alias("n_best"), (F.col("tf") * F.col("c")).alias("count_sum"))
    long = scored.where("pieces > 1").select("doc", "piece", "n_groups", *(x.split()[0] for x in FRAGMENT.split(", "))).groupBy("doc").applyInArrow(_stitch, "doc long, groups_sha256 string")
    parts = scored.select(*(x.split()[0] for x in PARTS.split(", "))).unionByName(more, allowMissingColumns=True).unionByName(long, allowMissingColumns=True)
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    whole = parts.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in sums), F.max("groups_sha256").alias("groups_sha256"))
    return whole.drop("doc")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
