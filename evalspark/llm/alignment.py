"""Alignment of two tokenizers' ids over the same text.

The two sides' cumulative byte ends are dictionaries from end to index, held as arrays by byte; the ends that both have
slice both id lists into groups, and inside a slice every pair of overlapping tokens is a link.  Documents are aligned
in batches, end to end: each of them ends where both sides do, so no group and no link crosses from one to the next.  How many
documents hold a linked id pair is counted over the whole corpus: documents are taken in chunks, a chunk's distinct
pairs are counted once, so that only they cross the shuffle, and each chunk gets its counts back.  A chunk is written as
pieces, small rows, because thousands of rows of a table are read into memory at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored

#: Text bytes of a chunk, at which it is closed; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Text bytes of a batch, at which it is aligned; its arrays are a few times larger and should stay in a core's cache.
BATCH_BYTES = 1 << 18
#: Entries at most that a piece has of each list of numbers, and bytes of documents' rows at which it is closed.
PIECE, PIECE_BYTES = 1 << 10, 1 << 14
#: Fixed value: what splits a text before byte-pair merging, for rank files, which do not hold it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of both sides are below 2**SHIFT; a pair is the first id shifted, plus the second.
SHIFT = 24
#: Documents of a chunk at most, as their number has the bits that two ids leave.
MOST_DOCS = 1 << 14


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file: its kind (``json``, ``tiktoken`` or ``model``), its bytes, and whether it puts a space
    before a text by itself.  The bytes, about a megabyte, travel with the task."""

    kind: str
    data: bytes
    adds_space: bool

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        kind = Path(path).suffix[1:]
        if kind not in ("json", "tiktoken", "model"):
            raise ValueError(f"no tokenizer for {path}")
        return cls(kind, Path(path).read_bytes(), kind == "model")

    def load(self) -> tuple[Callable[[str], list[int]], list[bytes]]:
        """(text → ids without special tokens, bytes of each id)."""
        return {"json": _json, "tiktoken": _ranks, "model": _pieces}[self.kind](self.data)


def _json(data: bytes) -> tuple[Callable, list[bytes]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode("utf-8"))
    t.encode_special_tokens = True
    # bytes that print as themselves, then the others in order from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    names = {i: s for s, i in t.get_vocab().items()}
    pieces = [bytes(byte.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
    return lambda text: t.encode(text, add_special_tokens=False).ids, pieces


def _ranks(data: bytes) -> tuple[Callable, list[bytes]]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    enc = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return enc.encode_ordinary, pieces


def _pieces(data: bytes) -> tuple[Callable, list[bytes]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        pieces.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode("utf-8"))
    return lambda text: sp.encode(text, num_threads=1, return_type="numpy"), pieces


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Sums of what stands before each entry, and of all at the end."""
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


class Side(NamedTuple):
    """A vocabulary in a task.  ``flat`` has the bytes of all ids, id ``i`` from ``start[i]`` on."""

    encode: Callable
    pieces: list[bytes]
    lead: bool
    lossless: bool
    size: np.ndarray
    start: np.ndarray
    flat: np.ndarray

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's)."""
        own = [self.encode(" " + t if self.lead else t) for t in texts]
        return np.concatenate([np.asarray(x, dtype=np.int64) for x in own]), np.fromiter(map(len, own), dtype=np.int64, count=len(own))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes, joined."""
        size = self.size[ids]
        before = _starts(size)
        at = np.repeat(self.start[ids] - before[:-1], size)
        at += np.arange(before[-1])
        return self.flat[at]


@dataclass(frozen=True)
class Batch:
    """Aligned documents: for each, its numbers of first ids, second ids, groups and linked pairs, and its groups as text;
    all linked pairs in text order, document after document."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    links: np.ndarray


class Aligner:
    """Aligns texts under two vocabularies; built once per task."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides, names = [], []
        for v, ends in ((a, (",", "|")), (b, (",", ";"))):
            encode, pieces = v.load()
            size = np.array([len(p) for p in pieces], dtype=np.int64)
            flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            # tokens of a rank file are stretches of the text in order, so their sizes tell whether one is missing
            self.sides.append(Side(encode, pieces, not v.adds_space, v.kind == "tiktoken", size, _starts(size), flat))
            names += [f"{i}{e}" for e in ends for i in range(len(pieces))]
        wide = max(map(len, names))
        self.name = np.array(names, dtype=f"S{max(wide, 8)}")  # entries of 8 bytes are copied fastest
        self.name_size = np.array([len(x) for x in names], dtype=np.int64)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(places of the texts that have tokens; both sides' ids of them; how many each has; its bytes).  Without tokens are
        null and empty texts, and those of which a side's bytes are not a space and the text."""
        place = np.array([k for k, t in enumerate(texts) if t], dtype=np.int64)
        raw = [(" " + texts[k]).encode("utf-8", "surrogatepass") for k in place]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        ids, count = [], []
        if len(place):
            ids, count = map(list, zip(*(s.ids([texts[k] for k in place]) for s in self.sides), strict=True))
        for check in (self._same_size, self._same_bytes):
            if len(place):
                good = check(ids, count, size, raw)
                if not good.all():
                    ids = [x[np.repeat(good, n)] for x, n in zip(ids, count, strict=True)]
                    count = [n[good] for n in count]
                    place, size, raw = place[good], size[good], [x for x, g in zip(raw, good, strict=True) if g]
        return place, ids, count, size

    def _same_size(self, ids: list, count: list, size: np.ndarray, raw: list[bytes]) -> np.ndarray:
        good = np.ones(len(size), dtype=bool)
        for s, x, n in zip(self.sides, ids, count, strict=True):
            good &= np.diff(_starts(s.size[x])[_starts(n)]) == size
        return good

    def _same_bytes(self, ids: list, count: list, size: np.ndarray, raw: list[bytes]) -> np.ndarray:
        good, whole = np.ones(len(size), dtype=bool), np.frombuffer(b"".join(raw), dtype=np.uint8)
        for s, x in zip(self.sides, ids, strict=True):
            if not s.lossless:
                other = np.flatnonzero(s.bytes_of(x) != whole)
                good[np.searchsorted(np.cumsum(size), other, side="right")] = False
        return good

    def align(self, texts: list[str | None]) -> Batch:
        place, ids, count, size = self.tokens(texts)
        n_a, n_b, n_groups, n_links = (np.zeros(len(texts), dtype=np.int64) for _ in range(4))
        groups = [b""] * len(texts)
        if not len(place):
            return Batch(n_a, n_b, n_groups, n_links, groups, np.zeros(0, dtype=np.int64))
        p, q = ids
        n_a[place], n_b[place] = count
        ends = _starts(size)  # of the documents
        end_a, end_b = (np.cumsum(s.size[x]) for s, x in zip(self.sides, ids, strict=True))
        at_a, at_b = (np.zeros(ends[-1] + 1, dtype=np.int32) for _ in ids)
        at_a[end_a], at_b[end_b] = np.arange(1, len(p) + 1), np.arange(1, len(q) + 1)
        either = np.flatnonzero(at_a | at_b)
        one, two = at_a[either], at_b[either]
        in_a, in_b = one > 0, two > 0
        cut = in_a & in_b
        n_groups[place] = np.diff(np.searchsorted(either[cut], ends, side="right"))
        n_links[place] = np.diff(np.searchsorted(either, ends, side="right"))
        for k, text in zip(place.tolist(), self._groups(p, q, one[cut], two[cut], np.cumsum(count[0] + count[1])), strict=True):
            groups[k] = text
        return Batch(n_a, n_b, n_groups, n_links, groups, self._links(p, q, in_a, in_b))

    @staticmethod
    def _links(p: np.ndarray, q: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
        """Pairs of overlapping tokens.  Between two neighbouring ends of either side lies one token of each, and
        each overlapping pair has one such stretch; a slice's stretches are its own, as it ends where both sides do."""
        return p[np.cumsum(in_a) - in_a] << SHIFT | q[np.cumsum(in_b) - in_b]

    def _groups(self, p: np.ndarray, q: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3``: each slice's ids of both sides.  ``ends``: of the documents, in tokens of both sides."""
        out, shift = np.empty(len(p) + len(q), dtype=np.int64), 0
        sides = ((p, cut_a, np.append(0, cut_b[:-1]), len(self.sides[0].size)), (q, cut_b, cut_a, len(self.sides[1].size)))
        for ids, own, other, n in sides:
            name = ids + shift
            name[own - 1] += n  # a slice's last id has the other end
            out[np.arange(len(ids)) + np.repeat(other, np.diff(own, prepend=0))] = name  # after the other side's ids that stand before
            shift += 2 * n
        to = _starts(self.name_size[out])[ends]
        text = self.name[out].tobytes().translate(None, b"\0")  # shorter names end in zero bytes
        return [text[lo : hi - 1] for lo, hi in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


#: A document's own results.
ROW = {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string", "groups_sha256": "string"}
CHUNK = (
    f"chunk bigint, part int, pair array<bigint>, docs array<int>, rows array<struct<{','.join(f'{k}:{v}' for k, v in ROW.items())}>>, "
    "size array<int>, at array<int>, times array<int>"
)
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]


def _chunks(
    docs: DataFrame, a: Vocabulary, b: Vocabulary, groups_out: bool, chunk_bytes: int, piece: int = 1 << 30, piece_bytes: int = 1 << 30
) -> DataFrame:
    """Chunks of documents, as one row per piece (``part``: its number).  All pieces of a chunk, joined, have its distinct pairs
    (``piece`` of them each) and the number of its documents that hold each; its documents' rows; and, document after
    document (``size`` entries each), places of its pairs and their numbers of links."""
    make = Aligner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, n = make(a, b), 0
        first = TaskContext.get().partitionId() << 32
        ids, texts, done, weight, waiting = [], [], [], 0, 0

        def flush() -> None:
            nonlocal texts, waiting
            x = aligner.align(texts)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups]
            done.append((x, [g.decode() for g in x.groups] if groups_out else [None] * len(texts), digests))
            texts, waiting = [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, done, weight, n
            aligned, groups, digests = zip(*done, strict=True)
            numbers = [np.concatenate([getattr(x, c) for x in aligned]) for c in ("n_a", "n_b", "n_groups", "n_links")]
            cols = [ids, *numbers, list(chain(*groups)), list(chain(*digests))]
            rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            # a document's number stands before its pairs, so that one sort finds the distinct pairs of all of them
            keys = np.concatenate([x.links for x in aligned]) + (np.repeat(np.arange(len(ids), dtype=np.int64), numbers[-1]) << (2 * SHIFT))
            keys.sort()
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            own, times = keys[new], np.diff(np.append(new, len(keys)))
            pair, at, docs_of = np.unique(own & ((1 << 2 * SHIFT) - 1), return_inverse=True, return_counts=True)
            size = np.bincount(own >> (2 * SHIFT), minlength=len(ids))
            row_bytes = np.array([128 + len(g or "") for g in chain(*groups)])
            home = (np.cumsum(row_bytes) - row_bytes) // piece_bytes  # the piece of each document's row
            pieces = np.arange(1 + max(home[-1], len(pair) // piece, len(at) // piece))
            by_count = lambda x: np.minimum(np.append(pieces, len(pieces)) * piece, len(x))
            by_bytes = np.searchsorted(home, np.append(pieces, len(pieces)))
            lists = [(pa.array(pair), by_count(pair)), (pa.array(docs_of, pa.int32()), by_count(pair)), (rows, by_bytes)]
            lists += [(pa.array(x, pa.int32()), to) for x, to in ((size, by_bytes), (at, by_count(at)), (times, by_count(at)))]
            cols = [pa.array(np.full(len(pieces), first + n)), pa.array(pieces, pa.int32())]
            cols += [pa.ListArray.from_arrays(pa.array(to, pa.int32()), x) for x, to in lists]
            ids, done, weight, n = [], [], 0, n + 1
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                ids.append(batch.column(0)[k].as_py())
                texts.append(text)
                weight += 64 + len(text or "")
                waiting += len(text or "")
                full = weight >= chunk_bytes or len(ids) == MOST_DOCS
                if full or waiting >= BATCH_BYTES:
                    flush()
                if full:
                    yield close()
        if texts:
            flush()
        if ids:
            yield close()

    names = list(ROW)
    kinds = [pa.string() if v == "string" else pa.int64() for v in ROW.values()]
    ints = pa.list_(pa.int32())
    schema = pa.schema({
        "chunk": pa.int64(), "part": pa.int32(), "pair": pa.list_(pa.int64()), "docs": ints,
        "rows": pa.list_(pa.struct(list(zip(names, kinds, strict=True)))), "size": ints, "at": ints, "times": ints,
    })
    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def _pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): documents corpus-wide that hold the linked pair, and whether no pair of its first id has more."""
    held = chunks.select(F.explode(F.arrays_zip("pair", "docs")).alias("x")).select("x.*")
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count"))
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, a: Vocabulary, b: Vocabulary, groups_out: bool = True, chunk_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of ``docs`` (doc_id, text) under both vocabularies.

    documents: one row per document row with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (null without
    ``groups_out``) and groups_sha256.  links: a, b, count, best for every id pair that is linked anywhere.

    A text is encoded whole, with one space before it and without special tokens.  Null and empty texts, and texts that a
    side does not give back byte by byte, have no tokens: zeros and empty strings.  Rows with null or equal doc_id
    are documents of their own and count each.  An empty table gives no rows.  Other columns play no part.
    """
    chunks = stored(_chunks(docs, a, b, groups_out, chunk_bytes, PIECE, PIECE_BYTES))
    counts = _pair_counts(chunks)
    own = chunks.select("chunk", "part", F.posexplode("pair").alias("at", "pair"))
    own = own.select("chunk", (F.col("part") * PIECE + F.col("at")).alias("place"), "pair")
    back = own.join(counts, "pair").select("chunk", "place", "count", "best")

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        if not left.num_rows:
            return pa.table({c: [] for c in final}, schema=empty)
        pieces = np.argsort(left.column("part").to_numpy())
        joined = {c: pa.concat_arrays([left.column(c)[k].values for k in pieces.tolist()]) for c in ("at", "times", "size", "rows")}
        at, times, size = (joined[c].to_numpy() for c in ("at", "times", "size"))
        doc = np.repeat(np.arange(len(size)), size)
        sums = [np.zeros(len(size), dtype=np.int64) for _ in range(2)]
        for s, value in zip(sums, (best, count), strict=True):
            np.add.at(s, doc, value[at] * times)
        cols = dict(zip(names, joined["rows"].flatten(), strict=True)) | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table([cols[c] for c in final], names=final)

    names, final = list(ROW), list(RESULT)
    empty = pa.schema([(c, pa.string() if c.startswith("groups") else pa.int64()) for c in final])
    kinds = ", ".join(f"{c} {'string' if c.startswith('groups') else 'bigint'}" for c in final)
    rows = chunks.select(F.col("chunk").alias("home"), "part", "rows", "size", "at", "times")
    documents = rows.groupBy("home").cogroup(back.groupBy("chunk")).applyInArrow(give, kinds)
    mask = (1 << SHIFT) - 1
    links = counts.select(
        F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(mask)).cast("int").alias("b"), "count", "best"
    )
    return documents, links
