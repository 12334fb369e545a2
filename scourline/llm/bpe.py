"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces (pre-tokens) of a batch are laid end to end as one doubly linked list of symbols; a piece of any length is
merged in the same arrays. Every adjacent pair that the ranks know sits in the bucket of its merge rank. A three-level
bitmap over the ranks gives the least non-empty bucket by find-first-set. Entries whose pair has changed since are
stale and skipped. All valid entries of a bucket merge in one step: pieces don't touch each other, and within a piece
merges of one rank go from left to right, overlapping ones alternately. Only where a merge of that rank could give a
pair of a lower rank does the piece stop at the first merge that does, as the one-at-a-time order asks.

Null and empty texts have no ids. Equal rows and equal ids keep a row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
#: Distinct pieces a worker remembers, and characters it cuts up before it merges what is new among them.
REMEMBERED, CHUNK = 800_000, 6_000_000


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


class RankQueue:
    """Buckets of list positions by merge rank under a bitmap of 64-way levels."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            was = level[at]
            level[at] = was | (1 << bit)
            if was:
                break

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and all positions in its bucket."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        found = self.buckets.pop(at)
        up = at
        for level in self.levels:
            up, bit = up >> 6, up & 63
            level[up] &= ~(1 << bit)
            if level[up]:
                break
        return at, found[0] if len(found) == 1 else np.concatenate(found)


class Codec:
    """Encodes and decodes by a rank file (lines of a base64 token and its rank) and a splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.split = regex.compile(pattern).findall
        self.size = max(self.ranks.values()) + 1
        self.token = [b""] * self.size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        #: Ranks whose merge can give a pair of a lower rank.
        self.falls = {int(x) for k, r in pairs.items() for x in divmod(k, self.size) if r < x}
        self.known: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to, NONE if it doesn't."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NONE) if len(self.keys) else np.full(len(a), NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each non-empty piece as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        spelt = b"".join(pieces)
        tok = self.byte[np.frombuffer(spelt, np.uint8)]
        n = len(tok)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes) if self.falls else None
        pair = np.full(n, NONE)
        inner = np.flatnonzero(nxt >= 0).astype(np.int32)
        data = np.frombuffer(spelt, np.uint8)
        pair[inner] = self.first[data[inner], data[inner + 1]]
        queue = RankQueue(self.size)

        def push(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks != NONE], ranks[ranks != NONE]
            if len(at) == 1:
                queue.push(int(ranks[0]), at)
            elif len(at):
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
                for i, j in zip(cuts, cuts[1:]):
                    queue.push(int(ranks[i]), at[i:j])

        push(inner)
        while (least := queue.pop()) is not None:
            r, at = least
            at = at[pair[at] == r]
            if len(at) > 1:
                at = _distinct(at)
                linked = nxt[at[:-1]] == at[1:]
                if linked.any():  # a run of overlapping pairs: every second one merges
                    index = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(np.concatenate([[True], ~linked]), index, 0))
                    at = at[(index - run) % 2 == 0]
            if not len(at):
                continue
            if r in self.falls and len(at) > 1:
                after, before = nxt[nxt[at]], prv[at]
                joined = np.concatenate([[False], nxt[at[:-1]] == before[1:]])
                left = np.where(before >= 0, self.rank(np.where(joined, r, tok[before]), np.full(len(at), r)), NONE)
                right = np.where(after >= 0, self.rank(np.full(len(at), r), tok[after]), NONE)
                low = np.minimum(left, right) < r
                if low.any():
                    of = piece[at]
                    seen = np.cumsum(low) - low  # falls before this one, over all pieces
                    first = np.searchsorted(of, of)
                    wait = seen - seen[first] > 0
                    if wait.any():
                        queue.push(r, at[wait])
                        at = at[~wait]
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = r
            nxt[at] = after
            pair[gone] = NONE
            tok[gone] = -1
            inside = after >= 0
            prv[after[inside]] = at[inside]
            before = prv[at]
            again = np.concatenate([at, before[before >= 0]])
            if len(again) > 2:
                again = _distinct(again)
            ahead = nxt[again]
            has = ahead >= 0
            pair[again] = NONE
            again = again[has]
            if len(again):
                pair[again] = self.rank(tok[again], tok[ahead[has]])
                push(again)
        alive = tok >= 0
        ids = tok[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [ids[i:j] for i, j in zip([0, *stops], stops)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of the pieces into ``known``; a piece that is a token is its id."""
        longer, spelt = [], []
        for p in pieces:
            data = p.encode()
            r = self.ranks.get(data)
            if r is None:
                longer.append(p)
                spelt.append(data)
            else:
                self.known[p] = r.to_bytes(4, "little")
        if longer:
            self.known.update(zip(longer, self.merge(spelt)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            cut, chars = [], 0
            while at < len(texts) and (not cut or chars + len(texts[at]) <= CHUNK):
                cut.append(self.split(texts[at]))
                chars += len(texts[at])
                at += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn(set().union(*cut) - self.known.keys())
            of = self.known.__getitem__
            out += [b"".join(map(of, c)) for c in cut]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """This process's codec for a rank file."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(``id_col``, n_tokens, ids, round_trip), or with ``digests`` (``id_col``, n_tokens, ids_sha256, decoded_sha256).

    round_trip says that the decoded ids are the text's bytes.

    The rank file is read on the driver and shipped as a broadcast variable: its size is that of the vocabulary.
    """
    with open(ranks_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for b in batches:
            start = 0
            while start < b.num_rows:  # rows a few at a time, by their bytes
                stop, size = start, 0
                while stop < b.num_rows and (stop == start or size < CHUNK):
                    size += len(b.column(1)[stop].as_py() or "")
                    stop += 1
                texts = [t or "" for t in b.column(1).slice(start, stop - start).to_pylist()]
                ids = own.encode(texts)
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    more = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]]
                    more = [pa.array(x, pa.string()) for x in more]
                else:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32())
                    same = [own.decode(x) == t.encode() for x, t in zip(ids, texts)]
                    more = [pa.ListArray.from_arrays(offsets, flat), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), n, *more], ["id", "n_tokens", "x", "y"])
                start = stop

    few = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    if digests:
        out = few.mapInArrow(run, "id bigint, n_tokens bigint, x string, y string").toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
    else:
        out = few.mapInArrow(run, "id bigint, n_tokens bigint, x array<int>, y boolean").toDF(id_col, "n_tokens", "ids", "round_trip")
    return out


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, text): the texts of arrays of ids; bytes that aren't UTF-8 become U+FFFD."""
    with open(ranks_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for b in batches:
            texts = [b"".join(map(own.token.__getitem__, x.as_py() or [])).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id bigint, text string").toDF(id_col, "text")
