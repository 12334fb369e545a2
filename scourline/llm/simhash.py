"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints that differ in at most 3 bits differ in at most 3 of 6 blocks, so they
agree on at least 3 blocks: each fingerprint is filed under its 20 choices of 3 blocks, fingerprints that share a
choice meet, and each meeting is verified by Hamming distance. Only distinct fingerprints are filed, and a meeting
place gives the edges of a spanning forest of its links instead of its pairs.

A meeting place of more than ``crowd`` fingerprints is not brought together. Its fingerprints are linked through
points of the Hamming space instead: a and b are within 3 bits exactly if some point lies within 1 bit of a and within
2 bits of b, and each point has at most 2081 such neighbours.

Null texts count as texts without words (fingerprint zero). Equal rows and equal ids keep a row each. A null id never
names a component while an id of the same component is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scourline.plans.scratch import keep, sized

BITS = 64
#: First bit and width of each of the six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints that one meeting place may bring into one task.
CROWD = 8192
#: Rows that a key may have in a join by that key; the others are looked up in a broadcast table.
HOT = 1 << 17


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of UTF-8 ``text``: words between ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    all_bits = np.array(hashes, dtype=">u8").view(np.uint8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(all_bits), 8 << 14):  # long texts a part at a time
        ones += np.unpackbits(all_bits[at : at + (8 << 14)]).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(``id_col``, fp): a row for each row of ``df``, whatever its other columns are called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", width, seed) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    few = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "id bigint, fp bigint").withColumnRenamed("id", id_col)


def hexed(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks() -> list[int]:
    whole = [((1 << w) - 1) << s for s, w in BLOCKS]
    return [int(np.uint64(a | b | c).astype(np.int64)) for a, b, c in combinations(whole, 3)]


def _forest(group: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``group`` (distinct unsigned fingerprints)."""
    edges = []
    left = group
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            pivot = front.pop()
            near = np.bitwise_count(left ^ pivot) <= most
            if near.any():
                found = left[near]
                edges += [(pivot, x) for x in found]
                front += list(found)
                left = left[~near]
    return edges


def _meet(most: int):
    """Streams rows (choice, place, fp) that arrive sorted by choice and place; gives edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group, which the next batch may continue

        def edges(choice, place, fp) -> pa.RecordBatch:
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (place[1:] != place[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            found = []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                found += _forest(np.unique(fp[bounds[i] : bounds[i + 1]].view(np.uint64)), most)
            both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[start:] for x in now]
            if start:
                yield edges(*(x[:start] for x in now))
        if held is not None:
            yield edges(*held)

    return run


def _through_points(fps: DataFrame, most: int) -> DataFrame:
    """Exact links of a crowd: fingerprints that share a point near both."""
    near = most // 2
    flips = [[0], [0]]
    for k in range(1, most - near + 1):
        more = [sum(1 << i for i in c) for c in combinations(range(BITS), k)]
        flips[1] += more
        if k <= near:
            flips[0] += more
    signed = [np.array(f, dtype=np.uint64).view(np.int64) for f in flips]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, flips = b.column(0).to_numpy(), np.concatenate(signed)
            for at in range(0, len(every), 32):
                fp = every[at : at + 32]
                close = np.tile(np.arange(len(flips)) < len(signed[0]), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, len(flips))), pa.array(close)], ["point", "fp", "close"])

    at = fps.mapInArrow(run, "point bigint, fp bigint, close boolean").groupBy("point")
    met = at.agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("fps"))
    return met.where(F.col("u").isNotNull() & (F.size("fps") > 1)).select("u", F.explode("fps").alias("v")).where("u <> v")


def links(distinct: DataFrame, most: int = 3, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` that connect whatever links of at most ``most`` bits connect."""
    if most != 3:
        raise ValueError("the six blocks are laid out for 3 differing bits")
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])).alias("choice", "place"))
    crowded = keep(filed.groupBy("choice", "place").count().where(F.col("count") > crowd).select("choice", "place"), "crowded")
    some = not crowded.isEmpty()
    calm = filed.join(crowded, ["choice", "place"], "left_anti") if some else filed
    sorted_in = calm.select("choice", "place", "fp").repartition("choice", "place").sortWithinPartitions("choice", "place")
    found = sorted_in.mapInArrow(_meet(most), "u bigint, v bigint")
    if some:
        found = found.union(_through_points(filed.join(crowded, ["choice", "place"], "left_semi").select("fp").distinct(), most))
    return found


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def looked_up(left: DataFrame, right: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and says in ``n`` how many rows of ``left`` have it.

    Keys of more than ``hot`` rows, of which there are at most the rows of ``left`` over ``hot``, are broadcast, so no task
    gets all rows of a hot key.
    """
    many = right.where(F.col("n") > hot).drop("n")
    rest = left.join(F.broadcast(many.select(key)), key, "left_anti").join(right.where(F.col("n") <= hot).drop("n"), key)
    return left.join(F.broadcast(many), key).unionByName(rest)


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every node a of the graph but the least of its component, with that least node b.

    Alternates large and small stars until nothing changes, each round a written table. A round needs the minimum of each
    node's neighbours, which is combined before the shuffle, and hands it to the neighbours; a hub's is broadcast.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "edges")
    mark = _digest(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = keep(looked_up(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        was, mark = mark, _digest(now)
        if mark == was:
            break
    return now


def components(fps: DataFrame, id_col: str = "doc_id", most: int = 3, crowd: int = CROWD) -> DataFrame:
    """(``id_col``, fp, component_id): component_id is the least id reachable by links of at most ``most`` bits."""
    fps = keep(fps.select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    distinct = keep(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")
    star = stars(links(distinct.select("fp"), most, crowd))
    named = distinct.join(star, F.col("fp") == F.col("a"), "left").select("fp", "rows", "first", F.coalesce("b", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = keep(looked_up(named, least, "root").select("fp", "component_id", F.col("rows").alias("n")), "component")
    return looked_up(fps, of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Similar documents: a longer fingerprint for links far beyond 3 bits.

TABLES, SLOT = 16, 16
#: Texts of so few shingles are compared with all others on the shingles: their bits do not follow the law of large sets.
FEW = 64
#: Shingles that a family may bring into one task to have its open links verified.
PACK = 1 << 22
#: Members of a crowded family that stand beside each of its parts, so that the parts of one dense group find each other.
PIVOTS = 32


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles, in order; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)] if words else [], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip([0, *(e + 1 for e in ends)], ends[width - 1 :])), np.uint64, len(words) - width + 1))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """16 signed 64-bit SimHashes of a set of shingles, each under hashes of its own."""
    out = np.zeros(TABLES, np.int64)
    if not len(h):
        return out
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (t + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(32))).astype(">u8").view(np.uint8)
            ones = np.zeros(BITS, np.int64)
            for at in range(0, len(x), 8 << 14):
                ones += np.unpackbits(x[at : at + (8 << 14)]).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
            out[t] = np.packbits(2 * ones > len(h)).view(">i8")[0]
    return out


def wide_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, most: int = FEW, seed: int = 42) -> DataFrame:
    """(id, mark, fps, few) for every row: mark is a hash of the text, few has the shingles in order if they are ``most`` at
    most, else it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, few = np.zeros((b.num_rows, TABLES), np.int64), []
            for i, t in enumerate(b.column(2).cast(pa.binary())):
                found = shingles(t.as_py() or b"", width, seed)
                fps[i] = wide_fingerprint(found)
                few.append(np.sort(found.view(np.int64)) if 0 < len(found) <= most else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * TABLES, pa.int32()), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(few, pa.list_(pa.int64()))], ["id", "mark", "fps", "few"])

    text = F.col(text_col).cast("string")
    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return chosen.mapInArrow(run, "id bigint, mark bigint, fps array<bigint>, few array<bigint>")


def radius_of(least: float, deviations: float, bits: int = TABLES * BITS) -> int:
    """Differing bits expected of two sets of Jaccard similarity ``least``, and so many deviations more."""
    p = float(np.arccos(2 * least / (1 + least)) / np.pi)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def shingle_sets(df: DataFrame, key_col: str, text_col: str, width: int, seed: int = 42) -> DataFrame:
    """(key, shingles): the distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py() or b"", width, seed).view(np.int64) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "shingles"])

    few = df.select(F.col(key_col).cast("bigint").alias("key"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "key bigint, shingles array<bigint>")


def _apart(f: np.ndarray, g: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count(f[a] ^ f[b]).astype(np.int16) + np.bitwise_count(g[a] ^ g[b])


def _meet_wide(most: int):
    """Like ``_meet`` for rows (place, node, f, g) sorted by place: (family, low, node) for whatever links over two
    fingerprints connect; low is the family's least node.

    Such links only say who may be alike, so all members of a family stay; families of the same members have one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def met(place, f, g) -> np.ndarray:
            """Numbers of the places with a link, and of all large ones; the small ones are compared all at once."""
            nth = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
            size = np.bincount(nth)
            found = [np.flatnonzero(size > 32)]
            small = size[nth] <= 32
            for d in range(1, 32):
                at = np.flatnonzero((nth[d:] == nth[:-d]) & small[d:])
                if not len(at):
                    break
                found.append(nth[at[_apart(f, g, at, at + d) <= most]])
            return np.unique(np.concatenate(found))

        def families(place, nodes, f, g) -> pa.RecordBatch:
            f, g = f.view(np.uint64), g.view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            found = {}
            for i in met(place, f, g):
                at = slice(bounds[i], bounds[i + 1])
                left = np.stack([nodes[at].view(np.uint64), f[at], g[at]])
                while left.shape[1] > 1:
                    front, left, members = [left[:, 0]], left[:, 1:], [left[0, :1]]
                    while front and left.shape[1]:
                        pivot = front.pop()
                        near = np.bitwise_count(left[1] ^ pivot[1]).astype(np.int16) + np.bitwise_count(left[2] ^ pivot[2]) <= most
                        if near.any():
                            members.append(left[0, near])
                            front += list(left[:, near].T)
                            left = left[:, ~near]
                    if len(members) > 1:
                        own = np.sort(np.concatenate(members).view(np.int64))
                        found[xxhash.xxh64_intdigest(own.tobytes())] = own
            sizes = [len(x) for x in found.values()]
            names = np.repeat(np.array(list(found), np.uint64).view(np.int64), sizes)
            lows = np.repeat(np.array([x[0] for x in found.values()], np.int64), sizes)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(lows), pa.array(np.concatenate([np.zeros(0, np.int64), *found.values()]))], ["family", "low", "node"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            same = now[0] == now[0][-1]
            start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[start:] for x in now]
            if start:
                yield families(*(x[:start] for x in now))
        if held is not None:
            yield families(*held)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each run of equal values in the first column."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:]):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


class _Members:
    """Members of a family, and who of them is linked to one of them: by the shingles if both have few, else by bits."""

    def __init__(self, t: pa.Table, least: float) -> None:
        self.least, self.sure, self.most = least, radius_of(least, -4), radius_of(least, 3)
        self.nodes = t["node"].to_numpy()
        self.fps = t["fps"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TABLES)
        few = [None if x.values is None else x.values.to_numpy() for x in t["few"]]
        self.size = np.array([0 if x is None else len(x) for x in few])
        self.has = np.flatnonzero(self.size)
        if len(self.has):
            self.kinds, self.codes = np.unique(np.concatenate([few[i] for i in self.has]), return_inverse=True)
            self.starts = np.concatenate([[0], np.cumsum(self.size[self.has])])
            self.order = np.zeros(len(few), np.int64)
            self.order[self.has] = np.arange(len(self.has))

    def linked(self, p: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``rest`` are linked to ``p`` for certain, and which may be."""
        certain, open_ = np.zeros(len(rest), bool), np.zeros(len(rest), bool)
        both = (self.size[rest] > 0) & (self.size[p] > 0)
        if both.any():
            own = np.zeros(len(self.kinds), np.int64)
            own[self.codes[self.starts[self.order[p]] : self.starts[self.order[p]] + self.size[p]]] = 1
            shared = np.add.reduceat(own[self.codes], self.starts[:-1])[self.order[rest[both]]]
            certain[both] = shared >= self.least * (self.size[rest[both]] + self.size[p] - shared)
        if not both.all():
            bits = np.bitwise_count(self.fps[rest[~both]] ^ self.fps[p]).sum(1, dtype=np.int64)
            certain[~both] = bits <= self.sure
            open_[~both] = (bits > self.sure) & (bits <= self.most)
        return certain, open_


#: Edges (u, v, 0, True), or (family, node, root, False) for members of a family that may be linked to one of another root.
Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]


def _alike(t: pa.Table, least: float, ask: bool) -> Found:
    """Certain edges of one family, by which its members have a root, and (with ``ask``) whom they leave open."""
    m = _Members(t, least)
    group = np.full(len(m.nodes), -1)
    left = np.arange(len(m.nodes))
    while len(left):
        front, left = [left[0]], left[1:]
        group[front[0]] = front[0]
        while front and len(left):
            p = front.pop()
            certain, _ = m.linked(p, left)
            if certain.any():
                near = left[certain]
                group[near] = group[p]
                yield np.full(len(near), m.nodes[p]), m.nodes[near], np.zeros(len(near), np.int64), True
                front += near.tolist()
                left = left[~certain]
    if not ask or (group == group[0]).all() or len(m.has) == len(m.nodes):
        return
    asks = np.zeros(len(m.nodes), bool)
    for p in range(len(m.nodes) - 1):
        rest = np.arange(p + 1, len(m.nodes))
        rest = rest[group[rest] != group[p]]
        near = rest[m.linked(p, rest)[1]]
        if len(near):
            asks[p] = asks[near] = True
    if asks.any():
        yield np.full(asks.sum(), t.column(0)[0].as_py()), m.nodes[asks], m.nodes[group[asks]], False


def _between(t: pa.Table, least: float) -> Found:
    """The same between the members that ask (each a strange one) and all others of another root."""
    m = _Members(t, least)
    root, strange, asks, family = (t[c].to_numpy(zero_copy_only=False) for c in ("root", "strange", "asks", "family"))
    everyone = np.flatnonzero(~asks)
    open_ = np.zeros(len(m.nodes), bool)
    for p in np.flatnonzero(asks):
        # Two strange members meet twice, once for each of them.
        rest = everyone[(root[everyone] != root[p]) & ~(strange[everyone] & (m.nodes[everyone] < m.nodes[p]))]
        certain, may_be = m.linked(p, rest)
        near = rest[certain][np.unique(root[rest[certain]], return_index=True)[1]]
        if len(near):
            yield np.full(len(near), m.nodes[p]), m.nodes[near], np.zeros(len(near), np.int64), True
        if may_be.any():
            open_[p] = open_[rest[may_be]] = True
    if open_.any():
        yield family[open_], m.nodes[open_], root[open_], False


def _verified(t: pa.Table, least: float) -> Found:
    """Edges of members whose shingles are similar, as many as join their roots. Of two parts, pairs across them only."""
    most = radius_of(least, 3)
    nodes, part, root = (t[c].to_numpy(zero_copy_only=False) for c in ("node", "part", "root"))
    fps = t["fps"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TABLES)
    sets = t["shingles"].combine_chunks()
    size = np.diff(sets.offsets.to_numpy())
    starts = np.cumsum(size) - size
    kinds, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    two = (part != part[0]).any()
    own = np.zeros(len(kinds), np.int64)
    for p in range(len(nodes) - 1):
        rest = np.arange(p + 1, len(nodes))
        rest = rest[(root[rest] != root[p]) & (not two or part[rest] != part[p])]
        rest = rest[np.bitwise_count(fps[rest] ^ fps[p]).sum(1, dtype=np.int64) <= most]
        rest = rest[size[rest] > 0]
        if not len(rest) or not size[p]:
            continue
        own[codes[starts[p] : starts[p] + size[p]]] = 1
        n = size[rest]
        at = np.repeat(starts[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.add.reduceat(own[codes[at]], np.cumsum(n) - n)
        own[codes[starts[p] : starts[p] + size[p]]] = 0
        for q in rest[shared >= least * (n + size[p] - shared)]:
            if root[q] != root[p]:
                yield nodes[p : p + 1], nodes[q : q + 1], np.zeros(1, np.int64), True
                root = np.where(root == root[q], root[p], root)


def _compare(of_family):
    """Streams rows sorted by their first column, a family; gives what ``of_family`` finds in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        many = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([x[i] for x in found])) for i in range(3)]
            sure = np.repeat([x[3] for x in found], [len(x[0]) for x in found])
            found.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(sure)], ["u", "v", "root", "sure"])

        for t in _runs(batches):
            for edge in of_family(t):
                found.append(edge)
                many += len(edge[0])
                if many > 100_000:
                    yield out()
                    many = 0
        if found:
            yield out()

    return run


_EDGES = "u bigint, v bigint, root bigint, sure boolean"


def _in_order(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _crowd_edges(members: DataFrame, crowded: DataFrame, calm: DataFrame, least: float, crowd: int) -> DataFrame:
    """Edges of families (family, n) too large for one task, given the certain edges of all others.

    A family is cut into parts of half a crowd. Each part is compared within itself and with some pivots that stand beside
    all parts, which gives certain edges and by them a root for every member. Members of the family's most frequent root
    need no further link among themselves. Every other member is strange: the strange ones are cut into blocks as well, and
    each block meets each part. No pair of different roots is left out, and no task has more than a crowd.
    """
    half = max(1, crowd // 2)
    own = members.join(F.broadcast(crowded), "family")  # few: a crowd or more of all memberships for each row
    own = own.withColumns({"parts": F.ceil(F.col("n") / half).cast("int"), "pivot": F.pmod(F.xxhash64("node", F.lit(6)), F.col("n")) < PIVOTS})
    own = keep(own.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")), "crowd")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = own.select("family", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("part"))).alias("in"), "node", "fps", "few")
    dealt = dealt.select(F.xxhash64("family", "in").alias("run"), "node", "fps", "few")
    within = keep(_in_order(dealt, "run").mapInArrow(_compare(lambda t: _alike(t, least, False)), _EDGES), "crowd-within")
    star = stars(within.union(calm).where("sure").select("u", "v"))
    rooted = own.join(star, F.col("node") == F.col("a"), "left").withColumn("root", F.coalesce("b", "node")).drop("a", "b")
    sizes = keep(rooted.groupBy("family", "root").agg(F.count(F.lit(1)).alias("size")), "crowd-roots")
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("strangers"))
    rooted = rooted.join(F.broadcast(main), "family").where("strangers > 0")
    rooted = rooted.withColumns({"strange": F.col("root") != F.col("main"), "blocks": F.ceil(F.col("strangers") / half).cast("int")})
    rooted = keep(rooted.withColumn("block", F.pmod(F.xxhash64("node", F.lit(8)), F.col("blocks")).cast("int")), "crowd-rooted")
    ask = rooted.where("strange").select("family", "block", F.explode(every).alias("part"), "node", "fps", "few", "root", "strange", F.lit(True).alias("asks"))
    all_ = rooted.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "node", "fps", "few", "root", "strange", F.lit(False).alias("asks"))
    both = ask.union(all_).select(F.xxhash64("family", "block", "part").alias("run"), "node", "fps", "few", "root", "strange", "asks", "family")
    return within.union(_in_order(both, "run").mapInArrow(_compare(lambda t: _between(t, least)), _EDGES))


def _merged(families: DataFrame, most: int) -> DataFrame:
    """(family, node): families (family, low, node) that share members are one, if they have ``most`` members at most
    together; the others stay as they are. ``low`` is any member of a family, the same in all its rows.

    A dense group meets in all its blocks, each time without some of its members. Merged, a member is one row instead of up
    to 64, a pair is compared once, and whoever met still meets.
    """
    lows = keep(families.groupBy("node").agg(F.collect_set("low").alias("lows")), "lows")  # a member's blocks at most
    least = F.array_min("lows").alias("v")
    star = stars(lows.select(F.col("node").alias("u"), least).union(lows.select(F.explode("lows").alias("u"), least)))
    rooted = keep(lows.select("node").join(star, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root")), "rooted")
    sizes = keep(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root"), "apart")
    large = F.broadcast(sizes)  # few: one for each ``most`` nodes at most
    whole = rooted.join(large, "root", "left_anti").select(F.xxhash64(F.lit(2), "root").alias("family"), "node")
    if sizes.isEmpty():
        return whole
    apart = rooted.join(large, "root", "left_semi").select("node")
    return whole.union(families.select("family", "node").join(apart.hint("merge"), "node", "left_semi").select("family", "node"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(distinct, star): groups of similar texts.

    ``distinct`` has a row (node, id, mark, fps, few) for each distinct 1024-bit fingerprint: a number of its own, and the
    least id of its texts with a hash of that text. ``star`` maps every node but one of each group to that one (a, b).

    Fingerprints meet in 64 blocks of 16 bits; what a Hamming check over 128 bits connects there is a family. Families that
    share members are merged up to half a crowd, so that most texts are in one and not in 64, see ``_merged``. Within a
    family all pairs are compared over all 1024 bits, and links that are certain join members; members with links too close
    to ``least`` for that meet again with their shingles. At a similarity of 0.8 two texts share a block with probability
    0.99, at 0.85 with 0.9997.

    Texts of at most ``FEW`` shingles do not go by bits. They and the texts of up to ``FEW / least``, the largest they can be
    similar to, are a family by each shingle of their prefixes (of two sets of similarity ``least`` the first shingles, so
    many that the rest couldn't make it, share one), and are compared on their shingles there: these links are exact.

    A block or a shingle that more than ``crowd`` texts share (or 16 times the mean of all blocks, where that is more) is a
    crowded family; no task gets it whole, see ``_crowd_edges``.
    """
    each = wide_fingerprints(docs, id_col, text_col, width, int(FEW / least + 1e-9)).where("id is not null")
    grouped = each.groupBy("fps").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("few").alias("few"))
    distinct = keep(grouped.select("first.id", "first.mark", "fps", "few").withColumn("node", F.monotonically_increasing_id()), "distinct-wide")
    slots = TABLES * (BITS // SLOT)
    per = BITS // SLOT
    crowd = max(crowd, 16 * distinct.count() // (1 << SLOT))
    own, other = f"fps[cast(s div {per} as int)]", f"fps[cast((s div {per} + 1) % {TABLES} as int)]"
    place = f"cast(s as bigint) * 65536 + (shiftrightunsigned({own}, {SLOT} * (s % {per})) & 65535)"
    by_bits = distinct.where(f"few is null or size(few) > {FEW}")
    filed = by_bits.select("node", F.explode(F.expr(f"transform(sequence(0, {slots - 1}), s -> named_struct('place', {place}, 'f', {own}, 'g', {other}))")).alias("r")).select("r.place", "node", "r.f", "r.g")
    first = F.expr(f"slice(few, 1, size(few) - cast(ceil({least} * size(few) - 1e-9) as int) + 1)")
    shared = distinct.where("few is not null").select("node", F.explode(first).alias("place"))
    blocks_of = by_bits.select(F.explode(F.expr(f"transform(sequence(0, {slots - 1}), s -> {place})")).alias("place"))
    hot = [keep(x.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd), "crowded") for x in (blocks_of, shared.select("place"))]
    some = [not x.isEmpty() for x in hot]
    named = [x.select("place", F.xxhash64(F.lit(i), "place").alias("family"), "n") for i, x in enumerate(hot)]
    calm = [x.join(F.broadcast(h.select("place")), "place", "left_anti") if s else x for x, h, s in zip((filed, shared), hot, some)]
    met = _in_order(calm[0].select("place", "node", "f", "g"), "place").mapInArrow(_meet_wide(radius_of(least, 3.1, 2 * BITS - SLOT)), "family bigint, low bigint, node bigint")
    sharing = calm[1].groupBy("place").agg(F.sort_array(F.collect_set("node")).alias("nodes")).where(F.size("nodes") > 1)
    # Nodes of the latter are inverted until the merging: bits don't tell whether a text of few shingles is like a longer one.
    inverted = sharing.select(F.xxhash64("nodes").alias("family"), F.bitwise_not(F.col("nodes")[0]).alias("low"), F.explode(F.transform("nodes", F.bitwise_not)).alias("node"))
    families = keep(met.union(inverted).distinct(), "families")
    texts = distinct.select("node", "fps", "few")
    merged = _merged(families, max(1, crowd // 2)).withColumn("node", F.greatest("node", F.bitwise_not("node")))
    members = merged.join(texts, "node").select("family", "node", "fps", "few")
    near = _in_order(members, "family").mapInArrow(_compare(lambda t: _alike(t, least, True)), _EDGES)
    if any(some):
        near = keep(near, "calm")
        crowds = [x.select("place", "node").join(F.broadcast(h), "place").select("family", "node") for x, h, s in zip((filed, shared), named, some) if s]
        crowded = reduce(DataFrame.union, [h.select("family", "n") for h, s in zip(named, some) if s])
        near = near.union(_crowd_edges(reduce(DataFrame.union, crowds).join(texts, "node").select("family", "node", "fps", "few"), crowded, near, least, crowd))
    near = keep(near.distinct(), "near")
    asked = near.where("not sure").select(F.col("u").alias("family"), F.col("v").alias("node"), "root")
    checked = _by_shingles(docs, id_col, text_col, width, least, distinct, asked)
    return distinct, stars(near.where("sure").select("u", "v").union(checked))


def _by_shingles(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, distinct: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges (u, v) of the members (family, node, root) that bits leave open, by their whole sets of shingles.

    Members are compared where they meet; no pair is a row. A family of more than ``PACK`` shingles is cut into parts, and
    each two parts meet.
    """
    nodes = keep(distinct.join(asked.select("node").distinct(), "node").select(F.col("id").alias("asked_id"), F.col("mark").alias("asked_mark"), "node"), "asked")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = texts.join(sized(nodes), (F.col("id") == F.col("asked_id")) & (F.col("mark") == F.col("asked_mark"))).select("node", "text")
    sets = shingle_sets(found, "node", "text", width).groupBy(F.col("key").alias("node")).agg(F.first("shingles").alias("shingles"))  # equal rows have equal sets
    sets = keep(sets.join(distinct.select("node", "fps"), "node"), "shingles")
    total = asked.join(sets.select("node", F.size("shingles").alias("n")), "node").groupBy("family").agg(F.sum("n").alias("n"))
    large = total.where(F.col("n") > PACK).select("family", F.ceil(F.col("n") / PACK).cast("int").alias("parts"))
    dealt = asked.join(F.broadcast(large), "family", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # large: few for all the shingles there are
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    run = F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")).alias("run")
    meets = dealt.select("family", "node", "root", "part", other).select(run, "node", "root", "part").join(sets, "node")
    in_order = _in_order(meets.select("run", "node", "root", "part", "fps", "shingles"), "run")
    return in_order.mapInArrow(_compare(lambda t: _verified(t, least)), _EDGES).select("u", "v")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each group of similar texts only, one of the least id of the group; the columns stay.

    Texts decide, not ids: an id whose texts are in several groups may stay with one of them and go with another. Of rows
    that repeat an id and its text, the least one by the other columns stays. Rows without an id stay: nothing can name
    them. Null texts are empty texts.
    """
    distinct, star = similar(docs, id_col, text_col, width, least, crowd)
    root = distinct.join(star, F.col("node") == F.col("a"), "left").select(F.coalesce("b", "node").alias("root"), "id", "mark")
    first = root.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("first")).select(F.col("first.id").alias("scourline_id"), F.col("first.mark").alias("scourline_mark"))
    first = keep(first, "representatives")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    orderable = not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema.fields)
    keyed = docs.where(docs[id_col].isNotNull()).select(F.col(id_col).cast("bigint").alias("scourline_id"), F.xxhash64(F.col(text_col).cast("string")).alias("scourline_mark"), own.alias("scourline_row"))
    # Copies are combined before the shuffle, which is the one that the join needs.
    unique = keyed.groupBy("scourline_id", "scourline_mark").agg((F.min if orderable else F.first)("scourline_row").alias("scourline_row"))
    kept = unique.join(first.hint("merge"), ["scourline_id", "scourline_mark"], "left_semi").select("scourline_row.*")
    return kept.union(docs.where(docs[id_col].isNull()))
