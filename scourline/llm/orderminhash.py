"""Order MinHash fingerprints of whole texts.

The k-mers of a text are its runs of ``k`` code points; equal k-mers are told apart by their occurrence number. Each of
the sketches orders all numbered k-mers by its own hash, keeps the ``width`` least, puts these back into the order of
the text and hashes the tuple of k-mers. Two texts agree on a sketch where they share those k-mers in that order, so
the share of agreeing sketches falls with the edit distance and not only with the common vocabulary.

A text of fewer than ``k`` code points is one k-mer, the empty text one too. A null text is empty. Equal texts have equal
fingerprints. A text with fewer numbered k-mers than ``width`` keeps all it has.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, WIDTH, SKETCHES = 8, 2, 64
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FACTOR = 0x9E3779B97F4A7C15
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: K-mers ranked at a time, for all sketches at once.
PART = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(FACTOR))


def kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` code points; one hash for a shorter text."""
    if len(codes) < k:
        h = hashlib.blake2b(codes.tobytes(), digest_size=8, person=b"short").digest()
        return np.frombuffer(h, np.uint64).copy()
    n = len(codes) - k + 1
    run, size = mix(codes.astype(np.uint64) + np.uint64(1)), 1  # polynomials of all runs of ``size``
    out, done, rest = np.zeros(n, np.uint64), 0, k
    while True:  # k as a sum of powers of two
        shift = np.uint64(pow(FACTOR, size, 1 << 64))
        if rest & 1:
            out = out * shift + run[done : done + n]
            done += size
        rest >>= 1
        if not rest:
            return mix(out)
        run, size = run[:-size] * shift + run[size:], 2 * size


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    index = np.arange(len(h))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), index, 0))
    out = np.empty(len(h), np.uint64)
    out[order] = (index - starts).astype(np.uint64)
    return out


def fingerprint(text: str, k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> np.ndarray:
    """One 32-bit value for each sketch."""
    with np.errstate(over="ignore"):
        h = kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)
        numbered = mix(h + occurrences(h) * np.uint64(0xD6E8FEB86659FD93))
        kept, seeds, every = min(width, len(h)), _seeds(sketches)[:, None], np.arange(sketches)
        ranks, places = np.full((sketches, kept), NEVER), np.zeros((sketches, kept), np.int64)
        for at in range(0, len(h), PART):
            rank = (numbered[None, at : at + PART] ^ seeds) * _MIX1
            for _ in range(kept):
                least = rank.argmin(axis=1)
                ranks = np.column_stack([ranks, rank[every, least]])
                places = np.column_stack([places, least + at])
                rank[every, least] = NEVER
            best = np.argsort(ranks, axis=1, kind="stable")[:, :kept]
            ranks, places = np.take_along_axis(ranks, best, 1), np.take_along_axis(places, best, 1)
        value = seeds[:, 0]
        for column in np.sort(places, axis=1).T:  # back in the order of the text
            value = mix(value * np.uint64(FACTOR) + h[column])
        return (value >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of sketches that agree."""
    return float((a == b).mean())


def hexed(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> DataFrame:
    """(``id_col``, fingerprint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hexed(fingerprint(t.as_py() or "", k, width, sketches)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    few = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "id bigint, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROWS = 20_000  # of a range


def _numbers(values: list[int]) -> Column:
    """One constant array, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def cuts(df: DataFrame, parts: int) -> list[tuple[int, int]]:
    """(key, mark) of rows that exist, descending by key, then ascending by mark, which cut the rows into about ``parts``
    ranges; the first one begins with the first row.

    The keys are quantiles of all keys. A key that takes several of them is cut by equal shares of its marks, which are
    hashes.
    """
    row = df.agg(F.max("key"), F.percentile_approx("key", [i / parts for i in range(1, parts + 1)], max(10_000, 10 * parts))).first()
    if row[0] is None:
        return []
    shares = Counter(row[1] or [])
    shares[row[0]] += 0
    wanted = [(k, -(1 << 63) + (i << 64) // max(1, n)) for k, n in shares.items() for i in range(max(1, n))]
    asked = df.sparkSession.createDataFrame(wanted, "key bigint, least bigint")
    firsts = df.join(F.broadcast(asked), "key").where("mark >= least").groupBy("key", "least").agg(F.min("mark").alias("mark"))
    found = {(r["key"], r["mark"]) for r in firsts.collect()}  # at most a row for each range
    return sorted(found, key=lambda x: (-x[0], x[1]))


def with_following(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> DataFrame:
    """Each text and its edit with the next one by descending id (after the last comes the first).

    Gives (``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The texts are
    shuffled once: the order is cut at rows that exist into ranges (``parts``; by default one for 20,000 rows, 64 at least),
    each range is a partition of its own, and its first row also closes the range before it. A range streams through its
    task in order. Rows of equal id are ordered by a hash of their text, and cut by it if they are many; rows that repeat an
    id and its text stay in one range, where each costs one comparison. Null ids come last.
    """
    few = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    few = few.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("mark", F.xxhash64("text"))
    if parts is None:
        parts = max(64, df.count() // ROWS)
    firsts = cuts(few.select("key", "mark"), parts) or [(0, 0)]
    keys, marks, n = _numbers([x for x, _ in firsts]), _numbers([x for _, x in firsts]), len(firsts)
    # How many ranges begin at or before the row, by halving.
    begun = "(element_at(keys_, mid) > key or element_at(keys_, mid) = key and element_at(marks_, mid) <= mark)"
    part = f"aggregate(sequence(1, {n.bit_length()}), named_struct('lo', 1, 'hi', {n}), (a, i) -> if(a.lo >= a.hi, a, transform(array(cast((a.lo + a.hi + 1) div 2 as int)), mid -> if({begun}, named_struct('lo', mid, 'hi', a.hi), named_struct('lo', a.lo, 'hi', mid - 1)))[0]), a -> a.lo - 1)"
    dealt = few.withColumns({"keys_": keys, "marks_": marks}).withColumn("part", F.expr(part))
    begins = F.expr("element_at(keys_, part + 1) = key and element_at(marks_, part + 1) = mark")
    place = lambda of, closes: F.struct(of.cast("int").alias("part"), F.lit(closes).alias("closes"))
    before = F.pmod(F.col("part") + (n - 1), F.lit(n))
    places = F.when(begins, F.array(place(F.col("part"), False), place(before, True))).otherwise(F.array(place(F.col("part"), False)))
    dealt = dealt.select("id", "text", "key", "mark", F.explode(places).alias("place")).select("id", "text", "key", "mark", "place.part", "place.closes")
    in_order = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "closes", F.desc("key"), "mark").select("id", "text", "part", "closes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one: its range, id, text, fingerprint
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        again = None  # the last result whose two texts were equal
        for b in batches:
            rows = []
            for row_id, text, own, closes in zip(*(b.column(i) for i in range(4))):
                own, closes = own.as_py(), closes.as_py()
                if closes and (held is None or held[0] != own):
                    continue  # another copy of the row that closed this range
                text = text.as_py()
                same = held is not None and held[2] == text
                fp = held[3] if same else fingerprint(text, k, width, sketches)
                if same and again is not None and again[0] == text:
                    rows.append((held[1], *again[1]))
                elif held is not None:
                    _, was_id, was, was_fp = held
                    now = edited(was, text)
                    now_fp = fingerprint(now, k, width, sketches)
                    digest = hashlib.sha256(now.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((was_id, len(was), digest, hexed(was_fp), hexed(now_fp), likeness(was_fp, now_fp), likeness(was_fp, fp)))
                    again = (text, rows[-1][1:]) if same else None
                held = None if closes else (own, row_id.as_py(), text, fp)
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order.mapInArrow(run, schema).withColumnRenamed("id", id_col)
