"""Merkle fixity audits of WARC archives.

A record's leaf hashes its bytes together with the offset range it fills in its file. Runs of ``fanout`` neighbouring
leaves hash to a node, runs of nodes to a node above, up to one root for each file; the files' roots, in the order of
their names, form the leaves of a tree of the same kind for the whole collection. Two replicas with equal roots are
equal. Otherwise the audit descends one level at a time and only below nodes that differ, down to the records.

A node never gathers more than ``fanout`` children, so no file, host or record size makes a group grow. Positions and
offsets are running sums over a file's records; a file of more records than ``slab`` is summed slab by slab.

A null URL or payload is an empty one. Records of equal keys are ordered by their bytes' hash and keep a row each; an
empty replica has no root, and every record of the other one is then missing. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scourline.plans.scratch import keep

FANOUT = 16
SLAB = 4096


def record_block(url: Column, payload: Column) -> Column:
    """The WARC/1.1 bytes of a resource record, without a date or random id so that replicas agree."""
    url, payload = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(payload.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(payload, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def records(df: DataFrame, file: Column, key: Column, block: Column) -> DataFrame:
    """(file, key, size, digest): what the trees need of each record."""
    return df.select(file.cast("string").alias("file"), key.cast("bigint").alias("key"), F.octet_length(block).cast("bigint").alias("size"), F.sha2(block, 256).alias("digest"))


def leaves(found: DataFrame, slab: int = SLAB) -> DataFrame:
    """(file, nth, key, start, end, hash): records in file order with their offset ranges and leaf hashes.

    A file's records are numbered within slabs of its key range first; the sums of whole slabs then shift them.
    """
    found = found.withColumn("file", F.coalesce("file", F.lit(""))).withColumn("slab", F.floor(F.coalesce("key", F.lit(-1)) / slab))
    order = [F.col("key").asc_nulls_first(), F.col("digest"), F.col("size")]
    inside = Window.partitionBy("file", "slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = found.withColumn("n", F.count(F.lit(1)).over(inside)).withColumn("upto", F.sum("size").over(inside))
    slabs = found.groupBy("file", "slab").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    shifts = slabs.select("file", "slab", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"))
    placed = local.join(shifts, ["file", "slab"])
    end = F.col("bytes_before") + F.col("upto")
    placed = placed.select("file", (F.col("rows_before") + F.col("n") - 1).alias("nth"), "key", (end - F.col("size")).alias("start"), end.alias("end"), "digest")
    return placed.select("file", "nth", "key", "start", "end", F.sha2(F.concat_ws(":", F.lit("leaf"), "start", "end", "digest"), 256).alias("hash"))


def level_up(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, nth, hash) one level above (file, nth, hash)."""
    children = F.array_sort(F.collect_list(F.struct("nth", "hash")))
    up = nodes.groupBy("file", F.floor(F.col("nth") / fanout).cast("bigint").alias("up")).agg(children.alias("c"))
    return up.select("file", F.col("up").alias("nth"), F.sha2(F.concat_ws(":", F.lit("node"), F.expr("concat_ws(':', transform(c, x -> x.hash))")), 256).alias("hash"))


def tree(found: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels from the leaves to one root per file, each a stored table."""
    levels = [keep(found, "leaves")]
    while (levels[-1].agg(F.max("nth")).first()[0] or 0) > 0:
        levels.append(keep(level_up(levels[-1], fanout), "nodes"))
    return levels


def roots(levels: list[DataFrame], fanout: int = FANOUT) -> list[DataFrame]:
    """The tree over the files' roots: its leaves are named by their files, its last level is the collection's root."""
    # Files are ranked by name without bringing them together: by ranges of names, then within each.
    top = levels[-1].select("file", "hash")
    spread = top.repartitionByRange("file").withColumn("range", F.spark_partition_id())
    spread = keep(spread, "files")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = spread.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("range").orderBy("file")
    ranked = spread.join(shift, "range").select((F.row_number().over(inside) - 1 + F.col("shift")).cast("bigint").alias("nth"), F.col("file").alias("name"), F.col("hash"))
    base = keep(ranked.select(F.lit("").alias("file"), "nth", "name", F.sha2(F.concat_ws(":", F.lit("file"), "name", "hash"), 256).alias("hash")), "file-leaves")
    out = [base]
    while (out[-1].agg(F.max("nth")).first()[0] or 0) > 0:
        out.append(keep(level_up(out[-1].select("file", "nth", "hash"), fanout), "file-nodes"))
    return out


def _differs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Places whose hashes differ or that one side lacks."""
    a, b = a.select(*on, F.col("hash").alias("hash_a")), b.select(*on, F.col("hash").alias("hash_b"))
    return a.join(b, on, "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, nth, key_a, key_b, start_a, end_a, start_b, end_b, fault): the records in which two replicas differ.

    ``a`` and ``b`` are :func:`records`. The fault is ``changed`` (both have a record at this position), ``missing`` (only a
    has) or ``extra`` (only b has). Positions are compared: behind a lost or added record all of its file's later records
    are at other offsets and count as changed.
    """
    levels_a, levels_b = tree(leaves(a), fanout), tree(leaves(b), fanout)
    roots_a, roots_b = roots(levels_a, fanout), roots(levels_b, fanout)
    same = len(roots_a) == len(roots_b) and keep(_differs(roots_a[-1], roots_b[-1], ["file", "nth"]), "root").isEmpty()
    if same:
        suspects = keep(levels_a[0].select("file", "nth").limit(0), "none")
    else:
        # Below the collection's root: down the tree of files while both are as deep, then the files' own trees.
        depth = min(len(roots_a), len(roots_b))
        nodes = None
        for i in range(depth - 1, 0, -1):
            x, y = roots_a[i], roots_b[i]
            if nodes is not None:
                x, y = (_below(t, nodes, fanout) for t in (x, y))
            nodes = keep(_differs(x, y, ["file", "nth"]).select("file", "nth"), "differ")
        x, y = roots_a[0], roots_b[0]
        if nodes is not None and len(roots_a) == len(roots_b):
            x, y = (_below(t, nodes, fanout) for t in (x, y))
        files = keep(_differs(x, y, ["name"]).select(F.col("name").alias("file")), "differing-files")
        nodes = None
        for i in range(max(len(levels_a), len(levels_b)) - 1, -1, -1):
            x, y = (levels[i].select("file", "nth", "hash") if i < len(levels) else None for levels in (levels_a, levels_b))
            if x is None or y is None:  # one replica's files are deeper: nothing to compare yet
                continue
            x, y = (t.join(files, "file", "left_semi") if nodes is None else _below(t, nodes, fanout) for t in (x, y))
            nodes = keep(_differs(x, y, ["file", "nth"]).select("file", "nth"), "differ")
        suspects = nodes
    side = lambda t, s: t.join(suspects, ["file", "nth"], "left_semi").select("file", "nth", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "start", "end", "hash")])
    both = side(levels_a[0], "a").join(side(levels_b[0], "b"), ["file", "nth"], "full_outer")
    fault = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return both.select("file", "nth", "key_a", "key_b", "start_a", "end_a", "start_b", "end_b", fault.alias("fault"))


def _below(nodes: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    up = parents.select("file", F.col("nth").alias("up_"))
    return nodes.withColumn("up_", F.floor(F.col("nth") / fanout).cast("bigint")).join(up, ["file", "up_"], "left_semi").select(*nodes.columns)


def write_warc(rows: Iterable[tuple[str, bytes]], compress: bool = False) -> bytes:
    """The bytes of a WARC file with a resource record for each (url, payload)."""
    out = []
    for url, payload in rows:
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
        block = head.encode() + payload + b"\r\n\r\n"
        out.append(gzip.compress(block, mtime=0) if compress else block)
    return b"".join(out)


def warc_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of an uncompressed WARC file; what can't be read as a record ends it as one piece."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = re.search(rb"(?im)^content-length:\s*(\d+)", data[at:head]) if head >= 0 else None
        end = min(len(data), head + 4 + int(size[1]) + 4) if size else len(data)
        yield at, data[at:end]
        at = end


def read_warcs(files: DataFrame) -> DataFrame:
    """:func:`records` of WARC files read as ``binaryFile`` (path, content); keys are offsets, gzip is undone."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                data = content.as_py() or b""
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [(path.as_py().rpartition("/")[2], at, len(x), hashlib.sha256(x).hexdigest()) for at, x in warc_records(data)]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "key", "size", "digest"])

    return files.select("path", "content").mapInArrow(run, "file string, key bigint, size bigint, digest string")
