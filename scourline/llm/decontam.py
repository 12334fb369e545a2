"""Benchmark decontamination with DataFrame functions only.

Every benchmark item gives its windows of ``size`` consecutive words (an item of fewer words gives one window). The
windows form a broadcast hash set, filed under an anchor: the longest word of the window. Documents are scanned word
by word; a word that is an anchor brings up its windows, and each is verified word for word around that position.
Clean text therefore costs one hash probe a word, and no window of it is ever built.

The set is broadcast only while it is at most ``broadcast_bytes``. Beyond that it is cut by its anchors into parts of
that size, and each part scans the documents in turn; the results are the same.

Words are maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and all non-ASCII characters. Null texts have no
words. Items with equal ids are one item; a null id is one item with the empty name. Rows of equal id and text get
equal results, one row each; other columns of the tables are carried by :func:`remove`, where names that begin with ``scourline_``
are taken, and ignored elsewhere. Very long texts cost time by their words.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourline.plans.scratch import keep, sized

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else as it is; null becomes empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS, -1), "")


def ngrams(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """(anchor, at, gram, items): each distinct window, its anchor, the anchor's offset and the items it is from."""
    spelt = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    cut = spelt.where(F.size("w") > 0).select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))")).alias("gram"))
    best = F.expr("array_max(transform(gram, (x, i) -> named_struct('l', octet_length(x), 'h', xxhash64(x), 'at', -i)))")
    placed = cut.select("item", "gram", (-best["at"]).alias("at"))
    return placed.groupBy("gram", "at").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.expr("gram[at]").alias("anchor"), "at", "gram", "items")


def _hits(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame) -> DataFrame:
    spelt = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words(F.col(text_col)).alias("w"))
    each = spelt.select("id", "mark", "w", F.posexplode_outer("w").alias("pos", "word"))
    fits = (F.col("word") == F.col("anchor")) & (F.col("pos") >= F.col("at")) & F.expr("slice(w, greatest(pos - at + 1, 1), size(gram)) = gram")
    return each.join(F.broadcast(grams), fits).select("id", "mark", F.expr("named_struct('start', pos - at, 'n', size(gram))").alias("span"), "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, mark, n_words, spans, items) for each row of ``docs``; mark is a hash of the text, spans are verified hits."""
    grams = keep(ngrams(items, item_col, item_text_col, size), "ngrams")
    # A row in memory: 8 bytes a word and 32 more around each column, besides the letters.
    held = grams.agg(F.sum(F.expr("160 + octet_length(anchor) + aggregate(gram, 0L, (s, x) -> s + 24 + octet_length(x)) + aggregate(items, 0L, (s, x) -> s + 24 + octet_length(x))"))).first()[0] or 0
    parts = max(1, -(-held // broadcast_bytes))
    each = [grams] if parts == 1 else [grams.where(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == i) for i in range(parts)]
    hits = reduce(DataFrame.union, (_hits(docs, id_col, text_col, g) for g in each))
    found = hits.groupBy("id", "mark").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    all_docs = docs.select(F.col(id_col).alias("id_"), F.xxhash64(text_col).alias("mark_"), F.size(words(F.col(text_col))).cast("bigint").alias("n_words"))
    joined = all_docs.join(found, F.col("id_").eqNullSafe(F.col("id")) & (F.col("mark_") == F.col("mark")), "left")
    return joined.select(F.col("id_").alias("id"), F.col("mark_").alias("mark"), "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,n:int>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def covered(spans: str = "spans") -> Column:
    """Words inside any of the sorted spans."""
    return F.expr(
        f"aggregate({spans}, named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(s.start + s.n - greatest(a.upto, s.start), 0), 'upto', greatest(a.upto, s.start + s.n)), a -> a.n)"
    )


def remove(docs: DataFrame, items: DataFrame, what: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents, or (``what="spans"``) without the words that were hit.

    A word goes with the separators before it. The columns are those of ``docs``.
    """
    if what not in ("documents", "spans"):
        raise ValueError(f"what: {what!r}")
    hit = contamination(docs, items, id_col, text_col, **options).where("size(spans) > 0")
    hit = keep(hit.select(F.col("id").alias("scourline_id"), F.col("mark").alias("scourline_mark"), F.col("spans").alias("scourline_spans")), "hits")
    same = docs[id_col].eqNullSafe(F.col("scourline_id")) & (F.xxhash64(docs[text_col]) == F.col("scourline_mark"))
    if what == "documents":
        return docs.join(sized(hit), same, "left_anti")
    once = keep(hit.dropDuplicates(["scourline_id", "scourline_mark"]), "hits")
    joined = docs.join(sized(once, 1024), same, "left")
    word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    tail = F.regexp_extract(docs[text_col], r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    joined = joined.withColumn("scourline_parts", F.regexp_extract_all(docs[text_col], F.lit(word), F.lit(0)))
    left = F.expr("array_join(filter(scourline_parts, (x, i) -> not exists(scourline_spans, s -> i >= s.start and i < s.start + s.n)), '')")
    cleaned = F.when(F.col("scourline_id").isNull() & F.col("scourline_spans").isNull(), docs[text_col]).otherwise(F.concat(left, tail))
    return joined.select(*[cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns])
