import pytest

#: Texts that every operator over documents must take: null, empty, blank, short, repeated, odd and long ones.
ODD = [None, "", " \n\t ", "a", "Ünïcödé 日本語 😀", "x" * 5000, "word " * 3000, "same text here", "same text here", "\x00\x1f", "ß İ ſ K"]
#: Names that operators use inside.
CLASHING = ["id", "fp", "mark", "blob", "spans", "w", "part", "key", "h", "y", "count", "point", "place", "text_", "score", "lang_pred", "fps", "u", "v"]


def table(spark, texts, id_col="doc_id", text_col="text", extra=CLASHING):
    """Texts with ids 0, 1, ... and extra columns of clashing names, in several partitions."""
    rows = [(i, t, *[str(i)] * len(extra)) for i, t in enumerate(texts)]
    schema = f"{id_col} bigint, {text_col} string" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **k: table(spark, texts, **k)
