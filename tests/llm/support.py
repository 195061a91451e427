"""Comparing a query with its SQL, and small tables."""

from __future__ import annotations

import pandas as pd

from tests.compare import connect, differences


def same_as_sql(got: pd.DataFrame, sql: str, sf_dir: str) -> str | None:
    """As the general comparison, with nullable integers of both sides brought to one type."""
    want = connect(sf_dir).execute(sql).df()
    for c in got.columns:
        if c in want and got[c].dtype != want[c].dtype and {got[c].dtype.kind, want[c].dtype.kind} <= {"f", "i"}:
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    return differences(got, want)


# Names that operators use inside, to be met as columns of a caller's table.
CLASHES = ["n", "sha", "h1", "key", "bucket", "row", "label", "score", "kept", "owner", "domain", "epoch", "pieces", "count", "body", "words", "node", "batch", "counts", "held", "host", "fit", "cell", "v", "_own"]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 5003}x{i % 17}" for i in range(150_000))
EDGES = [
    (1, "the same little text stands here twice over", "en", "src1", 1), (2, "the same  little\ttext stands here twice over ", "en", "src1", 1), (3, None, None, None, None), (4, "", "en", "src0", 0),
    (5, " \t\n ", "de", "src2", 3), (6, LONG, "en", "src0", 1), (7, LONG, "fr", "src0", 1), (8, "Ünïcode ▁ text 日本 𝄞 \x00 end", "es", None, 5), (9, "one", None, "src3", 3), (9, "one", None, "src3", 3),
    (None, "no id at all", "en", "src4", 3), (10, "Released under the MIT License.\nmit license, MIT License", "en", "src5", 2),
]


def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(EDGES, DOC_SCHEMA)
    return base.withColumns({c: F.lit(f"{c}!") for c in CLASHES})


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
