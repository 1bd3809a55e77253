import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def lowered(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(s))


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents table, then rows of every odd kind; further columns clash with names used inside."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"w{i % 997} the" for i in range(30_000))
    odd = [(9000, None, "en", "src0"), (9001, "", "en", None), (9002, "  \n\t ", None, "src0"), (9003, "12 34 !!", "en", None), (9004, "one", "en", "src1"), (9005, "Two words", "en", "src1"),
           (9006, long, "en", "src2"), (9007, long, "en", "src2"), (9008, "a\u00a0b  c \u2003 \U0001f600 \u65e5\u672c\u8a9e <|endoftext|> x", "en", "src1"), (None, "no id here at all", "en", "src1"), (None, None, None, None),
           (9009, "twice the same row", "en", "src1"), (9009, "twice the same row", "en", "src1"), (9010, "It's\x00 odd\x1c \x85 'tis.\r\n\r\n end", "en", "src3")]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    both = base.unionByName(rows)
    for name in ("rep", "key", "row", "size", "language", "contamination", "toxicity", "n"):
        both = both.withColumn(name, F.lit("x"))
    return both.cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
