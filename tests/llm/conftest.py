import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents: prose, copies, near copies, nulls, empty and very long texts, repeated rows."""
    words = [f"word{i * 7919 % 613}" for i in range(400)]
    prose = " ".join(words[:120])
    near = prose.replace("word0 ", "other ", 1)
    shared = " ".join(f"shared{i}" for i in range(60))
    long = " ".join(f"token{i * 31 % 4001}" for i in range(40_000))
    rows = [
        (1, prose, "en", "src0"), (2, prose, "en", "src0"), (3, near, "en", "src1"), (4, None, None, None),
        (5, "", "de", ""), (6, "short text", "en", "src2"), (7, "short text", None, "src2"), (8, long, "fr", "src3"),
        (9, "before it\n" + shared + "\nafter it", "en", "src4"), (10, shared + "\nother end", "en", "src4"),
        (11, "Word " * 300, "en", "src5"), (12, "é ü 漢字 ñ", "es", "src6"), (13, " \t\n\n ", "es", "src6"),
        (14, long, "fr", "src3"), (2, prose, "en", "src0"), (15, " ".join(words[100:300]), "de", "src7"),
    ]
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), f"x{r[0]}") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")


@pytest.fixture(scope="session")
def texts(docs):
    from pyspark.sql import functions as F
    return docs.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("key"), F.lit("x").alias("digest"))
