import pytest

#: Columns of documents, in their order.
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (id, text[, source])."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder of tables with nulls, empty texts, ties, repeated rows and columns of clashing names."""
    root = tmp_path_factory.mktemp("tables")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * i + i // 7) % 12] + str(i % 89) for i in range(3000))
    rows = [(i, " ".join(words[(i * k) % 12] for k in range(1, 3 + i % 40)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n", "en", None, 3), (103, "x", "en", "s1", 1), (None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5)]
    rows += [(200, long, "en", "s0", 1), (201, long + " end", "en", "s2", 1), (202, "pre " + long[:9000], "en", "s1", 1), (103, "x", "en", "s1", 1), (204, "a  b\tc", "en", "s2", 5), (205, "a b c", "en", "s2", 5), (206, "ümläut 日本語 😀 " * 30, "de", "s2", 9)]
    df = spark.createDataFrame([(*r, 7, "clash", 0) for r in rows], DOCS + ", size int, score string, _rk int")
    df.repartition(3, "doc_id").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    schemas = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)
