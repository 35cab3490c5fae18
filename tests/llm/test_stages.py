import re

import pytest
from pyspark.sql import functions as F

from slotwise.llm import common, exact_dedup, mixing, near_dedup, simhash, toxicity

CLASHES = ["size", "pieces", "score", "row", "_row", "_text", "_rk", "_w", "_copy", "_whole", "_more", "_id", "id", "node", "_node", "_f", "v", "key", "new", "words", "more"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Documents whose other columns have names that operators use, as files; and the same rows through a shuffle."""
    path = str(tmp_path_factory.mktemp("clash") / "d")
    rows = [(i, " ".join(f"w{(i % 20) * 7 + k}" for k in range(30)), "en", "s" + str(i % 2), 9) for i in range(60)] + [(None, None, None, None, None), (7, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")


def stages(labels):
    return {"toxicity": lambda d: toxicity.not_toxic(d, labels), "exact": exact_dedup.deduplicated, "simhash": simhash.near_deduplicated, "near": near_dedup.near_deduplicated, "mixing": mixing.mixed}


@pytest.mark.parametrize("name", ["toxicity", "exact", "simhash", "near", "mixing"])
def test_clashing_columns_stay(spark, clashing, labels, name):
    got = stages(labels)[name](clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    same = [c for c in got.columns if name != "mixing" or c not in ("text", "n_chars")]
    known = {tuple(r[c] for c in same) for r in clashing.collect()}
    assert rows and all(tuple(r[c] for c in same) in known for r in rows)
    if name != "mixing":
        assert len({(r.doc_id, r.text) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["exact", "simhash", "near", "mixing"])
def test_tables_that_are_no_files(spark, labels, name):
    """Computed tables under small adaptive partitions: every distinct text stays, whatever columns a pass reads."""
    texts = spark.range(1500).select((F.col("id") % 500).alias("k"), F.col("id").alias("doc_id"))
    named = spark.range(500).select(F.col("id").alias("k"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{j}")), 256) for j in range(12)]).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "60000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = texts.join(named, "k").select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("k") % 2).cast("string")).alias("source"), F.lit(1).cast("long").alias("n_chars"))
        rows = stages(labels)[name](df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    if name == "mixing":
        assert sum(len(r.text.split()) for r in rows) == 1500 * 12
    else:
        assert sorted(r.doc_id for r in rows) == list(range(500))


def test_what_counts_as_files(spark, clashing):
    assert common._is_file_table(clashing) and common._is_file_table(clashing.filter("doc_id > 3").select("doc_id", "text"))
    assert not common._is_file_table(clashing.distinct()) and not common._is_file_table(clashing.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))))
    assert not common._is_file_table(spark.range(3)) and not common._is_file_table(clashing.unionByName(clashing)) and not common._is_file_table(clashing.crossJoin(spark.range(2)))


def test_megabyte_texts(spark, docs, tmp_path):
    """One text above the size of a bucket of texts, its near copy, and one word of megabytes."""
    long = " ".join(f"w{k * k % 99991}" for k in range(1_300_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 3_000_000), (4, "x" * 3_000_000 + " y"), (5, "short text here"), (6, re.sub("w1 ", "W1  ", long))]
    docs(rows).repartition(2).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    assert sorted(r.doc_id for r in near_dedup.near_deduplicated(df).select("doc_id").collect()) == [1, 3, 4, 5]
    assert exact_dedup.deduplicated(df).count() == 6
    sizes = {r.id: (r.size, r.taken) for r in mixing.mix(df).collect()}
    assert sizes[1][0] == 1_300_000 and sum(t for _, t in sizes.values()) == sum(s for s, _ in sizes.values())
