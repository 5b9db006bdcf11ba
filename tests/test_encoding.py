"""Level order is text order; training-only indexer; all levels kept; domains."""

from pyspark.sql import functions as F

from auger.functions.encoding import assembler, domains, encode_categorical, index_label


def test_index_label_text_order_and_unseen(spark):
    train = spark.createDataFrame([("1",), ("0",), ("1",), ("10",)], "y string")
    idx = index_label(train, "y", handle_invalid="keep")
    assert idx.labels == ["0", "1", "10"]  # text order, not frequency
    test = spark.createDataFrame([("1",), ("2",)], "y string")
    got = [r["label"] for r in idx.transform(test).collect()]
    assert got == [1.0, 3.0]  # an unseen level gets its own index, never a silent re-map


def test_all_levels_kept(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "p string, q string")
    pipe = encode_categorical(["p", "q"], drop_last=False).fit(df)
    out = assembler(["p_vec", "q_vec"]).transform(pipe.transform(df))
    sizes = {len(r["features"].toArray()) for r in out.collect()}
    assert sizes == {(3 + 1) + (2 + 1)}  # every level of each column, plus one slot for unseen levels


def test_domains_ranks(spark):
    df = spark.createDataFrame([("b", 10), ("a", 2), ("b", 2)], "s string, n int")
    got = {(r["column"], r["level"]): r["level_index"] for r in domains(df, ["s", "n"]).collect()}
    assert got == {("s", "a"): 0, ("s", "b"): 1, ("n", "10"): 0, ("n", "2"): 1}
    assert domains(df.where(F.lit(False)), ["s"]).count() == 0
