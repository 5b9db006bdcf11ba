"""B-rules on the synthetic cleaning fixture; CSV with bare CR line ends; label specs."""

import os

from auger.functions import cleaning as C
from auger.sources.config import JobConfig, LabelSpec
from auger.sources.tables import read_labelled_text, read_positional, read_scoring, read_table


def test_encode_fixture(spark):
    rows = [("yes", 1.0), (" YES ", 1.0), ('"Yes"', 1.0), ("no", 0.0), ('"NO"', 0.0), ("?", 0.0),
            (" ? ", 0.0), (" 3", 3.0), ('"415"', 415.0), ("12.2", 12.2), ("abc", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "f string")
    out = C.encode_frame(df, ["f"]).collect()
    assert [r["f"] for r in out] == [r[1] for r in rows]
    assert [r["_bad_fields"] for r in out] == [0] * 10 + [1]


def test_cr_line_ends_and_trim(spark, tmp_dir):
    p = os.path.join(tmp_dir, "test.csv")
    with open(p, "w", newline="") as f:
        f.write("0, 415 ,yes\r1,408, no\r0,510,?")  # bare CR, no final line end
    df = read_table(spark, p, ["churn", "area", "vmail"])
    assert df.count() == 3
    assert [r["area"] for r in df.collect()] == ["415", "408", "510"]
    pos = read_positional(spark, p, 3)
    assert pos.columns == ["c0", "c1", "c2"]


def test_scoring_uses_training_cleaning(spark, tmp_dir):
    p = os.path.join(tmp_dir, "score.csv")
    with open(p, "w") as f:
        f.write('1," 3",yes\n0,"NO",abc\n')
    cfg = JobConfig(path=p, names=("churn", "a", "b"), response=LabelSpec("name", "churn"))
    out = read_scoring(spark, p, cfg).orderBy("a").collect()
    assert [(r["a"], r["b"], r["_bad_fields"]) for r in out] == [(0.0, None, 1), (3.0, 1.0, 0)]


def test_label_specs_and_slices(spark):
    df = spark.createDataFrame([("1", "x", "2")], "a string, b string, c string")
    assert LabelSpec("first").resolve(df.columns) == "a"
    assert LabelSpec("last").resolve(df.columns) == "c"
    assert LabelSpec("index", 1).resolve(df.columns) == "b"
    assert C.label_of(df, LabelSpec("last")).first()["label"] == 2.0
    assert C.slice_columns(df, 1, -1).columns == ["b"]
    assert C.report_table(df, ["a", "c"]).columns == ["A", "C"]


def test_properties_config():
    cfg = JobConfig.from_properties("columns=churn,area,vmail\nignored=area\nresponse=churn\n", "/x.csv")
    assert cfg.names == ("churn", "area", "vmail") and cfg.ignored == ("area",)
    assert cfg.response.resolve(list(cfg.names)) == "churn"


def test_labelled_text(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "spam.txt"), os.path.join(tmp_dir, "ham.txt")
    open(a, "w").write("win money now\nfree offer\n")
    open(b, "w").write("see you at lunch\n")
    df = read_labelled_text(spark, {a: 1.0, b: 0.0})
    assert sorted((r["label"], r["text"]) for r in df.collect())[0] == (0.0, "see you at lunch")


def test_tokens_java_split_rules(spark):
    from auger.functions.features import tokens
    df = spark.createDataFrame([("a b  c  ",), ("",), ("   ",), (" x",)], "t string")
    got = [r[0] for r in df.select(tokens("t")).collect()]
    assert got == [["a", "b", "", "c"], [""], [], ["", "x"]]


def test_discretize_does_not_floor(spark):
    df = spark.createDataFrame([(40.0,)], "x double")
    assert C.discretize(df, ["x"]).first()["x"] == 2.5
    assert C.discretize(df, ["x"], floor=True).first()["x"] == 2.0


def test_positional_width_from_first_line(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pos.csv")
    open(p, "w").write("1,2,3,4\n5,6,7,8\n")
    df = read_positional(spark, p)
    assert df.columns == ["c0", "c1", "c2", "c3"] and df.count() == 2


def test_small_rules(spark):
    from auger.functions.cleaning import clean_all, drop_response, split_fields, trim_all
    from auger.operators.metrics import confusion_wide
    df = spark.createDataFrame([(' "a" ', " b ", 1)], "x string, y string, n int")
    assert trim_all(df).first()["x"] == '"a"'
    assert clean_all(df).first()["x"] == "a" and clean_all(df).first()["n"] == 1
    assert drop_response(df, "n").columns == ["x", "y"]
    lines = spark.createDataFrame([("a|b||c",)], "l string")
    assert lines.select(split_fields("l", "|").alias("f")).first()["f"] == ["a", "b", "", "c"]
    sc = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    wide = {r["label"]: (r["0.0"], r["1.0"]) for r in confusion_wide(sc).collect()}
    assert wide == {0.0: (2, 0), 1.0: (1, 1)}


def test_wall_clock_hour_independent_of_zone(spark):
    import datetime as dt
    from auger.functions.cleaning import wall_clock_hour
    ntz = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 30),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert ntz.select(wall_clock_hour(ntz, "ts")).first()[0] == 5
        ltz = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 30, tzinfo=dt.timezone.utc),)], "ts timestamp")
        assert ltz.select(wall_clock_hour(ltz, "ts")).first()[0] == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_properties_with_original_key_names():
    text = ("CHURN_TRAIN_FILE_PATH=/data/train.csv\nschemaString=churn,area,vmail\n"
            "ignoredCols=area\nresponse_column=churn\n")
    cfg = JobConfig.from_properties(text)
    assert cfg.path == "/data/train.csv" and cfg.names == ("churn", "area", "vmail")
    assert cfg.ignored == ("area",) and cfg.response.resolve(list(cfg.names)) == "churn"
