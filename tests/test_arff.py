import os

from auger.sources.arff import read_arff, write_arff


def test_read_arff_fixture(spark, tmp_dir):
    p = os.path.join(tmp_dir, "churn.arff")
    open(p, "w").write("""% comment
@relation churn
@attribute churn {0,1}
@attribute 'day mins' numeric
@attribute area real

@data
1,12.5,415
0,?,408
% trailing comment
1,'3',510
""")
    df = read_arff(spark, p)
    assert df.columns == ["churn", "day mins", "area"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("0", None, 408.0), ("1", 3.0, 510.0), ("1", 12.5, 415.0)]


def test_arff_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a b", 2.5), (2, "c", None)], "id long, s string, x double")
    p = os.path.join(tmp_dir, "rt")
    write_arff(df, p)
    back = read_arff(spark, p)
    assert sorted(tuple(r) for r in back.collect()) == [(1.0, "a b", 2.5), (2.0, "c", None)]
