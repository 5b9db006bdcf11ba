from collections import Counter

import corpus_pipeline as P
from auger.llm import langid
from test_decontaminate import ITEM, filler
from test_jaccard import brute
from test_passages import word_list

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, lang="en"):
    return i, text, lang, "s", None if text is None else len(text)


def test_each_stage_takes_effect(spark, tmp_dir):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    base, passage = filler(1), filler(99, 90)
    rows = [row(1, base), row(2, base + " more"), row(3, "12 ... 34", None), row(4, None), row(5, f"{filler(2)} {passage} {filler(3)}"),
            row(6, f"{filler(4)} {passage} {filler(5)}"), row(7, f"{filler(6)}. {ITEM}"), row(8, filler(8)), row(9, passage)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_dir}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, tmp_dir)
        assert out.columns == docs.columns
        path = f"{tmp_dir}/out{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    text = {r[0]: r[1] for r in rows}
    assert set(kept[0]) == set(text) - {3, 4}
    assert set(kept[1]) == set(kept[0]) - {2}
    assert set(kept[2]) == set(kept[1]) - {9} and kept[2][5] == text[5] and word_list(kept[2][6]) == word_list(filler(4) + " " + filler(5))
    assert set(kept[3]) == set(kept[2]) - {7}
    packed = P.run(spark, tmp_dir).collect()
    assert {r["doc_id"] for r in packed} == {1, 5, 6, 8}


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    told = P.identify_language(spark, docs, sf)
    assert {r["doc_id"] for r in told.collect()} == {d for d, t in rows if langid.has_letter(t)}
    kept = P.drop_near_copies(spark, docs, sf)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for _, c, _ in brute(rows)})


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            given, got = (Counter(r["doc_id"] for r in df.collect()) for df in (docs, out))
            if name != P.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert not got - given  # each row is one of those given
            else:
                assert set(got) == set(given)  # all documents are packed


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]


def test_one_row_of_repeated_and_null_id_rows_stays(spark):
    a, b, c = filler(1), filler(2), filler(3)
    rows = [row(1, a)] * 3 + [row(None, b)] * 3 + [row(None, c), row(5, c), row(5, c), row(6, c + " more"), row(7, filler(4)), row(None, filler(5))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = P.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (None, b), (5, c), (7, filler(4)), (None, filler(5))])


def test_documents_stay_where_no_row_has_a_language(spark):
    rows = [row(1, "one text", None), row(2, "żółw", None), row(3, "12 ... 34", None), row(4, None, None), row(5, "", None)]
    kept = P.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}
