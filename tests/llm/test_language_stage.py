"""The pipeline's language stage: unknown languages and letter noise go, labelled documents stay."""

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_profiles_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = ["Это русский текст о погоде и природе", "これは日本語の文章です", "qzxv jkwq vvxz zzkq xqjv", "123 !", None]
    strange += ["Привет", "文章", ""]
    rows = [(-1 - i, t) for i, t in enumerate(strange)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    short = ["Ok", "FAQ", "Wow!", "Hmm", "XML", "the", "der und", "que la", "les des", "Gesch.", "español niño", "été"]
    more = more.unionByName(spark.createDataFrame([(-100 - i, t) for i, t in enumerate(short)], more.schema))
    both = docs.unionByName(more, allowMissingColumns=True).unionByName(docs.limit(1))
    kept = P.language(spark, both, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} | {-100 - i for i in range(len(short))}
    assert kept.count() == docs.count() + 1 + len(short) and P.language(spark, docs.limit(0), SF).count() == 0
