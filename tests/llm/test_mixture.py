"""The pipeline's mixture stage: toxic text goes at every share, all other documents stay, and the weights are met."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from mailloom.llm import mixing


def labelled(spark, rows, path):
    """(id, text, quality, toxic) as documents, with clashing columns, and a table of labels."""
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.createDataFrame([(i, x, 1, 2) for i, x, _, _ in rows], "doc_id long, text string, posteriors_ long, copy_ long")


def test_stage_drops_rare_toxic_text(spark, tmp_path):
    rows = [(i, f"calm river w{i} " * 300, 1, 0) for i in range(600)] + [(i, "vile slur", 1, 1) for i in range(600, 640)]
    docs = labelled(spark, rows, tmp_path)
    kept = P.mixture(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(600))
    # One among thousands goes as well: the decision is the document's own.
    rare = docs.where("doc_id < 599").unionByName(docs.where("doc_id = 600"))
    assert {r["doc_id"] for r in P.mixture(spark, rare, str(tmp_path)).collect()} == set(range(599))
    assert P.mixture(spark, docs.limit(0), str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, "calm river", 1, 2), (None, None, 1, 2), (7, "", 1, 2), (8, "calm river", 1, 2), (8, "calm river", 1, 2)], docs.schema)
    assert sorted(str(r["doc_id"]) for r in P.mixture(spark, odd, str(tmp_path)).select("doc_id", "text").distinct().collect()) == ["7", "8", "None", "None"]


def test_stage_meets_its_weights(spark, tmp_path):
    rows = [(i, f"{'lucid' if i % 20 else 'filler'} river stone w{i} " * 40, int(i % 20 > 0), 0) for i in range(2000)]
    docs = labelled(spark, rows, tmp_path)
    kept = P.mixture(spark, docs, str(tmp_path)).withColumn("plain", (F.col("doc_id") % 20 == 0).cast("int"))
    row = kept.agg(F.avg("plain").alias("share"), F.count_distinct("doc_id").alias("n")).first()
    assert row["n"] == 2000 and abs(row["share"] - P.WEIGHTS["plain"]) < 0.01
    most = kept.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 2 <= most <= 4


def test_rates_keep_their_bounds(spark):
    """Targets out of reach: rates stop at the bounds, and equal posteriors have equal rates."""
    posteriors = F.when(F.col("id") % 10 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    rows = spark.range(500).select("id", F.lit(30.0).alias("tokens"), posteriors.alias("posteriors"))
    for targets, want in (([0.0, 13500.0, 15000.0], {1.0, 4.0}), ([0.0, 100.0, 3000.0], {1.0, 2.0}), ([0.0, 13500.0, 1500.0], {1.0})):
        fitted = mixing.fit(rows, targets, least=1.0, most=4.0)
        found = {round(r["r"], 4) for r in rows.select(fitted.rate(F.col("posteriors")).alias("r")).distinct().collect()}
        assert found == want
