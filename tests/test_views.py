"""The views over the driver tables keep every row."""

from workload.views import Views

SF_DIR = "/root/testdata/sf0.001"


def test_no_row_is_left_out(spark):
    v = Views(spark, SF_DIR)
    assert v.attachments.count() == v.table("lineitem").count()
    dates = {str(r[0])[:10] for r in v.table("orders").select("o_orderdate").distinct().collect()}
    assert {r["file_name"].split("_", 1)[1].removesuffix(".pdf") for r in v.files.collect()} == dates
