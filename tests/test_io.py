"""Readers, writers, tasks, streams and result checks."""

import pytest
from pyspark.sql import functions as F

import mailbox
from mailloom.functions import quality as Q
from mailloom.operators import filters, tasks
from mailloom.session import ship_package
from mailloom.sources import messages as src
from mailloom.sources import mime_archive, sinks
from mailloom.sources.listing import read_listing
from mailloom.sources.staging import staged, staging_root
from mailloom.streaming import stream_messages

EML = "\r\n".join([
    "From: billing@invoices.com", "To: recipient@test.com", "Subject: =?utf-8?q?Invoice_=C3=A9?=",
    "Date: Thu, 25 Jan 2024 08:00:00 +0200", "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="B"', "",
    "--B", 'Content-Type: text/plain; charset="utf-8"', "", "Please find attached your invoice.",
    "--B", 'Content-Type: text/html; charset="nonsense"', "", "<p>Please</p>",
    "--B", 'Content-Type: application/pdf; name="invoice.pdf"', 'Content-Disposition: attachment; filename="invoice.pdf"',
    "Content-Transfer-Encoding: base64", "", "JVBERi0xLjQK", "--B--", ""])


def test_archive(spark, tmp_path):
    ship_package(spark)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.eml").write_bytes(EML.encode())
    (tmp_path / "b.eml").write_bytes(b"Subject: x\r\nDate: never\r\n\r\nbody")
    (tmp_path / "c.txt").write_bytes(b"not mail")
    parsed = mime_archive.read_archive(spark, str(tmp_path)).cache()
    rows = {r["subject"]: r for r in mime_archive.to_messages(parsed, "path").collect()}
    assert set(rows) == {"Invoice é", "x"}
    first = rows["Invoice é"]
    assert str(first["internal_date"]) == "2024-01-25 06:00:00" and first["body_html"].strip() == "<p>Please</p>"
    assert first["body_text"].strip() == "Please find attached your invoice." and rows["x"]["internal_date"] is None
    attached = mime_archive.to_attachments(parsed, "path").collect()
    assert [(a["name"], bytes(a["content"])) for a in attached] == [("invoice.pdf", b"%PDF-1.4\n")]


def test_message_table_and_stream(spark, tmp_path):
    path = str(tmp_path / "mail")
    box = mailbox.messages(spark)
    src.write_messages(box, path)
    one = src.read_messages(spark, path, "a", "INBOX")
    assert one.count() == 7 and "body" not in one.columns
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(account" in plan and "body" not in plan
    stops = stream_messages(spark, path).filter(filters.hints_unsubscribe()).select("uid")
    run = stops.writeStream.format("memory").queryName("stops").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["uid"] for r in spark.table("stops").collect()] == [3]


def test_accounts_stay_texts(spark, tmp_path):
    path = str(tmp_path / "digits")
    df = spark.createDataFrame([("0123", "1", i) for i in range(8)] + [("123", "1", 8)], "account string, folder string, uid int")
    src.write_messages(df.repartition(4), path)
    assert src.read_messages(spark, path, "0123").count() == 8 and src.read_messages(spark, path, "123").count() == 1
    assert len(list((tmp_path / "digits" / "account=0123").rglob("*.parquet"))) == 1


def test_text_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@x", "b@y, c@z", "d", "s", "false", None)],
                               "email_no int, from string, to string, date string, subject string, attachment string, body string")
    assert sinks.write_text(df, str(tmp_path / "t"), F.col("email_no")) == str(tmp_path / "t" / sinks.RESPONSE_NAME)
    assert [r[0] for r in spark.read.text(str(tmp_path / "t" / sinks.RESPONSE_NAME)).collect()][:3] == ["=== Email #1 ===", "From: a@x", "To: b@y, c@z"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_text(df, str(tmp_path / "t"))
    sinks.write_json(df, str(tmp_path / "j"))
    row = spark.read.json(str(tmp_path / "j")).first()
    assert row["Email"] == 1 and row["To"] == ["b@y", "c@z"] and row["Body"] is None


@pytest.mark.parametrize(("path", "target"), [
    ("/out/mail.txt", "/out/mail.txt"), ("s3a://b/out/x.log", "s3a://b/out/x.log"), ("/out", "/out/response.txt"),
    ("/out/", "/out/response.txt"), ("/out.d/", "/out.d/response.txt"), ("/a.b/out", "/a.b/out/response.txt"), (".hidden", ".hidden/response.txt")])
def test_folder_targets_have_a_default_name(path, target):
    assert sinks.output_target(path) == target


def test_file_export_and_listing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a.pdf", bytearray(b"1")), ("b/c.pdf", bytearray(b"2"))], "target string, content binary")
    assert {r["status"] for r in sinks.write_files(df, out).collect()} == {"written"}
    assert {r["status"] for r in sinks.write_files(df, out).collect()} == {"exists"}
    listed = {(r["file_name"], r["size"]) for r in read_listing(spark, out).collect()}
    assert listed == {("a.pdf", 1), ("b_c.pdf", 1)}


def test_staging(spark):
    df = staged(spark.range(5).withColumn("s", F.struct("id")), "t")
    assert df.count() == 5 and staging_root(spark) == staging_root(spark)


def test_tasks(spark):
    box = mailbox.messages(spark)
    registry = tasks.TaskRegistry()

    @registry.task("stop")
    def stop(df):
        return df.filter(filters.is_stop_request()).select("from_addr")

    assert registry.run("stop", box).first()[0] == "kim@choir.example.org"
    with pytest.raises(KeyError):
        registry.run("none", box)
    steps = [tasks.Step("a", F.lit("x"), F.col("uid") > 3), tasks.Step("b", F.lit("y"))]
    assert tasks.run_steps(box, steps, "uid").filter("task = 'b'").count() == 4
    long = box.filter(tasks.custom_handler(lambda s: s.str.len() > 15, "subject"))
    assert sorted(r["uid"] for r in long.collect()) == [1, 2, 5]


def test_row_task(spark):
    out = tasks.row_task(spark.range(5), lambda frame: frame[frame["id"] > 2].assign(x="y"), "id bigint, x string")
    assert sorted(tuple(r) for r in out.collect()) == [(3, "y"), (4, "y")]


def test_results(spark):
    df = spark.createDataFrame([(1, "r", "x", "c"), (0, " ", None, "c"), (0, "r", "x", "c")],
                               "n int, r string, who string, card string")
    e = Q.result_errors("n", "r", "who", "card")
    rows = [r[0] for r in df.select(F.transform(e, lambda x: x["field"])).collect()]
    assert rows == [[], ["attachments", "dateRange", "recipient"], ["attachments"]]
    given = df.withColumn("whole", F.when(F.col("who").isNotNull(), F.struct("n", "r")))
    for r in given.select("whole", Q.result_errors("n", "r", "who", "card", result="whole").alias("a"), e.alias("b")).collect():
        missing = [("result", "INVALID_RESULT", "Result is null or not an object")]
        assert [tuple(x) for x in r["a"]] == (missing if r["whole"] is None else [tuple(x) for x in r["b"]])
    relaxed = Q.result_errors("n", "r", "who", "card", require_attachments=False)
    assert [r[0] for r in df.select(F.size(relaxed)).collect()] == [0, 2, 0]
    block = df.select(Q.result_error(e)).collect()[1][0]
    assert block == ("-??EXTRACTION_ERROR\nCODE: EMPTY_ATTACHMENTS\n"
                     "REASON: No attachments found or matched for the extracted date range\n"
                     "DETAIL: Additional failures: dateRange, recipient\n??EXTRACTION_ERROR-")


def test_blocks(evaluate):
    text = "-??A\n1\n2\n??A-\nx\n-??B\n3\n??B-\n-??A\n4\n??A-\n-??C\nopen"
    assert evaluate(Q.parse_blocks, [text, ""]) == [{"A": "4", "B": "3"}, {}]
    assert evaluate(Q.is_extraction_error, ["a -??EXTRACTION_ERROR", "b", None]) == [True, False, False]


def test_rows_are_dealt_out_ahead_of_text_work(spark):
    from pyspark.sql import functions as F

    from mailloom.sources.mime_archive import parse_messages
    from mailloom.sources.staging import spread

    rows = spark.range(400).select("id", F.lit("same").alias("t"), F.array("id").alias("a"), F.lit(None).cast("string").alias("x.y")).coalesce(1)
    dealt = spread(rows)
    held = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert dealt.columns == rows.columns and sum(r["count"] for r in held) == 400
    raw = parse_messages(rows.select("id", F.lit("Subject: a\r\n\r\nb").alias("raw")), "raw", "id")
    for plan in (dealt, raw):
        assert "RepartitionByExpression" in plan._jdf.queryExecution().optimizedPlan().toString()
    only_arrays = rows.select("a")
    assert spread(only_arrays).collect() == only_arrays.collect()
