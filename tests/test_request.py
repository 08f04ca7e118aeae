import datetime as dt

import pytest

from mailbox import REF_DATE
from mailloom.functions import request as R
from mailloom.functions.filenames import FilePattern
from mailloom.operators.mapping import (
    file_counts,
    matching_files,
    request_files,
    resolve_document,
    resolve_documents,
    resolve_recipient,
    resolve_recipients,
    wanted_ranges,
    with_file_lists,
)
from mailloom.plans.requests import gated_requests, read_requests, resolve_requests
from mailloom.sources.request_map import DocumentRule, RecipientRule, RequestMap, load_map, map_rules, read_map_rules
from pyspark.sql import functions as F


def span(evaluate, texts, ref=REF_DATE):
    return [None if r is None else tuple(r) for r in evaluate(lambda c: R.date_range_text(c, ref), texts)]


def test_number_words(evaluate):
    texts = ["Twenty four weeks", "last three months", "sic tow", "someone tenth", "twenty nein", "sixty", None]
    assert evaluate(R.words_to_digits, texts) == [
        "24 weeks", "last 3 months", "6 2", "someone tenth", "20 9", "60", None]


def test_document_type(evaluate):
    texts = ["send me reports", "invoice reports", "fule reprot", "yield report", "P&L please", "invite", "hello",
             "budget statement", None]
    assert evaluate(R.document_type, texts) == [
        "report", "invoice", "report", "production report", "income statement", "invoice", None, "budget report", None]


def test_relative_ranges(evaluate):
    assert span(evaluate, [
        "last 3 months", "past two weeks", "previous 10 dys", "prior 1 yr", "this month", "this week", "this year",
        "ytd", "quarter-to-date", "last month", "this quarter",
    ]) == [
        ("12/12/2025", "03/12/2026", "last 3 months(s)"), ("02/26/2026", "03/12/2026", "last 2 weeks(s)"),
        ("03/02/2026", "03/12/2026", "last 10 dys(s)"), ("03/12/2025", "03/12/2026", "last 1 yr(s)"),
        ("03/01/2026", "03/12/2026", "this month"), ("03/08/2026", "03/12/2026", "this week"),
        ("01/01/2026", "03/12/2026", "this year"), ("01/01/2026", "03/12/2026", "year to date"),
        ("01/01/2026", "03/12/2026", "quarter to date"), None, None,
    ]


def test_month_overflow(evaluate):
    assert span(evaluate, ["last 1 month"], dt.date(2026, 3, 31))[0][0] == "03/03/2026"
    assert span(evaluate, ["last 1 year"], dt.date(2024, 2, 29))[0][0] == "03/01/2023"
    assert span(evaluate, ["last 999999999999 days", "last 90000 weeks"])[0][0] is None


def test_absolute_ranges(evaluate):
    assert span(evaluate, [
        "from 2/1/26 to 3-2-2026", "between 02/01/2026 and 3/2/26", "1/2/2025 to 1/3/2025", "usage 2/1-3/23",
        "2/1-3/23/2026", "for Feb 2024", "after 12/31", "since 3/12", "before 3-15", "before 1/2/20", "13/45/2026 to 1/1/26",
    ]) == [
        ("02/01/2026", "03/02/2026", "explicit range"), ("02/01/2026", "03/02/2026", "explicit range"),
        ("01/02/2025", "01/03/2025", "explicit range"), ("02/01/2026", "03/23/2025", "compact range"), None,
        ("02/01/2024", "02/29/2024", "feb 2024"), ("12/31/2025", "03/12/2026", "after 12/31"),
        ("03/12/2026", "03/12/2026", "after 3/12"), (None, "03/15/2025", "before 3-15"),
        (None, "01/02/2020", "before 1/2/20"), ("13/45/2026", "01/01/2026", "explicit range"),
    ]
    got = evaluate(lambda c: R.date_range(c, REF_DATE), ["13/45/2026 to 2/30/26", "before 1/2/20", "none"])
    assert tuple(got[0]) == (None, None, "explicit range")
    assert tuple(got[1]) == (None, dt.date(2020, 1, 2), "before 1/2/20") and got[2] is None


def test_second_range_reader(evaluate):
    got = evaluate(lambda c: R.text_date_range(c, REF_DATE), [
        "from 2/01 to Mar 3rd", "between Feb 1 and March 3rd, 2025", "since January 15, 2026", "before 13/5",
        "after 12/31/25", "nothing", "before 6/1", None])
    assert [None if r is None else tuple(r) for r in got] == [
        (dt.date(2026, 2, 1), dt.date(2026, 3, 3), "2/01 to Mar 3rd"),
        (dt.date(2026, 2, 1), dt.date(2025, 3, 3), "Feb 1 to March 3rd, 2025"),
        (dt.date(2026, 1, 15), REF_DATE, "after January 15, 2026"), (None, dt.date(2025, 1, 5), "before 13/5"),
        (dt.date(2025, 12, 31), REF_DATE, "after 12/31/25"), None, (None, dt.date(2025, 6, 1), "before 6/1"), None]


def test_recipient(evaluate):
    got = evaluate(R.recipient, [
        "send me reports", "send Priya Raman the reports", "send accounting the reports", "forward it to Tomas Berg now",
        "mail x.y+z@host-a.org", "reports to Priya K. Raman", "to Accounting", "to the board", "Send Priya Raman the", "hi",
        None])
    assert [tuple(r) for r in got] == [
        ("sender", "Back to sender (requestor)"), ("named", 'by name "Priya Raman"'),
        ("department", 'by department "accounting"'), ("named", 'by name "Tomas Berg"'),
        ("email", "x.y+z@host-a.org"), ("named", 'by name "Priya K. Raman"'), ("department", 'by department "Accounting"'),
        ("department", 'by department "board"'), ("unknown", "Recipient not identified"),
        ("unknown", "Recipient not identified"), ("unknown", "Recipient not identified")]


def test_invoice_data(evaluate):
    assert evaluate(R.invoice_number, ["INVOICE # 12", "invoice77", "none"]) == ["12", "77", "Unknown"]
    assert evaluate(R.invoice_amount, ["due $1,204.50 now", "5.00"]) == ["$1,204.50", "Not found"]


def test_file_pattern_syntax():
    assert FilePattern.parse("File-{% date(<mm>-<dd>-<yy>) %}.pdf").regex == r"File-\d{2}-\d{2}-\d{2}.pdf"
    assert FilePattern.parse("Report-{% date(<yyyy>) %}.pdf").regex == r"Report-\d{4}.pdf"
    assert "January|February" in FilePattern.parse("Statement-{% date(<MONTH>-<yyyy>) %}.pdf").regex
    assert FilePattern.parse("a.*").date_regex is None


def test_file_dates(evaluate):
    p = FilePattern.parse("S-{% date(<mm>-<dd>-<yy>) %}.pdf")
    assert evaluate(lambda c: p.date_of(c, REF_DATE), ["S-11-17-25.pdf", "S.pdf", "x 1-2-03 y"]) == [
        dt.date(2025, 11, 17), None, dt.date(2003, 1, 2)]
    p = FilePattern.parse("{% date(<MONTH> <yyyy>) %}")
    assert evaluate(lambda c: p.date_of(c, REF_DATE), ["March 2024"]) == [dt.date(2024, 3, 1)]


RULES = RequestMap(
    documents=(DocumentRule("invoice", "Inv", "Billing_{% date(<yyyy>-<mm>-<dd>) %}.pdf"),
               DocumentRule("statement", "St", "Monthly-.*"), DocumentRule("report", "Rep")),
    recipients=(RecipientRule("accounting", "ledger@example.net"),
                RecipientRule("Priya Raman", "priya@example.net", "Extracts_Priya_.*"), RecipientRule("%requestor%")),
)


def test_rules(spark):
    df = spark.createDataFrame(
        [("invoice", "x"), ("tax report", 'by name "Priya Raman"'), (None, 'by department "accounting"')], "t string, d string")
    rows = df.select(
        resolve_document("t", RULES)["folder"].alias("folder"),
        resolve_recipient(F.struct(F.lit("a").alias("type"), F.col("d").alias("display")), RULES).alias("c"),
    ).collect()
    assert [r["folder"] for r in rows] == ["Inv", "Rep", None]
    assert [(r["c"]["email"], r["c"]["resolved"]) for r in rows] == [
        (None, True), ("priya@example.net", True), ("ledger@example.net", True)]
    task = resolve_recipient(F.struct(F.lit("a").alias("type"), F.lit("zz").alias("display")), RULES, F.lit("t@example.com"))
    assert df.select(task["email"]).first()[0] == "t@example.com"


def test_map_file(tmp_path, spark):
    assert load_map(None) is None
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    for path in (bad, tmp_path / "none.json"):
        with pytest.raises(ValueError, match=path.name):
            load_map(str(path))
        with pytest.raises(Exception, match=path.name):
            read_map_rules(spark, str(path)).collect()
    text = '{"documents": [{"name": "a", "file": "f"}, {"name": "*"}], "recipients": [{"name": "%requestor%"}]}'
    good = tmp_path / "good.json"
    good.write_text(text)
    assert load_map(str(good)).documents == (DocumentRule("a", None, "f"), DocumentRule("*"))
    df = spark.createDataFrame([(1, text), (2, "{")], "id int, doc string")
    assert sorted(tuple(r) for r in map_rules(df, "doc", "id").collect()) == [
        (1, "document", 0, "a", None, "f"), (1, "document", 1, "*", None, None),
        (1, "recipient", 0, "%requestor%", None, None)]
    rules = read_map_rules(spark, str(good)).drop("source")
    assert sorted(map(tuple, rules.collect())) == sorted(tuple(r)[1:] for r in map_rules(df, "doc", "id").collect())


def test_rule_rows_equal_literal_rules(spark):
    """One map per account, a null account, an account without a map; the first fitting rule in file order wins."""
    def rows(account, own):
        out = [(account, "document", k, r.name, r.folder, r.file) for k, r in enumerate(own.documents)]
        return out + [(account, "recipient", k, r.name, r.email, r.file) for k, r in enumerate(own.recipients)]

    other = RequestMap((DocumentRule("*", "All", ""),), (RecipientRule("Priya Raman", ""),))
    rules = spark.createDataFrame([*rows("a", RULES)[::-1], *rows(None, other)], "account string, kind string, pos bigint, name string, target string, file string")
    asked = [(k, a, t, d) for a in ("a", None, "none") for k, (t, d) in enumerate([("invoice", "x"), ("tax report", 'by name "Priya Raman"'), (None, 'by department "accounting"'), ("zz", None)])]
    df = spark.createDataFrame(asked, "k int, account string, doc_type string, display string").withColumn("who", F.struct(F.lit("a").alias("type"), "display"))
    found = resolve_recipients(resolve_documents(df, "doc_type", rules, "account"), "who", rules, "account").collect()
    assert len(found) == len(asked)
    for account, own in (("a", RULES), (None, other), ("none", RequestMap())):
        here = df.filter(F.col("account").eqNullSafe(account))
        want = {r["k"]: (r["d"], r["c"]) for r in here.select("k", resolve_document("doc_type", own).alias("d"), resolve_recipient("who", own).alias("c")).collect()}
        assert {r["k"]: (r["document"], r["contact"]) for r in found if r["account"] == account} == want


@pytest.fixture(scope="module")
def files(spark):
    first = dt.date(2025, 1, 1)
    names = [("Inv", f"Billing_{first + dt.timedelta(days=9 * i)}.pdf", False) for i in range(60)]
    names += [("Inv", "Billing_2026-01-05.pdf.d", True), ("Inv", "notes.txt", False), ("St", "Monthly-a", False),
              ("St", "Monthly-b", False), ("Rep", "Extracts_Priya_1.pdf", False), ("Other", "Billing_2026-01-05.pdf", False),
              ("Inv", "Billing_1969-01-05.pdf", False)]
    return spark.createDataFrame(names, "folder string, file_name string, is_dir boolean")


def test_interval_join_against_brute_force(spark, files):
    bounds = [(None, dt.date(2025, 5, 5)), (dt.date(2025, 1, 10), dt.date(2025, 1, 10)),
              (dt.date(2025, 3, 1), dt.date(2026, 2, 27)), (dt.date(2026, 1, 1), None), (dt.date(2026, 1, 2), dt.date(2025, 1, 1))]
    dated = "Billing_{% date(<yyyy>-<mm>-<dd>) %}.pdf"
    rows = [(i, "Inv", dated, b) for i, b in enumerate(bounds)]
    rows += [(10, "St", "Monthly-.*", bounds[0]), (11, "St", "Monthly-.*", None), (12, None, dated, bounds[0])]
    asked = spark.createDataFrame(rows, "id int, folder string, pattern string, range struct<start: date, end: date>")
    patterns = RULES.file_patterns()
    got = {(r["id"], r["file_name"]) for r in request_files(asked, files, patterns, REF_DATE, "id").collect()}
    listed = [tuple(r) for r in files.collect()]
    expected = {(10, "Monthly-a"), (10, "Monthly-b")}
    for i, (start, end) in enumerate(bounds):
        for folder, name, is_dir in listed:
            if folder == "Inv" and name.startswith("Billing_") and not is_dir:
                day = dt.date.fromisoformat(name[8:18])
                if (start or dt.date(1970, 1, 1)) <= day <= (end or dt.date.max):
                    expected.add((i, name))
    assert got == expected
    counts = {r["id"]: r["n_files"] for r in file_counts(asked, files, patterns, REF_DATE).collect()}
    assert counts == {r[0]: sum(1 for k, _ in expected if k == r[0]) for r in rows}
    lists = matching_files(files, wanted_ranges(asked), patterns, REF_DATE)
    assert lists.count() == len(expected)  # every range of the fixture is asked for once


def test_document_type_against_every_alias(spark):
    """The cut-out places give what a search of the whole text for every alias gives, overlapping words and line breaks too."""
    ranked = sorted(R.DOCUMENT_TYPES, key=lambda d: -len(d[0]))
    pieces = ["report", "tax", "yield ", "reportax report", "crop\nreport", "inv", "inventory", "asset report", "q1", "", " ", "é", "sales", "data", "reports"]
    texts = [a for _, aliases in ranked for a in aliases] + [f"{x}{gap}{y}" for x in pieces for y in pieces for gap in ("", " ", " report ")]
    texts += ["x" * 50 + "Harvest REPORT", "harvest  report", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", R.document_type("t").alias("d")).collect()
    for row in got:
        low = (texts[row["k"]] or "").lower()
        assert row["d"] == next((name for name, aliases in ranked if any(a in low for a in aliases)), None), low


def test_calendars_on_odd_listings(spark):
    """Null folders, gaps, many files a day, undated patterns, an empty listing, requests with own columns of the same names."""
    dated, plain = "F_{% date(<yyyy>-<mm>-<dd>) %}", "^a"
    patterns = [FilePattern.parse(dated), FilePattern.parse(plain)]
    names = [("x", f"F_2025-01-0{d}{i}") for d in (1, 2, 7) for i in "abc"] + [("x", "F_0001-01-01"), ("x", "F_9999-12-31"), ("x", "a1"), (None, "F_2025-01-01")]
    files = spark.createDataFrame(names, "folder string, file_name string")
    day = dt.date
    rows = [("x", dated, (day(2025, 1, 2), day(2025, 1, 6)), 3), ("x", dated, (day(2025, 1, 3), day(2025, 1, 6)), 0), ("x", dated, (day(1, 1, 1), day(9999, 12, 31)), 11),
            ("x", dated, (day(2025, 1, 7), day(2025, 1, 1)), 0), ("x", plain, (day(2025, 1, 7), day(2025, 1, 1)), 1), ("x", dated, None, 0),
            (None, dated, (None, None), 0), ("y", dated, (None, None), 0), ("x", dated, (None, None), 10), ("x", "other", (None, None), 0)]
    schema = "n int, folder string, pattern string, range struct<start: date, end: date>, day string, file_name string, want bigint"
    asked = spark.createDataFrame([(k, f, p, r, "d", "own", w) for k, (f, p, r, w) in enumerate(rows)], schema)
    counted = file_counts(asked, files, patterns, REF_DATE)
    assert counted.columns == [*asked.columns, "n_files"]
    assert all(r["n_files"] == r["want"] for r in counted.collect())
    per = {r["n"]: r["c"] for r in request_files(asked, files, patterns, REF_DATE, "n").groupBy("n").agg(F.count("*").alias("c")).collect()}
    assert per == {k: r[3] for k, r in enumerate(rows) if r[3]}
    whole = {r["n"]: r for r in with_file_lists(asked, files, patterns, REF_DATE).collect()}
    assert len(whole) == len(rows) and {k: len(r["file_names"] or []) for k, r in whole.items()} == {k: r[3] for k, r in enumerate(rows)}
    assert whole[0]["file_names"] == ["F_2025-01-02a", "F_2025-01-02b", "F_2025-01-02c"]
    assert [whole[k]["folder_found"] for k in (0, 5, 6, 7)] == [True, None, None, False]
    assert [r["n_files"] for r in file_counts(asked, files.limit(0), patterns, REF_DATE).collect()] == [0] * len(rows)
    assert request_files(asked.limit(0), files, patterns, REF_DATE, "n").count() == 0


def test_file_join_reads_texts_once(spark, files):
    """No filter on what a text gives is moved below its reading, and nothing is expanded by levels."""
    df = spark.createDataFrame([(1, "send me invoice reports for last 3 months")], "id int, body string")
    asked = read_requests(df, "body", RULES, REF_DATE)
    plan = request_files(asked, files, RULES.file_patterns(), REF_DATE, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "rlike" in line.lower() and "body" in line]


def test_request_flow(spark, files):
    df = spark.createDataFrame([
        (1, "send me invoice reports for last 3 months"), (2, "send Priya Raman the reports for this year"), (3, "hello")],
        "id int, body string")
    rows = {r["id"]: r for r in resolve_requests(df, "body", files, RULES, REF_DATE, "id").collect()}
    assert rows[1]["verdict"]["valid"] and rows[1]["n_files"] == 10 and rows[1]["who"]["type"] == "sender"
    assert rows[2]["n_files"] == 1 and rows[2]["contact"]["email"] == "priya@example.net"
    assert rows[3]["verdict"]["code"] == "NO_DATE_RANGE" and rows[3]["n_files"] == 0
    assert "12/12/2025 to 03/12/2026" in rows[1]["summary"]
    assert rows[1]["summary"].count("\n   Billing_") == 10 and "Extracts_Priya_1.pdf" in rows[2]["summary"] and "Files" not in rows[3]["summary"]
    lost = {r["id"]: r for r in resolve_requests(df, "body", files.filter("folder <> 'Inv'"), RULES, REF_DATE, "id").collect()}
    assert lost[1]["summary"].endswith("Error: Folder not found: Inv") and lost[1]["verdict"]["code"] == "NO_FILES_MATCHED"
    few = {r["id"]: r["verdict"] for r in gated_requests(df, "body", files, RULES, REF_DATE, "id").collect()}
    assert few == {k: r["verdict"] for k, r in rows.items()}
    task = read_requests(df, "body", RULES, REF_DATE, F.lit("t@example.com"), F.lit("T.pdf")).orderBy("id").first()
    assert task["contact"]["email"] == "t@example.com" and task["pattern"] == "T.pdf"
