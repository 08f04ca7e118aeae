"""Positions, filters, counts and bodies on the seven-message mailbox."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import mailbox
from mailbox import REF_DATE
from mailloom.functions import patterns as P
from mailloom.functions import html
from mailloom.functions.html import columns_map, decode_entities, grid_columns, html_to_text, leaf_elements, table_grid, tables
from mailloom.functions.mime import extension
from mailloom.operators import counts, filters, numbering
from mailloom.operators.attachments import attachment_parts, export_names, file_mode_names
from mailloom.operators.bodies import body_with_fallback, first_part, part_bodies, refetched
from mailloom.operators.counts import count_by_folder, position_pieces
from mailloom.operators.filters import criteria
from mailloom.operators.folders import flatten_tree, move_in_table, move_messages, moved_messages, resolve_folders, target_folder
from mailloom.operators.numbering import first_matches
from mailloom.plans.search import matching_positions, search
from mailloom.sources.messages import read_messages, write_messages


@pytest.fixture(scope="module")
def box(spark):
    return mailbox.messages(spark)


def numbers(df):
    return sorted(r["email_no"] for r in df.select("email_no").collect())


def test_numbering(box):
    rows = {r["uid"]: r["email_no"] for r in numbering.with_numbers(box).collect()}
    assert rows == {uid: 8 - uid for uid in range(1, 8)}
    assert numbers(numbering.newest(box, 3)) == [1, 2, 3]
    assert [r["uid"] for r in numbering.newest_first(box).collect()] == [7, 6, 5, 4, 3, 2, 1]
    assert numbering.nth(box, 4).first()["uid"] == 4 and numbering.nth(box, 8).count() == 0


def test_ranges(box):
    assert numbers(numbering.number_range(box, "3-5")) == [3, 4, 5]
    assert numbers(numbering.number_range(box, "6-last")) == [6, 7]
    assert numbers(numbering.number_range(box, "5-99")) == [5, 6, 7]
    assert numbering.number_range(box, "9-12").count() == 0
    for bad in ("0-3", "5-2", "x", "3"):
        with pytest.raises(ValueError):
            numbering.parse_range(bad)


def test_positions_and_counts(box):
    assert numbers(matching_positions(box, criteria(from_="example.com"))) == [1, 7]
    body = body_with_fallback("html", "body")
    assert numbers(matching_positions(box, filters.body_contains("invoice", body))) == [4]
    assert numbers(matching_positions(box, criteria(sender="plumber.example.net"))) == [4]
    assert counts.count_messages(box).first()["n"] == 7
    assert counts.count_messages(box, criteria(from_="example.com")).first()["n"] == 2
    assert counts.position_list(box, criteria(from_="example.com"), 100).first()["positions"] == "1,7"
    assert counts.position_list(box, criteria(from_="nobody"), 100).first()["positions"] == ""
    assert counts.any_match(box, criteria(subject="stop")).first()["found"] is True
    assert counts.any_match(box, criteria(subject="nothing")).first()["found"] is False
    assert counts.count_by_folder(box, None, "9-12").first()["n"] == 0
    assert numbers(search(box, criteria(subject="poll"), stop_after=1)) == [1]
    assert numbers(search(box, criteria(from_="example.com"), pool=3)) == [1]
    assert [r["from_addr"] for r in box.filter(filters.is_stop_request()).collect()] == ["kim@choir.example.org"]


def test_numbers_of_a_hot_folder(spark):
    """One timestamp holds most rows, UIDs span several blocks, some dates are missing."""
    ids = spark.range(0, 4000).withColumn("uid", (F.col("id") * 97) % 400009)
    at = F.when(F.col("id") % 3 != 0, F.lit("2024-05-05 01:02:03")).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("2024-05-0"), (F.col("id") % 9 + 1).cast("string"), F.lit(" 0"), (F.col("id") % 7).cast("string"), F.lit(":00:00")))
    df = ids.select(F.lit("a").alias("account"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("folder"), "uid",
                    at.cast("timestamp_ntz").alias("internal_date"))
    epoch = dt.datetime(1970, 1, 1)
    rows = df.collect()
    got = {(r["folder"], r["uid"]): r["email_no"] for r in numbering.with_numbers(df).collect()}
    for folder in "xy":
        ordered = sorted((r for r in rows if r["folder"] == folder), key=lambda r: (epoch - (r["internal_date"] or epoch), r["uid"]))
        assert [got[(folder, r["uid"])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_numbers_with_null_keys_and_deep_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "a").alias("account"), F.when(F.col("id") % 2 > 0, "f").alias("folder"), F.col("id").alias("uid"), F.lit(None).cast("timestamp_ntz").alias("internal_date"))
    assert numbering.with_numbers(rows).count() == 3000
    for first, last in ((400, 450), (1, 1500), (999, 1001)):
        got = sorted((str(r["account"]), str(r["folder"]), r["email_no"]) for r in numbering.number_range(rows, f"{first}-{last}").collect())
        want = sorted((str(r["account"]), str(r["folder"]), r["email_no"]) for r in numbering.with_numbers(rows).collect() if first <= r["email_no"] <= last)
        assert got == want


def test_flags(spark):
    df = spark.createDataFrame([(["\\Sent"],), (["$SENT"],), (["\\Seen", "\\sent"],), (["Sent"],), ([],), (None,)], "flags array<string>")
    assert [r[0] for r in df.select(filters.is_sent()).collect()] == [True, True, True, False, False, False]


def test_patterns(evaluate):
    def found(source, texts, make=P.template_pattern):
        return evaluate(lambda c: P.matches(c, make(source, REF_DATE) if make is not P.glob_pattern else make(source)), texts)

    assert found(None, ["a", None]) == [True, True]
    assert found("Invoice", ["my INVOICE", "x", None]) == [True, False, False]
    assert found("Invoice {{ #[0-9]+ }}", ["invoice #12", "invoice 12"]) == [True, False]
    assert found("{{ dates.month }} {{ dates.year }}", ["for march 2026", "march 2025"]) == [True, False]
    assert found("a.b {{ .{3,} }}", ["a.b xyz", "aXb xyz", "a.b x"]) == [True, False, False]
    assert found("{{ ^end$ }}", ["end", "end\n"]) == [True, False]
    assert found("x{{ [a }}", ["x[a", "xa"]) == [True, False]
    assert found("{{ a{ }}", ["a{", "a"]) == [True, False]
    assert found("*.JP?", ["a.jpg", "a.jpg.x", "jpg"], P.glob_pattern) == [True, False, False]
    assert found("{{ \\bé }}", ["é", "aé"]) == [False, True]  # boundaries are ASCII


def test_ignore_rules(box):
    rules = P.ignore_rules('[from="example.com", subject=[stop, "Poll*"], att=*.jpg]', REF_DATE)
    assert [r.field for r in rules] == ["from", "subject", "attachment"]
    assert sorted(r["uid"] for r in filters.not_ignored(box, rules).collect()) == [2, 4, 5]
    assert P.ignore_rules("nothing", REF_DATE) == []
    assert filters.not_ignored(box, P.ignore_rules("body=ticket", REF_DATE)).count() == 7


def test_html(evaluate):
    text = evaluate(html_to_text, [mailbox.SURVEY_TABLE, mailbox.SURVEY_CELLS, "a &amp;lt; &#233; &bogus; &euro;", "x<br>y<h1>T</h1>z", None])
    assert text[0] == ("Your answers at a glance:\n| Question | Answer |\n| Guest | Mira Olsen |\n| Breakfast | No |\n"
                       "| Nights | 3 nights |\nHarbour Hotel")
    assert "| Item | Choice |" in text[1] and text[1].endswith("See you there,\nPoll Desk")
    assert evaluate(html_to_text, ["&#0; a &#9999999; &#xD800; &#99999999999999999999; &#00000000065; &#x0000000041;"]) == ["&#0; a &#9999999; &#xD800; &#99999999999999999999; A A"]
    assert text[2:] == ["a &lt; é &bogus; €", "x\ny\n\nT\n\nz", None]


def test_html_lists(evaluate):
    """Numbers, nesting, widths, start and type; rules and capitals; lists in cells, broken markup, control characters."""
    pages = {
        "<p>a</p><ul><li>x</li><li>y</li></ul><p>b</p>": "a\n\n * x\n * y\n\nb",
        "<ol><li>x<ul><li>u</li><li>v<ol><li>w</li></ol></li></ul></li><li>y</li></ol>z": "1. x\n    * u\n    * v\n      1. w\n 2. y\n\nz",
        "a<ol start=9><li>b<li>c</ol>": "a\n\n 9.  b\n 10. c",
        "k<OL type='a' start=26><li>p</li><li>q</li></OL><ol type=I start=\"4\"><li>r</li></ol>": "k\n\n z.  p\n aa. q\n\n IV. r",
        "a<hr>b<h4>caf&eacute; <b>x</b></h4>c": "a\n\n" + "-" * 40 + "\n\nb\n\nCAFÉ X\n\nc",
        "<table><tr><td><ol><li>q</li></ol></td><td>r</td></tr></table>": "| q | r |",
        "</ul>a</ol><li>b": "a\n\n * b",
        "a\x05\x06b\x0e": "ab",
        "a</h5>b": "a\n\nb",
    }
    assert dict(zip(pages, evaluate(html_to_text, list(pages)))) == pages
    many = "a<ol>" + "".join(f"<li>i{k}</li>" for k in range(1, 1001)) + "</ol>"
    assert evaluate(html_to_text, [many])[0].splitlines()[-1] == " 1000. i1000"


def test_html_regular_tables(evaluate):
    """A regular table is read by whole-table steps and gives the lines that cell by cell cleaning gives; odd tables are cleaned cell by cell."""
    pages = {
        "<table>\n<thead><tr class=h><TH>A</th> <th> b&nbsp; <b>c</b>\n d</th></tr></thead>x<tbody><tr><td> </td><td>&lt;i&gt; | e</td></tr></tbody></table>z": "| A | b c d |\n|  | <i> | e |\nz",
        "<table><tr><td>a<td>b</td></tr><tr></tr></table>": "| ab |",
        "<table><tr><td>a</td></tr><tr <b>x><td>\u3000c</td></tr></table>": "| a |\n| c |",
        "<table><tr><td>&nb<i>sp;</i>a</td><td>1 < 2</td></tr></table>": "| a | 1 < 2 |",
    }
    assert dict(zip(pages, evaluate(html_to_text, list(pages)))) == pages
    regular = evaluate(lambda c: html._regular(tables(c)[0]).isNotNull(), list(pages))
    assert regular == [True, False, False, False]


def test_html_tables(evaluate):
    columns = evaluate(lambda c: columns_map(grid_columns(table_grid(c))), [
        mailbox.SURVEY_TABLE, mailbox.SURVEY_CELLS,
        "<table><tr><td>A</td><td>B</td></tr><tr><td>1</td></tr></table><table><tr><th>A</th></tr><tr><td>2</td></tr></table>",
        "<table><tr><td>A</td><td>A</td></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "<p>none</p>"])
    assert columns[0] == {"Question": ["Guest", "Breakfast", "Nights"], "Answer": ["Mira Olsen", "No", "3 nights"]}
    assert set(columns[1]) == {"Item", "Choice"} and columns[1]["Choice"] == ["Quince", "Maybe", "monthly"]
    assert columns[2] == {"A": ["1", "2"], "B": [""]} and columns[3] == {"A": ["1", "2", "3", ""]} and columns[4] == {}


def test_leaf_elements(evaluate):
    page = "<head><title>t</title></head><div><p>a&nbsp;b</p><p> </p><script>'<p>x</p>'</script><li>c<br></li><b>d</b></div>"
    assert [tuple(e) for e in evaluate(leaf_elements, [page])[0]] == [(1, "p", "a b"), (3, "li", "c"), (4, "b", "d")]
    assert evaluate(lambda c: decode_entities(c), ["&", "&#x41;&#128512;"]) == ["&", "A😀"]


def test_attachments(spark):
    parts = spark.createDataFrame([
        (1, 1, "text", "plain", None, None, None), (1, 2, "application", "PDF", None, None, None),
        (1, 3, "image", "png", "inline", None, "n.png"), (2, 1, "text", "plain", "ATTACHMENT", None, None),
        (2, 2, "image", "png", "inline", "", ""), (3, 1, "text", "plain", None, "f.txt", "n.txt")],
        "uid int, part_no int, type string, subtype string, disposition string, disp_filename string, param_name string")
    got = {(r["uid"], r["part_no"]): r["name"] for r in attachment_parts(parts).collect()}
    assert got == {(1, 2): "attachment.pdf", (1, 3): "n.png", (2, 1): "attachment.plain", (3, 1): "f.txt"}


def test_export_names(spark):
    def row(uid, part, name):
        return ("a", "f", uid, dt.datetime(2024, 1, 1) + dt.timedelta(days=uid), part, name)

    rows = [row(u, p, "x.pdf") for u in range(1, 31) for p in (1, 2)] + [row(40, 1, "y.pdf"), row(41, 1, "y.pdf")]
    df = spark.createDataFrame(rows, "account string, folder string, uid int, internal_date timestamp_ntz, part_no int, name string")
    got = {(r["uid"], r["part_no"]): r["target"] for r in export_names(df).collect()}
    assert got[(30, 1)] == "1_x.pdf" and got[(29, 1)] == "1a_x.pdf" and got[(4, 2)] == "2z_x.pdf"
    assert (3, 1) not in got and (41, 1) not in got and got[(40, 1)] == "y.pdf"


def test_export_targets_are_unique(spark):
    def row(uid, part, name):
        return ("a", None, uid, dt.datetime(2024, 1, 1) + dt.timedelta(days=uid), part, name)

    rows = [row(1, 1, "x.pdf"), row(1, 2, "y.pdf"), row(2, 1, "1_x.pdf"), row(3, 1, "1a_x.pdf"), row(4, 1, "2_y.pdf"),
            row(5, 1, "a/b.txt"), row(6, 1, "a_b.txt"), row(7, 1, "x.pdf"), row(7, 2, "z.pdf")]
    df = spark.createDataFrame(rows, "account string, folder string, uid int, internal_date timestamp_ntz, part_no int, name string")
    got = {(r["uid"], r["part_no"]): r["target"] for r in export_names(df).collect()}
    assert got[(2, 1)] == "1_x.pdf" and got[(3, 1)] == "1a_x.pdf" and got[(4, 1)] == "2_y.pdf"
    assert got[(7, 1)] == "1b_x.pdf" and got[(1, 1)] == "1c_x.pdf" and got[(1, 2)] == "2a_y.pdf" and got[(7, 2)] == "2_z.pdf"
    assert (6, 1) not in got or (5, 1) not in got
    assert len(set(got.values())) == len(got) == 8


def test_export_names_sort_a_message_once(spark):
    """Counts and positions of a message's attachments come from one window, so a task holds one sort for them."""
    df = spark.createDataFrame([("a", "f", 1, dt.datetime(2024, 1, 1), k, n) for k, n in ((1, "b.pdf"), (2, "A.txt"), (3, None))],
                               "account string, folder string, uid int, internal_date timestamp_ntz, part_no int, name string")
    named = file_mode_names(df, "x.PDF")
    assert named.columns == [*df.columns, "target"]
    assert {r["part_no"]: r["target"] for r in named.collect()} == {1: "3_x.PDF", 2: "2_x.PDF.txt", 3: None}

    def windows(found):
        return found._jdf.queryExecution().optimizedPlan().toString().count("Window [")

    assert windows(named) == 1
    assert windows(export_names(df)) == 6  # three readings of the numbered rows, names taken, and bare names twice


def test_templates_run_on_the_engine_that_checks_them(spark):
    from mailloom.functions.patterns import template_pattern

    def found(source, text):
        pattern = template_pattern(source, dt.date(2024, 1, 1))
        return spark.createDataFrame([(text,)], "t string").select(pattern.found_in("t")).head()[0]

    assert found("Y {{ (?<y>[0-9]{4}) }}", "Y 2024") and not found("Y {{ (?<y>[0-9]{4}) }}", "Y x")
    assert not found("Y {{ (?P<y>[0-9]) }}", "Y 2") and found("Y {{ (?P<y>[0-9]) }}", "Y (?P<y>[0-9])")
    assert found("a {{ [ }}", "a [")


def test_extension(evaluate):
    assert evaluate(extension, ["a.PDF", "a.tar.gz", ".bashrc", "none", "a."]) == [".pdf", ".gz", "", "", "."]


def test_folders(spark):
    tree = spark.createDataFrame(
        [("1", None, "INBOX", "/", [], 0), ("2", None, "invoices", "/", [], 1), ("3", None, "Sent", "/", ["\\Sent"], 2),
         ("4", None, "Drafts", "/", ["\\Drafts"], 3), ("5", None, "[Gmail]", "/", ["\\Noselect"], 4),
         ("6", "5", "Sent Mail", None, ["\\Sent"], 5), ("7", "5", "All Mail", ".", ["\\All"], 6)],
        "node string, parent string, name string, delimiter string, attribs array<string>, ord int")
    flat = flatten_tree(tree).orderBy("listing")
    assert [r["full_path"] for r in flat.collect()] == [
        "INBOX", "invoices", "Sent", "Drafts", "[Gmail]", "[Gmail]/Sent Mail", "[Gmail].All Mail"]
    listed = flat.withColumn("ord", F.col("listing"))
    deep = [(str(k), str(k - 1) if k else None, f"f{k}", None, [], 10**12 + k) for k in range(7)] + [("z", None, "last", "|", [], 10**13), ("y", None, "first", "|", [], 9), ("loop", "loop", "l", "/", [], 1)]
    deep = flatten_tree(spark.createDataFrame(deep, "node string, parent string, name string, delimiter string, attribs array<string>, ord bigint"), ".")
    assert [(r["full_path"], r["depth"]) for r in deep.orderBy("listing").collect()] == [
        ("first", 1), *[(".".join(f"f{i}" for i in range(k + 1)), k + 1) for k in range(7)], ("last", 1)]
    found = {r["target"]: r["full_path"] for r in resolve_folders(listed, ["SENT", "all", "draft", "voice", "zzz"]).collect()}
    assert found == {"SENT": "Sent", "all": "[Gmail].All Mail", "draft": "Drafts", "voice": "invoices"}


def test_move(spark, box):
    known = spark.createDataFrame([("invoices",)], "full_path string")
    moved = move_messages(box, "invoices", criteria(subject="invoice"), known)
    assert sorted(r["uid"] for r in moved.filter("folder = 'invoices'").collect()) == [1] and moved.count() == 7 and moved.filter("uid = 4").isEmpty()
    with pytest.raises(ValueError):
        move_messages(box, "invoices", None)
    with pytest.raises(ValueError):
        move_messages(box, "nowhere", criteria(subject="x"), known)


def message(uid, folder="INBOX", subject="invoice", account="a", second=0):
    return (account, folder, uid, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second), subject)


MAIL = "account string, folder string, uid bigint, internal_date timestamp_ntz, subject string"


def test_moves_keep_uids_unique(spark):
    rows = [message(1), message(2), message(70000), message(3, subject="other"), message(1, "Old"), message(1, "Invoices"), message(5, "Invoices", "x"),
            message(1, account="b"), message(9, None), message(4, account=None)]
    df = spark.createDataFrame(rows, MAIL)
    moved = moved_messages(df, "Invoices", criteria(subject="invoice")).collect()
    got = {(r["account"], r["from_folder"], r["from_uid"]): r["uid"] for r in moved}
    assert got == {("a", None, 9): 6, ("a", "INBOX", 1): 7, ("a", "INBOX", 2): 8, ("a", "INBOX", 70000): 9, ("a", "Old", 1): 10, ("b", "INBOX", 1): 1, (None, "INBOX", 4): 1}
    after = move_messages(df, "Invoices", criteria(subject="invoice")).collect()
    keys = [(r["account"], r["folder"], r["uid"]) for r in after]
    assert len(keys) == len(set(keys)) == len(rows) and ("a", "INBOX", 3) in keys
    listed = spark.createDataFrame([("Bills", "Work/Bills", [], 0), ("x", "x", ["\\Archive"], 1)], "name string, full_path string, attribs array<string>, ord int")
    assert target_folder(listed, "bill") == "Work/Bills" and target_folder(listed, "archive") == "x" and target_folder(listed, "Work/Bills") == "Work/Bills"


def test_move_in_table_writes_touched_partitions_only(spark, tmp_path):
    rows = [message(k, subject="invoice" if k % 2 else "note") for k in range(1, 9)]
    rows += [message(k, "Full", "invoice") for k in range(1, 4)] + [message(k, "Quiet", "note") for k in range(1, 4)] + [message(7, "Bills", "old"), message(2, account="b", subject="note")]
    path = str(tmp_path / "mail")
    write_messages(spark.createDataFrame(rows, MAIL), path)
    files = lambda: {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}
    before = files()
    touched = move_in_table(spark, path, "Bills", criteria(subject="invoice"))
    assert sorted(touched) == [("a", "Full"), ("a", "INBOX")]
    after = files()
    kept = {f for f in before if "folder=Quiet" in f or "folder=Bills" in f or "account=b" in f}
    assert kept <= after and not any("folder=Full" in f for f in after) and not before & after - kept
    found = read_messages(spark, path).collect()
    assert len(found) == len(rows)
    assert sorted((r["uid"]) for r in found if r["folder"] == "Bills") == [7, 8, 9, 10, 11, 12, 13, 14]
    assert sorted(r["uid"] for r in found if r["folder"] == "INBOX" and r["account"] == "a") == [2, 4, 6, 8]
    assert move_in_table(spark, path, "Bills", criteria(subject="invoice")) == [] and files() == after


def test_numbers_by_counting(spark):
    rng = random.Random(6)
    rows, seen = [], set()
    for _ in range(900):
        account, folder, uid = rng.choice(["a", "b", None]), rng.choice(["INBOX", None]), rng.choice([rng.randrange(40), rng.randrange(1 << 22)])
        if (account, folder, uid) not in seen:
            seen.add((account, folder, uid))
            rows.append(message(uid, folder, rng.choice(["invoice", "x", "x"]), account, rng.choice([0, 1, 86400, rng.randrange(400000)])))
    rows.append((None, None, 5_000_000, None, "invoice"))
    df = spark.createDataFrame(rows, MAIL)
    numbers = {}
    for place in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == place), key=lambda r: (-(r[3] or dt.datetime(1970, 1, 1)).timestamp(), r[2]))
        numbers |= {(*place, r[2]): k for k, r in enumerate(own, 1)}
    hits = sorted(((*r[:2], r[2]) for r in rows if r[4] == "invoice"), key=lambda x: numbers[x])
    for n, pool in ((3, None), (500, None), (4, 9)):
        want = {}
        for place in {x[:2] for x in hits}:
            want |= {x: numbers[x] for x in [h for h in hits if h[:2] == place][:n] if pool is None or numbers[x] <= pool}
        found = first_matches(df, F.col("subject") == "invoice", n, pool)
        assert {(r["account"], r["folder"], r["uid"]): r["email_no"] for r in found.collect()} == want
        assert found.columns == [*df.columns, "email_no"]
    plan = first_matches(df, F.col("subject") == "invoice", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
    places = sorted(str(x[:2]) for x in {h[:2] for h in hits})
    listed = position_pieces(df, F.col("subject") == "invoice", 50).orderBy("piece").collect()
    for place in {h[:2] for h in hits}:
        joined = ",".join(r["positions"] for r in listed if (r["account"], r["folder"]) == place)
        assert joined == ",".join(str(numbers[h]) for h in hits if h[:2] == place)
    assert len(places) == 6 and {(r["piece"], r["positions"]) for r in position_pieces(df, F.col("subject") == "none").collect()} == {(1, "")}
    total = {(r["account"], r["folder"]): r["n"] for r in count_by_folder(df, F.col("subject") == "invoice", "1-20").collect()}
    assert total == {p: sum(numbers[h] <= 20 for h in hits if h[:2] == p) for p in {r[:2] for r in rows}}


def test_refetch_takes_one_raw_row(spark):
    mail = spark.createDataFrame([(1, " "), (2, "kept"), (3, None), (4, "")], "uid int, body string")
    raw = spark.createDataFrame([(1, " "), (1, "b"), (1, "a"), (2, "other"), (3, None), (3, None)], "uid int, raw_text string")
    assert sorted((r["uid"], r["body"]) for r in refetched(mail, raw, keys=("uid",)).collect()) == [(1, "a"), (2, "kept"), (3, None), (4, None)]


def test_first_parts(spark):
    """Smallest path of the wanted kind; a path listed twice gives one row; no sorting aggregate moves contents."""
    rows = [("a", "I", 1, 2, "text", "PLAIN", "second"), ("a", "I", 1, 1, "TEXT", "plain", "first"), ("a", "I", 1, 0, "text", "html", "<p>"),
            ("a", "I", 2, 3, "text", "plain", "twice"), ("a", "I", 2, 3, "text", "plain", "twice"), ("a", "I", 3, 1, "image", "png", "x"),
            ("b", "I", 1, 5, "text", "plain", None), ("b", "I", 4, None, "text", "plain", "no path"), (None, "I", 1, 1, "text", "plain", "no key")]
    parts = spark.createDataFrame(rows, "account string, folder string, uid int, path int, type string, subtype string, content string")
    found = first_part(parts, "plain")
    assert found.columns == parts.columns
    assert sorted((r["account"], r["uid"], r["path"], r["content"] or "") for r in found.collect()) == [("a", 1, 1, "first"), ("a", 2, 3, "twice"), ("b", 1, 5, "")]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    messages = spark.createDataFrame([("a", "I", u) for u in (1, 2, 3)], "account string, folder string, uid int")
    assert sorted((r["uid"], r["t"]) for r in part_bodies(messages, parts, "plain", "t").collect() if r["t"]) == [(1, "first"), (2, "twice")]
    assert part_bodies(messages, parts, "html", "h").count() == 3 and first_part(parts.limit(0), "html").count() == 0
