from pyspark.sql import functions as F

from mailloom.functions import chain as C
from mailloom.operators import chains as O

DASHES = "-" * 40
THANK_YOU_CHAIN = "\n".join([
    " ", "", DASHES,
    "From: Olsen Boats <mira.olsen@boats.example.net>", "Sent: Friday, May 8, 2026 4:11:07 PM",
    "To: Quay Office <quay@example.org>", "Subject: Re: Mooring fees - 04/01/2026 to 04/30/2026", "",
    "Thank you, all clear now!", "", "[cid:logo-17]", "",
    "Mira Olsen", "", "9 Harbour Lane", "", "Tidewater, ME 04101", "", "(555) 310-2277 office", "", DASHES,
    "From: quay@example.org <quay@example.org>", "Sent: Thursday, May 7, 2026 9:40 AM",
    "To: mira.olsen@boats.example.net", "Subject: Mooring fees - 04/01/2026 to 04/30/2026", "",
    "Hello,", "", "Attached are the fee sheets from 04/01/2026 to 04/30/2026", "", "Fair winds,",
])
REQUEST_CHAIN = "\n".join([
    " ", "", DASHES, "From: quay@example.org <quay@example.org>", "Sent: Thursday, May 7, 2026 9:40 AM",
    "To: mira.olsen@boats.example.net", "Subject: Mooring fees - 04/01/2026 to 04/30/2026", "", "Hello,", "",
    "Thanks for the fee sheets. Could you send the berth plans as well.", "", "Fair winds,",
])
SIGNED = "\n".join([
    "Thank you, all clear now!", "", "[cid:logo]", "", "Mira Olsen", "", "9 Harbour Lane", "",
    "Tidewater, ME 04101", "", "(555) 310-2277 office",
])


def test_thank_you_texts(evaluate):
    yes = ["Thank you, Ilse!", "Thanks, crew", "Thank you, all clear now!", "Received the charts. Thanks", "Got it, thanks, Ilse!",
           "Your help is much appreciated!", SIGNED]
    no = ["Thanks for the fee sheets. Could you send the berth plans as well.",
          "Thanks, could you forward the tide table?",
          "Thanks for the sketch. The second mast seems too short to me. We should measure it again. "
          "The sails need a new seam too.", "", None, "Please send me the log of last week."]
    assert evaluate(C.is_thank_you, yes) == [True] * len(yes)
    assert evaluate(C.is_thank_you, no) == [False] * len(no)


def test_thank_you_chains(evaluate):
    texts = [THANK_YOU_CHAIN, REQUEST_CHAIN, "Thanks!", "Please send me the crew list of last month.", None, ""]
    assert evaluate(O.is_thank_you_chain, texts) == [True, False, True, False, False, False]


def test_split(evaluate):
    segments = evaluate(C.split_chain, [THANK_YOU_CHAIN])[0]
    assert [s["index"] for s in segments] == [0, 1, 2]
    assert segments[0]["body"] == "" and segments[0]["headers"] == {}
    assert segments[1]["headers"]["from"] == "Olsen Boats <mira.olsen@boats.example.net>"
    assert set(segments[2]["headers"]) == {"from", "sent", "to", "subject"}
    assert segments[2]["body"].startswith("Hello,") and segments[2]["body"].endswith("Fair winds,")


def test_split_edges(evaluate):
    texts = [
        "a\n" + DASHES + "\nplain text\nb",  # a divider without headers is text
        "a\r\n" + DASHES + "\r\n\r\nFROM : x\r\nfrom: y\r\n\r\nTo: z\r\nb\r\nc",  # last header wins
        "a\n" + DASHES + "\n" + DASHES + "\nTo: x\nb",
        "a\n" + DASHES + "\n" * 5000 + "To: x\nb",  # a long run of blank lines
        "", None,
    ]
    got = evaluate(C.split_chain, texts)
    assert [s["body"] for s in got[0]] == [texts[0]]
    assert [s["body"] for s in got[1]] == ["a", "b\nc"]
    assert got[1][1]["headers"] == {"from": "y", "to": "z"}
    assert [s["body"] for s in got[2]] == ["a\n" + DASHES, "b"]
    assert [s["body"] for s in got[3]] == ["a", "b"]
    assert got[4] == [] and got[5] == []


def test_is_chained_looks_seven_lines_ahead(evaluate):
    texts = ["x\n" + DASHES + "\n" * k + "From: a" for k in (1, 7, 8)]
    texts += ["x\n---------\nFrom: a", "x\n" + DASHES + "\nhello\nFrom: a", None]
    assert evaluate(C.is_chained, texts) == [True, True, False, False, False, False]


def test_classify(evaluate):
    texts = ["Attached are the statements", "did you get my mail?", "Could you send the data", "Are you able? yes",
             "hello", " ", "Can you do that? any update", "reattach it?", None]
    assert evaluate(C.classify, texts) == [
        "attachment-received", "did-you-receive", "send-data", "boolean", "unclassified", "unclassified",
        "did-you-receive", "unclassified", "unclassified",
    ]


def test_dominant_type_and_ties(spark):
    df = spark.createDataFrame(
        [(["send-data", "attachment-received"],), (["boolean", "boolean", "send-data"],), ([],)], "t array<string>"
    )
    got = [r[0] for r in df.select(C.dominant_type("t")).collect()]
    assert got == ["attachment-received", "boolean", "unclassified"]


def test_best_bodies(evaluate):
    first, last = evaluate(O.best_body, [THANK_YOU_CHAIN]), evaluate(lambda c: O.best_body(c, "earliest"), [THANK_YOU_CHAIN])
    assert first[0].startswith("Hello,") and last == first
    assert evaluate(O.best_body, ["a\n[cid:x]\nb", None]) == ["a\nb", None]
    narrowed = evaluate(O.narrowed_body, [THANK_YOU_CHAIN])[0]
    assert narrowed.startswith("Thank you") and "cid:" not in narrowed  # two unclassified segments win


def test_task_narrowing(evaluate):
    by_date = evaluate(lambda c: O.best_body_for_task(c, "fair winds"), [THANK_YOU_CHAIN])[0]
    assert by_date.startswith("Hello,")
    by_name = evaluate(lambda c: O.best_body_for_task(c, None, "file-name: All Clear"), [THANK_YOU_CHAIN])[0]
    assert by_name.startswith("Thank you, all")
    raw = evaluate(lambda c: O.best_body_for_task(c, "mira olsen", "raw-data:x"), [THANK_YOU_CHAIN])[0]
    assert raw.startswith("Hello,")


def test_message_content(evaluate):
    assert evaluate(C.message_content, [SIGNED, "a\r\n[cid:1]\r\nMira Olsen\r\nbye", "Mira Olsen\n\n\n\n\n555-123-4567"]) == [
        "Thank you, all clear now!", "a\nMira Olsen\nbye", "Mira Olsen\n\n\n\n\n555-123-4567",
    ]


def test_date_range_words(evaluate):
    yes = ["02/01/2026 to 03/23/26", "between 1/2", "last 3 months", "since 2/01", "on 1-2-2026", "2/1-3/4"]
    assert evaluate(C.has_date_range, yes) == [True] * 6
    assert evaluate(C.has_date_range, ["last month", "1/2", None]) == [False] * 3


def test_segments_operator(spark):
    df = spark.createDataFrame([(1, THANK_YOU_CHAIN), (2, "plain")], "id int, body string")
    rows = O.segments(df, "body", "id").groupBy("id").agg(F.count("*").alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == {1: 3, 2: 1}
    counts = {(r["id"], r["type"]): r["n"] for r in O.segment_type_counts(df, "body", "id").collect()}
    assert counts == {(1, "attachment-received"): 1, (1, "unclassified"): 2, (2, "unclassified"): 1}
