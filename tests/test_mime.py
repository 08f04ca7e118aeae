"""Raw messages: the column expressions against the standard library's parser, and stated odd cases."""

import datetime as dt
import email
import random
from email.header import Header, decode_header, make_header
from email.mime.application import MIMEApplication
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText
from email.utils import format_datetime, parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from mailloom.functions import rfc822 as R
from mailloom.sources.mime_archive import parse_messages, to_attachments, to_messages

TEXTS = {"utf-8": "Größe – 5 €\nzwei", "iso-8859-1": "naïve café", "windows-1252": "“quoted” – €", "koi8-r": "Привет", "shift_jis": "日本語のテキスト", "us-ascii": "plain = text"}


def _message(rng: random.Random):
    def leaf():
        if rng.random() < 0.4:
            part = MIMEApplication(rng.randbytes(rng.randrange(200)), rng.choice(["pdf", "octet-stream"]))
            if rng.random() < 0.8:
                part.add_header("Content-Disposition", rng.choice(["attachment", "inline"]), filename=rng.choice(["a b.pdf", "x;y.bin", ("utf-8", "", "größe €.pdf"), "=?utf-8?q?gr=C3=B6=C3=9Fe.txt?="]))
            return part
        charset = rng.choice(sorted(TEXTS))
        part = MIMEText(TEXTS[charset] * rng.randrange(1, 40), rng.choice(["plain", "html"]), charset)
        if rng.random() < 0.2:
            part.add_header("Content-Disposition", "attachment", filename="notes.txt")
        return part

    def tree(depth):
        if depth and rng.random() < 0.6:
            # Boundaries that begin like their parents'.
            whole = MIMEMultipart(rng.choice(["mixed", "alternative"]), boundary="=_B" + "1" * (depth + rng.randrange(2) * 4))
            for _ in range(rng.randrange(1, 4)):
                whole.attach(tree(depth - 1))
            return whole
        return leaf()

    out = tree(3)
    out["From"] = "billing@invoices.example"
    out["Subject"] = Header(*rng.choice([("plain subject", "utf-8"), ("Größe " * 20, "utf-8"), ("日本語の件名", "shift_jis"), ("café", "iso-8859-1")]))
    zone = dt.timezone(dt.timedelta(minutes=rng.choice([0, 120, -330])))
    out["Date"] = format_datetime(dt.datetime(rng.randrange(1990, 2030), rng.randrange(1, 13), 5, 13, 7, 9, tzinfo=zone))
    out["Received"] = "by one;\r\n\tfor two"
    out["Received"] = "by three"
    return out


def _expected(raw: bytes) -> dict:
    message = email.message_from_bytes(raw)
    out = {"text": None, "html": None, "attachments": []}
    for number, part in enumerate((p for p in message.walk() if not p.is_multipart()), 1):
        name, content = part.get_filename(), part.get_payload(decode=True)
        if part.get_content_maintype() == "text" and part.get_content_disposition() != "attachment" and not name:
            key = {"plain": "text", "html": "html"}[part.get_content_subtype()]
            out[key] = content.decode(part.get_content_charset() or "utf-8", "replace") if out[key] is None else out[key]
        else:
            name = name and str(make_header(decode_header(name)))
            out["attachments"].append((number, part.get_content_type(), part.get_content_disposition(), name, content))
    sent = parsedate_to_datetime(message["Date"])
    out["sent_at"] = sent.replace(tzinfo=None) - (sent.utcoffset() or dt.timedelta())
    out["subject"] = str(make_header(decode_header(message["Subject"])))
    return out


def test_messages_equal_the_standard_parser(spark):
    rng = random.Random(11)
    raws = [_message(rng).as_bytes() for _ in range(150)]
    raws += [r.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n") for r in raws[:50]]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")
    found = {r["i"]: r for r in parse_messages(rows, "raw", "i").collect()}
    for i, raw in enumerate(raws):
        want, got = _expected(raw), found[i]
        assert [got["text"], got["html"], got["sent_at"]] == [want["text"], want["html"], want["sent_at"]], raw
        assert got["headers"]["subject"] == [want["subject"]] and got["headers"]["received"] == ["by one;\tfor two", "by three"]
        assert [(a["part_no"], f"{a['type']}/{a['subtype']}", a["disposition"], a["name"], bytes(a["content"])) for a in got["attachments"]] == want["attachments"], raw


def test_odd_messages(spark):
    raws = [
        None, "", "no header at all", "Subject: only\r\n", "\r\nbody at once",
        "Content-Type: multipart/mixed; boundary=B\n\nno such line",
        "Content-Type: multipart/mixed; boundary=B\n\n--B\n\nunclosed",
        "Content-Type: multipart/mixed; boundary=\"B\"\n\npre\n--B \n\none\n--B2\ntwo\n--B--\nafter\n--B\n\nnot a part",
        "Content-Transfer-Encoding: base64\n\nSGVsbG8", "Content-Transfer-Encoding: base64\n\nA",
        "Content-Transfer-Encoding: Quoted-Printable\n\na=3Db=\nc =zz=e9",
        "Content-Type: text/plain; charset=nonsense\n\n$1 \\ é", "Subject: =?x?q?=\nDate: soon\n\nx",
        "Content-Type: message/rfc822\n\nSubject: inner\n\ninner text",
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = {r["i"]: r for r in parse_messages(rows, "raw", "i").collect()}
    texts = [None, "", "", "", "body at once", "no such line", "unclosed", "one\n--B2\ntwo", "Hello", "", "a=bc =zz�", "$1 \\ é", "x", None]
    assert [got[i]["text"] for i in range(len(raws))] == texts
    assert got[0]["attachments"] == [] and got[0]["headers"] is None and got[3]["headers"] == {"subject": ["only"]}
    assert got[12]["headers"]["subject"] == ["=?x?q?="] and got[12]["sent_at"] is None
    assert [(a["subtype"], bytes(a["content"])) for a in got[13]["attachments"]] == [("rfc822", b"Subject: inner\n\ninner text")]
    empty = parse_messages(rows.limit(0), "raw", "i")
    assert empty.count() == 0 and to_attachments(empty, "i").count() == 0
    assert to_messages(parse_messages(rows, "raw", "i"), "i").where("i = 12").first()["date_hdr"] == "soon"


@pytest.mark.parametrize(("text", "want"), [
    ("Thu, 25 Jan 2024 08:00:00 +0200", dt.datetime(2024, 1, 25, 6)), ("5 Feb 99 23:59 EST", dt.datetime(1999, 2, 6, 4, 59)),
    ("Mon, 05-Feb-2024 01:02:03 -0330 (NDT)", dt.datetime(2024, 2, 5, 4, 32, 3)), ("1 Mar 2020 10:00:00", dt.datetime(2020, 3, 1, 10)),
    ("31 Feb 2020 10:00:00 +0000", None), ("1 Foo 2020 10:00", None), ("", None), (None, None)])
def test_dates(evaluate, text, want):
    assert evaluate(R.sent_at, [text]) == [want]


def test_long_and_deep_messages(spark):
    deep = "".join(f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\n" for k in range(40)) + "\n" + "word " * 200000
    deep += "".join(f"\n--b{k}x--" for k in reversed(range(40)))
    flat = "Content-Type: multipart/mixed; boundary=B\n\n" + "--B\nContent-Disposition: attachment\n\nx\n" * 2000 + "--B--"
    got = parse_messages(spark.createDataFrame([(0, deep), (1, flat)], "i int, raw string"), "raw", "i")
    sizes = {r["i"]: (r["t"], r["n"]) for r in got.select("i", F.length("text").alias("t"), F.size("attachments").alias("n")).collect()}
    assert sizes == {0: (1000000, 0), 1: (None, 2000)}
