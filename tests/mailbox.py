"""Seven-message example mailbox, one row per message, newest last."""

import datetime as dt

REF_DATE = dt.date(2026, 3, 12)
SURVEY_TABLE = (
    "<html><body><p>Your answers at a glance:</p><table><tr><th>Question</th><th>Answer</th></tr>"
    "<tr><td>Guest</td><td>Mira Olsen</td></tr><tr><td>Breakfast</td><td>No</td></tr>"
    "<tr><td>Nights</td><td>3 nights</td></tr></table><p>Harbour Hotel</p></body></html>"
)
SURVEY_CELLS = (
    '<html><body><h1>Garden Poll</h1><table border="0"><tbody>'
    "<tr><td><div>&nbsp;Item</div></td><td><div>Choice</div></td></tr>"
    "<tr><td><div>Tree</div></td><td><div>Quince</div></td></tr>"
    "<tr><td><div>Pond</div></td><td><div>Maybe</div></td></tr>"
    "<tr><td><div>Visits</div></td><td><div>monthly</div></td></tr></tbody></table>"
    "<div><span>See you there,</span></div>"
    '<div><a href="mailto:polls@example.com">Poll Desk</a></div></body></html>'
)
SCHEMA = (
    "account string, folder string, uid bigint, internal_date timestamp_ntz, flags array<string>, "
    "from_addr string, return_path string, to_addrs string, subject string, body string, html string"
)


def _row(uid, day, hour, sender, subject, body, return_path=None, html=None):
    at = dt.datetime(2024, 1, day, hour)
    return ("a", "INBOX", uid, at, ["\\Seen"], sender, return_path, "recipient@test.com", subject, body, html)


MESSAGES = [
    _row(1, 2, 7, "library@example.com", "Your card is ready", "Come and fetch it at the desk."),
    _row(2, 9, 18, "ledger@bakery.example.net", "Quarterly figures", "The figures are in the file beside this note"),
    _row(3, 11, 6, "kim@choir.example.org", "STOP", "No more rehearsal notices, please."),
    _row(4, 17, 13, "office@plumber.example.net", "Invoice 88-A", "Here is the invoice for the new tap.",
         "<desk@plumber.example.net>"),
    _row(5, 19, 20, "help@printer.example.net", "Re: Paper jam 31", "The roller was replaced."),
    _row(6, 23, 5, "stay@harbour.example.net", "Poll result", None, html=SURVEY_TABLE),
    _row(7, 29, 22, "polls@example.com", "Poll result", "Item Choice", "<returns@example.com>",
         SURVEY_CELLS),
]


def messages(spark):
    return spark.createDataFrame(MESSAGES, SCHEMA)
