"""Raw messages against the standard library's parser."""

import email
import email.policy
from email.header import decode_header, make_header
from email.message import EmailMessage
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pytest
from pyspark.sql import functions as F

from newsloom.sources import messages as ms

DATE = "Sat, 01 Aug 2026 10:00:00 +0200"


def made():
    out = []
    m = EmailMessage()
    m["From"], m["Subject"], m["Date"] = "Reef News <News@Example.com>", "Größere Riffe – café 🐠 and a long line " * 3, DATE
    m.set_content("plain äöü = text\n")
    m.add_alternative("<p>Fish &amp; corals = é 🐠</p>" * 20, subtype="html")
    out.append(m.as_string())
    m = MIMEMultipart("mixed")
    m["From"], m["Subject"], m["Date"] = "a@b.org", "=?utf-8?q?caf=C3=A9_one?= =?iso-8859-1?B?Z3L832U=?= tail", DATE
    inner = MIMEMultipart("alternative")
    inner.attach(MIMEText("plain", "plain", "utf-8"))
    inner.attach(MIMEText("<b>übung</b>", "html", "iso-8859-1"))
    m.attach(inner)
    m.attach(MIMEText("<i>second</i>", "html", "utf-8"))
    out.append(m.as_string())
    out.append(f"From: x@y.z\nSubject: folded\n line\nDate: {DATE}\n\njust text with a = sign\n")
    out.append(f"from: X <x@y.z>\r\nDATE: {DATE}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<a href=3D\"u\">soft=\r\n break =zz</a>")
    return out


def expected(raw):
    m = email.message_from_string(raw)
    html, plain = [], []
    for part in m.walk():
        if part.get_content_maintype() == "multipart":
            continue
        text = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", errors="replace")
        (html if part.get_content_subtype() == "html" else plain).append(text)
    subject = str(make_header(decode_header(m.get("Subject", "")))).strip()
    return email.utils.parseaddr(m["From"])[1].lower(), subject, "\n".join(html or plain)


def parsed(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "message_id long, raw string").withColumn("html", F.lit("clash"))
    return {r["message_id"]: r for r in ms.parse_messages(rows).collect()}


def squeezed(text):
    return " ".join((text or "").split())


def test_messages_equal_the_standard_parser(spark):
    raws = made()
    got = parsed(spark, raws)
    for i, raw in enumerate(raws):
        sender, subject, body = expected(raw)
        assert got[i]["sender"] == sender and got[i]["reason"] is None
        assert squeezed(got[i]["subject"]) == squeezed(subject)
        assert squeezed(got[i]["html"]) == squeezed(body)
        assert str(got[i]["published_at"]).startswith("2026-08-01 08:00:00")


@pytest.mark.parametrize(
    "raw,reason",
    [
        (None, "no sender"),
        ("", "no sender"),
        (f"Subject: x\nDate: {DATE}\n\nbody", "no sender"),
        (f"From: nobody\nDate: {DATE}\n\nbody", "no sender"),
        ("From: a@b\nDate: soon\n\nbody", "no usable date"),
        ("From: a@b\n\nbody", "no usable date"),
        (f"From: a@b\nDate: {DATE}\n\n", "no readable body"),
        (f"From: a@b\nDate: {DATE}", "no readable body"),
        (f"From: a@b\nDate: {DATE}\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n###", "no readable body"),
        (f"From: a@b\nDate: {DATE}\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\naGk=", "no readable body"),
        (f"From: a@b\nDate: {DATE}\nContent-Type: multipart/mixed; boundary=q\n\npreamble only", "no readable body"),
        (f"From: a@b\nDate: {DATE}\nContent-Type: multipart/mixed; boundary=q.q\n\n--q.q\n\nopen end", None),
        (f"From: a@b\nDate: {DATE}\nContent-Type: multipart/mixed; boundary=q\n\n--q\n\nin\n--q--\nafter\n--q\n\nout", None),
    ],
)
def test_unusable_messages_say_why(spark, raw, reason):
    got = parsed(spark, [raw])[0]
    assert got["reason"] == reason
    if reason is None:
        assert got["html"] in ("open end", "in")


def test_a_broken_part_leaves_the_others(spark):
    raw = (
        f"From: a@b\nDate: {DATE}\nContent-Type: multipart/mixed; boundary=\"x y\"\n\n--x y\nContent-Type: text/html\n"
        "Content-Transfer-Encoding: base64\n\n!!!\n--x y\nContent-Type: text/html\n\n<p>ok</p>\n--x y--\n"
    )
    got = parsed(spark, [raw])[0]
    assert got["html"] == "<p>ok</p>" and got["reason"] is None


def test_links_of_allowed_senders_only(spark):
    body = '<a href="https://n.example.com/a">A long enough headline about coral reefs</a>'
    raws = [f"From: {s}\nDate: {DATE}\nSubject: s\nContent-Type: text/html\n\n{body}" for s in ("Good@x.org", "bad@x.org")]
    rows = spark.createDataFrame(list(enumerate(raws)), "message_id long, raw string")
    allow = spark.createDataFrame([("good@X.org",)], "sender string")
    got = ms.harvest_messages(rows, allow, terms=None).collect()
    assert [(r["message_id"], r["url"], r["sender"]) for r in got] == [(0, "https://n.example.com/a", "good@x.org")]
    assert ms.harvest_messages(rows, allow.limit(0), terms=None).count() == 0
