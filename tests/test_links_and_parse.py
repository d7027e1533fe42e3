import re

from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.fixed import DOMAIN_PATTERN
from tidewire.functions.links import extract_links
from tidewire.operators import parse

TEXTS = [
    ("see https://example.com/a.", "https://example.com/a"),
    ("visit www.example.org today", "https://www.example.org"),
    ("https://example.com and example.com", "https://example.com"),
    ("HTTP link https://a.io/x and https://a.io/x/", "https://a.io/x/"),
    ("mail bob@mail.example.com, x.y.co", "https://mail.example.com, https://x.y.co"),
    ("no link", ""),
    ("", ""),
    ("https://A.io/X https://a.io/x", "https://A.io/X"),
    ("http://s.co/" + "a" * 3000, "http://s.co/" + "a" * 3000),
]


def test_text_links(frame):
    df = frame([(t,) for t, _ in TEXTS], "text string")
    assert [r[0] for r in df.select(extract_links(F.col("text"))).collect()] == [e for _, e in TEXTS]


def test_links_against_a_plain_fold(frame):
    """The longest link of every family survives, as in a fold over links sorted by length."""
    texts = ["a.bc.com bc.com http://x.bc.com/q?bc.com www.bc.com!", "q.io/x q.io, https://q.io/x https://Q.io/X",
             "one.two.three.net two.three.net three.net", "http://a.co). http://a.co/b; b.co.a.co"]
    df = frame([(t,) for t in texts], "text string")
    for text, got in zip(texts, [r[0] for r in df.select(extract_links(F.col("text"))).collect()]):
        links = [u for u in re.findall(r"https?://[!$-_a-z]+", text) if len(u) > 4]
        for d in re.findall(DOMAIN_PATTERN, text):
            if len(d) > 4 and not any(d in u for u in links):
                links.append("https://" + d)
        kept = []
        for u in sorted({re.sub(r"[.,;!?)]+$", "", u) for u in links}, key=lambda u: (-len(u), u)):
            if not any(u.lower() in k.lower() for k in kept):
                kept.append(u)
        assert got == ", ".join(sorted(kept))


def raw(**over):
    base = dict(message_id=5, channel="@@news", date=None, text="hello", post_author=None, from_id=None, sender=None,
                forward=None, media=None, entities=None)
    base.update(over)
    return tuple(base.values())


def media(kind, mime=None, page=None, urls=None):
    return (kind, mime, page, urls)


def test_parse(frame, spark):
    from datetime import datetime
    day = datetime(2025, 10, 11, 22, 30)
    rows = [
        raw(message_id=1, date=day, from_id=(7, None, None)),
        raw(message_id=2, date=day, post_author="Ed", forward=("", (None, 9, None), 3, None)),
        raw(message_id=3, date=day, text="", media=None),
        raw(message_id=4, date=day, text=None, media=media("webpage", page=("https://p.io/x", "more http://q.io/d."))),
        raw(message_id=5, date=day, from_id=(None, None, "PeerChat(5)"), media=media("document", "video/audio", urls=["https://c.io/download?file_id=1", "https://c.io/ok "])),
        raw(message_id=6, date=day, from_id=(None, 4, None), media=media("document", "audio/mp3"), forward=("Bob", None, None, None)),
        raw(message_id=7, date=day, text="click", media=media("photo"), forward=(None, None, 8, None),
            entities=[("text_url", 0, 5, "https://b.io"), ("url", 0, 3, None), ("mention", 0, 1, "https://m.io/z")]),
    ]
    df = frame(rows, schemas.RAW_MESSAGE)
    got = {r["Message_ID"]: r for r in parse.parse_messages(df, "2025-10-12 00:00:00").collect()}
    assert set(got) == {1, 2, 4, 5, 6, 7}
    assert got[1]["Message_URL"] == "https://t.me/news/1" and got[1]["Date"] == "2025-10-11" and got[1]["Time"] == "22:30:00"
    assert got[1]["Processed_Date"] == "2025-10-12 08:00:00"
    assert [got[i]["Author"] for i in (1, 2, 4, 5, 6)] == ["User_7", "Ed", "", "ID_PeerChat(5)", "Channel_4"]
    assert [got[i]["Forward_From"] for i in (1, 2, 6, 7)] == ["", "Channel_9", "Bob", "Channel_8"]
    assert got[4]["Message_Text"] == "\n\nURL: https://p.io/x" and got[4]["Attached_Links"] == "http://q.io/d, https://p.io/x"
    assert [(got[i]["Message_Type"], got[i]["Media_Type"]) for i in (1, 4, 5, 6, 7)] == [
        ("text", ""), ("webpage", "webpage"), ("document", "video"), ("document", "audio"), ("photo", "photo")]
    assert got[5]["Attached_Links"] == "https://c.io/ok"
    assert got[7]["Attached_Links"] == "https://b.io, https://m.io/z"


def test_rich_parse(frame):
    rows = [
        raw(message_id=1, sender=("joe", "J", None, None)), raw(message_id=2, sender=(None, "Ann", "Lee", None)),
        raw(message_id=3, sender=("", None, None, "Group"), forward=(None, None, None, (6, None))),
        raw(message_id=4, forward=(None, None, None, (6, "Chat")))]
    got = {r["Message_ID"]: (r["Author"], r["Forward_From"])
           for r in parse.parse_messages(frame(rows, schemas.RAW_MESSAGE), "2025-01-01", rich=True).collect()}
    assert got == {1: ("@joe", ""), 2: ("Ann Lee", ""), 3: ("Group", "6"), 4: ("", "Chat")}


def test_empty_text(frame):
    rows = [(1, "", ""), (2, "   ", None), (3, "\t \n", ""), (4, "", "x"), (5, "y", " ")]
    df = frame(rows, "id int, text string, Message_Text string")
    full, empty = parse.split_empty_text(df)
    assert sorted(r["id"] for r in full.collect()) == [4] and sorted(r["id"] for r in empty.collect()) == [1, 2, 3, 5]
    first = parse.drop_empty_text(df, order=("text", "Message_Text"))
    assert sorted(r["id"] for r in first.collect()) == [4, 5]
