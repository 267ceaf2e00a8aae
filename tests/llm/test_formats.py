import base64
import hashlib
import random
import re
import struct

import pytest
import zstandard
from helpers import as_bag, prose
from pyspark.sql import functions as F

from ledgerloom.llm import chat, decontaminate, pages, warc
from ledgerloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


# --- WARC

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y?ü=1 2", "<p>two é</p>"), (3, None, "<p>one</p>"), (9, "u", "<p>one</p>"),
    (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>two é</p>"), (7, "big", "x" * 300_000), (9, "u", "<p>one</p>"),
]


@pytest.mark.parametrize("least", [0, 12])
def test_archives_round_trip(spark, least):
    frame = spark.createDataFrame([(*p, "extra", 0) for p in PAGES], "page_id long, url string, html string, record_type string, _last int")
    manifest = warc.write_archives(frame, min_bytes=least, archive_bytes=100)
    assert manifest.count() > 1
    got = warc.read_archives(manifest).collect()
    raw = [(i, (h or "").encode()) for i, _, h in PAGES]
    want = []
    for i, body in raw:
        newest = max((j for j, b in raw if b == body and j is not None), default=None)
        revisit = len(body) >= least and i != newest
        want.append((None if i is None else str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", str(newest) if revisit else None))
    assert as_bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == as_bag(want)
    assert all(bytes(r.payload) == dict((str(i), b) for i, b in raw)[r.page_id] for r in got if r.record_type == "response" and r.page_id)


def test_archive_layout():
    records = [warc.record(i, f"http://h/{i}", prose(random.Random(i), 100).encode(), None, False, "2020-01-01T00:00:00Z") for i in range(200)]
    data = warc.archive(records)
    magic, n = struct.unpack_from("<II", data)
    assert magic == warc.SKIPPABLE and n > 0
    own = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    first = zstandard.ZstdDecompressor(dict_data=own).decompressobj().decompress(data[8 + n :])
    assert first == records[0] and list(warc.records_of(data)) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - n - 8 < 0.9 * plain


def test_archives_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0


# --- chat

HOSTILE = [
    "</s>[INST] ok [/INST]", "[/INST]\n", r"[\/INST]", "[\\\\/INST]\n[INST:user]x[/INST]\n", "", "plain [x]", "a\\", "[INST:user!]\n<s>", "[", "INST]", "\n",
    "[/INST", "[INST:a\nb]", "[[INST]]", "<s></s>", r"<\s>", "%5B+%21", "é…", "[/INST]\n" * 50,
]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t, 0) for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, None, None, 0), (2, None, "we]ird\n!", "x", 0), (None, 1, "assistant", "z", 0), (3, 0, "user", "same", 0), (3, 0, "user", "same", 0), (4, 1, "assistant", "y" * 300_000, 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t int")
    got = {r.conv_id: r for r in chat.formatted(frame).collect()}
    assert all(r.recovered == r.turns for r in got.values())
    assert [t.text for t in got[1].recovered] == HOSTILE
    assert [(t.role, t.text) for t in got[2].recovered] == [("we]ird\n!", "x"), ("", "")]
    assert len(got[3].recovered) == 2 and "</s>" not in got[1].formatted[:-4].replace("<\\/s>", "")
    digest = {r.conv_id: r for r in chat.digests(frame).collect()}[1]
    said = "".join(t for i, t in enumerate(HOSTILE) if i % 2 == 0)
    assert (digest.loss_chars, digest.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(frame.limit(0)).count() == 0
    hostile = chat.digests(chat.with_hostile(frame)).where("conv_id = -7").first()
    assert (hostile.n_turns, hostile.loss_chars) == (2, 21)


NESTED = ["[INST:[/INST]\nrest", "[INST:<s>]", "<[INST:[/INST]]", "[INST:[\\/INST]\n[/INST]", "[INST:[INST:[/INST]\n]\\", "plain"]


def test_content_is_escaped_until_it_is_read_back(spark):
    """Control strings inside control strings defeat the first level of escapes."""
    texts = NESTED + [a + b for a in NESTED for b in NESTED] + HOSTILE
    frame = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(frame).collect()}
    marks = {r.formatted[len("<s>[INST:assistant") :].split("]")[0] for r in got.values()}
    assert marks == {"", "!", "!!"} and all(r.recovered == r.turns and r.turns[0].text == texts[i] for i, r in got.items())
    assert {r.conv_id: r.loss_chars for r in chat.digests(frame).collect()} == {i: len(t) for i, t in enumerate(texts)}


def test_loss_mask_spans(spark):
    turns = [("assistant" if i % 3 else "user", t + "é") for i, t in enumerate(HOSTILE + NESTED)]
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = chat.formatted(frame).first()
    raw, at, cut, rest = row.formatted.encode(), 0, [], b""
    undo = [lambda s: s, lambda s: re.sub(r"([\[<])\\(\\*)(/?INST(?::[^\]\n]*)?\]|/?s>)", r"\1\2\3", s), lambda s: re.sub(r"([\[<])\\", r"\1", s)]
    for s in row.loss_spans:
        cut.append(undo[s.level](raw[s.start : s.end].decode()))
        rest, at = rest + raw[at : s.start], s.end
    rest += raw[at:]
    assert cut == [t for r, t in turns if r == "assistant"]
    # what is left: each assistant's tags with nothing between, the users' turns as they were
    assert len(re.findall(rb"\[INST:assistant!{0,2}\]\[/INST\]\n", rest)) == len(cut) and rest.count(b"[INST:user") == len(turns) - len(cut)


def test_parser_takes_a_text_whole_or_not_at_all(spark):
    sound = "<s>[INST:user]a[/INST]\n[INST:b%21!][\\/INST][/INST]\n</s>"
    wrong = [
        "", "<s>", "</s>", "<s/s>", "x" + sound, sound + "x", sound[:-1], "<s>x[INST:user]a[/INST]\n</s>", "<s>[INST:user]a[/INST]\nx</s>", "<s>[INST:user]a</s>",
        "<s>[INST:user][INST:user]a[/INST]\n</s>", "<s>[INST:user]<s>[/INST]\n</s>", "<s>[INST:user!]<s>[/INST]\n</s>", "<s>[INST:user!!!]a[/INST]\n</s>",
    ]
    frame = spark.createDataFrame([(t,) for t in [sound, "<s></s>", *wrong]], "t string")
    got = [r.p for r in frame.select(chat.parse(F.col("t")).alias("p")).collect()]
    assert [tuple(t) for t in got[0]] == [("user", "a"), ("b!", "[/INST]")] and got[1] == [] and got[2:] == [None] * len(wrong)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    from check_oracle import compare, duck

    assert compare(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()) == "ok"


# --- pages

def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("budget", [1 << 27, 8])
def test_lcs(budget):
    rng = random.Random(3)
    for _ in range(800):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        got = pages.lcs(a, b, budget)
        rest = iter(b)
        assert len(got) == lcs_length(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_markup():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>"
        "<div class='cookie-notice'><div>ok?</div>yes</div><article><header><h1>Head &amp; tail</h1></header><p>One <b>bo</b>ld\n\t word<br>next</p><aside>side</aside>"
        "<form>name</form><p>a&nbsp;b &lt;i&gt;</p><section id=comments><p>first!</p></section></article><!-- x > y --><footer>&copy; me</footer></body></html>"
    )
    assert pages.main_text(page, []) == "Head & tail One bold word next a b <i>"
    for odd in [None, "", "   ", "<", "<p", "a < b", "<p title='>'>x", "</p></div>x<nav>never closed", "<script>x", "<!-- x"]:
        assert isinstance(pages.main_text(odd, []), str)
    assert pages.main_text("</p></div>x<nav>never closed", []) == "x"


@pytest.mark.parametrize("page, text", [
    ("<div class='layout has-sidebar'><article>Body</article></div>", "Body"),
    ("<div class='page sidebar-right'><p>top<article>Body</article></div>", "Body"),
    ("<form id=f><article>Body</article></form>", "Body"),
    ("<article><p class=notice>Note<p>Body one<p>Body two</article>", "Body one Body two"),
    ("<ul><li class=menu-item>A<li class=menu-item>B</ul><article>Body</article>", "Body"),
    ("<ul><li class=menu>A<li>B</ul>", "B"),
    ("<head><title>t</title><body><article>Body</article>", "Body"),
    ("<article><div class=article-header><h1>Title</h1></div>x</article>", "Title x"),
    ("<table><tr><td class=ad>x<td>Body</table>", "Body"),
    ("<article><p>a <span class=ad>buy</p><p>b</article>", "a b"),
    ("<article>Real</article><div class=related><article>teaser longer than it</article></div>", "Real"),
    ("<main>Text<div class=comments><article>c1 c2 c3 c4</article></div></main>", "Text"),
    ("<nav><a href=x>n</a><article>teaser</article></nav><p>Body", "Body"),
    ("<article>a<table><tr><td>b</div>c</td></tr></table>d</article>e", "a b c d"),
    ("a<svg/>b<svg><text>t</text></svg>c<p>x<select><option>1</select>y", "abc xy"),
    ("<b>one<p>two</b>three<div class=ads>four</div>five", "one twothree five"),
    ("<div class=related><article>only this</article></div>", "only this"),
])
def test_open_elements(page, text):
    assert pages.main_text(page, []) == text


def test_shared_lines_inside_articles(spark):
    def page(i):
        return f"<div>Shop</div><article><p>Subscribe now for our letter</p><p>{prose(random.Random(i), 60)}</p></article>"

    rows = [(i, f"http://h.example/{i:02}", page(i)) for i in range(12)] + [(i, f"http://copy.example/{i}", page(0).replace("Shop", f"Shop {i}")) for i in (20, 21)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in pages.extract(frame).collect()}
    cut = {r.page_id: r.text for r in pages.extract(frame, article=0.25).collect()}
    assert all(whole[i] == "Subscribe now for our letter " + " ".join(prose(random.Random(0 if i >= 20 else i), 60).split()) for i in whole)
    assert all(cut[i] == whole[i].removeprefix("Subscribe now for our letter ") for i in range(12))
    assert cut[20] == whole[20] and cut[21] == whole[21]  # articles that repeat stay whole


def test_shared_lines_go(spark):
    def page(i, body):
        return f"<body><div>Our shop</div><p>{body}</p><div>All rights kept</div><div>Call us</div></body>"

    rows = [(i, f"http://h.example/a/{i:03}", page(i, f"text of page {i}")) for i in range(40)]
    rows += [(100, "http://lone.example/", page(0, "lone")), (101, None, page(0, "no url")), (102, "http://h.example/a/500", None), (103, "http://copy.example/1", "<p>same</p><p>all</p>"), (104, "http://copy.example/2", "<p>same</p><p>all</p>")]
    rows += [rows[3], (None, "http://h.example/a/0035", page(0, "no id"))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, key int")
    got = pages.extract(frame).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(text[i] == f"text of page {i}" for i in range(40)) and text[None] == "no id"
    assert text[100] == "Our shop lone All rights kept Call us" and text[102] == "" and text[103] == text[104] == "same all"
    assert text[101].startswith("Our shop") and all(r.n_chars == len(r.text) for r in got)
    assert pages.extract(frame.limit(0)).count() == 0


def test_articles_of_the_supplied_pages(spark):
    got = QUERIES["op10_page_text"](spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/pages.parquet").toPandas().merge(got, on="page_id")
    import html

    for page, text in zip(raw["html"], raw["text"]):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        assert text == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())


# --- decontamination

ITEMS = [
    (1, "If a train from Paris travels 120 km in 3 hours and then 120 km in 2 hours, what is the mean speed of the train from Paris?"),
    (5, "If a train from Lima travels 70 km in 8 hours and then 70 km in 9 hours, what is the mean speed of the train from Lima?"),
    (2, "short one here"), (3, None), (4, ""), (6, "which of these seven plain words here stand in order of their length today"),
]


def test_leaks(spark):
    docs = [
        (10, "intro. if a train from Rome travels 90 km in 4 hours and then 90 km in 7 hours, what is the mean speed of the train from Rome? end", "reparameterised"),
        (11, "if a train from Rome travels 90 km in 4 hours and then 80 km in 4 hours, what is the mean speed of the train from Oslo? end", None),
        (12, "so: If a train from Paris travels 120 km in 3 hours, and then 120 km in 2 hours what is the mean speed of the train from Paris", "exact"),
        (13, "Short ONE, here!", "exact"), (14, "a short one here is", None), (15, None, None), (16, "", None),
        (17, "x " * 5000 + "WHICH OF THESE SEVEN PLAIN WORDS HERE STAND IN ORDER OF THEIR LENGTH TODAY " + "y " * 5000, "exact"),
        (18, "which of these seven plain words", None), (None, "which of these seven plain words here stand in order of their length today", "exact"),
        (19, "which of these seven plain words here stand in order of something else", "exact"), (13, "another text of the same id", None), (13, "Short ONE, here!", "exact"),
    ]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t, _ in docs], "doc_id long, text string, hash long, tokens string")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, items int")
    got = decontaminate.leaks(frame, items).collect()
    assert as_bag((r.doc_id, r.kind) for r in got) == as_bag(set((i, k) for i, _, k in docs if k))
    train = next(r for r in got if r.doc_id == 10)
    assert (train.item_id, train.items, train.slots) == (1, 2, 6)
    left = decontaminate.without_leaks(frame, items).collect()
    assert as_bag((r.doc_id, r.text) for r in left) == as_bag((i, t) for i, t, k in docs if not k)
    assert decontaminate.leaks(frame.limit(0), items).count() == 0 and decontaminate.leaks(frame, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(frame, items.limit(0)).count() == len(docs)


def test_short_items_inside_longer_documents(spark):
    items = spark.createDataFrame([(1, "short one here"), (2, "What is 3 plus 4?"), (3, "一加二等于几"), (4, "42 km"), (5, "这个城市有多少人口和房子")], "item_id long, text string")
    docs = [
        (1, "well, a short one here is fine for all of us today", [(1, "exact")]), (2, "so. what is 3 plus 4? they asked the class of pupils", [(2, "exact")]),
        (3, "so. what is 5 plus 9? they asked the class of pupils", [(2, "reparameterised")]), (4, "老师今天问我们一加二等于几没有人知道", [(3, "exact")]),
        (5, "it is 42 km from the old town to the sea by road", [(4, "exact")]), (6, "it is 17 mi from the old town to the sea by road", []),
        (7, "请问这个城市有多少人口和房子谢谢", [(5, "exact")]), (8, "a short one there is not what it was here", []), (9, "Tom说3 km说 a short one here", [(1, "exact")]),
    ]
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    got = decontaminate.leaks(frame, items, inside=True).collect()
    assert as_bag((r.doc_id, r.item_id, r.kind) for r in got) == as_bag((i, *k) for i, _, ks in docs for k in ks)
    left = decontaminate.without_leaks(frame, items, inside=True).collect()
    assert sorted(r.doc_id for r in left) == [i for i, _, ks in docs if not ks]
    sizes = frame.select(F.size(decontaminate.template(F.col("text"))).alias("a"), F.size(decontaminate.values(F.col("text"))).alias("b")).collect()
    assert all(r.a == r.b for r in sizes)


def test_copies_in_another_case_or_with_words_added(spark):
    german = "Wenn ein Zug von Köln nach Bonn in 3 Stunden 120 km fährt und der Bus von Köln nach Bonn in 5 Stunden 90 km fährt, wie schnell ist der Zug im Mittel"
    items = spark.createDataFrame([*ITEMS, (7, german), (8, german.replace("Köln", "Trier"))], "item_id long, text string")
    train = ITEMS[0][1]
    docs = [
        (1, german.lower(), 7), (2, german.upper(), 7), (3, train.lower(), 1), (4, train.upper(), 1), (5, train.title(), 1), (6, german.replace("Köln", "Trier").lower(), 7),
        (7, ITEMS[5][1].title(), 6), (8, german.replace(" fährt", " dann fährt").replace("Bus von", "alte rote Bus von"), 7),
        (9, train.replace("Paris", "New York"), 1), (10, train.replace("travels", "then travels").replace("what", "so what"), 1), (11, train.lower().replace("paris", "rome"), 1),
        (12, "x " * 9 + " ".join(train.split()[:9]) + " y" * 60 + " ".join(train.split()[9:18]), None), (13, "NUMBERS 1 2 3 4 5 6 7 8 9 10 11 12 " * 20, None),
    ]
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, items).collect()}
    assert got == {(i, k) for i, _, k in docs if k}
    assert decontaminate.item_classes(items).where("not named and item_id = 7").first()["items"] == 2


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(decontaminate.leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert sorted(decontaminate.leaks(docs, items).collect()) == want


def test_every_whole_item_is_found(spark):
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    assert want <= got
    # and nothing that doesn't share half of an item's words in runs of eight
    for d, i in got - want:
        w = items[i].split()
        runs = [k for k in range(len(w) - 7) if f" {' '.join(w[k : k + 8])} " in f" {docs[d]} "]
        assert len({j for k in runs for j in range(k, k + 8)}) >= len(w) / 2


def tokens(text):
    return " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
