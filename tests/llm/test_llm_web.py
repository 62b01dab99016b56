"""WARC round trips with damage, and main text of pages."""

import hashlib
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import html_text, warc


def pages():
    big, other = "<p>" + "é same page " * 40 + "</p>", "<p>" + "x" * 100 + "</p>"
    rows = [(3, "http://a/ b\r\nc", big), (1, "http://b", big), (2, None, big), (7, "http://c", None), (8, "http://d", ""),
            (9, "u", "<p>short</p>"), (10, "u", "<p>short</p>"), (11, "u", other), (11, "u", other), (None, "n", big),
            (12, "u", "WARC/1.0\r\nWARC-Type: response\r\n\r\n" * 9), (13, "u", "y" * 300_000)]
    return [(*r, "clash", "d", 1) for r in rows]


SCHEMA = "page_id bigint, url string, html string, payload string, digest string, refers_to int"


def plain_records(rows):
    first = {}
    for i, _, h, *_ in rows:
        d = (h or "").encode()
        if len(d) >= 100 and i is not None:
            first[d] = min(first.get(d, i), i)
    out = Counter()
    for i, _, h, *_ in rows:
        d = (h or "").encode()
        to = first.get(d, i) if len(d) >= 100 else i
        to = None if to == i else to
        out[i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if to is not None else "response", to] += 1
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    got = warc.archive_and_read(df).collect()
    assert not [r for r in got if r.record_type == "quarantined"]
    number = lambda urn: None if urn in (None, "<urn:page:>") else int(urn[10:-1])
    records = Counter()
    for r in got:
        if r.record_type in ("response", "revisit"):
            assert r.record_type == "revisit" or (hashlib.sha256(r.payload).hexdigest() == r.payload_digest
                                                  and len(r.payload) == r.payload_length)
            records[number(r.record_id), r.payload_length, r.payload_digest, r.record_type, number(r.refers_to)] += 1
    assert records == plain_records(pages())
    assert Counter(r.target_uri for r in got)["http://a/%20b%0D%0Ac"] == 1


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def records(n):
    return [warc.page_record(i, f"http://h/{i}", f"<p>page {i} {'z' * (i * 37 % 500)}</p>".encode(),
                             hashlib.sha256(b"").hexdigest(), None) for i in range(n)]


def found(data):
    out = list(warc.read_archive(data))
    good = [x.headers["warc-record-id"] for _, _, x in out if isinstance(x, warc.Record)]
    gaps = [(x.offset, x.length, x.reason) for _, _, x in out if isinstance(x, warc.Gap)]
    return good, gaps


def urns(numbers):
    return [f"<urn:page:{i}>" for i in numbers]


def test_damage_in_plain_files():
    parts = records(6)
    at = [sum(map(len, parts[:i])) for i in range(7)]
    data = bytearray(b"".join(parts))
    assert found(bytes(data)) == (urns(range(6)), [])
    data[at[2] + len(parts[2]) - 20] ^= 1                                   # in the block: the digest fails
    assert found(bytes(data)) == (urns([0, 1, 3, 4, 5]), [(at[2], len(parts[2]), "wrong block digest")])
    cut = b"".join(parts)[: at[5] + 50]                                      # the last record's header ends early
    assert found(cut) == (urns(range(5)), [(at[5], 50, "header without end")])
    lost = b"".join(parts[:2]) + parts[2][:60] + b"garbage" + b"\r\n" + b"".join(parts[3:])
    good, gaps = found(lost)
    assert good == urns([0, 1, 3, 4, 5]) and [g[:2] for g in gaps] == [(at[2], 69)]
    assert found(b"nothing here") == ([], [(0, 12, "no version line")])
    assert found(b"") == ([], [])


def test_damage_in_gzip_files():
    parts = [warc.gzip_member(r) for r in records(8)]
    at = [sum(map(len, parts[:i])) for i in range(9)]
    whole = b"".join(parts)
    assert found(whole) == (urns(range(8)), [])
    for victim in (0, 3, 7):
        for place in (1, 12, len(parts[victim]) // 2, len(parts[victim]) - 5):
            data = bytearray(whole)
            data[at[victim] + place] ^= 0x55
            good, gaps = found(bytes(data))
            if not gaps:      # a header byte that no check covers
                assert good == urns(range(8)) and place < 12
                continue
            assert good == urns(i for i in range(8) if i != victim)
            assert [g[:2] for g in gaps] == [(at[victim], len(parts[victim]))]
    good, gaps = found(whole[:at[3]] + whole[at[3] + 7:at[5] + 9] + whole[at[6]:])   # bytes lost twice
    assert good == urns([0, 1, 2, 4, 6, 7]) and len(gaps) == 2
    good, gaps = found(whole[:-3])
    assert good == urns(range(7)) and gaps == [(at[7], len(parts[7]) - 3, "truncated gzip member")]
    bad = bytearray(records(1)[0])
    bad[-30] ^= 1
    mixed = warc.gzip_member(bytes(bad) + records(3)[2])       # a sound member with one bad record
    good, gaps = found(parts[0] + mixed + parts[1])
    assert good == urns([0, 2, 1]) and gaps[0][:2] == (at[1], len(mixed)) and "wrong block digest" in gaps[0][2]
    assert found(parts[0] + zlib.compress(b"x" * 50) + parts[1])[0] == urns([0, 1])


def test_damage_at_the_head_of_a_plain_file():
    parts = records(6)
    inner = warc.page_record(9, "http://z", zlib.compress(b"a page " * 50, wbits=31), hashlib.sha256(b"").hexdigest(), None)
    assert warc.MAGIC in inner
    for head in (b"XXXX", warc.MAGIC + b"\0"):
        data = head + parts[0][4:] + parts[1] + inner + b"".join(parts[2:])
        good, gaps = found(data)
        assert good == urns([1, 9, 2, 3, 4, 5]) and [g[:2] for g in gaps] == [(0, len(parts[0]))]
    packed = warc.gzip_member(parts[3])
    good, gaps = found(b"X" + b"".join(parts[:2])[1:] + packed + b"lost\r\n" + parts[4])   # the nearest of both kinds
    assert good == urns([1, 3, 4]) and [g[:2] for g in gaps] == [(0, len(parts[0])), (len(parts[0] + parts[1] + packed), 6)]


def test_damage_in_members_of_many_records():
    parts = records(300)
    whole = warc.gzip_member(b"".join(parts))
    after = warc.gzip_member(records(302)[301])
    assert found(whole + after) == (urns([*range(300), 301]), [])
    for cut in (len(whole) // 3, len(whole) // 2, len(whole) - 40):
        n = zlib.decompressobj(31).decompress(whole[:cut])
        kept = 0
        while len(b"".join(parts[:kept + 1])) <= len(n):
            kept += 1
        assert 0 < kept < 300
        good, gaps = found(whole[:cut])                         # truncated
        assert good == urns(range(kept)) and len(gaps) == 1
        assert gaps[0][0] + gaps[0][1] == cut and 0 < gaps[0][0] <= cut and gaps[0][2] == "truncated gzip member"
        for data in (whole[:cut] + after, whole[:cut] + b"\xff" * 64 + whole[cut + 64:] + after):
            good, gaps = found(data)                            # damaged
            assert good[:kept] == urns(range(kept)) and good[-1] == urns([301])[0] and gaps
    for data in (whole[:-5] + b"!!" + whole[-3:] + after, whole[:-8]):    # only the check is wrong or missing
        good, gaps = found(data)
        assert good[:300] == urns(range(300)) and (len(gaps) == 1 and gaps[0][1] <= 12 or not gaps)


def test_wrong_check_of_records_without_digest():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    member = bytearray(warc.gzip_member(record % 1 + record % 2))
    assert found(bytes(member)) == (urns([1, 2]), [])
    assert found(bytes(member[:-12]))[0] == urns([1])
    member[-6] ^= 1
    assert found(bytes(member)) == ([], [(0, len(member), "damaged gzip member")])


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<script>var a = '<p>no</p>';", ""),
    ("<article><h1>Title</h1><p>One &amp; two&nbsp;&#233;<br>three\n four</p><p>Te.</p></article>",
     "Title\nOne & two é three four\nTe."),
    ("<article><p>a &amp;lt; b</p></article>", "a &lt; b"),
    ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy the best of all</div><article><p>Text</p>"
     "<div class='comments'><p>I like it and the rest of it</p></div><form><p>Sign up</p></form></article>"
     "<footer>&copy; me</footer>", "Text"),
    ("<div class='cookie-notice'>We use the cookies</div><main><header><h2>Head</h2><p>by line</p></header><p>Body</p>"
     "<aside>Side</aside></main><section id='comments'><article><p>first!</p></article></section>", "Head\nBody"),
    ("<article><p>open <b>bold<p>next<!-- gone --> one</article><p>after", "open bold\nnext one"),
    ("<nav><a href='x'>left open<article><p>Still there</p></article>", "Still there"),
    ("<article title=\"a > b\"><p>ok</p><style>p{}</style><textarea>typed</textarea></article>", "ok"),
])
def test_pages(page, text):
    assert html_text.main_text(page or "") == text


@pytest.mark.parametrize(("page", "text"), [
    ("<body style='overflow-x:hidden'><article><p>Text</p></article></body>", "Text"),
    ("<main data-state=\"hidden\" style=overflow:hidden><p>Text</p></main>", "Text"),
    ("<article data-hidden='false' data-id='sidebar' data-class='ad'><p>Text</p></article>", "Text"),
    ("<main><div data-role='navigation' title='a hidden class=menu'><p>Text</p></div></main>", "Text"),
    ("<body hidden><main aria-hidden=true><p>Text</p><p HIDDEN>no</p><div aria-hidden='true'>no</div></main>", "Text"),
    ("<article><p>Text</p><div id=a class='x' hidden=''><p>no</p></div><div\tROLE='Search'>no</div></article>", "Text"),
    ("<div class='content has-sidebar'><article><p>Text</p></article></div>", "Text"),
    ("<div class='page-with-menu noWidgets'><main><p>Text</p></main></div>", "Text"),
    ("<main><div class='wrap sidebar-right'><article><p>Text</p></article></div></main>", "Text"),
    ("<div class='comments-open'><main><p>Text</p></main></div>", "Text"),
    ("<article><p>Text</p><div class=widget><article><p>no</p></article></div></article>", "Text"),
    ("<article><p>Text</p></article><div class=widget><div class=comments><article><p>no</p></article></div></div>", "Text"),
    ("<article><p>Text</p></article><div class=widget><aside><article><p>no</p></article></aside></div>", "Text"),
])
def test_attributes_by_name_and_articles_in_wrappers(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<svg-icon name=x></svg-icon><article><p>Text</p></article>", "Text"),
    ("<article><title-block><p>Head</p></title-block><p>Text</p><button-group>b</button-group></article>", "Head\nText\nb"),
    ("<video-js></video-js><article><p>Text</p></article><video>no</video>", "Text"),
    ("<div><button class=x>Menu</div><article><p>Text</p></article>", "Text"),
    ("<body><button>Menu<article><p>Text</p></article><button>no</button>", "Text"),
    ("<article><p>One <span><select><option>no<option>no</span> two</p><p>Text</p></article>", "One two\nText"),
    ("<article><div><object><p>no</p><audio>no</div><p>Text</p><canvas>no</article>", "Text"),
    ("<article><p>a <a href=x><svg><path d=x></a> b</p><p>Text</p></article>", "a b\nText"),
    ("<head><title>no<meta name=x></head><body><article><p>Text</p><svg><title>no</title></svg></article>", "Text"),
    ("<title>no <script> no</title><article><p>Text</p></article>", "Text"),
    ("<article><svg><g><svg>no</svg>no</g></svg><p>Text<button><b>no</b><p>no</p></button> end</p></article>", "Text end"),
    ("<template><article><p>no</p></article></template><article><p>Text</p><script>no</p></article>", "Text"),
    ("<article><p>Text</p><svg/><p>More</p><TEXTAREA>no</p></article>", "Text\nMore"),
])
def test_dropped_elements(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<article data-page=\"{'a > b ' * 2000}\"><p>Text</p></article><p>no</p>", "Text"),
    (f"<article><div class=sidebar data-props='{'{}> ' * 2000}'>no</div><p>Text</p></article>", "Text"),
    (f"<article><div><nav style=\"{'x' * 5000}\">no</nav></div><p>Text</p></article>", "Text"),
    (f"<article><p>Text <img src=\"data:{'A' * 99999}>\"> end</p></article>", "Text end"),
    (f"<article><p><a title='{'y' * 5000}' href=/x>Read it all here</a></p><p>{'Text and more of it in the end. ' * 9}</p></article>",
     ("Text and more of it in the end. " * 9).strip()),
    ("<article class=it's><p>He said it's</p><p>Text</p></article>", "He said it's\nText"),
    ("<article><p title=\"a><b>Text</b></p><p>More</p></article>", "Text\nMore"),
    ("<article><div class=sidebar title='a>no</div><p>Text</p></article>", "Text"),
    ("<article><p alt = \"a>b\" title=a\"b>Text</p></article>", "Text"),
])
def test_quoted_values(page, text):
    assert html_text.main_text(page) == text


LINK = "<p><a href=x>Read more of this</a></p>"
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 4


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><h1>Title</h1><p>One</p>{LINK}<p>Two</p></article>", "Title\nOne\nTwo"),
    (f"<article><p>{POLISH}</p><p>{POLISH}</p>{LINK}</article>", f"{POLISH.strip()}\n{POLISH.strip()}"),
    (f"<article>{LINK}<p>{POLISH}</p>{LINK}</article>", POLISH.strip()),
    (f"<article>{LINK}<p>|</p>{LINK}<p>One</p><p>Two</p><p>Three</p><p>Four</p></article>", "One\nTwo\nThree\nFour"),
    (f"<article>{LINK}<p>One</p><p>Two</p><p>Three</p><p>Four</p>{LINK}</article>", "One\nTwo\nThree\nFour"),
])
def test_links_in_articles_reject_little(page, text):
    assert html_text.main_text(page) == text


def test_main_text_beside_articles():
    prose = ("It is the way of all the things that they are and were in the world, and so it will be for us. " * 3).strip()
    card = "<article><h3><a href=x>Some other page</a></h3></article>"
    page = f"<div><h1>Title</h1><p>{prose}</p><p>{prose}</p></div>{card * 3}"
    assert html_text.main_text(page) == f"Title\n{prose}\n{prose}"
    page = f"<article><h1>Title</h1><p>{prose}</p><p>{prose}</p></article><div>{prose}</div>"
    assert html_text.main_text(page) == f"Title\n{prose}\n{prose}"


def test_pages_without_an_article_go_by_their_words():
    prose = "It is the way of all the things that they are and were in the world, and so it will be for us. " * 3
    page = (f"<body><div><a href='/1'>Home of the best</a> <a href='/2'>About</a></div><div><h1>A title</h1><p>{prose}</p>"
            f"<p>Short one.</p><p>{prose}</p></div><div>Copyright 2020 Acme</div><div><a href='/3'>Imprint and the rest</a></div></body>")
    blocks = html_text.main_blocks(page)
    assert blocks[-3:] == [prose.strip(), "Short one.", prose.strip()] and len(blocks) <= 4


def test_extracts_whole_table(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (2, None, None), (1, "u", "<article><p>a</p></article>"), (None, "v", "<p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = Counter(map(tuple, html_text.extract_text(df).collect()))
    assert got == Counter([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0)])
