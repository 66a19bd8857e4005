import base64
import hashlib
import zlib

import numpy as np
import pytest

from remarq.llm import flac, main_text, warc_zip


def padded(data):
    n = max(1, -(-len(data) // flac.FRAME)) * flac.FRAME
    return data + b"\xff" * (n - len(data))


TEXTS = [b"", b"a", b"abc" * 400, bytes(range(256)) * 9, np.random.default_rng(1).bytes(5000), b"\xff" * 577, b"the cat sat on the mat. " * 100, bytes([0, 255] * 900), np.random.default_rng(2).bytes(576 * 70)]


def test_streams_are_lossless_and_seekable():
    streams = flac.encode_payloads(TEXTS)
    assert flac.decode_payloads(streams) == [padded(t) for t in TEXTS]
    long = padded(TEXTS[-1])
    stream = flac.Stream(streams[-1])
    for a, b in ((0, 1), (575, 577), (1000, 30000), (len(long) - 3, len(long))):
        assert stream.read(streams[-1], a, b) == long[a:b]
    assert flac.encode_payloads([TEXTS[2]])[0] == streams[2]


def test_damage_is_found():
    stream = flac.encode_payloads([b"the cat sat on the mat. " * 100])[0]
    for at in (-1, -50, -600, 60):
        bad = bytearray(stream)
        bad[at] ^= 4
        if bytes(bad) == stream:
            continue
        try:
            assert flac.decode_payloads([bytes(bad)]) == [padded(b"the cat sat on the mat. " * 100)]  # only a seek point's padding could be harmless
        except (ValueError, IndexError, struct_error):
            pass
        else:
            assert at == 60


struct_error = zlib.error


def test_a_frame_with_lpc_and_partitions():
    """Written bit by bit: LPC of order 2 with coefficients 2 and -1, two Rice partitions, one of them escaped."""
    x = np.clip(np.cumsum(np.random.default_rng(0).integers(-2, 3, flac.FRAME)), -100, 100).astype(int)
    bits = []

    def put(value, n):
        bits.extend(int(b) for b in format(value & ((1 << n) - 1), f"0{n}b"))

    put(0, 1), put(33, 6), put(0, 1)
    for v in x[:2]:
        put(int(v), 8)
    put(3 - 1, 4), put(0, 5), put(2, 3), put(-1, 3)
    residual = [int(x[i] - (2 * x[i - 1] - x[i - 2])) for i in range(2, flac.FRAME)]
    put(0, 2), put(1, 4)
    half = flac.FRAME // 2 - 2
    put(1, 4)
    for r in residual[:half]:
        u = 2 * r if r >= 0 else -2 * r - 1
        bits.extend([0] * (u >> 1) + [1]), put(u & 1, 1)
    put(15, 4), put(10, 5)
    for r in residual[half:]:
        put(r, 10)
    body = np.packbits(bits).tobytes()
    head = b"\xff\xf8\x24\x02\x00"
    crc = 0
    for b in head:
        crc = int(flac.CRC8[crc ^ b])
    frame = head + bytes([crc]) + body
    crc = 0
    for b in frame:
        crc = ((crc << 8) & 0xFFFF) ^ int(flac.CRC16[(crc >> 8) ^ b])
    data = np.frombuffer(frame + crc.to_bytes(2, "big"), np.uint8)
    samples, ends = flac.decode_frames(data, np.array([0]))
    assert samples[0].tolist() == x.tolist() and ends.tolist() == [len(data)]


def test_media_columns(spark):
    rows = [(1, "été " * 300, 0), (2, None, 0), (3, "", 0), (1, "été " * 300, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = flac.from_media(flac.to_media(df)).collect()
    assert len(got) == 4
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id).encode()
        p = padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got}) == 2
    assert flac.from_media(flac.to_media(df.limit(0))).count() == 0


def want_records(rows):
    largest = {}
    for k, _, h in rows:
        if k is not None:
            largest[(h or "")] = max(largest.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        body = (h or "").encode()
        first = largest.get(h or "")
        revisit = k is not None and first != k
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u r\nl", None), (4, "é", ""), (5, "q", "long " * 99999), (None, "n", "x"), (7, "z", "a\r\n\r\nb é"), (7, "z", "a\r\n\r\nb é")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, refers_to string")
    found = warc_zip.read_archives(warc_zip.write_archives(df), with_payload=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == want_records(rows)
    assert {bytes(r.payload).decode() for r in found if r.record_type == "response"} == {h or "" for _, _, h in rows}
    assert warc_zip.round_trip(df.limit(0)).count() == 0


def test_zip64_directories_are_followed(tmp_path):
    import struct
    import zipfile

    from pyarrow import fs

    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("archive/a", "w", force_zip64=True) as f:
            f.write(b"first member")
        z.writestr("b", b"second")
    data = path.read_bytes()
    at = data.rfind(b"PK\x05\x06")
    entries, length, start = struct.unpack_from("<HII", data, at + 10)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, length, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path.write_bytes(data[:at] + end64 + locator + end)
    directory = warc_zip.ZipDirectory(fs.LocalFileSystem().open_input_file(str(path)))
    assert directory.read("archive/a") == b"first member" and directory.read("b") == b"second"


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies to serve you well.</div>
%s<div class="sidebar"><p>Read more about other things that happened elsewhere today.</p></div>
<div id="comments"><p>I liked this article very much, thank you for writing all of it.</p></div><form><label>Your mail</label></form><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>A title</h1><p><b>First &amp; long paragraph</b> of the\n text, with words.<br><p>Short.</p><p>Another long paragraph that ends it.</article>",
        '<div class="post-body"><h1>A title</h1><p>First &amp; long paragraph of the text, with words.</p><p>Short.</p><p>Another long paragraph that ends it.</div>',
    ],
)
def test_main_text(body):
    assert main_text.main_text(PAGE % body) == "A title First & long paragraph of the text, with words. Short. Another long paragraph that ends it."


def test_names_of_what_stands_around():
    around = ["ad", "ad-box", "top_ads", "siteHeader", "pageFooter", "cookie-banner", "reader-comments", "sidebar1", "main-nav", "ad123", "notice"]
    assert all(map(main_text.marked, around))
    assert not any(map(main_text.marked, ["", "article-header", "post_title", "adjacent", "content", "badge", "shadow", "headline", "commentary"]))


def test_main_text_of_odd_pages(spark):
    assert main_text.main_text("just text &lt;b&gt;") == "just text <b>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 500), (4, "u", "<nav>menu</nav>"), (4, "u", "<p>One\n  line</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text.extract(df).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "", 0), (4, "One line", 8)]
    assert main_text.extract(df.limit(0)).count() == 0


LONG = "A long paragraph of the text, with words that go on and on, so that nobody takes it for a menu."


@pytest.mark.parametrize("begin", ["<body><p>", "<p>", "", "<body><div><h1></h1><p>"])
def test_a_head_without_its_end(begin):
    assert main_text.main_text(f"<html><head><title>T</title><meta name=a><noscript><img src=x></noscript>{begin}{LONG}") == LONG
    assert main_text.main_text(f"<html><head><title>T</title></head>{begin}{LONG}") == LONG


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class=no-sidebar", "div class=with-footer", "div class=search-results", "div class=topic-legal", "div class='post social'", "form", "div id=sidebar-layout"])
def test_a_marked_wrapper_holds_the_article(wrapper):
    tag = wrapper.split()[0]
    page = f"<body><nav>Home</nav><{wrapper}><p>{LONG}</p><p>Short.</p><div class=sidebar>Other</div><p>{LONG}</p></{tag}><footer>End</footer>"
    assert main_text.main_text(page) == f"{LONG} Short. {LONG}"


@pytest.mark.parametrize("name", ["comments", "cookie-banner", "related", "post-comments", "newsletter"])
def test_long_parts_around_the_article_stay_out(name):
    part = f"<div class={name}>" + f"<p>{LONG}</p>" * 3 + "</div>"
    assert main_text.main_text(f"<body><article><h1>Head</h1><p>{LONG}</p></article>{part}") == f"Head {LONG}"
    assert main_text.main_text(f"<body>{part}") == ""


@pytest.mark.parametrize(
    "body",
    [
        "<main><article>{a}</article><section>{b}</section></main>",
        "<div class=entry><div>{a}</div><div>{b}</div></div>",
        "<div class=entry><div>{b}</div><div>{a}</div></div>",
        "<article>{a}</article><nav>Menu</nav><article>{b}</article>",
    ],
)
def test_an_article_in_sibling_containers(body):
    a = [f"First {i} {LONG}" for i in range(6)]
    b = [f"Second {LONG}", "Short.", f"Third {LONG}"]
    page = "<body><div><a>Home</a> <a>News</a> <a>About</a></div>" + body.format(a="".join(f"<p>{x}</p>" for x in a), b="".join(f"<p>{x}</p>" for x in b)) + "<div><a>Terms</a> <a>Contact</a></div>"
    assert main_text.main_text(page) == " ".join(a + b if body.index("{a}") < body.index("{b}") else b + a)


def test_stored_media_and_pcm_blocks(spark, tmp_path):
    rows = [(i, (None, "", "abc é " * (50 * i), "x" * 1500)[i % 4]) for i in range(12)] + [(2, "abc é " * 100)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, media string").repartition(2)
    direct = sorted(map(tuple, flac.from_media(flac.to_media(df)).collect()))
    assert sorted(map(tuple, flac.round_trip(df).collect())) == direct
    index = flac.write_media(df, f"file://{tmp_path}/media")
    assert index.select("uri").distinct().count() == 2  # one a partition
    media = flac.read_media(index)
    assert sorted(map(tuple, flac.from_media(media).collect())) == direct
    long = spark.createDataFrame([(1, "0123456789" * 200_000), (2, "short")], "doc_id long, text string")
    flac.pcm_blocks(flac.to_media(long)).write.parquet(f"{tmp_path}/pcm")
    blocks = spark.read.parquet(f"{tmp_path}/pcm")
    whole = padded(b"0123456789" * 200_000)
    assert blocks.where("doc_id = 1").count() == -(-len(whole) // flac.PCM_BLOCK) == 2
    for a, b in ((0, 9), (flac.PCM_BLOCK - 5, flac.PCM_BLOCK + 5), (len(whole) - 3, len(whole) + 9)):
        assert flac.read_samples(blocks, 1, a, b) == whole[a:b]
    assert flac.read_samples(blocks, 3, 0, 9) == b""
    assert flac.round_trip(df.limit(0)).count() == 0


def without_table(stream, every=None):
    """The stream with every so many seek points, or with no seek table."""
    info, size = stream[: 4 + 38], int.from_bytes(stream[4 + 38 + 1 : 4 + 38 + 4], "big")
    table, rest = stream[46 : 46 + size], stream[46 + size :]
    if every is None:
        return b"fLaC" + bytes([0x80]) + info[5:] + rest
    points = b"".join(table[i : i + 18] for i in range(0, len(table), 18 * every)) + b"\xff" * 18
    return info + b"\x83" + len(points).to_bytes(3, "big") + points + rest


def test_thin_and_missing_seek_tables_are_walked():
    for text in TEXTS[2:]:
        (stream,) = flac.encode_payloads([text])
        for every in (None, 1, 2, 7):
            other = without_table(stream, every)
            assert flac.decode_payloads([other, stream]) == [padded(text)] * 2
            assert flac.Stream(other).read(other, 3, 500) == padded(text)[3:500]


def test_lpc_subframes_are_written_where_they_are_shortest():
    wave = (100 * np.sin(np.arange(flac.FRAME * 3) / 2)).astype(np.int8)
    (stream,) = flac.encode_payloads([(wave.view(np.uint8) ^ 128).tobytes()])
    found = flac.Stream(stream)
    assert {stream[at + 6] >> 1 for at in found.offsets} == {31 + flac.LPC_ORDER}
    assert len(stream) < 0.6 * len(wave) and flac.decode_payloads([stream]) == [(wave.view(np.uint8) ^ 128).tobytes()]
