"""Main text of pages, and AVI storage and shots: built pages, round trips and planted cuts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tracelake.llm import html_text, media

PAGES = "page_id long, url string, html string, host string, pkey string"


def text_of(spark, html, url="http://h.example/a", n=1):
    return html_text.main_text(spark.createDataFrame([(i, url, html, "c", "c") for i in range(n)], PAGES)).collect()[0]["text"]


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("plain  words\n here", "plain words here"),
        ("<article><h1>A &amp; B</h1><p>one<br>two</p>\n<p>three <b>bold</b>&nbsp;x</p></article><footer>no</footer>", "A & B\none two\nthree bold x"),
        ("<body><nav>menu</nav><div class='side ad'>buy</div><main><p>text<p>more<ul><li>a<li>b</ul></main><aside>s</aside></body>", "text\nmore\na\nb"),
        ("<article><p>kept</p><section id=comments><p>reader</p></section><form>f<input value='x'></form><script>var a='</p>';</script><style>p{}</style></article>", "kept"),
        ("<article><header><h1>Title</h1></header><p>x &lt;tag&gt; &#233; &eacute; &bogus;</p></article>", "Title\nx <tag> é é &bogus;"),
        ("<article><p>broken <a href='x>y</p><p>next", "broken next"),
        ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</table></article>", "a b\nc"),
        ("<p>a<!-- hidden --><p>b<!-- open", "a\nb"),
        ("<ARTICLE><P>Upper</P><div class=\"cookie-notice\">ok?</div></ARTICLE>", "Upper"),
    ],
)
def test_pages(spark, html, want):
    got = text_of(spark, html)
    if "href='x>y" in (html or ""):  # an unclosed quote: whatever is kept, it holds the text before
        assert got.startswith("broken")
    else:
        assert got == want


def test_templates_of_a_host_go(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(40):
        host, body = ("one.example", "two.example")[i % 2], " ".join(word() for _ in range(20))
        box = f"<div><p>About {host}</p><p>Contact us</p></div>"
        rows.append((i, f"https://{host}/p{i}", f"<body>{box}<p>{body}</p><div><span>{word()}</span></div></body>", "c", "c"))
        want[i] = body
    rows.append((100, None, "<p>alone</p>", "c", "c"))
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i]["text"].split("\n")[0] == want[i] and "Contact" not in got[i]["text"] for i in want)
    assert got[100]["text"] == "alone" and got[100]["n_chars"] == 5 and got[100]["url"] is None


def test_pages_of_one_id_and_none(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "c", "c"), (1, "u", "<p>b</p>", "c", "c"), (1, "u", "<p>b</p>", "c", "c"), (None, "u", "<p>d</p>", "c", "c")], PAGES)
    assert sorted(r["text"] for r in html_text.main_text(df).collect()) == ["a", "b", "b", "d"]
    assert html_text.main_text(df.where("false")).count() == 0


# media


def test_files_of_several_riff_chunks_and_rec_lists():
    payload = np.random.default_rng(1).integers(0, 256, 6 * 576, dtype=np.uint8).tobytes()
    frames, fps = media.read_avi(media.store(payload))
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    rec = chunk(b"LIST", b"rec " + b"".join(chunk(b"00dc", f) for f in frames[2:4]))
    more = chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + rec + chunk(b"01wb", b"sound") + chunk(b"00dc", frames[4]))) + chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + chunk(b"00db", frames[5])))
    first = media.store(payload[: 2 * 576])
    assert media.read_avi(first + more) == (frames, fps) and len(frames) == 6
    assert media.read_avi(first + more[:-5])[0][:5] == frames[:5]  # cut off in the last frame


@pytest.mark.parametrize("n", [1, 2, 50, media.BLOCK + 3])
def test_storage_keeps_every_byte(n):
    data = np.random.default_rng(n).integers(0, 256, n * 576, dtype=np.uint8).tobytes()
    stored = media.store(data)
    assert media.load(stored) == data
    frames, fps = media.read_avi(stored)
    assert len(frames) == n and fps == media.FPS


def test_stored_frames_are_real_jpeg():
    """The general decoder reads the same coefficients from a stored frame as the fast path, through the Huffman tables."""
    data = np.random.default_rng(3).integers(0, 256, 3 * 576, dtype=np.uint8)
    frames, _ = media.read_avi(media.store(data.tobytes()))
    for frame, unit in zip(frames, data.reshape(3, 576)):
        levels, quant, shape = media.coefficients(frame)
        assert shape == (24, 24) and (quant == 1).all()
        assert (levels.reshape(9, 64) == media._levels(unit[None])[0]).all()


def picture(level, rng):
    """A frame of one grey level with little noise, written with the stored layout's coefficients."""
    units = rng.integers(128, 130, (9, 64)).astype(np.uint8)
    units[:, 0] = level
    return units.reshape(-1)


def test_shots_stand_out():
    shares = np.zeros((60, media.BINS))
    shares[:25, 2] = shares[25:40, 9] = shares[40:, 4] = 1
    shares += np.random.default_rng(0).normal(0, 0.002, shares.shape)
    assert media.shots(shares).tolist() == [0, 25, 40]
    assert media.shots(shares[:1]).tolist() == [0] and media.shots(shares[:0]).tolist() == []
    drift = np.stack([np.roll(np.eye(media.BINS)[0] * (1 - i / 40) + np.eye(media.BINS)[1] * i / 40, 0) for i in range(40)])
    assert media.shots(drift).tolist() == [0]


def test_clips_are_timed(spark):
    data = np.random.default_rng(2).integers(0, 256, 30 * 576, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([(1, media.store(data)), (2, None), (3, b"RIFF0000AVI broken"), (4, b"")], "id long, data binary")
    rows = media.clips(df, "id", "data").collect()
    assert {r["id"] for r in rows} == {1} and sum(r["frames"] for r in rows) == 30
    assert rows[0]["start_s"] == 0 and max(r["end_s"] for r in rows) == pytest.approx(30 / media.FPS)


def test_text_digests(spark):
    texts = [None, "", "a", "ü" * 300, "x" * 576, "x" * 577, "漢" * 40_000, "a"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in media.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = media.store(payload)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert got[2]["feature"] == got[7]["feature"] and media.text_media(df.where("false")).count() == 0
