"""Texts made to cost time or memory, and tables that hold nothing to learn from."""

import time
import tracemalloc

import numpy as np
import pytest

from mutaspark.llm import html_text, quality, secrets, toxicity

MEGABYTE = 1_000_000


@pytest.mark.parametrize("token", ["<b>", "<b>x</i>", "<a ", "<div>", "<li>", "<p>", "</i>", "<div><li></li>", "<!--", "&amp;", "<td>", '<a x="', "<svg>", "<script>", "<span><div>", "<", '"', "<x-y>", "</div>"])
def test_pages_of_one_token_take_linear_time(token):
    model, times = html_text.trained(), []
    for size in (MEGABYTE // 8, MEGABYTE // 2):
        start = time.process_time()
        html_text.main_blocks(token * (size // len(token)), model)
        times.append(time.process_time() - start)
    assert times[1] < 10 * max(times[0], 0.05)


def test_end_tags_that_close_nothing():
    start = time.process_time()
    html_text.main_blocks("<b>" * 100_000 + "x</i>" * 100_000, html_text.trained())
    html_text.main_blocks("<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, html_text.trained())
    assert time.process_time() - start < 20


@pytest.mark.parametrize(("page", "blocks"), [
    ("<p>Just one paragraph without anything else.</p>", ["Just one paragraph without anything else."]), ("plain text only", ["plain text only"]),
    ("<div><p>Some words of text here. And more.</p></div>", ["Some words of text here. And more."]), ("<body><h1>A post</h1><p>With one line.</p><footer>Imprint</footer></body>", ["A post", "With one line."]),
    ("<nav><a href=x>Home</a></nav>", []), ('<div class="cookie-banner">We use cookies.</div>', []), ("<p hidden>Not shown</p>", []), ("<p>&<b>lt;</b> here.</p>", ["&lt; here."]), ("a<!-- x > y", ["a"]), ("<p>x</p> and <b", ["x", "and <b"]),
])
def test_plain_pages(page, blocks):
    assert html_text.main_blocks(page, html_text.trained()) == blocks


@pytest.mark.parametrize("token", ["a = a + a\n", 'password = password + "y"\n', 'a="x"\n', '"', "'''", "a:", 'key="', "<a>", "<a ", "x = y + ", "token: ", "${a}", "# a = 'b'\n", '=""', "\\"])
def test_sources_of_one_token_take_little(token):
    text, start = "a = 's3cretVALUE9x'\n" + token * (MEGABYTE // 4 // len(token)), time.process_time()
    tracemalloc.start()
    secrets.scan(text)
    secrets.joined_literals(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * MEGABYTE and time.process_time() - start < 60


def test_names_that_double():
    text = "a = 's3cretVALUE9x'\n" + "a = a + a\n" * 60 + "password = a\n"
    tracemalloc.start()
    assert secrets.scan(text) == [(5, 18, "lexed")]
    assert tracemalloc.get_traced_memory()[1] < 50 * MEGABYTE
    tracemalloc.stop()


def test_long_values_score_as_their_text(monkeypatch):
    whole = lambda v: (monkeypatch.setattr(secrets, "LONGEST", 1 << 30), secrets.literal_score(v))[1]
    for v in ("x" * 300, "your" + "A1" * 200, "<" + "a" * 300 + ">", "<" + "a" * 300, "aB3$" * 100, "a b" * 100, "ab" * 200, "%(" + "w" * 200 + ")s", "${" + "v" * 200 + "}", "X" * 150 + "y" + "x" * 150):
        for k in (1, 7, len(v) // 2):
            summary = secrets.Long.of(v[:k]) + secrets.Long.of(v[k:])
            assert abs(secrets.literal_score(summary) - whole(v)) < 1e-9, v[:9]


def test_every_chunk_of_a_long_text_is_learned_from():
    data = bytes(np.random.default_rng(2).integers(0, 256, 200_000, dtype=np.uint8))
    seen = {c.tobytes() for epoch in range(quality.EPOCHS) for c in quality.drawn(data, epoch, quality.EPOCHS, 7)}
    assert seen == {c.tobytes() for c in quality.chunks(data)}


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([1], 0.99), ([0, 0], 0.01)])
def test_quality_of_nothing_learned(labels, want):
    net = quality.train([b"some text"] * len(labels), np.array(labels))
    assert np.allclose(quality.score(net, net.pairs(), ["any text", None, "x" * 5000]), want, atol=1e-6)


def test_voters_of_long_words():
    voters = toxicity.Voters.of([(1, "zonk")])
    start = time.process_time()
    for text in ("z" * MEGABYTE, "you " * (MEGABYTE // 4), "A" * MEGABYTE, "*" * MEGABYTE, "AAA " * (MEGABYTE // 4), "a*" * (MEGABYTE // 2)):
        voters.votes(text, toxicity.words_of(text))
    assert time.process_time() - start < 30
