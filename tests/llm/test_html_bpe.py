import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from pulsegrid.llm import bpe, html

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARA = "This is the text of an article that was written for the test and it has many of the words that are in all texts, so that it is long enough to be seen as good."


def test_article_and_containers():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-comments"><header><h1>Site of the day</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{PARA}</p></div><div class="ad">Buy it now</div>
    <article><h1>Title &amp; more</h1><p>{PARA}<p>To.</p><p><b>A&nbsp;&lt;b&gt;   bold<br>line</p><div class="related"><a href="x">{PARA}</a></div><form><p>{PARA}</p></form><p>End.</p></article>
    <aside><p>{PARA}</p></aside><section id="comments"><p>{PARA}</p></section><footer>&copy; it</footer><!-- {PARA} --></body>"""
    assert html.main_text(page) == f"Title & more\n{PARA}\nTo.\nA <b> bold line\nEnd."


def test_page_without_article():
    page = f'<body><div id="menu"><a href="/">{PARA}</a></div><div><p>{PARA}</p><p>Short.</p><p>{PARA}</p></div><ul><li><a href="/x">More of it</a></li></ul><div>Copyright 2020</div>'
    assert html.main_text(page).startswith(f"{PARA}\nShort.\n{PARA}")


def test_self_closing_drawings_and_link_cards():
    assert html.main_text(f"<article><p>{PARA}<svg class=i/> second part</p><p><svg><path d='x'/><text>no</text></svg>Third.</p></article>") == f"{PARA} second part\nThird."
    card = f'<a href="/x"><div><h3>Other news of the day</h3><p>{PARA}</p></div></a>'
    assert html.main_text(f"<body><div><p>{PARA}</p></div><div>{card}{card}</div><div><p>{PARA}</p></div></body>") == f"{PARA}\n{PARA}"
    assert html.main_text(f"<body><div><p><a href=x>open</p><p>{PARA}</p></div></body>").endswith(PARA)  # a link that was never closed


def test_page_edges(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- open") == ""
    assert html.main_text("<article><p>Er.</p></article>") == "Er."
    assert html.main_text("<article><p a=\"x>y\">Er &am") == "Er &am"
    long = "<article>" + f"<p>{PARA}</p>" * 3000
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>x", 1), (2, "v", long, 1)], "page_id bigint, url string, html string, text int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract_text(df).collect()}
    assert got[(1, None)] == ("", 0) and got[(2, "v")][1] == 3000 * (len(PARA) + 1) - 1
    assert html.extract_text(df.limit(0)).count() == 0


def test_real_pages_keep_the_article(spark, small):
    import re
    from html import unescape

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))]
        assert html.main_text(r.html) == "\n".join(x for x in want if x)


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "line\nnext\n\n third\t\ttab ", "it's we'll 'S 12345 ::: #*$ é😀\x00\x1c x", "a" * 3000, "ab" * 1000, "xyzzyq" * 40, "<|endoftext|> is text",
    "the quick brown fox " * 500, "\u2003wide\u00a0space \u0085x", " lead", "trail ", "ſ K ÀÉ 漢字かな" * 9,
]


def test_encode_is_the_library_s(spark, small):
    enc = reference()
    texts = [*TEXTS, *[r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    rows = {r.doc_id: r for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN, at_spaces=True).collect()}
    assert rows == {r.doc_id: r for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert rows[i].ids == want and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(i, r.ids) for i, r in rows.items()], "doc_id bigint, ids array<int>"), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_random_words_meet_the_library():
    import random

    enc, b = reference(), bpe.Bpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = {"".join(rng.choice("abthe ingéß") for _ in range(rng.randint(2, 130))).replace(" ", "") for _ in range(200)} - {""}
    b.learn(words)
    assert all(b.words[w][0] == " ".join(map(str, enc.encode_ordinary(w))) for w in words)
    assert base64.b64encode(b.decode([np.array(enc.encode_ordinary("x y"), np.int32).tobytes()])[0]) == base64.b64encode(b"x y")


def test_long_words_meet_the_library():
    """Words that are cut where no token crosses, and words of merges with a lower rank than their parts'."""
    import random

    enc, b = reference(), bpe.Bpe(ranks := bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(4)
    low = [k for k, v in ranks.items() if k.isalpha() and len(k) > 2 and any(v < max(ranks.get(k[:i], -1), ranks.get(k[i:], -1)) for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks)]
    assert len(low) > 1000
    words = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "a" * 20_001, "ab" * 5000, "thing" * 2000, "\u6f22\u5b57\u304b\u306a" * 3000}
    for _ in range(60):
        few = rng.sample(low, 3)
        words.add(b"".join(rng.choice(few) for _ in range(rng.randint(30, 120))).decode())
    words = {x for w in words for x in b.pattern.findall(w)}
    b.learn(words)
    for w in words:
        assert b.words[w][0] == " ".join(map(str, enc.encode_ordinary(w))) and b.words[w][1] == w.encode()


def test_class_words_around_an_article():
    for head, tail in (('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div class="no-banner"><main>', "</main></div>"), ('<div class="widget-area"><article>', "</article></div>"),
                       ('<article class="post comments-open">', "</article>"), ('<article class="post type-ad-free">', "</article>"), ('<div id=sidebar><div class=banner><article class="social">', "</article></div></div>")):
        assert html.main_text(f"<body>{head}<h1>Title</h1><p>{PARA}</p><p>{PARA}</p>{tail}</body>") == f"Title\n{PARA}\n{PARA}", head
    for head, tail in (('<div class="comments"><article>', "</article></div>"), ('<article class="comment">', "</article>"), ("<aside><article>", "</article></aside>"), ('<div style="display:none"><article>', "</article></div>")):
        assert html.main_text(f"<article><p>{PARA}</p></article>{head}<p>{PARA} Second.</p>{tail}") == PARA, head


def test_broken_markup_takes_linear_time():
    import time

    for junk in ("<p a='", "<a b ", "<p a='>'", "<svg ", "<!-- ", "<script ", '<div class="', '<a href="x', "</script ", "<div></ul>"):
        page = junk * (1_000_000 // len(junk))
        began = time.process_time()
        html.main_text(page)
        html.main_text(page + ">")
        assert html.main_text(f"<article><p>{PARA}</p>{page}").startswith(PARA)
        assert time.process_time() - began < 9, junk
    began = time.process_time()
    html.main_text("<div>" * 100_000 + "</ul>" * 100_000)
    assert time.process_time() - began < 9
