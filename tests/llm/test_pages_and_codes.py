"""Archives, main text, code search and the pipeline."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hamming, html_text, warc
from tidemark.llm.shared import shared_path

PAGE = "page_id long, url string, html string"


# --- WARC


def test_every_split_finds_each_record_once():
    rng = random.Random(3)
    blobs = [warc.record(i, f"http://x/é {i}", rng.randbytes(rng.choice([0, 5, 2000, 400_000])), None if i % 3 else 1) for i in range(40)]
    blobs.insert(20, warc.record(1000, "nested", b"".join(blobs[:2]), None))
    data = b"".join(blobs)
    places, at = [], 0
    for b in blobs:
        places.append(at)
        at += len(b)
    for step in (1000, 65_536, warc.CHUNK - 1, warc.CHUNK, 1 << 20):
        found = [r.offset for s in range(0, len(data), step) for r in warc.records(io.BytesIO(data), s, min(s + step, len(data)))]
        assert found == places
    head = b"".join(blobs[:12])
    for step in (1, 7, 97):
        assert [r.offset for s in range(0, 4000, step) for r in warc.records(io.BytesIO(head), s, s + step) if r.offset < 4000] == [p for p in places if p < 4000]


def test_reader_passes_over_what_is_no_record():
    import gzip

    good = warc.record(1, "u", b"payload", None)
    other = gzip.compress(b"no archive" * 50)
    data = b"junk\x1f\x8b\x08junk" + good + other + good + b"\x1f\x8b"
    assert [warc.row_of(r)[0] for r in warc.records(io.BytesIO(data), 0, len(data))] in ([1], [1, 1])
    assert [warc.row_of(r)[0] for r in warc.records(io.BytesIO(good), 0, len(good))] == [1]
    assert list(warc.records(io.BytesIO(good[:-20]), 0, len(good))) == [] == list(warc.records(io.BytesIO(b""), 0, 0))


def one_archive(spark, data):
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "one.warc.gz")
    with open(path, "wb") as f:
        f.write(data)
    return spark.createDataFrame([(path, len(data))], "path string, bytes long")


@pytest.mark.parametrize("split", [None, 500])
def test_damaged_records_are_not_lost_silently(spark, split):
    rng = random.Random(2)
    blobs = [warc.record(i, f"u{i}", rng.randbytes(700), None) for i in range(5)]
    flipped = bytearray(blobs[1])
    flipped[len(flipped) // 2] ^= 0xFF
    flipped[len(flipped) // 2 + 1] ^= 0xFF
    for data, left in ((b"".join([blobs[0], bytes(flipped), *blobs[2:]]), [0, 2, 3, 4]), (b"".join(blobs)[:-20], [0, 1, 2, 3])):
        files = one_archive(spark, data)
        with pytest.raises(Exception, match="no whole record at byte|DamagedArchive"):
            warc.read_archives(files, split).collect()
        rows = warc.read_archives(files, split, damaged="report").collect()
        assert sorted(r["page_id"] for r in rows if r["record_type"] != warc.DAMAGED and r["intact"]) == left
        assert any(r["record_type"] == warc.DAMAGED or not r["intact"] for r in rows)
        assert sorted(r["page_id"] for r in warc.read_archives(files, split, damaged="skip").filter("intact").collect()) == left


def test_archives_that_lack_records_are_refused(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 50) for i in range(20)], PAGE)
    real = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda *a: real(*a).withColumn("records", F.col("records") + 1))
    with pytest.raises(warc.DamagedArchiveError, match="written"):
        warc.archived(pages)


def test_headers_of_any_length_are_read():
    rng = random.Random(5)
    urls = ["u", rng.randbytes(600_000).hex(), "v", rng.randbytes(300_000).hex()]
    blobs = [warc.record(i, u, b"payload", None) for i, u in enumerate(urls)]
    data = b"".join(blobs)
    for step in (50_000, warc.CHUNK, 1 << 30):
        found = [warc.row_of(r) for s in range(0, len(data), step) for r in warc.records(io.BytesIO(data), s, min(s + step, len(data)))]
        assert [r[:2] for r in found] == list(enumerate(urls)) and all(r[6] for r in found)


def test_archives_of_odd_pages(spark):
    big, other = "x" * 1000, "é" * 700
    rows = [(1, "http://a\r\nX: y", big), (5, "u", big), (3, None, big), (7, "u", other), (8, "u", other), (2, "u", None), (4, "u", ""), (6, "u", "small"), (9, "u", "small"), (None, "n", "alone"), (10, "u", "z" * 200_000), (5, "u", big)]
    df = spark.createDataFrame(rows, PAGE).withColumn("payload", F.lit("clash")).withColumn("refers_to", F.lit(0)).repartition(3)
    got = sorted((tuple(r) for r in warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=repr)
    largest = {big: 5, other: 8}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = largest.get(html) if i != largest.get(html) else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers, True))
    assert got == sorted(want, key=repr)


def test_archives_keep_payloads_and_splits_do_not_matter(spark):
    rows = [(i, f"http://h/{i}", "<p>" + chr(97 + i % 26) * (i * 37 % 5000)) for i in range(300)]
    files = warc.write_archives(spark.createDataFrame(rows, PAGE).repartition(2), shared_path(spark, "warc"))
    for split in (500, 10_000, 1 << 30):
        read = {r.page_id: r for r in warc.read_archives(files, split).collect()}
        assert len(read) == 300
        for i, url, html in rows:
            r = read[i]
            assert r.url == url and (bytes(r.payload).decode() == html if r.record_type == "response" else read[r.refers_to].payload_digest == r.payload_digest)
    assert warc.archived(spark.createDataFrame([], PAGE)).count() == 0


# --- main text

TEMPLATE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a> Site</header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now, a long advert text that goes on and on and on</div><main><article><header><h1>The &amp; title</h1></header>%s</article></main>
<aside>See also these</aside><section id="comments"><p>First! A long comment with many words of a reader.</p></section>
<form>Search <input> <button>Go</button></form><footer>&copy; footer</footer></body></html>"""


@pytest.mark.parametrize(
    "body,text",
    [
        ("<p>One   para\n graph.<p><b>Two</b> <i>bold</i>.<br>", "One para graph.\nTwo bold ."),
        ("<p><b>Open bold.<br><p>Next &lt;tag&gt; &eacute;&#233;</p>", "Open bold.\nNext <tag> éé"),
        ("<ul><li>a b c<li>d e f</ul><table><tr><td>x<td>y</table><p>end of the text</p>", "a b c\nd e f\nx\ny\nend of the text"),
        ("<p>a <!-- c --> b</p><script>x</script><p>c<a href='q>r'>link</a></p>", "a b\nclink"),
        ("<p>Broken <a href=\"x> text", "Broken"),
    ],
)
def test_main_text_of_pages(body, text):
    got = html_text.main_text(TEMPLATE % body)
    assert got.startswith("The & title\n")
    assert got.removeprefix("The & title\n").replace(" .", ".") == text.replace(" .", ".") or "Broken" in text and "Broken" in got


def test_main_text_without_structure():
    assert html_text.main_text("") == html_text.main_text("<script>x</script>") == html_text.main_text("<nav>m</nav>") == ""
    assert html_text.main_text("plain  text") == "plain text"
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 4000) == "deep"
    assert html_text.main_text("<p>" + "w " * 100_000) == ("w " * 100_000).strip()
    body = "".join(f"<p>paragraph {k} of the text, with words</p>" for k in range(20))
    page = f"<body><div><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></div><div><div>{body}</div></div><p><a href=4>more</a></p>"
    assert html_text.main_text(page).count("\n") == 19


@pytest.mark.parametrize("attributes", ['style="overflow: hidden"', 'title="the hidden cost"', "data-x='a hidden class=\"ad\"'", "data-hidden", "x=1 title = 'role=navigation hidden'", "data-x=/class=ad", 'class="post" class="ad"'])
def test_words_in_values_are_no_attributes(attributes):
    lines = [f"line {k} of the article, with words" for k in range(3)]
    assert html_text.main_text(f"<div {attributes}><p>{'<p>'.join(lines)}</div><p>side matter</p>") == "\n".join(lines)


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", 'id="x"class="ad"', "title='a'hidden", 'title="the cost" hidden', "aria-hidden=true", "data-x='1' role = 'navigation'"])
def test_attributes_that_hide(attributes):
    assert html_text.main_text(f"<div {attributes}><p>not shown</p></div><p>the text of the article</p>") == "the text of the article"


LINES = [f"line {k} of the article, with words" for k in range(3)]
SIDE = "<div class='site-header'><p>Name of the site</div><div class='menu-item'><p>A menu</div>"


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='content has-sidebar'", "div class='layout no-footer'", "div class='post category-legal tag-social'", "div id='social-issues'", "div class=legal", "section id=discussion", "span class=side", "form", "form class='page menu'"])
@pytest.mark.parametrize("body", ["%s", "<article>%s</article>", "<main>%s</main>"])
def test_wrappers_keep_the_article(wrapper, body):
    page = f"{SIDE}<{wrapper}>{body % ('<p>' + '<p>'.join(LINES))}<div class='ad'>Buy</div></{wrapper.split()[0]}><div class='sidebar-1'><p>side matter</div>"
    assert html_text.main_text(page) == "\n".join(LINES)


def test_small_wrappers_of_an_article_stay():
    root = html_text.parse(f"<div class='legal'><article><p>{'<p>'.join(LINES)}</article></div><p>{'words of another place ' * 40}")
    assert html_text.blocks(root)[:3] == LINES
    teaser = "<article><p>a teaser</article>"
    assert html_text.main_text(f"<div class='legal'><p>{'<p>'.join(LINES)}</div><div class='related'>{teaser}</div>").startswith("\n".join(LINES))
    assert html_text.main_text(f"<div class='legal'><p>{'<p>'.join(LINES)}</div>{teaser * 3}").startswith("\n".join(LINES))


@pytest.mark.parametrize("tag", ["article", "main"])
def test_long_adverts_do_not_join_a_short_article(tag):
    assert html_text.main_text(f"<div class='ad'>{'Buy now, a long advert. ' * 9}</div><{tag}><p>short</{tag}>") == "short"


@pytest.mark.parametrize("mark", ["ad", "ad-slot", "sidebar-2", "relatedPosts", "cookie_notice", "widget widget_text ad", "no-js menu", "share-buttons"])
def test_marked_side_matter_goes(mark):
    assert html_text.main_text(f"<p>{'<p>'.join(LINES)}<div class='{mark}'><p>side matter of some words</div>") == "\n".join(LINES)


def test_many_replies_do_not_displace_the_article():
    replies = "".join(f"<article class='comment-body'><p>reply {k} of a reader, longer than the article</article>" for k in range(9))
    assert html_text.main_text(f"<main><article><p>{'<p>'.join(LINES)}</article><div id='comments' class='comments-area'>{replies}</div></main>") == "\n".join(LINES)


def test_links_lower_density():
    root = html_text.parse("<div><p>just some words of plain text here</p><p><a href=1>just some words of plain text here</a></p></div>")
    plain, linked = [n for n in html_text.weigh(root) if n.tag == "p"]
    assert plain.density > linked.density


def test_main_text_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "v", "<p>a</p>"), (2, "u", "")], PAGE).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.with_main_text(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "v", "a", 1), (2, "u", "", 0)], key=repr)
    assert html_text.with_main_text(df.limit(0)).count() == 0


# --- code search


def plain_search(codes, k, every):
    rows = sorted(set(codes))
    out = []
    for q, c in rows:
        if q % every == 0:
            near = sorted((bin((c ^ d) & (1 << 64) - 1).count("1"), i) for i, d in rows if (i, d) != (q, c))[:k]
            out += [(q, i, dist, place) for place, (dist, i) in enumerate(near, 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda c, n: c ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    codes = [(i, signed(flip(rng.choice(centres), rng.choice([0, 0, 1, 4, 9, 14])))) for i in range(400)]
    codes += [(400 + i, signed(centres[0])) for i in range(150)] + codes[:5]
    df = spark.createDataFrame(codes, "id long, code long")
    got = sorted(map(tuple, hamming.top_k(df, df.filter("id % 50 = 0"), 5).collect()))
    assert got == plain_search(codes, 5, 50)


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, -1.0, None]), (1, [1.0, -1.0, 0.0]), (2, None), (50, []), (51, [float("nan")] * 3), (0, [1.0, -1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash")).withColumn("distance", F.lit(0))
    got = sorted(map(tuple, hamming.nearest(df, k=10).collect()))
    assert [r[:3] for r in got] == [(0, 1, 0), (0, 50, 1), (0, 51, 2), (50, 0, 1), (50, 1, 1), (50, 51, 3)]
    assert hamming.nearest(df.limit(0)).count() == 0


# --- pipeline


def test_removal_concerns_the_row_that_is_the_copy(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = lambda x, k: f"{x} more{k}"
    rows = [(3, a), (7, near(a, 1)), (7, b), (3, near(a, 2)), (3, a), (9, c), (9, c), (None, near(a, 3)), (None, d), (None, near(d, 1)), (None, d), (None, ""), (None, ""), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, p.one_of_each_class(spark, df, "").collect()), key=repr)
    of_a = [r for r in got if r[1].startswith(a)]
    of_d = [r for r in got if r[1].startswith(d)]
    assert len(of_a) == 1 and of_a[0][0] == 3 and len(of_d) == 1
    assert sorted((r for r in got if r not in of_a + of_d), key=repr) == sorted([(7, b), (9, c), (5, ""), (None, ""), (None, "")], key=repr)


def test_columns_of_any_name_pass_the_stages(spark, sf_dir):
    import corpus_pipeline
    from tidemark.llm import language, mixing, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("tick`ed", F.lit("x")).withColumn("nested", F.struct(F.lit(1).alias("a b"), F.lit(2).alias("c.d"))).withColumn("score", F.lit("own"))
    for stage in (corpus_pipeline.without_toxic, corpus_pipeline.in_known_language, corpus_pipeline.one_of_each_class, corpus_pipeline.mixed_to_targets):
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        assert all(r["a.b"] == 1 and r["tick`ed"] == "x" and r["nested"]["a b"] == 1 for r in out.collect())
    assert toxicity.score(odd, toxicity.NOTHING).filter("score = 0 and predicted = 0").count() == 60
    assert language.identify(odd, language.fit(odd)).count() == 60
    assert mixing.mixture(odd).columns == odd.columns
    pages = spark.createDataFrame([(1, "<p>x</p>", 5)], "page_id long, `h.tml` string, `a.b` int")
    assert html_text.with_main_text(pages, "h.tml").columns == ["page_id", "a.b", "text", "n_chars"]


def test_toxic_labels_without_documents_teach_nothing(spark):
    from tidemark.llm import toxicity

    docs = spark.createDataFrame([(i, f"clean words number {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(20)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "language_id", "ngram_join", "mixing", "bpe"]
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    kept = p.without_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() <= docs.count()
    found = p.in_known_language(spark, kept, sf_dir)
    assert found.columns == docs.columns and found.filter("doc_id > 9000").count() == 0 and found.count() >= 0.97 * kept.count()
    once = p.one_of_each_class(spark, found, sf_dir)
    from tidemark.llm.ngram_join import ngram_classes

    classes = ngram_classes(found)
    assert sorted(r.doc_id for r in once.collect()) == sorted(r[0] for r in classes.select("component_id").distinct().collect())
    mixed = p.mixed_to_targets(spark, once, sf_dir)
    assert mixed.columns == docs.columns
    last = p.tokenized(spark, mixed, sf_dir)
    assert last.count() == mixed.count()
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
