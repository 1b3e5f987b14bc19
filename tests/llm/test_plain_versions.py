"""Operators that SQL cannot express against plain versions of their own: other code for the same definitions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, graph, hamming, html_text, language, media, ngram_join, registry, token_counts, toxicity
from tidemark.llm.presplit import Splitter
from tidemark.llm.shared import shared_path, written

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


# --- toxicity


def plain_risk(positive, unlabelled, prior, w, b):
    """The risk by its definition, document by document."""
    margin = lambda row: b + sum(w[k] for k in row)
    loss = lambda g: math.log1p(math.exp(-g))
    mean = lambda rows, sign: sum(loss(sign * margin(r)) for r in rows) / len(rows)
    return prior * mean(positive, 1), mean(unlabelled, -1) - prior * mean(positive, -1)


@pytest.mark.parametrize("scale", [0.3, 6.0])
def test_risk_and_its_derivatives(scale):
    rng = random.Random(11)
    rows = lambda n: [sorted(rng.sample(range(12), rng.randint(0, 5))) for _ in range(n)]
    p, u, w, b = rows(15), rows(40), [rng.gauss(0, scale) for _ in range(12)], -0.5 * scale
    sets = [toxicity.Rows([np.array(r, np.int64) for r in x], 12) for x in (p, u)]
    toxic, clean, step = toxicity.risk(*sets, 0.3, np.array(w), b)
    assert (toxic, clean) == pytest.approx(plain_risk(p, u, 0.3, w, b))
    value = (lambda w, b: sum(plain_risk(p, u, 0.3, w, b))) if clean >= 0 else (lambda w, b: -plain_risk(p, u, 0.3, w, b)[1])
    for k in range(13):
        x = [*w, b]
        moved = []
        for h in (1e-5, -1e-5):
            y = list(x)
            y[k] += h
            moved.append(value(y[:-1], y[-1]))
        assert step[k] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


def test_both_cases_of_the_risk_occur():
    p = toxicity.Rows([np.array([0])] * 5, 1)
    u = toxicity.Rows([np.array([0])] * 5 + [np.array([], np.int64)] * 5, 1)
    assert toxicity.risk(p, u, 0.5, np.array([0.0]), 0.0)[1] > 0 > toxicity.risk(p, u, 0.9, np.array([9.0]), -4.0)[1]


def plain_toxicity(model, text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    features = words | {w[:k] + "-" for w in words for k in (4, 5, 6) if len(w) > k}
    margin = model.bias + math.fsum(model.weights.get(f, 0.0) for f in features)
    return 1 / (1 + math.exp(-margin))


def test_toxicity_of_the_fixture(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in registry.op3_toxicity(spark, MIDDLE).collect()}
    model = toxicity.fit(docs, labels)
    assert min(model.weights.values()) < 0 < max(model.weights.values())
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].score == pytest.approx(plain_toxicity(model, r.text), abs=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == held_out(r.doc_id, 5, 0)
    known = [r for r in labels.collect() if r.toxic is not None and r.doc_id in got and got[r.doc_id].held_out]
    right = [got[r.doc_id].predicted == r.toxic for r in known]
    assert sum(right) >= 0.95 * len(right) > 20


# --- language


def plain_language(rows):
    """A predictor by the definition, from (lang, text) rows all of which are learned; dictionaries of logs."""
    languages = sorted({x for x, _ in rows})
    words, grams = Counter(), Counter()
    for lang, text in rows:
        words.update((lang, w) for w in re.findall(r"[^\W\d_]+", text.lower()))
    for (lang, w), n in words.items():
        for order in (5, 4, 3, 2, 1):
            grams.update({(lang, g): c * math.sqrt(n) for g, c in Counter(f"^{w}$"[i : i + order] for i in range(len(w) + 3 - order)).items()})

    def logs(counts):
        keys = {k for _, k in counts}
        total = {x: sum(n for (y, _), n in counts.items() if x == y) + 0.5 * len(keys) for x in languages}
        return keys, lambda x, k: math.log((counts.get((x, k), 0) + 0.5) / total[x])

    word_keys, word_log = logs(words)
    gram_keys, gram_log = logs(dict(grams))

    def predict(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        sums, n = dict.fromkeys(languages, 0.0), 0
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            n += 1
            padded = f"^{w}$"
            orders = ([g for i in range(len(padded) - o + 1) if (g := padded[i : i + o]) in gram_keys] for o in (5, 4, 3, 2, 1))
            known = [] if w in word_keys else next((x for x in orders if x), [])
            for x in languages:
                sums[x] += word_log(x, w) if w in word_keys else sum(gram_log(x, g) for g in known) / max(1, len(known))
        best = max(languages, key=lambda x: sums[x])
        odds = [math.exp((sums[x] - sums[best]) / math.sqrt(max(n, 1))) for x in languages]
        return best, 1 / sum(odds)

    return predict


def test_language_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    predict = plain_language([(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and not held_out(r.doc_id, 4, 2)])
    got = {r.doc_id: r for r in registry.op5_language(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = predict(r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[r.doc_id].held_out == held_out(r.doc_id, 4, 2)


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("lang is not null and text is not null").collect()}
    right = [r.lang_pred == truth[r.doc_id] for r in registry.op5_language(spark, MIDDLE).filter("held_out").collect() if r.doc_id in truth]
    assert sum(right) >= 0.98 * len(right) > 100


def test_sparse_and_full_tables_agree(monkeypatch):
    rng = random.Random(7)
    counts = {f"k{i}": {x: float(rng.randint(1, 9)) for x in rng.sample(range(6), rng.randint(1, 6))} for i in range(50)}
    full = language.tabled(counts, 6)
    monkeypatch.setattr(language, "MOST_CELLS", 10)
    sparse = language.tabled(counts, 6)
    assert full.rows is not None and sparse.rows is None
    found, weights = rng.choices(range(50), k=40), np.array([rng.random() for _ in range(40)])
    assert full.total(found, weights) == pytest.approx(sparse.total(found, weights))


def test_many_languages_and_long_words(spark):
    rows = [(k, " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}lo"] * 4) + " " + chr(97 + k % 26) * 500, f"l{k:03d}") for k in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert max(map(len, model.words.keys)) <= language.LONGEST and len(model.languages) > 200
    assert model.predict("aalo")[0] == "l000"


# --- main text


def plain_weights(node, root=None):
    """(characters, tags, characters of links, tags of links) of an element by its definition."""
    chars = tags = link_chars = link_tags = 0
    for child in node.children:
        if isinstance(child, str):
            chars += len(" ".join(child.split()))
        elif not child.dropped:
            c, t, lc, lt = plain_weights(child)
            chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt
    if node.tag == "a":
        link_chars, link_tags = chars, link_tags + 1
    return chars, tags, link_chars, link_tags


def plain_density(node, root):
    c, t, lc, lt = plain_weights(node)
    rc, _, rlc, _ = plain_weights(root)
    if not c:
        return 0.0
    if not rlc:
        return c / max(1, t)
    inner = (c / max(1, c - lc)) * lc + (rlc / rc) * c + math.e
    ratio = c / max(1, lc) * max(1, t) / max(1, lt)
    return c / max(1, t) * max(0.0, math.log(max(1.0, ratio))) / math.log(math.log(inner))


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "p", "div", "a", "b", "ul", "section"] if depth < 4 else ["text"])
        words = " ".join(rng.choice(["one", "two", "three", "eleven"]) for _ in range(rng.randint(1, 12)))
        out.append(words if kind == "text" else f"<p>{words}</p>" if kind == "p" else f"<{kind}>{random_page(rng, depth + 1)}</{kind}>")
    return " ".join(out)


@pytest.mark.parametrize("seed", range(12))
def test_densities_equal_their_definition(seed):
    root = html_text.parse(random_page(random.Random(seed)))
    nodes = html_text.weigh(root)
    assert nodes[0] is root
    blocks = html_text.BLOCK
    for node in nodes:
        assert node.density == pytest.approx(plain_density(node, root))
        inner = [c for c in node.children if not isinstance(c, str) and not c.dropped and c.tag in blocks]
        assert node.total == pytest.approx(sum(plain_density(c, root) for c in inner))
    top = max(nodes, key=lambda n: n.total)
    if top.total:
        # the subtree with the largest sum is part of what is chosen
        ids = {id(top)}
        up = top
        while up is not None:
            ids.add(id(up))
            up = up.parent
        assert any(id(n) in ids for n in html_text.chosen(root))


def test_every_page_of_the_fixture_gives_one_row(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = registry.op7_main_text(spark, SMALL).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        bare = " ".join(re.sub(r"<[^>]*>", " ", __import__("html").unescape(pages[r.page_id].html or "")).split())
        assert all("".join(line.split()) in "".join(bare.split()) for line in r.text.split("\n"))


LINES = [f"line {k} of the article, with words" for k in range(4)]
ARTICLE = "<p>" + "<p>".join(LINES)


@pytest.mark.parametrize("word", sorted(set(re.sub(r"\(\?:[^)]*\)|[?]", "", html_text.MARKS.pattern).split("|"))))
def test_no_mark_takes_an_article(word):
    for page in (f"<div class='content {word}'>{ARTICLE}</div>", f"<div class='{word}-wrap'><article>{ARTICLE}</article></div>", f"<div class='right-{word}-content'>{ARTICLE}</div><p>side", f"<main id='{word}'>{ARTICLE}</main>"):
        assert html_text.main_text(page).startswith("\n".join(LINES))


def test_parts_of_an_article_stay():
    assert html_text.main_text(f"<div><div class='article-header'><h1>The title of it</h1></div>{ARTICLE}</div>") == "\n".join(["The title of it", *LINES])
    law = "<section id='legal'><h2>The law</h2><p>What the law says in this case</section>"
    assert html_text.main_text(f"<article>{ARTICLE}{law}</article>") == "\n".join([*LINES, "The law", "What the law says in this case"])
    assert html_text.main_text(f"<p>so <math><mi>x</mi></math> is it{ARTICLE}").startswith("so x is it\n")
    assert html_text.main_text(f"{ARTICLE}<p><![CDATA[the tail").endswith("\nthe tail")
    assert html_text.main_text(f"<p title=it's>first words{ARTICLE}").startswith("first words\n")


@pytest.mark.parametrize("heading", ["3 Comments", "Comments (12)", "Leave a reply", "Responses", "Reader comments:"])
def test_replies_without_a_name_go(heading):
    replies = f"<div class='x1'><h3>{heading}</h3><p>what a reader says of it</p><p>and another reader</p></div>"
    assert html_text.main_text(f"<article>{ARTICLE}</article>{replies}") == html_text.main_text(f"<div>{ARTICLE}{replies}</div>") == "\n".join(LINES)


@pytest.mark.parametrize("page", ["<p>x" + "</b>" * 100_000, "<div>" * 3000 + "x" + "</section>" * 100_000, "<li>a" * 30_000, "<b>" * 20_000 + "<hr>x" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 5000 + "<li>a" * 20_000, "<td>a" * 30_000, '<p title="x>y' * 20_001, "<div>" * 5000 + "<header>a</header>" * 20_000, "<a " + "=" * 100_000, "<" * 100_000])
def test_odd_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 2


# --- media


def plain_stream(data):
    """Payload, time stamps and random-access points by reading the bytes in order."""
    assert len(data) % 188 == 0
    tables, units, counters = {}, [], {}
    pmt_pid = data_pid = None
    for at in range(0, len(data), 188):
        packet = data[at : at + 188]
        assert packet[0] == 0x47
        start, pid = packet[1] >> 6 & 1, (packet[1] & 0x1F) << 8 | packet[2]
        has_field, has_body, counter = packet[3] >> 5 & 1, packet[3] >> 4 & 1, packet[3] & 15
        assert has_body and counters.get(pid, counter) == counter
        counters[pid] = (counter + 1) & 15
        field = packet[5 : 5 + packet[4]] if has_field else b""
        body = packet[5 + len(field) :] if has_field else packet[4:]
        if pid == 0 or pid == pmt_pid:
            section = body[1 + body[0] :]
            section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
            crc = 0xFFFFFFFF
            for bit in (byte >> k & 1 for byte in section for k in range(7, -1, -1)):
                crc = (crc << 1 ^ (0x04C11DB7 if (crc >> 31) ^ bit else 0)) & 0xFFFFFFFF
            assert crc == 0
            tables[pid] = section
            if pid == 0:
                pmt_pid = (section[10] & 0x1F) << 8 | section[11]
            else:
                data_pid = (section[13] & 0x1F) << 8 | section[14]
        elif pid == data_pid:
            if start:
                units.append([bytearray(), bool(field and field[0] & 0x40)])
            units[-1][0] += body
    payload, stamps = b"", []
    for unit, _ in units:
        assert unit[:3] == b"\0\0\1" and unit[7] & 0x80
        bits = "".join(f"{b:08b}" for b in unit[9:14])
        stamps.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        payload += bytes(unit[9 + unit[8] : 6 + (unit[4] << 8 | unit[5])])
    return payload, stamps, [r for _, r in units]


def test_stored_streams_of_the_fixture(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stored = media.stored_media(docs)
    assert stored.columns == ["doc_id", "n_bytes", "media"]
    streams = {r.doc_id: bytes(r.media) for r in spark.read.parquet(stored.stored_at).collect()}
    got = {r.doc_id: r for r in registry.op10_media(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) == len(streams)
    for r in rows:
        raw = (r.text or "").encode()
        payload, stamps, points = plain_stream(streams[r.doc_id])
        assert payload == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        own = got[r.doc_id]
        assert [u.pts for u in own.units] == stamps and [u.random_access for u in own.units] == points and points[0]
        assert [u.offset for u in own.units] == [sum(u.size for u in own.units[:k]) for k in range(len(own.units))]
        assert (own.n_bytes, own.payload_bytes, own.payload_sha256, own.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (own.media_bytes, own.media_sha256) == (len(streams[r.doc_id]), hashlib.sha256(streams[r.doc_id]).hexdigest())


# --- long texts


def test_a_long_text_has_the_set_of_its_words():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcÉ", k=rng.choice([1, 4, 30]))) for _ in range(4000)] + ["x" * 5000, "y"]
    for count, space in ((len(words), " "), (4, "\n"), (1, "\t"), (0, " ")):
        text = f"{space}{space}".join(words[-count:] if count else []) + space * 7
        texts = pa.array([text, "short one", text, None])
        whole = ngram_join.sets_of(texts)
        try:
            ngram_join.TEXT_SLICE, before = 997, ngram_join.TEXT_SLICE
            pieces = ngram_join.sets_of(texts)
        finally:
            ngram_join.TEXT_SLICE = before
        for name in ("hashes", "begins", "sizes", "keys"):
            assert (getattr(whole, name) == getattr(pieces, name)).all()


def peak_mb(f, *args):
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_long_texts_take_bounded_memory():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 3_000_000)]
    text = " ".join(words)
    assert len(text) > 15_000_000
    del words
    assert peak_mb(ngram_join.sets_of, pa.array([text])) < 12 * len(text) / 1e6
    pieces = {bytes([b]): -9.0 for b in range(256)} | {b" w": -3.0, b"xx": -4.0}
    trie = token_counts.Trie(pieces)
    counts = token_counts.Counts(trie)

    def count(text):
        for some in Splitter().parts(text):
            counts.age()
            sum(map(counts.__getitem__, some))

    assert peak_mb(count, text[: 2 << 20]) < 64
    assert peak_mb(count, "x" * (1 << 20)) < 16 and trie.insert(b"x" * (1 << 20)) == 1 << 19
    assert len(trie.best) < 200_000


def test_long_words_are_counted_as_short_ones():
    rng = random.Random(6)
    pieces = {bytes([b]): -9.0 for b in range(256)} | {b"ab": -3.0, b"abc": -12.0, b"bc": -3.0, b"aa": -18.0}
    trie = token_counts.Trie(pieces)
    for size in (1, 2, 5, 40, 300):
        word = bytes(rng.choices(b"abc", k=size))
        assert trie.scored_alone(word) == trie.insert(word)


def test_long_words_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    codec, library = bpe.codec_of(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    for text in ("ab" * 20_000, "".join(rng.choices("etaoin shrdlu", k=150_000)), "".join(rng.choices("etaoinshrdlu", k=50_000))):
        assert list(memoryview(codec.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


# --- n-gram join at its seams


def plain_components(pairs):
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_equal_a_plain_search(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 530)] + [(7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components(pairs)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frequent_ngrams_are_ranked_however_many_there_are(spark, monkeypatch):
    """More n-grams than HOT reach any frequency: the most frequent ones are still ranked, and above all others."""
    monkeypatch.setattr(ngram_join, "HOT", 64)
    phrase = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n + 4))  # noqa: E731  n n-grams
    texts = [phrase(k, 30) + f" own{j} a b" for k in range(10) for j in range(3 + k)] + ["top one of all the words"] * 200
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    hot, n = ngram_join.hot_hashes(docs, 4)
    assert 32 <= len(hot) <= 96 and (np.diff(n) >= 0).all()
    counts = Counter(h for t in texts for h in (ngram_join.sets_of(pa.array([t])).hashes >> np.uint64(32)).tolist())
    assert all(counts[h] == c for h, c in zip(hot.tolist(), n.tolist(), strict=True))
    assert n[-1] == 200 and n[0] >= sorted(counts.values())[-96]


@pytest.mark.parametrize("split", [2, 5])
def test_hot_ngrams_are_dealt_out(spark, monkeypatch, split):
    from tests_llm_corpus import corpus, plain_classes

    monkeypatch.setattr(ngram_join, "SPLIT", split)
    rng = random.Random(split)
    texts = corpus(rng, 5, 30)
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, texts[3]), (None, texts[-1] + " x"), (None, "another text that is alone here")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr)
    assert got == plain_classes(rows)


def test_suffix_filter_loses_no_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64) << np.uint64(1))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 80))).astype(np.uint64) << np.uint64(1)]))
        if not len(y):
            continue
        parts = [np.minimum(np.bincount((z >> np.uint64(59)).astype(int), minlength=32), 255)[None, :] for z in (x, y)]
        if ngram_join.linked(x, y):
            assert not ngram_join.far_apart(*parts, np.array([len(x)]), np.array([len(y)]))[0]
    assert ngram_join.far_apart(np.array([[40] + [0] * 31]), np.array([[0, 40] + [0] * 30]), np.array([40]), np.array([40]))[0]


def test_no_pair_is_verified_twice(spark, monkeypatch):
    from tests_llm_corpus import corpus

    seen = []
    inner = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, sets: seen.append(pairs.collect()) or inner(pairs, sets))
    texts = corpus(random.Random(8), 8, 12)
    ngram_join.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    pairs = [tuple(sorted(p)) for some in seen for p in some]
    assert len(seen) == 2 and pairs and len(set(pairs)) == len(pairs)


def test_full_join_alone_finds_every_link(spark, monkeypatch):
    """Without pivots, and with texts whose overlap is just enough or one n-gram short, of many sizes."""
    from tests_llm_corpus import corpus, plain_classes

    monkeypatch.setattr(ngram_join, "pivot_pairs", lambda prefixes: prefixes.select(F.col("key").alias("a"), F.col("pivot").alias("b")).limit(0))
    texts = corpus(random.Random(21), 4, 8)
    for n in (*range(1, 30), 57, 64, 100, 131):
        words = [f"{k}n{n}" for k in range(n + 4)]
        enough = -(-3 * n // 4)
        texts += [" ".join(words), " ".join(words[: enough + 4]), " ".join(reversed(words)), " ".join([*reversed(words)][: enough + 3])]
    rows = list(enumerate(texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == plain_classes(rows)


# --- code search at its seams


def test_segments_follow_the_rows():
    for rows, width in ((10, 8), (1000, 10), (65_536, 16), (10**9, 22), (10**10, 32)):
        parts = hamming.segments(rows, 64)
        assert sum(p.width for p in parts) == 64 and max(p.width for p in parts) - min(p.width for p in parts) <= 1
        assert [p.start for p in parts] == [sum(q.width for q in parts[:k]) for k in range(len(parts))] and abs(parts[0].width - width) <= 1


@pytest.mark.parametrize("cell,block", [(4, 1 << 18), (16, 3), (1 << 12, 20)])
def test_cells_and_blocks_do_not_matter(spark, monkeypatch, cell, block):
    monkeypatch.setattr(hamming, "CELL", cell)
    monkeypatch.setattr(hamming, "BLOCK", block)
    monkeypatch.setattr(hamming, "AT_ONCE", 50)
    rng = random.Random(cell)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    centre = rng.getrandbits(64)
    codes = [(i, signed(rng.getrandbits(64))) for i in range(150)] + [(i, signed(centre ^ 1 << rng.randrange(64))) for i in range(150, 260)] + [(i, signed(centre)) for i in range(260, 300)]
    df = spark.createDataFrame(codes, "id long, code long")
    want = []
    for q, c in codes:
        if q % 50 == 0:
            near = sorted((bin((c ^ d) & (1 << 64) - 1).count("1"), i) for i, d in codes if i != q)[:4]
            want += [(q, i, dist, place) for place, (dist, i) in enumerate(near, 1)]
    assert sorted(map(tuple, hamming.top_k(df, df.filter("id % 50 = 0"), 4).collect())) == sorted(want)


# --- storage


def test_tables_are_deleted_when_done(spark):
    from tidemark.llm.shared import forget

    df = written(spark.range(5), "x")
    assert df.count() == 5
    forget(df)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|path"):
        spark.read.parquet(df.stored_at).count()
    assert shared_path(spark, "y") != shared_path(spark, "y")


def test_small_tables_are_dealt_out_and_batches_follow_the_session(spark):
    from tidemark.llm import shared

    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert one.rdd.getNumPartitions() == 1 and shared.spread(one).rdd.getNumPartitions() == 2 * cores
    many = spark.range(100).repartition(3 * cores)
    assert shared.spread(many) is many
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for own, then in (("10000", "1000"), ("50", "50")):
            spark.conf.set(name, own)
            shared.small_batches(one)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


# --- the pipeline


def test_pipeline_equals_its_plain_version(spark):
    """Every decision of the pipeline, made again row by row."""
    import corpus_pipeline as p
    from tests_llm_corpus import plain_classes
    from tokenizers import Tokenizer

    from tidemark.llm import mixing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in rows if plain_toxicity(model, r.text) < 0.5]
    predict = plain_language([(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and not held_out(r.doc_id, 4, 2)])
    kept = []
    for r in rows:
        lang, score = predict(r.text)
        if lang != "und" and score >= 0.5:
            kept.append(r)
    classes = {i: c for i, _, c in plain_classes([(r.doc_id, r.text) for r in kept])}
    once = [r for r in kept if classes[r.doc_id] == r.doc_id]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in once}
    mixed = {r.doc_id: r.repeats for r in mixing.mix(spark.createDataFrame(once, docs.schema)).collect()}
    library = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for r in once:
        ids = library.encode(r.text, add_special_tokens=False).ids
        if mixed[r.doc_id]:
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += mixed[r.doc_id]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, SMALL).collect())
    assert got == Counter(want)
    # what is taken of a source is as near to its target as whole documents allow
    targets = {r.source: r.target for r in mixing.mix(spark.createDataFrame(once, docs.schema)).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        own = [r for r in once if r.source == source]
        assert abs(sum(size[r.doc_id] * mixed[r.doc_id] for r in own) - target) <= max(size[r.doc_id] for r in own)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = ["score", "predicted", "toxicity_score", "toxicity_predicted", "language_found", "language_score", "lang_pred", "mix_key", "mix_size", "mix_source", "mix_copy", "epochs", "last", "key", "row", "n", "label"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in own})
    for stage in (p.without_toxic, p.in_known_language, p.one_of_each_class, p.mixed_to_targets):
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        assert [tuple(r) for r in kept.select(*own).distinct().collect()] == [tuple(f"own {c}" for c in own)]
    assert p.tokenized(spark, docs, SMALL).count() == docs.count()


def test_equal_rows_leave_the_same_one(spark):
    import corpus_pipeline as p

    text = "some words that are a text of their own"
    rows = [(1, text, "en", s, 9) for s in "badc"] + [(1, text, "en", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {tuple(map(tuple, p.one_of_each_class(spark, df.repartition(k), SMALL).collect())) for k in (1, 3)}
    assert len(found) == 1 and len(next(iter(found))) == 1
