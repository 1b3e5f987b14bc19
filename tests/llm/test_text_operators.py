"""Operators on documents: exact round trips, brute force, and the cases of nulls, empties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_corpus import corpus, plain_classes

from tidemark.llm import bpe, language, media, mixing, ngram_join, token_counts, toxicity
from tidemark.llm.presplit import Splitter
from tidemark.llm.registry import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, lang="en", source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOC)


ODD = [None, "", " ", "\n\t", "a", "plain words here", "naïve façade ½ ² Ⅷ ١٢٣", "日本語 🤗́", "x" * 50_000, "tab\x1c\x85　end", "same", "same"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_of(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


# --- BPE


def test_automaton_is_the_library(codec, library):
    rng = random.Random(1)
    words = [x.decode("utf-8", "ignore") for x in codec.labels[:50_000]]
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaa" * 900, " " * 300 + "x", "ttto Alttto", *filter(None, ODD)]
    texts += ["".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(30)) for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        own = codec.encode(text)
        assert list(memoryview(own).cast("I")) == ids
        assert codec.decode(own) == library.decode(ids, skip_special_tokens=False)


def test_automaton_equals_merging_on_a_small_vocabulary():
    letters = "ab"
    labels = [bytes([x]) for x in letters.encode()]
    merges = []
    rng = random.Random(3)
    while len(labels) < 30:
        u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
        if labels[u] + labels[v] not in labels:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    automaton = bpe.Automaton(labels, merges)

    def merged(word):
        own = [labels.index(bytes([b])) for b in word]
        for u, v, w in merges:
            k = 0
            while k < len(own) - 1:
                if own[k : k + 2] == [u, v]:
                    own[k : k + 2] = [w]
                k += 1
        return own

    for size in range(1, 11):
        for word in itertools.product(letters.encode(), repeat=size):
            assert automaton.walk(bytes(word)) == merged(bytes(word))


def test_tokens_of_odd_rows(spark, codec, library):
    got = {(r.doc_id): r for r in bpe.token_digests(docs_of(spark, ODD), codec).collect()}
    for k, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    whole = bpe.with_tokens(docs_of(spark, ODD), codec).collect()
    assert sorted(r.decoded for r in whole) == sorted(t or "" for t in ODD)
    assert bpe.token_digests(docs_of(spark, []), codec).count() == 0


# --- token counts


def test_counts_equal_a_plain_search(spark):
    pieces = {bytes([b]): -9.0 for b in range(256)} | {b"ab": -3.0, b"abc": -12.0, b"bc": -3.0, b"aa": -18.0, b" ab": -4.0}
    trie = token_counts.Trie(pieces)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[i][0] + pieces[word[i:end]], best[i][1] - 1) for i in range(end) if word[i:end] in pieces))
        return -best[-1][1]

    for size in range(1, 8):
        for word in itertools.product(b"abc", repeat=size):
            assert trie.insert(bytes(word)) == plain(bytes(word))
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in token_counts.count_tokens(docs_of(spark, ODD), pieces).collect()}
    split = Splitter().split
    for k, text in enumerate(ODD):
        words = split(text or "")
        assert got[k] == (sum(plain(w.encode()) for w in words if len(w) < 1000) + sum(len(w.encode()) for w in words if len(w) >= 1000), len(words))


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models

    pieces = token_counts.pieces_of(tokenizer_path("byte_bpe_50k.tiktoken"))
    wide = lambda b: "".join(chr(0x100 + x) for x in b)
    model = Tokenizer(models.Unigram([(wide(k), v) for k, v in pieces.items()], unk_id=None, byte_fallback=False))
    trie = token_counts.Trie(pieces)
    for word in {w for t in ODD if t and len(t) < 1000 for w in Splitter().split(t)} | {" international", "unbelievable", "zzqx"}:
        assert trie.insert(word.encode()) == len(model.encode(wide(word.encode())).ids)


# --- media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 160, 161, 162, 169, 170, 171, 184, 500, media.UNIT - 1, media.UNIT, media.UNIT + 1, media.UNIT * 9 + 5])
def test_streams_come_back(n):
    payload = random.Random(n).randbytes(n)
    stream = media.demux(media.mux(payload))
    assert stream.payload == payload and stream.continuity_errors == stream.skipped_bytes == stream.crc_errors == 0
    assert sum(stream.sizes) == n and stream.random_access == [k % media.RAP_EVERY == 0 for k in range(len(stream.sizes))]
    assert stream.pts == [k * media.TICKS for k in range(len(stream.sizes))]


def test_reader_sees_faults():
    payload = bytes(range(256)) * 100
    good = media.mux(payload)
    lost = media.demux(good[: 188 * 5] + good[188 * 6 :])
    assert lost.continuity_errors == 1 and lost.payload != payload
    assert media.demux(b"noise" + good).payload == payload and media.demux(b"noise" + good).skipped_bytes == 5
    twice = media.demux(good[: 188 * 5] + good[188 * 4 : 188 * 5] + good[188 * 5 :])
    assert twice.payload == payload and twice.continuity_errors == 0
    broken = bytearray(good)
    broken[10] ^= 1
    assert media.demux(bytes(broken)).crc_errors == 1
    assert media.demux(b"").payload == media.demux(b"junk" * 500).payload == b""


def test_media_of_odd_rows(spark):
    df = docs_of(spark, ODD).withColumn("media", F.lit(1)).withColumn("feature", F.lit("x"))
    got = {r.doc_id: r for r in media.media_digests(media.stored_media(df)).collect()}
    for k, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[10][1:] == got[11][1:]
    stored = media.read_media(media.with_media(df)).collect()
    assert {bytes(r.payload)[:4] for r in stored} >= {b"same", b"\0\0\0\0"} and all(r.units for r in stored)
    assert media.media_digests(media.stored_media(docs_of(spark, []))).count() == 0


# --- mixing


def mixed_plainly(rows):
    """Capping and resharing by rounds; then the sample in order of keys."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + size(t)
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(per, 0.0), set(per), 1.5 * sum(per.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * per[s]:
                left += target[s] - 2 * per[s]
                target[s] = 2.0 * per[s]
                free.discard(s)
    return per, target


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 300])) + rng.choice(["", " $$$ 12"]), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(600)] + [(None, "x y", "a"), (7, None, None), (8, "dup", "b"), (8, "dup", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash")).withColumn("key", F.lit(0))
    got = mixing.mix(df).collect()
    per, target = mixed_plainly(rows)
    assert len(got) == len(rows)
    for s, n in per.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {n} and own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
        assert all(r.taken <= 2 * r.size and r.taken == r.repeats * r.size for r in own)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    whole = mixing.mixture(df)
    assert whole.columns == df.columns
    counted = {r["doc_id"]: r["n"] for r in whole.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(counted.get(r.doc_id, 0) == r.repeats for r in got if r.doc_id not in (None, 7, 8))


def test_mix_without_words(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}


# --- n-gram join


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [*corpus(rng), None, "", " \n", "one", "ONE", "one two", "one two three four five", "one  two three four five", "é É", "é é"]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(ids[0], texts[0]), (ids[3], texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(df).collect()), key=repr)
    assert got == plain_classes(rows)


def test_classes_of_nothing_and_of_null_ids(spark):
    schema = "doc_id long, text string"
    assert ngram_join.ngram_classes(spark.createDataFrame([], schema)).count() == 0
    empty = ngram_join.ngram_classes(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert sorted(map(tuple, empty)) == [(1, 0, 1), (2, 0, 2)]
    text = "a b c d e f g h"
    ids = ngram_join.ngram_classes(spark.createDataFrame([(None, text), (5, text + " i"), (9, "q")], schema)).collect()
    assert sorted(map(tuple, ids), key=repr) == [(5, 5, 5), (9, 1, 9), (None, 4, 5)]


def test_suffix_filter_never_overstates():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in "xy")
        true = len(np.setxor1d(x, y))
        for depth in range(4):
            assert ngram_join.apart(x, y, 1000, depth) <= true


def test_hashes_are_the_same_in_any_slice(spark):
    import pyarrow as pa

    texts = pa.array([*corpus(random.Random(4), 3, 3), None, "", "a", "ab"])
    whole = ngram_join.sets_of(texts)
    for k in range(len(texts)):
        own = ngram_join.sets_of(texts.slice(k, 1))
        assert own.keys[0] == whole.keys[k] and own.sizes[0] == whole.sizes[k]


# --- language


def test_languages(spark):
    rng = random.Random(2)
    stems = {"aa": ["kar", "lom", "tis"], "bb": ["zug", "wex", "pyr"]}
    word = lambda lang: "".join(rng.choices(stems[lang], k=rng.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(3, 40))), lang, "s", 0) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    odd = [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "123 ½ --", "bb", "s", 0), (1003, rows[0][1], None, "s", 0), (1004, "x" * 30_000, "aa", "s", 0)]
    df = spark.createDataFrame(rows + odd, DOC).withColumn("score", F.lit("clash")).withColumn("word", F.lit(1))
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[r[0]].lang_pred == r[2] for r in rows)
    assert {got[k].lang_pred for k in (1000, 1001, 1002)} == {"und"} and got[1003].lang_pred == rows[0][2]
    nothing = language.fit(df.filter("lang is null"))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_unknown_words_fall_back_to_shorter_parts():
    model = language.model_of([("aa", "karlom", 5), ("bb", "zugwex", 5)], ["aa", "bb"])
    assert model.predict("karlom")[0] == model.predict("lomkar")[0] == model.predict("kar")[0] == "aa"
    assert model.predict("wexzug")[0] == "bb"
    assert model.predict("qqqq")[0] == "aa"  # nothing known: a tie, which goes to the first


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    clean = [f"word{i}" for i in range(300)]
    texts, toxic = [], []
    for _ in range(1500):
        bad = rng.random() < 0.15
        texts.append(" ".join(rng.choices(clean, k=40) + (rng.sample(["scumbag", "rotten", "vermin"], 2) if bad else [])))
        toxic.append(int(bad))
    df = docs_of(spark, [*texts, None, "", texts[0]], [*range(1500), 2000, 2001, 0]).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 2 == 0] + [(1, 1, None), (0, 1, toxic[0])], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert toxicity.score(df, model).count() == 1503
    hits = sum(got[i].predicted == toxic[i] for i in range(1500))
    assert hits >= 1490 and all(0 <= r.score <= 1 for r in got.values())
    assert got[2000].score == got[2001].score < 0.5
    again = toxicity.fit(df.repartition(5), labels.repartition(3))
    assert again.weights == model.weights and again.bias == model.bias
    none = toxicity.fit(df, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_risk_is_not_fitted_below_zero():
    rng = np.random.default_rng(1)
    positive = toxicity.Rows([np.array([0, 1 + k % 40]) for k in range(60)], 41)
    unlabelled = toxicity.Rows([np.array([0, 1 + k % 40]) if k % 10 == 0 else np.array([1 + int(rng.integers(40))]) for k in range(400)], 41)
    w, b = toxicity.train(positive, unlabelled, 0.1)
    assert w[0] + b > 0 > b + np.abs(w[1:]).max()
