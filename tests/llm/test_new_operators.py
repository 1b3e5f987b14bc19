"""MinHash classes, dominance counts and token alignment against brute-force versions, odd rows included."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tests_llm_corpus import corpus, plain_classes
from tidemark.llm import alignment, dominance, minhash, ngram_join
from tidemark.llm.registry import tokenizer_path

SPLIT_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "hello world  two\n\n three\tfour", "x\r\ny \r z;\r\n", "tab\tstart \t mix", "no▁stand ▁in",
    "<|endoftext|> is plain <s> </s> <unk> <0x0A>", "été 中文文本 no spaces　ideographic", "a b  c  d", "\x1cfs \x1c x", "emoji \U0001f600\U0001f600 ́combining", "it's we'll 'quoted' 1234 5.6①½", "nul\x00byte \x00", "    indented\n        code = 1\n\n\n", "word " * 3000, "z" * 5000, "hello world  two\n\n three\tfour",
]


def plain_alignment(texts):
    """The contract on whole texts, segment by no segment."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    first.encode_special_tokens = True
    letters = alignment.byte_letters()
    label = {k: bytes(letters[c] for c in t) for t, k in first.get_vocab().items()}
    piece = lambda k: bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        whole = " " + (text or "")
        a, b = first.encode(whole, add_special_tokens=False).ids, second.encode(text or "")
        if not text or b"".join(map(label.get, a)) != whole.encode() or b"".join(map(piece, b)) != whole.encode():
            found.append(None)
            continue
        spans = []
        for ids, data in ((a, label.get), (b, piece)):
            ends = np.cumsum([len(data(x)) for x in ids]).tolist()
            spans.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
        # for each byte the token of A and of B that holds it
        at_a = [k for k, (_, s, e) in enumerate(spans[0]) for _ in range(s, e)]
        at_b = [k for k, (_, s, e) in enumerate(spans[1]) for _ in range(s, e)]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(at_a, at_b, strict=True))]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, s, e in spans[0] if s >= low and e <= cut) + "|" + ",".join(str(x) for x, s, e in spans[1] if s >= low and e <= cut))
            low = cut
        counts.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for one in found:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


@pytest.fixture(scope="module")
def both():
    return alignment.tokenizers_of(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_that_of_whole_texts(spark, both):
    rng = random.Random(5)
    alphabet = ["a", "the ", " the", "\n", " ", "  ", "\r", "\t", ";\r\n", "é", "中", "'s", "12", " ", "\u0085", "_", "<s>"]
    texts = SPLIT_TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "x", None) for k, t in enumerate(texts)], "doc_id long, text string, `a.b` string, segment string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.composed(docs, both).collect()}
    want = plain_alignment(texts)
    assert [got[k] for k in range(len(texts))] == want


def test_alignment_of_the_table(spark, both, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.composed(docs, both).collect())
    assert got == sorted((r["doc_id"], *x) for r, x in zip(rows, plain_alignment([r["text"] for r in rows]), strict=True))


def test_alignment_whole_gives_the_ids(spark, both):
    docs = spark.createDataFrame([(None, "some words here"), (1, "some words here"), (1, None)], "doc_id long, text string")
    rows = alignment.composed(docs, both, whole=True).collect()
    ids = both.first.encode(" some words here", add_special_tokens=False).ids
    assert sorted((str(r["doc_id"]), r["a"], sum(r["of_a"]), sum(r["of_b"])) for r in rows) == sorted([("None", ids, len(ids), rows_b := len(both.second.encode("some words here"))), ("1", ids, len(ids), rows_b), ("1", [], 0, 0)])


def test_alignment_of_nothing(spark, both):
    assert alignment.composed(spark.createDataFrame([], "doc_id long, text string"), both).count() == 0


def test_texts_are_split_where_no_vocabulary_merges(both):
    assert " " in both.splitters and "\r" not in both.splitters
    text = " one two\r\n three\n\n four "
    assert "".join(both.pattern().findall(text)) == text
    assert both.pattern().findall(" a\r b c") == [" a\r b", " c"]


def test_very_long_texts_and_pieces(spark, both, monkeypatch):
    text = "alpha beta\n gamma " * 400
    monkeypatch.setattr(alignment, "AT_ONCE", 7)
    want = plain_alignment([text])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in alignment.composed(docs, both).collect()] == want


def plain_dominance(rows):
    def weight(k):
        return 1 + zlib.crc32(("" if k is None else str(k)).encode()) % 2

    points = []
    for k, t, total in rows:
        slot = None if t is None else (t - datetime(1970, 1, 1)) // timedelta(hours=1)
        level = None if total is None or total != total or abs(total) >= 2**55 else int(np.floor(np.floor(100 * total + 0.5) / 100))
        points.append((k, slot, level))
    found = []
    for k, slot, level in points:
        if slot is None or level is None:
            found.append((k, slot, level, None, None))
            continue
        above = [weight(j) for j, s, v in points if s is not None and v is not None and s <= slot and v > level]
        found.append((k, slot, level, len(above), sum(above)))
    return sorted(found, key=repr)


def dominance_case(spark, rows, kind="timestamp_ntz"):
    df = spark.createDataFrame(rows, f"`sale.id` long, t {kind}, total double, slot string, level int")
    return sorted((tuple(r) for r in dominance.rows_above(df, "sale.id", "t", "total").collect()), key=repr)


@pytest.mark.parametrize("blocks", [4, 1024])
def test_dominance_is_that_of_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(dominance, "BLOCKS", blocks)
    monkeypatch.setattr(dominance, "RUN", 16)
    rng = random.Random(blocks)
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(-9000, 9000)), round(rng.choice([rng.uniform(-5, 40), rng.expovariate(0.01)]), 2)) for k in range(500)]
    rows += [(k, datetime(2024, 1, 2, 3), 7.0 + k % 50) for k in range(500, 800)]  # a crowded slot
    rows += [(k, datetime(1969, 12, 31, 23, 59, 59) - timedelta(hours=k), 7.5) for k in range(800, 900)]  # a crowded level, before 1970
    rows += [(None, None, 1.0), (7, datetime(2024, 1, 1), None), (8, datetime(9999, 1, 1), float("nan")), (9, datetime(9999, 1, 1), 1e300), (None, datetime(2024, 1, 1), -0.001), (None, datetime(2024, 1, 1), -0.001), rows[0], rows[0]]
    assert dominance_case(spark, [(*r, "x", 1) for r in rows]) == plain_dominance(rows)


def test_dominance_of_little(spark):
    assert dominance_case(spark, []) == []
    assert dominance_case(spark, [(1, datetime(2024, 1, 1), 2.0, None, None)]) == plain_dominance([(1, datetime(2024, 1, 1), 2.0)])
    assert dominance_case(spark, [(1, None, None, None, None)]) == [(1, None, None, None, None)]


def test_slots_are_the_same_in_any_zone(spark):
    rows = [(k, datetime(2024, 3, 10, k % 24, 30), float(k % 7), None, None) for k in range(48)]
    want = plain_dominance([r[:3] for r in rows])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert dominance_case(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def plain_near_duplicates(rows):
    return [(i, n, c, i == c) for i, n, c in plain_classes(rows, 85)]


def minhash_case(spark, rows):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, `a.b` string, key string")
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize(("seed", "crowd", "block"), [(1, 32, 512), (2, 2, 512), (3, 2, 3)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, seed, crowd, block):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    monkeypatch.setattr(minhash, "SHARD", 300)
    rows = list(enumerate(corpus(random.Random(seed))))
    rows += [(None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "One  TWO"), (None, None), (9006, "w1 " * 40_000)]
    assert minhash_case(spark, rows) == plain_near_duplicates(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash_case(spark, []) == []
    assert minhash_case(spark, [(1, None), (None, "")]) == plain_near_duplicates([(1, None), (None, "")])


def test_minima_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    x, y = np.unique(pool[:2000]), np.unique(pool[500:2500])  # 1500 of 2500
    both = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.12
    whole = minhash.signatures(x, np.array([0, 0, len(x)]))
    assert (whole[1] == both[0]).all() and not whole[0].any()
    many = rng.integers(0, 1 << 63, 3 * minhash.BLOCK).astype(np.uint64)
    once = minhash.signatures(many, np.array([0, len(many)]))
    parts = [minhash.signatures(many[k :: 3], np.array([0, len(many[k :: 3])])) for k in range(3)]
    assert (once == np.minimum.reduce(parts)).all()


def test_pairs_are_given_up_by_the_posterior():
    least = dict(minhash.least_matches())
    assert list(least) == list(range(minhash.BATCH, minhash.MINIMA + 1, minhash.BATCH))
    # the posterior by numerical integration of the likelihood from a uniform prior
    grid = (np.arange(200_000) + 0.5) / 200_000
    for k, m in least.items():
        for agreed, kept in ((m, True), (m - 1, False)):
            weight = np.exp(agreed * np.log(grid) + (k - agreed) * np.log1p(-grid))
            assert (weight[grid >= minhash.UP / minhash.DOWN].sum() / weight.sum() >= minhash.MISS) == kept
    rng = np.random.default_rng(1)
    y = rng.integers(0, 1 << 16, (4000, minhash.MINIMA)).astype(np.uint16)
    for similarity, low, high in ((0.5, 0, 0.001), (0.85, 0.999, 1), (0.95, 1, 1)):
        x = np.where(rng.random(y.shape) < similarity, y, y ^ np.uint16(1))
        assert low <= len(minhash.plausible(x, y)) / len(y) <= high


def test_bands_of_one_band_agree_only_where_rows_do():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 32, (2, minhash.MINIMA)).astype(np.uint32)
    x[1, : minhash.ROWS] = x[0, : minhash.ROWS]
    hashes = minhash.band_hashes(x)
    assert (hashes[0] == hashes[1]).tolist() == [True] + [False] * (minhash.BANDS - 1)
    assert len(set(hashes.ravel().tolist())) == 2 * minhash.BANDS - 1
    assert ngram_join.UP != minhash.UP
