"""Alignment of two tokenizers' tokens over a corpus, by distinct segments.

A is a byte-level BPE vocabulary of the tokenizers library, B a BPE model of sentencepiece with byte fallback; A encodes a
space and the text, B the text, before which it puts a space itself. Texts are split before runs of white space that begin
with a character across whose left edge neither vocabulary can merge, which `split_characters` verifies: A's pre-splitting
never joins other characters to white space after them, and no piece of B has such a character after another one that is
no white space. So a segment's tokens are the same in every text, and each distinct segment is tokenised and aligned once.

Documents are read once and become bundles: a document is its segments' places in the bundle's list of distinct segments. A
bundle is what a task has read, up to BUNDLE_BYTES of texts or one longer text. Lists are joined to the alignments by
segment and meet their documents by bundle, where documents are composed; what moves follows the distinct segments of a
bundle, not its words. This also counts in how many documents each id pair is linked. A segment's sums over its links
follow from these counts by joins on numbers, and a second meeting adds them up for documents.

Null and empty texts have no tokens. Nor have texts whose tokens do not spell them: those with the stand-in for a space of
B, U+2581, in them. Rows that repeat are documents of their own and count each. Texts of any length are taken whole; one
without white space is one segment. No rows give no rows; columns other than id and text are dropped.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tidemark.llm.bpe import byte_letters
from tidemark.llm.ngram_join import planes, unplanes
from tidemark.llm.shared import SLICE_BYTES, forget, give_back, map_batches, slices, spread, written

#: The stand-in for a space in B's pieces.
STAND_IN = "▁"
#: White space before which texts may be split, if the vocabularies allow it.
SPLITTERS = " \n\t\r\x0b\x0c"
#: Bytes of texts in a bundle, and segments that a document composes at once.
BUNDLE_BYTES = 48 << 20
AT_ONCE = 1 << 16


class Tokenizers:
    """Both tokenizers from the contents of their files, made anew in each worker."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = a, b
        self.open()
        self.splitters = self.split_characters()

    def open(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel enough
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(self.a)
        self.first.encode_special_tokens = True
        self.first.no_padding()
        self.first.no_truncation()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=self.b)
        letters = byte_letters()
        self.label = {}
        for text, k in self.first.get_vocab(with_added_tokens=True).items():
            own = [letters.get(c) for c in text]
            data = text.encode() if None in own else bytes(own)
            self.label[k] = len(data), data
        self.piece = {}
        for k in range(self.second.get_piece_size()):
            text = self.second.id_to_piece(k)
            data = bytes([int(text[3:5], 16)]) if self.second.is_byte(k) else text.replace(STAND_IN, " ").encode()
            self.piece[k] = len(data), data
        self.space = self.second.piece_to_id(STAND_IN)
        # sizes and bytes by id, looked up for every token
        self.sides = [({k: n for k, (n, _) in of.items()}.__getitem__, {k: data for k, (_, data) in of.items()}.__getitem__) for of in (self.label, self.piece)]
        # an id pair is one number: the id of A times the number of B's pieces, and the id of B
        self.base = self.second.get_piece_size()
        self.pair_kind = np.uint32 if (max(self.label) + 1) * self.base <= 1 << 32 else np.uint64

    def __getstate__(self) -> dict:
        return {"a": self.a, "b": self.b, "splitters": self.splitters}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.open()

    def split_characters(self) -> str:
        """The characters before which a run of white space can be split off: checked against both vocabularies.

        A has to pre-split by its pattern, without a prefix space or a normalizer, and no token added to it may hold white
        space. No piece of B may have the character after one that is no white space, or after its own stand-in unless
        it is that stand-in.
        """
        spec = json.loads(self.a)
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        if not plain or any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ()) if not t.get("special")):
            return ""
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size()) if not self.second.is_byte(k)]
        found = []
        for c in SPLITTERS:
            own = STAND_IN if c == " " else c
            across = re.compile(rf"[^\s{STAND_IN}]{own}" if c == " " else rf"\S{re.escape(own)}")
            if not any(map(across.search, pieces)):
                found.append(c)
        return "".join(found)

    def pattern(self) -> re.Pattern:
        """The segments of a text: what begins with white space that cannot be split off is joined to what it follows."""
        if not self.splitters:
            return re.compile(r"[\s\S]+")
        return re.compile(rf"\s*\S+(?:[^\S{re.escape(self.splitters)}]\s*\S*)*|\s+")

    def encode_second(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments; the space that B puts before one is the segment's own or is taken away again."""
        found = self.second.encode([s[1:] if s.startswith(" ") else s for s in segments], num_threads=1) if segments else []
        for k, (segment, ids) in enumerate(zip(segments, found, strict=True)):
            if segment.startswith(" "):
                if len(segment) == 1:
                    found[k] = [self.space]
            elif ids[:1] != [self.space]:
                raise ValueError("a piece joins the leading space to a character before which texts are split")
            else:
                found[k] = ids[1:]
        return found

    def align(self, segments: list[str]) -> Iterator[tuple[str, list[int], list[int], bool]]:
        """For each segment: its groups as text, how many tokens of A and of B and groups it has, its linked pairs, and whether both spell it."""
        firsts = self.first.encode_batch_fast(segments, add_special_tokens=False)  # without offsets, which no one reads
        (_, of_a), (_, of_b) = self.sides
        for segment, encoded, b in zip(segments, firsts, self.encode_second(segments), strict=True):
            a, data = encoded.ids, segment.encode()
            if b"".join(map(of_a, a)) != data or b"".join(map(of_b, b)) != data:
                yield "", [0, 0, 0], [], False
                continue
            groups, links = self.groups(a, b)
            yield ";".join(groups), [len(a), len(b), len(groups)], links, True

    def groups(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """The groups between offsets where tokens of both end, as text, and a pair of ids for each overlap of two tokens."""
        ends_a, ends_b = (list(accumulate(map(size, ids))) for ids, (size, _) in zip((a, b), self.sides, strict=True))
        said_a, said_b = list(map(str, a)), list(map(str, b))
        found, links = [], []
        i = j = from_i = from_j = 0
        while i < len(a) and j < len(b):
            links.append(a[i] * self.base + b[j])
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                found.append(f"{','.join(said_a[from_i:i])}|{','.join(said_b[from_j:j])}")
                from_i, from_j = i, j
        return found, links


def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    """Read on the driver; executors get the contents."""
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        return Tokenizers(f.read(), g.read())


def fields(text: str) -> list[StructField]:
    """Fields from names and kinds, such as 'a long, b binary'."""
    return StructType.fromDDL(text).fields


class Numbered(dict):
    """Numbers from 0 of the keys that are looked up, in order of their first look-up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def bundles(docs: DataFrame, tokenizers: Tokenizers, id_column: str, text_column: str) -> DataFrame:
    """A written table of two kinds of rows: (bundle, place, segment) of distinct segments, and (bundle, row, id, places) of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    schema = StructType([*fields("bundle long, place int, segment string"), StructField("id", docs.schema[id_column].dataType), *fields("row int, places binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = shared.value.pattern()
        known = Numbered()
        name, size, rows_before = 0, 0, 0

        def numbers(matches: list[str]) -> np.ndarray:
            return np.fromiter(map(known.__getitem__, matches), np.uint32, len(matches))

        def places(text: str | None) -> bytes:
            if not text or STAND_IN in text:
                return b""
            text = " " + text
            if len(text) <= 1 << 20:
                return planes(numbers(pattern.findall(text)))
            found, matches = [], (m[0] for m in pattern.finditer(text))
            while some := list(islice(matches, AT_ONCE)):
                found.append(numbers(some))
            return planes(np.concatenate(found))

        def lists() -> Iterator[pa.RecordBatch]:
            names = iter(list(known))
            at = 0
            while some := list(islice(names, 1000)):
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.int64()), pa.array(range(at, at + k), pa.int32()), pa.array(some, pa.string()), pa.nulls(k, kind), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=schema.names)
                at += k
            known.clear()

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                kind = part.column(0).type
                if size and size + part.nbytes > BUNDLE_BYTES:
                    yield from lists()
                    size = 0
                if not size:
                    name, rows_before = int.from_bytes(os.urandom(8), "little") >> 1, 0
                size += part.nbytes + 1
                rows = [places(text.as_py()) for text in part.column(1)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), part.column(0), pa.array(range(rows_before, rows_before + n), pa.int32()), pa.array(rows, pa.binary())], names=schema.names)
                rows_before += n
        if size:
            yield from lists()
        give_back()

    rows = spread(docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")))
    return written(rows.mapInArrow(run, schema), "bundles")


def alignments(found: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(segment, own, spelled, groups, n_a, n_b, n_groups, links) of every distinct segment of bundles; own: a number of its own, links packed."""
    shared = found.sparkSession.sparkContext.broadcast(tokenizers)
    schema = StructType(fields("segment string, own long, spelled boolean, groups string, n_a int, n_b int, n_groups int, links binary"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        tool = shared.value
        # numbers from a place of each task's own among 2^63
        own = count(int.from_bytes(os.urandom(5), "little") << 23)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not batch.num_rows:
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.string()), *(pa.array([], pa.int32()) for _ in range(3)), pa.array([], pa.binary())], names=schema.names)
            groups, sizes, links, spelled = zip(*tool.align(batch.column(0).to_pylist()), strict=True)
            ids = pa.array(list(islice(own, batch.num_rows)), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(spelled), pa.array(groups), *(pa.array(x, pa.int32()) for x in zip(*sizes, strict=True)), pa.array([np.array(x, tool.pair_kind).tobytes() for x in links], pa.binary())], names=schema.names)

        return work

    distinct = found.filter("segment is not null").select("segment").distinct()
    return written(map_batches(distinct, schema, make, 1 << 20), "alignments")


#: Rows of one task that are packed together, and bytes from which a pack is compressed.
PACK_ROWS, LEAST_PACK = 1 << 18, 256


def packs(rows: DataFrame, names: dict[str, type], texts: str | None = None, blobs: str | None = None) -> DataFrame:
    """(bundle, pack) of rows: what a task has of a bundle as one value, column by column, instead of a row each.

    names: columns of whole numbers and their kinds; texts: a column of texts without line ends, blobs: one of bytes. A pack
    of few rows is not larger than they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(gathered)
            table = table.take(pa.array(np.argsort(table.column("bundle").to_numpy(), kind="stable")))
            bundle = table.column("bundle").to_numpy()
            cuts = [*np.flatnonzero(np.diff(bundle, prepend=-1)).tolist(), len(bundle)]
            numbers = {n: table.column(n).to_numpy(zero_copy_only=False).astype(kind) for n, kind in names.items()}
            lines, raw = table.column(texts).to_pylist() if texts else [], table.column(blobs).to_pylist() if blobs else []
            lengths = np.array(list(map(len, raw)), np.uint32)
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                parts = [planes(x[a:b]) for x in numbers.values()] + ([planes(lengths[a:b]), b"".join(raw[a:b])] if blobs else [])
                data = b"".join([*parts, *(["\n".join(lines[a:b]).encode()] if texts else [])])
                small = len(data) < LEAST_PACK
                found.append((b - a).to_bytes(4, "little") + (0 if small else len(data)).to_bytes(8, "little") + (data if small else pa.compress(data, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(bundle[cuts[:-1]]), pa.array(found, pa.binary())], names=["bundle", "pack"])

        for batch in batches:
            gathered.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield from flush()
                gathered, size = [], 0
        if size:
            yield from flush()
        gathered = []
        give_back()

    return rows.select("bundle", *names, *([blobs] if blobs else []), *([texts] if texts else [])).mapInArrow(run, "bundle long, pack binary")


def unpacked(found: list[bytes], names: dict[str, type], texts: bool = False, blobs: type | None = None) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """The numbers, texts, joined blobs and how many values each has, of all packs of a bundle, in order of `place`."""
    numbers, lines, values, lengths = {n: [np.empty(0, kind)] for n, kind in names.items()}, [], [np.empty(0, blobs or np.uint8)], [np.empty(0, np.uint32)]
    for pack in found:
        rows, size = int.from_bytes(pack[:4], "little"), int.from_bytes(pack[4:12], "little")
        data = pa.decompress(pack[12:], size, "zstd", asbytes=True) if size else pack[12:]
        at = 0
        for n, kind in names.items():
            width = np.dtype(kind).itemsize * rows
            numbers[n].append(unplanes(data[at : at + width], kind))
            at += width
        if blobs:
            lengths.append(unplanes(data[at : at + 4 * rows], np.uint32))
            at += 4 * rows
            width = int(lengths[-1].sum())
            values.append(np.frombuffer(data[at : at + width], blobs))
            at += width
        if texts:
            lines += data[at:].decode().split("\n")
    joined = {n: np.concatenate(x) for n, x in numbers.items()}
    order = np.argsort(joined["place"], kind="stable")
    joined = {n: x[order] for n, x in joined.items()}
    counts = np.concatenate(lengths).astype(np.int64) // np.dtype(blobs or np.uint8).itemsize
    starts, flat = np.cumsum(counts) - counts, np.concatenate(values)
    counts, starts = (counts[order], starts[order]) if blobs else (counts, starts)
    return joined, [lines[k] for k in order.tolist()] if texts else lines, gathered(flat, starts, counts), counts


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at starts, one after another."""
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return values[np.repeat(starts, counts) + within]


def meet(docs: DataFrame, packed: DataFrame) -> PandasCogroupedOps:
    """Documents and the packs of their bundles; only a bundle's rows are in one place."""
    own = docs.select(F.col("bundle").alias("own_bundle"), *(c for c in docs.columns if c != "bundle"))
    return own.groupBy("own_bundle").cogroup(packed.groupBy("bundle"))


def parsed(groups: list[str]) -> list[list[int]]:
    """Ids of A, ids of B, and how many of each every group has, from groups as text."""
    sides = [[x.split(",") for x in g.split("|")] for text in groups for g in text.split(";")]
    a, b = ([list(map(int, side[k])) for side in sides] for k in (0, 1))
    return [[x for g in a for x in g], [x for g in b for x in g], list(map(len, a)), list(map(len, b))]


ARRAYS = ["a", "b", "of_a", "of_b"]


def composed(docs: DataFrame, tokenizers: Tokenizers, whole: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for every row of docs: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    whole: the alignment itself too, as arrays: ids of A, ids of B, and how many of each every group has.
    """
    found = bundles(docs, tokenizers, id_column, text_column)
    aligned = alignments(found, tokenizers)
    lists = found.filter("segment is not null").select("bundle", "place", "segment")
    first = _first_meeting(found, lists.join(aligned, "segment"), tokenizers.pair_kind, whole)
    pairs = written(first.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    sums = segment_sums(aligned, pairs, tokenizers)
    named = written(sums.join(aligned.select("own", "segment"), "own").select("segment", "n_best", "count_sum"), "sums")
    forget(aligned)
    out = _second_meeting(first.filter("row is not null"), lists.join(named, "segment"), whole)
    forget(found, first, pairs, named)
    return out.withColumnRenamed("id", id_column)


#: Numbers of a segment that the two meetings need.
FIRST = {"place": np.uint32, "spelled": np.uint8, "n_a": np.uint32, "n_b": np.uint32, "n_groups": np.uint32}
SECOND = {"place": np.uint32, "n_best": np.uint32, "count_sum": np.uint64}


def _first_meeting(found: DataFrame, entries: DataFrame, pair_kind: type, whole: bool) -> DataFrame:
    """Rows of documents, composed: (bundle, row, id, places, n_a, n_b, n_groups, n_links, groups_sha256), and of pairs: (pair, n).

    n: in how many documents of the bundle the pair is linked. The places of documents without tokens are gone.
    """
    kind = found.schema["id"].dataType
    schema = StructType([*fields("pair long, n long, bundle long, row int, places binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"), StructField("id", kind), *(StructField(n, ArrayType(IntegerType())) for n in (ARRAYS if whole else []))])

    def compose(docs: pa.Table, entries: pa.Table) -> pa.Table:
        numbers, texts, links, n_links = unpacked(entries.column("pack").to_pylist(), FIRST, True, pair_kind)
        entries = None
        spelled, begins = numbers["spelled"] > 0, np.cumsum(n_links) - n_links
        sizes = np.stack([*(numbers[n].astype(np.int64) for n in ("n_a", "n_b", "n_groups")), n_links], axis=1)
        total, counts, waiting, size = np.empty(0, pair_kind), np.empty(0, np.int64), [], 0

        def add_up() -> None:
            nonlocal total, counts, waiting, size
            new, at = np.unique(np.concatenate([total, *waiting]), return_inverse=True)
            weights = np.ones(len(at), np.int64)
            weights[: len(total)] = counts
            total, counts, waiting, size = new, np.bincount(at, weights, len(new)).astype(np.int64), [], 0

        sums, digests, blobs, lists = np.zeros((docs.num_rows, 4), np.int64), [], [], [[] for _ in ARRAYS]
        for k, blob in enumerate(docs.column("places").to_pylist()):
            places = unplanes(blob, np.uint32)
            if len(places) and not spelled[places].all():
                places, blob = places[:0], b""
            sha, before = hashlib.sha256(), b""
            for at in range(0, len(places), AT_ONCE):
                some = places[at : at + AT_ONCE]
                sums[k] += sizes[some].sum(axis=0)
                sha.update(before + ";".join(map(texts.__getitem__, some.tolist())).encode())
                before = b";"
            digests.append(sha.hexdigest() if len(places) else "")
            blobs.append(blob)
            own = np.unique(places)
            waiting.append(np.unique(gathered(links, begins[own], n_links[own])))
            size += len(waiting[-1])
            if size > 1 << 21:
                add_up()
            if whole:
                for x, part in zip(lists, parsed([texts[p] for p in places.tolist()]), strict=True):
                    x.append(part)
        add_up()
        n, m, name = docs.num_rows, len(total), docs.column("own_bundle")
        of_docs = {"bundle": name, "row": docs.column("row"), "places": pa.array(blobs, pa.binary()), **{c: pa.array(sums[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": pa.array(digests, pa.string()), "id": docs.column("id"), **{c: pa.array(x, pa.list_(pa.int32())) for c, x in zip(ARRAYS, lists, strict=True) if whole}}
        of_pairs = {"pair": pa.array(total.astype(np.int64)), "n": pa.array(counts)}
        both = [{c: of.get(c) for c in schema.names} for of in (of_docs, of_pairs)]
        kinds = {"pair": pa.int64(), "n": pa.int64()} | {c: x.type for c, x in of_docs.items()}
        give_back()
        return pa.concat_tables([pa.table({c: pa.nulls(rows, kinds[c]) if x is None else x for c, x in of.items()}) for rows, of in zip((n, m), both, strict=True)])

    docs = found.filter("row is not null").select("bundle", "row", "id", "places")
    # a table between the join and the meeting, so that the shuffle of one is gone before the other's
    packed = written(packs(entries, FIRST, "groups", "links"), "packs")
    first = written(meet(docs, packed).applyInArrow(compose, schema), "first")
    forget(packed)
    return first


def segment_sums(aligned: DataFrame, pairs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(own, n_best, count_sum): over a segment's links, how many have the highest count of their A id, and the sum of counts."""
    kind, base = tokenizers.pair_kind, tokenizers.base

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            links = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in links])
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate([np.empty(0, kind), *links]).astype(np.int64))], names=["own", "pair"])

        return work

    links = map_batches(aligned.filter("spelled").select("own", "links"), "own long, pair long", make)
    top = pairs.groupBy(F.expr(f"pair div {base}").alias("a")).agg(F.max("n").alias("top"))
    ranked = pairs.withColumn("a", F.expr(f"pair div {base}")).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    return links.join(ranked, "pair").groupBy("own").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def _second_meeting(first: DataFrame, entries: DataFrame, whole: bool) -> DataFrame:
    """The documents of the first meeting with n_best and count_sum, their segments' sums added up."""
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(ARRAYS if whole else [])]
    schema = StructType([first.schema["id"], *fields("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), *(first.schema[c] for c in kept[6:])])

    def add(docs: pa.Table, entries: pa.Table) -> pa.Table:
        numbers, *_ = unpacked(entries.column("pack").to_pylist(), SECOND)
        # segments without tokens are in no list here, and in no document that has places
        own = np.zeros((int(numbers["place"].max(initial=0)) + 1, 2), np.int64)
        own[numbers["place"]] = np.stack([numbers["n_best"], numbers["count_sum"]], axis=1).astype(np.int64)
        sums = [own[unplanes(blob, np.uint32)].sum(axis=0).tolist() if blob else (0, 0) for blob in docs.column("places").to_pylist()]
        best, counted = (pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1))
        return pa.table({c: best if c == "n_best" else counted if c == "count_sum" else docs.column(c) for c in schema.names})

    return written(meet(first.select("bundle", "places", *kept), packs(entries, SECOND)).applyInArrow(add, schema), "composed")
