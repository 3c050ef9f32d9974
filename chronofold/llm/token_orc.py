"""Token ids of whole documents in ORC files, in document order.

Spark's ORC writer lays the ids out as run-length-encoded integer streams in
stripes with row indexes, and keeps Bloom filters on the document id, so
readers split files at stripes and skip stripes and row groups by metadata.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace, small_batches
from .textops import base_powers, mix, utf8_parts
from .workers import process_cache, tidy

STORED = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Under this name a worker keeps encoders and hash powers.
OWNER = "piece encoders"
#: Pieces of text whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 600_000
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _odd_spaces(raw: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Spaces (byte positions ``at``; ``last``: last byte of the text) that end the text or precede white space."""
    n = len(raw)
    b1, b2, b3 = (np.where(at + k <= last, raw[np.minimum(at + k, n - 1)], 32) for k in (1, 2, 3))
    odd = ((b1 >= 9) & (b1 <= 13)) | ((b1 >= 28) & (b1 <= 32))
    odd |= (b1 == 0xC2) & ((b2 == 0x85) | (b2 == 0xA0))
    odd |= (b1 == 0xE1) & (b2 == 0x9A) & (b3 == 0x80)
    odd |= (b1 == 0xE2) & (((b2 == 0x80) & ((b3 <= 0x8A) | (b3 == 0xA8) | (b3 == 0xA9) | (b3 == 0xAF))) | ((b2 == 0x81) & (b3 == 0x9F)))
    return odd | ((b1 == 0xE3) & (b2 == 0x80) & (b3 == 0x80))


_ALPHA, _OTHER, _MARK, _BREAK, _SEEN = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = _ALPHA if _c.isalpha() else _OTHER if _c != " " else 0
    _KIND[_b] |= (_MARK if 33 <= _b <= 126 and not _c.isalnum() and _c != "'" else 0) | (_BREAK if _c in "\t\n\r" else 0) | (_SEEN if 33 <= _b <= 126 else 0)


def _kinds(raw: np.ndarray) -> np.ndarray:
    """What each byte is: of a letter (ASCII or Latin-1), other ASCII, a mark (no apostrophe), a line break or tab, not white space."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the signs for times and divided by
    kind[lead] = kind[lead + 1] = _ALPHA | _SEEN
    return kind


def _word_edges(kind: np.ndarray) -> np.ndarray:
    """Where the pattern of byte-level tokenizers starts anew in any text (True at the first byte after such a place).

    A letter ends its word before other ASCII; a word starts after a mark, as
    marks take no letters (an apostrophe can), and after a single break: of more
    the last stands alone, which a piece that ends there would not show.
    """
    edge = np.zeros(len(kind), bool)
    before, after = kind[:-1], kind[1:]
    edge[1:] = ((before & _ALPHA) != 0) & ((after & _OTHER) != 0)
    edge[1:] |= ((before & _MARK) != 0) & ((after & _ALPHA) != 0)
    edge[2:] |= ((kind[:-2] & _SEEN) != 0) & ((before[1:] & _BREAK) != 0) & ((after[1:] & _ALPHA) != 0)
    return edge


def spans_of(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions begin[0], begin[0]+1, ... of all spans one after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceEncoder:
    """Encode texts piece by piece, remembering the ids of pieces.

    The byte-level pre-tokenizer always starts a new word at a space that
    stands alone before a non-space, so the ids of a text are the ids of its
    pieces cut there; where the file names the usual byte-level pattern, pieces
    are cut at the edges of words as well (see :func:`_word_edges`), so that a
    word is learnt once, whatever mark follows it.  Texts with other spaces, or with the string of an added
    token of the file, are encoded whole, as the library does.  Pieces are
    known by a 64-bit hash of their bytes in an open-addressing table.  New
    pieces are encoded joined, some thousands at a time; the byte lengths of
    the vocabulary's entries tell where each piece ends.
    """

    JOINED = 3000
    SLOTS = 1 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.joined = 1 if any(b" " in a or b"\n" in a for a in self.added) else self.JOINED  # joined pieces must not form one
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        self.words = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) is True and not cut.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, i in vocabulary.items():
            self.bytes_of[i] = len(word)  # the vocabulary writes each byte as one character
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.values = np.full(self.SLOTS, -1, np.int32)
        self.flat = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(left):
            value, key = self.values[slot], self.keys[slot]
            hit = (value >= 0) & (key == hashes[left])
            out[left[hit]] = value[hit]
            on = (value >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def _insert(self, hashes: np.ndarray) -> None:
        """New distinct pieces, numbered on from those known."""
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.values[slot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True  # one newcomer a slot
            put = free & first
            self.keys[slot[put]] = hashes[left[put]]
            self.values[slot[put]] = self.known + left[put]
            left, slot = left[~put], np.where(free & ~first, slot, (slot + 1) & (self.SLOTS - 1))[~put]
        self.known += len(hashes)

    def _learn(self, raw: np.ndarray, kind: np.ndarray, hashes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        spaced = raw[begin] == 32
        word = np.zeros(len(begin), bool)
        if self.words and self.joined > 1:  # joined by line breaks, whose ids are dropped
            word = ((kind[begin] & _ALPHA) != 0) & ((kind[begin + length - 1] & _ALPHA) != 0)
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(word), np.flatnonzero(~spaced & ~word)])
        hashes, begin, length, tail = hashes[order], begin[order], length[order], word[order].astype(np.int64)
        n_spaced, n_joined = int(spaced.sum()), int((spaced | word).sum())
        groups = [(i, min(i + self.joined, end)) for first, end in ((0, n_spaced), (n_spaced, n_joined)) for i in range(first, end, self.joined)]
        groups += [(i, i + 1) for i in range(n_joined, len(begin))]
        ends = np.cumsum(length + tail)
        written = np.full(int(ends[-1]), 10, np.uint8)
        written[spans_of(ends - length - tail, length)] = raw[spans_of(begin, length)]
        bounds = np.concatenate([[0], ends])
        texts = [written[bounds[a] : bounds[b]].tobytes().decode() for a, b in groups]
        found = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        done = np.cumsum(self.bytes_of[ids])
        at = np.searchsorted(done, ends)
        breaks = at[tail == 1]
        if not np.array_equal(done[np.minimum(at, len(done) - 1)], ends) or (self.bytes_of[ids[breaks]] != 1).any():
            raise ValueError("the tokenizer does not cut at single spaces")
        ids, at = np.delete(ids, breaks), at - np.cumsum(tail)
        used = int(self.starts[self.known])
        while self.known + len(begin) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.starts[self.known + 1 : self.known + 1 + len(begin)] = used + at + 1
        self._insert(hashes)

    def _held(self, raw: np.ndarray) -> np.ndarray:
        """Places in ``raw`` where the string of an added token begins."""
        whole, found = raw.tobytes(), []
        for content in self.added:
            at = whole.find(content)
            while at >= 0:
                found.append(at)
                at = whole.find(content, at + 1)
        return np.array(found, np.int64)

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (bytes starts[i] to ends[i] of ``raw``)."""
        if self.known > REMEMBERED:
            self.clear()
        low, high = (int(starts.min()), int(ends.max())) if len(starts) else (0, 0)
        raw, starts, ends = raw[low:high], starts - low, ends - low
        counts, filled = np.zeros(len(starts), np.int64), np.flatnonzero(ends > starts)
        if not len(filled):
            return np.zeros(0, np.int32), counts
        space = raw == 32
        kind = _kinds(raw)
        edge = space | _word_edges(kind) if self.words else space.copy()
        edge[starts[filled]] = True
        begin = np.flatnonzero(edge)
        owner = np.searchsorted(starts[filled], begin, "right") - 1
        last = ends[filled][owner]
        inside = begin < last  # bytes between texts (under nulls) belong to none
        begin, owner, last = begin[inside], owner[inside], last[inside]
        stop = np.minimum(np.append(begin[1:], len(raw)), last)
        at = np.flatnonzero(raw[begin] == 32)
        special = np.searchsorted(starts[filled], self._held(raw), "right") - 1
        odd = np.unique(np.concatenate([owner[at[_odd_spaces(raw, begin[at], last[at] - 1)]], special[special >= 0]]))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * base_powers(len(raw), owner=OWNER), out=total[1:])
        hashes = mix(((total[stop] - total[begin]) * base_powers(len(raw), inverse=True, owner=OWNER)[begin]) ^ ((stop - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        if len(odd):
            plain = ~np.isin(owner, odd)
            begin, stop, owner, hashes = begin[plain], stop[plain], owner[plain], hashes[plain]
        number = self._find(hashes)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new = fresh[np.unique(hashes[fresh], return_index=True)[1]]
            for i in range(0, len(new), REMEMBERED):
                self._learn(raw, kind, hashes[f := new[i : i + REMEMBERED]], begin[f], stop[f] - begin[f])
            number[fresh] = self._find(hashes[fresh])
        n = self.starts[number + 1] - self.starts[number]
        flat = self.flat[spans_of(self.starts[number], n)]
        counts[filled] = np.bincount(owner, n, len(filled)).astype(np.int64)
        if len(odd):
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i in filled[odd]:
                parts[i] = np.asarray(self.tokenizer.encode(raw[starts[i] : ends[i]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts


def _encode(path: str | None, end_id: int, batch_bytes: int = 1_000_000):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = path
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("byte_bpe_50k.json")
        cache = process_cache(OWNER)
        if file not in cache:
            cache[file] = PieceEncoder(file)
        encoder, part, at = cache[file], TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, starts, ends = utf8_parts(batch.column("text"))
            i = 0
            while i < len(starts):
                j = i + 1
                while j < len(starts) and ends[j] - starts[i] <= batch_bytes:
                    j += 1
                found, counts = encoder.encode(raw, starts[i:j], ends[i:j])
                stop = np.cumsum(counts + 1)
                flat = np.full(int(stop[-1]), end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[stop - 1] = False
                flat[inner] = found
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(flat))
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at + stop - counts - 1), pa.array((counts + 1).astype(np.int32)), lists]
                at += int(stop[-1])
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                i = j

    return encode


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


class TokenStore:
    """Token ids under ``path``: one ORC file per range of document ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, stripe_bytes: int = 64 << 20, row_stride: int = 1000, partitions: int | None = None) -> TokenStore:
        """Encode ``docs`` (doc_id, text) in ascending doc_id order (ties by text; null ids first; a null text is empty)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
        tokens = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(tidy(_encode(tokenizer, end_id)), STORED)
        options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(row_stride), "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true"}
        with small_batches(docs.sparkSession):
            tokens.write.mode("overwrite").options(**options).orc(path)
        return cls(docs.sparkSession, path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(STORED).orc(self.path)

    def lookup(self, doc_ids: Sequence[int]) -> DataFrame:
        """Rows of a few documents; min/max and Bloom filters skip the other stripes and row groups."""
        return self.read().where(F.col("doc_id").isin(list(doc_ids)))

    def starts(self) -> DataFrame:
        """part, part_start: ids in all files before (one row per file)."""
        sizes = self.read().groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def digest(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 as read back from the files."""
        rows = self.read().select("doc_id", "part", "local_start", "ids").mapInArrow(tidy(_checksums), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
        placed = rows.join(F.broadcast(self.starts()), "part")  # a row per file
        return placed.select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token ORC files below the shared folder and digest what is read back.

    Repeated doc_ids keep a row each.  An empty table gives an empty result;
    columns other than doc_id and text are not read.
    """
    work = Workspace(docs.sparkSession, "tokens")
    return TokenStore.write(docs, work.path("orc"), **options).digest()
