"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments.  A text region within k
edits of a segment of m characters shares at least m - q + 1 - k*q of its
q-grams, on diagonals (text position less segment position) no more than k
apart.  So windows of text with too few known q-grams are skipped; in the rest
shared q-grams are counted per overlapping diagonal band; bands that reach the
bound are verified by banded alignment.  Items shorter than a q-gram are held by
texts that have them word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Workspace
from .textops import mix, utf8_parts
from .workers import process_cache, tidy

#: q-gram length; longest item matched as a whole; length and stride of the segments of longer excerpts; edits allowed
#: per segment character; benchmark bytes handled in one pass.
Q, SEGMENT, PART, STRIDE, EDITS, BLOCK_BYTES = 10, 100, 50, 10, 0.06, 2 << 20
LEAKS = "item_id long, n_segments int, edits int, start int, stop int"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32
#: Six-bit codes: space 0, letters, digits; the bytes of other characters share the rest (q-gram counts only rise by that).
_CODE = np.zeros(256, np.uint64)
_CODE[97:123], _CODE[48:58] = np.arange(1, 27), np.arange(27, 37)
_CODE[128:] = 37 + np.arange(128) % 27


def normalise(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, starts, ends) with A-Z in lower case and runs of other ASCII non-alphanumerics as one space.

    Characters are UTF-8 code units; texts follow one another without a gap.
    """
    low, high = int(starts[0]) if len(starts) else 0, int(ends.max()) if len(ends) else 0
    piece = _FOLD[raw[low:high]]
    keep = piece != 32
    keep[1:] |= piece[:-1] != 32
    edge = np.unique(np.clip(starts - low, 0, max(0, len(piece) - 1)))
    if len(piece):
        keep[edge] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return piece[keep], count[starts - low], count[np.maximum(ends, starts) - low]


def qgrams(text: np.ndarray) -> np.ndarray:
    """Each run of Q = 10 characters as one integer of six-bit codes."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(text) - Q + 1, np.uint64)
    code = _CODE[text]
    for k in range(Q):
        out <<= np.uint64(6)
        out |= code[k : len(text) - Q + 1 + k]
    return out


def segments_of(length: int) -> list[tuple[int, int]]:
    """Segments of an item: all of it if it is short, and parts at a stride; items without a q-gram are matched as words instead.

    A part may begin at every tenth character, so an excerpt is found by its
    length wherever it begins.  The last parts are counted from the end too:
    any hundred characters from there within 6 edits hold one within 3.
    """
    if length < Q:
        return []
    whole = [(0, length)] if length <= SEGMENT else []
    if length <= PART:
        return whole
    starts = {*range(0, length - PART, STRIDE), length - PART, max(0, length - 2 * PART)}
    return whole + [(a, a + PART) for a in sorted(starts)]


class QGramIndex:
    """q-grams of a block of benchmark items, with their places in the segments."""

    def __init__(self, items: list[tuple[int, str]]):
        raw, starts, ends = utf8_parts(pa.array([t for _, t in items], pa.string()))
        text, starts, ends = normalise(raw, starts, ends) if len(raw) else (np.zeros(0, np.uint8), starts, ends)
        self.item, self.short, patterns = [], [], []
        for (item, _), a, b in zip(items, starts, ends, strict=True):
            while a < b and text[a] == 32:
                a += 1
            while a < b and text[b - 1] == 32:
                b -= 1
            if 0 < b - a < Q:
                self.short.append((item, bytes(text[a:b])))
            for x, y in segments_of(int(b - a)):
                self.item.append(item)
                patterns.append(text[a + x : a + y])
        # Short items by length: their numbers, and their characters in two integers, sorted by the first.
        self.by_length = {}
        for n in range(1, Q):
            number = np.array([k for k, (_, word) in enumerate(self.short) if len(word) == n], np.int64)
            whole = np.frombuffer(b"".join(self.short[k][1].ljust(16, b"\0") for k in number), "<u8").reshape(-1, 2)
            by = np.argsort(whole[:, 0], kind="stable")
            self.by_length[n] = (number[by], whole[by, 0], whole[by, 1])
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.budget = np.minimum((self.length * EDITS).astype(np.int64), np.maximum(0, (self.length - Q) // Q))
        self.bound = self.length - Q + 1 - self.budget * Q
        self.patterns = np.zeros((len(patterns), SEGMENT), np.uint8)
        grams, seg, pos = [], [], []
        for i, p in enumerate(patterns):
            self.patterns[i, : len(p)] = p
            g = qgrams(p)
            grams.append(g)
            seg.append(np.full(len(g), i))
            pos.append(np.arange(len(g)))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        self.seg = np.concatenate(seg)[order] if seg else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int64)
        self.grams, self.first, self.count = np.unique(grams, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._cell(self.grams)] = True
        # Windows in which any segment can lie, and the fewest known q-grams such a window holds.
        self.window = int((self.length + self.budget).max(initial=0))
        self.fewest = int(self.bound.min()) if len(patterns) else 1
        self.band = 2 * (int(self.budget.max(initial=0)) + 1)

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return (mix(grams) >> np.uint64(42)).astype(np.int64)

    def hits(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, index of the q-gram) of known q-grams within dense enough windows."""
        grams = qgrams(text)
        at = np.flatnonzero(self.maybe[self._cell(grams)])
        place = np.searchsorted(self.grams, grams[at])
        found = self.grams[np.minimum(place, len(self.grams) - 1)] == grams[at]
        at, place = at[found], place[found]
        owner = np.searchsorted(starts, at, "right") - 1
        inside = at + Q <= ends[owner]
        at, place = at[inside], place[inside]
        if not len(at):
            return at, place
        # A hit stays if some window around it has enough hits: the run of hits of the bound's length reaches it.
        reach = np.zeros(len(at) + 1, np.int64)
        n = self.fewest
        if len(at) >= n:
            tight = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] <= self.window - Q)
            np.add.at(reach, tight, 1)
            np.add.at(reach, tight + n, -1)
        kept = np.cumsum(reach[:-1]) > 0
        return at[kept], place[kept]

    def words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Places of the short items as whole words of the normalised text; ``seg`` is the place in ``short``."""
        out: list[tuple[np.ndarray, ...]] = []
        if self.short and len(text):
            inner = text != 32
            begins = inner.copy()
            begins[1:] &= ~inner[:-1]
            first = starts[starts < len(text)]
            begins[first] = inner[first]
            begin = np.flatnonzero(begins)
            owner = np.searchsorted(starts, begin, "right") - 1
            room = ends[owner] - begin
            eight = np.zeros(len(begin), np.uint64)
            tail = np.zeros(len(begin), np.uint64)
            for n in range(1, Q):  # the first n characters from each word's start, in two integers
                letter = text[np.minimum(begin + n - 1, len(text) - 1)].astype(np.uint64)
                if n <= 8:
                    eight |= letter << np.uint64(8 * (n - 1))
                else:
                    tail |= letter << np.uint64(8 * (n - 9))
                number, head, rest = self.by_length[n]
                if not len(number):
                    continue
                stop = np.minimum(begin + n, len(text) - 1)
                at = np.flatnonzero((room == n) | ((room > n) & ~inner[stop]))
                low, high = np.searchsorted(head, eight[at]), np.searchsorted(head, eight[at], "right")
                at, low, many = np.repeat(at, high - low), low, high - low
                place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(at))
                same = rest[place] == tail[at]
                at, place = at[same], place[same]
                if len(at):
                    begun = begin[at] - starts[owner[at]]
                    out.append((owner[at], number[place], np.zeros(len(at), np.int64), begun, begun + n))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return dict(zip(("text", "seg", "edits", "start", "stop"), columns, strict=True))

    def leaks(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Verified regions: text number, segment, edits, start and stop within the normalised text."""
        none = {k: np.zeros(0, np.int64) for k in ("text", "seg", "edits", "start", "stop")}
        at, place = self.hits(text, starts, ends)
        if not len(at):
            return none
        n = self.count[place]
        spread = np.repeat(self.first[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        seg, pos = self.seg[spread], self.pos[spread]
        diagonal = at - pos + SEGMENT  # not negative
        shift = self.band // 2
        band = np.concatenate([2 * (diagonal // self.band), 2 * ((diagonal + shift) // self.band) + 1])
        seg, pos, at = np.tile(seg, 2), np.tile(pos, 2), np.tile(at, 2)
        owner = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((pos, band, seg, owner))
        owner, seg, band, pos = owner[order], seg[order], band[order], pos[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1]) | (band[1:] != band[:-1])
        distinct = new.copy()
        distinct[1:] |= pos[1:] != pos[:-1]
        cut = np.flatnonzero(new)
        shared = np.add.reduceat(distinct.astype(np.int64), cut)
        ok = shared >= self.bound[seg[cut]]
        owner, seg, band = owner[cut][ok], seg[cut][ok], band[cut][ok]
        if not len(owner):
            return none
        lowest = np.where(band % 2 == 0, band // 2 * self.band, band // 2 * self.band - shift) - SEGMENT
        edits, stop = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for i in range(0, len(owner), 4096):
            s = slice(i, i + 4096)
            edits[s], stop[s] = self.align(text, starts[owner[s]], ends[owner[s]], seg[s], lowest[s])
        good = edits <= self.budget[seg]
        start = np.maximum(stop - self.length[seg], starts[owner])
        return {"text": owner[good], "seg": seg[good], "edits": edits[good], "start": (start - starts[owner])[good], "stop": (stop - starts[owner])[good]}

    def align(self, text: np.ndarray, low: np.ndarray, high: np.ndarray, seg: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits between each segment and any region whose diagonals lie in its band, and that region's end."""
        slack = int(self.budget.max(initial=0))
        width = self.band + 2 * slack + 1
        base = lowest - slack  # diagonal of column 0
        columns = np.arange(width)
        cost = np.zeros((len(seg), width), np.int32)
        length = self.length[seg]
        best, stop = cost.copy(), None
        big = np.int32(1 << 20)
        for row in range(int(length.max())):
            where = base[:, None] + row + columns
            valid = (where >= low[:, None]) & (where < high[:, None])
            letter = text[np.clip(where, 0, len(text) - 1)]
            step = cost + ~(valid & (letter == self.patterns[seg, row][:, None]))
            step = np.minimum(step, np.concatenate([cost[:, 1:], np.full((len(seg), 1), big)], axis=1) + 1)
            step = np.minimum.accumulate(step - columns, axis=1) + columns
            cost = step.astype(np.int32)
            done = length == row + 1
            best[done] = cost[done]
        at = best.argmin(1)
        stop = base + length + at
        return best[np.arange(len(seg)), at].astype(np.int64), np.minimum(stop, high)


def _scan(items: list[tuple[int, str]], keys: list[str], size: int = 1 << 19):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = process_cache("q-gram indexes")
        mark = hash(tuple(items))
        if mark not in kept:
            kept.clear()
            kept[mark] = QGramIndex(items)
        index = kept[mark]
        for batch in batches:
            raw, starts, ends = utf8_parts(batch.column("text"))
            i = 0
            while i < len(starts):
                j = i + 1
                while j < len(starts) and ends[j] - starts[i] <= size:
                    j += 1
                text, a, b = normalise(raw, starts[i:j], ends[i:j])
                for found, items_of in ((index.leaks(text, a, b) if len(index.grams) else None, index.item), (index.words(text, a, b), [x for x, _ in index.short])):
                    if found is None or not len(found["text"]):
                        continue
                    item = np.array(items_of)[found["seg"]]
                    order = np.lexsort((found["start"], found["edits"], found["seg"], item, found["text"]))
                    groups: dict[tuple[int, int], list] = {}
                    for k in order.tolist():
                        groups.setdefault((int(found["text"][k]), int(item[k])), []).append(k)
                    picked = [(t, x, len({int(found["seg"][k]) for k in ks}), int(found["edits"][ks].min()), int(found["start"][ks].min()), int(found["stop"][ks].max())) for (t, x), ks in groups.items()]
                    columns = list(zip(*picked, strict=True))
                    carried = [batch.column(c).slice(i, j - i).take(pa.array(columns[0])) for c in keys]
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(carried + [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)], names=[*keys, "item_id", "n_segments", "edits", "start", "stop"])
                i = j

    return rows


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark (item_id, text) in blocks of bounded size, streamed to the driver; null texts are left out."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_segments, edits, start, stop: items that ``docs`` (doc_id, text) hold, in part or whole.

    A document holds an item if a region of it is within the edit budget of one
    of the item's segments; ``edits`` is the fewest, start and stop bound the
    regions in the normalised text.  A larger benchmark takes one pass over the
    documents per block of ``block_bytes``.  An item of under 10 characters is
    held where it stands as whole words, without edits.  Null or empty texts and
    items hold and match nothing; repeated rows are reported each; other columns
    are not read; an empty benchmark or table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = None
    for block in item_blocks(benchmark, block_bytes):
        part = docs.select("doc_id", "text").mapInArrow(tidy(_scan(block, ["doc_id"])), f"doc_id {kind}, {LEAKS}")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {LEAKS}")
    return Workspace(docs.sparkSession, "leaks").table(out, "found")


def _drop(items: list[tuple[int, str]]):
    scan = _scan(items, ["at"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["at", "text"])
            for found in scan(iter([numbered])):
                good[found.column("at").to_numpy()] = False
            yield batch.filter(pa.array(good))

    return rows


def remove_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item."""
    out = docs
    for block in item_blocks(benchmark, block_bytes):
        out = out.mapInArrow(tidy(_drop(block)), docs.schema)
    return out
