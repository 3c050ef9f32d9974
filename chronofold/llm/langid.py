"""Language identification by cross-parsing entropy.

Per language a suffix automaton of a bounded sample of labelled text is built.
A text is parsed from left to right into longest phrases that occur in that
sample; phrases times the bits of one pointer into the sample, per character,
estimate the cross entropy, and the language with the fewest wins.  A text that
no sample describes in far fewer bits than random letters take is in none of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace
from .workers import process_cache, tidy

#: The bounded training sample: rows per language, characters per language, languages.  Rarer labels are never predicted.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_LANGS = 24, 24_000, 256
#: Letters of the sample up to which each has a symbol of its own; beyond, the first half has, and the others have two each.
LETTERS = 200
#: Characters parsed side by side; a longer text's pieces are parsed anew from where the one before ends, until both ways meet.
PIECE = 256
#: Steps of this that all pieces take together before the rest goes on one by one.
RESUMED = 24
#: A text is told from chance if it takes at most CHANCE times the bits of letters at random, and SLACK phrases: a short one tells little.
CHANCE, SLACK = 1.25, 4
UNDETERMINED = "und"
OUT = "lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def training_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, langs: int = SAMPLE_LANGS) -> dict[str, str]:
    """At most ``chars`` characters of ``rows`` distinct texts per language, texts of moderate length first, else by id hash.

    Only rows with text and label outside the held-out part are seen; of more
    than ``langs`` labels the most frequent are learnt.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    moderate = F.length("text").between(200, 8000)
    texts = labelled.select("lang", "text", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("d"))
    # Copies of a text are found by its hash: texts themselves are not shuffled but for those picked.
    distinct = texts.groupBy("lang", "h").agg(F.min("d").alias("d"), F.max(moderate).alias("moderate"))
    order = Window.partitionBy("lang").orderBy(F.desc("moderate"), "d", "h")
    chosen = distinct.select("lang", "h", "d", F.row_number().over(order).alias("k")).where(F.col("k") <= rows).join(F.broadcast(known), "lang", "left_semi")
    one = Window.partitionBy("lang", "k").orderBy("text")
    picked = texts.join(F.broadcast(chosen), ["lang", "h", "d"]).select("lang", "text", "k", F.row_number().over(one).alias("copy")).where(F.col("copy") <= 1)
    found: dict[str, list] = {}
    for r in picked.select("lang", "k", F.left("text", F.lit(chars)).alias("text")).collect():  # rows * langs at most
        found.setdefault(r.lang, []).append((r.k, r.text))
    return {lang: "\n".join(t for _, t in sorted(texts))[:chars] for lang, texts in sorted(found.items())}


def _letters() -> np.ndarray:
    kept = process_cache("cross parsing", "letters")
    if "table" not in kept:
        kept["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["table"]


class Symbols:
    """Small alphabet: 0 for a run of non-letters, then the letters of the sample, one symbol for all others, and padding.

    Alphabets of more than ``LETTERS`` letters spell the rarer ones as two
    symbols, a high and a low digit, so that each letter still differs.
    """

    def __init__(self, texts: dict[str, str]):
        counts = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        chars = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if len(c) == 1]
        direct = len(chars) if len(chars) <= LETTERS else LETTERS // 2
        base = math.isqrt(max(0, len(chars) - direct - 1)) + 1 if len(chars) > direct else 0
        self.other = 1 + direct + 2 * base
        self.pad, self.size = self.other + 1, self.other + 2
        self.first = np.where(_letters(), self.other, 0).astype(np.int32)
        self.second = np.zeros(len(self.first) if base else 0, np.int32)
        for i, c in enumerate(chars):
            high, low = divmod(max(0, i - direct), base) if base else (0, 0)
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.first[ord(form)] = i + 1 if i < direct else 1 + direct + high
                    if i >= direct:
                        self.second[ord(form)] = 1 + direct + base + low

    def of(self, points: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Symbols of the characters, and ``owner`` of each."""
        out = self.first[points]
        if len(self.second):
            low = self.second[points]
            count = 1 + (low > 0)
            out = np.repeat(out, count)
            out[(np.cumsum(count) - 1)[low > 0]] = low[low > 0]
            owner = None if owner is None else np.repeat(owner, count)
        return out, owner


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transition table of the minimal automaton of all substrings; 0 is no transition, state 1 the start."""
    longest, link, moves = [0, 0], [0, 0], [{}, {}]
    last = 1
    for c in symbols:
        new = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.zeros((len(moves), size), np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            table[state, c] = to
    return table


ENDED = np.int32(1 << 30)


class CrossParser:
    """Parses many pieces at once against every language's automaton."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.symbols = Symbols(texts)
        self.tables, self.columns, self.bits, self.chance = [], [], [], []
        for lang in self.langs:
            raw, _ = self.symbols.of(points_of(texts[lang]))
            raw = raw[(raw != 0) | np.concatenate([[True], raw[:-1] != 0])] if len(raw) else raw
            # A table has columns for the symbols of its own sample only, one for all others and one for padding.
            own = np.unique(raw)
            other, pad, size = len(own), len(own) + 1, len(own) + 2
            column = np.full(self.symbols.size, other, np.int32)
            column[own] = np.arange(len(own))
            column[self.symbols.pad] = pad
            full = suffix_automaton(column[raw].tolist(), size)
            dead = full == 0
            # Row 0 stands before any phrase; a letter that the sample lacks is a phrase of its own and leads back there.
            np.copyto(full, full[1].copy(), where=dead)
            full *= size
            full[dead] |= ENDED
            full[:, pad] = np.arange(len(full)) * size
            self.tables.append(full.ravel())
            self.columns.append(column)
            self.bits.append(np.log2(max(2, len(raw))))
            self.chance.append(np.log2(max(2, len(own))))

    def phrases(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Phrases of each text per language; ``symbols``: one row per piece, padded; ``owner``: its text, pieces in order."""
        goes_on = owner[1:] == owner[:-1]
        long = np.concatenate([[False], goes_on]) | np.concatenate([goes_on, [False]])
        out = np.zeros((len(self.langs), n))
        for part, parse in ((~long, self._parse), (long, self._parse_on)):
            if part.any():
                steps, whose = np.ascontiguousarray(symbols[part].T), owner[part]
                for k, (table, place) in enumerate(zip(self.tables, self.columns, strict=True)):
                    out[k] += np.bincount(whose, parse(table, place, steps, whose), n)
        return out

    @staticmethod
    def _parse(table: np.ndarray, place: np.ndarray, steps: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Phrases of each piece by itself."""
        state, count = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
        for column in steps:
            value = table.take(state + place.take(column))
            count += value >> 30
            state = value & (ENDED - 1)
        return count

    @staticmethod
    def _parse_on(table: np.ndarray, place: np.ndarray, steps: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Phrases of each piece as parts of their whole texts.

        All pieces are parsed from the start state at once.  Each is then parsed
        anew from the state in which the one before it ends, until it comes to
        the state it was in before, from where nothing changes: the first
        ``RESUMED`` steps of all pieces together, the few that go on one by one.
        """
        states, begun = np.empty(steps.shape, np.int32), np.empty(steps.shape, bool)
        state = np.zeros(steps.shape[1], np.int32)
        for t, column in enumerate(steps):
            value = table.take(state + place.take(column))
            begun[t] = value >> 30
            states[t] = state = value & (ENDED - 1)
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        ends = states[-1].copy()
        entered = np.zeros(steps.shape[1], np.int32)
        at = later[ends[later - 1] != 0]
        entered[at] = state = ends[at - 1]
        resumed = min(RESUMED, len(steps))
        for t in range(resumed):
            value = table.take(state + place.take(steps[t, at]))
            begun[t, at] = value >> 30
            state = value & (ENDED - 1)
            apart = states[t, at] != state
            states[t, at] = state
            at, state = at[apart], state[apart]
        moves, column_of, goes_on = memoryview(table), memoryview(np.ascontiguousarray(place)), set(later.tolist())
        waiting = at.tolist()[::-1]  # the next piece last
        while waiting:
            piece = waiting.pop()
            first, now = resumed, int(states[resumed - 1, piece])
            if states[-1, piece - 1] != entered[piece]:
                first, now = 0, int(states[-1, piece - 1])
                entered[piece] = now
            symbols, old, new, fresh = steps[first:, piece].tolist(), states[first:, piece].tolist(), [], []
            for symbol, before in zip(symbols, old, strict=True):
                value = moves[now + column_of[symbol]]
                now = value & 0x3FFFFFFF
                new.append(now)
                fresh.append(value >> 30)
                if now == before:
                    break
            states[first : first + len(new), piece] = new
            begun[first : first + len(new), piece] = fresh
            after = piece + 1
            if after in goes_on and states[-1, piece] != entered[after] and not (waiting and waiting[-1] == after):
                waiting.append(after)
        return begun.sum(0)

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Predicted language, score (how far the runner-up's entropy lies above, 0 to 1), and whether it is told from chance."""
        n = len(texts)
        if not self.langs or not n:
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        raw, owner = self.symbols.of(points_of("".join(texts)), np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n)))
        keep = raw != 0
        keep[1:] |= (raw[:-1] != 0) | (owner[1:] != owner[:-1])
        keep[:1] = True
        raw, owner = raw[keep], owner[keep]
        letters = np.bincount(owner, raw != 0, n) > 0
        lengths = np.bincount(owner, minlength=n)
        pieces = -(-lengths // PIECE)
        first = np.cumsum(pieces) - pieces
        at = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        padded = np.full((max(1, int(pieces.sum())), PIECE), self.symbols.pad, np.int32)
        padded[first[owner] + at // PIECE, at % PIECE] = raw
        pointer = np.array(self.bits)[:, None]
        bits = self.phrases(padded, np.repeat(np.arange(n), pieces) if len(raw) else np.zeros(1, np.int64), n) * pointer
        best = bits.argmin(0)
        told = letters & ((bits - SLACK * pointer)[best, np.arange(n)] <= CHANCE * lengths * np.array(self.chance)[best])
        order = np.sort(bits, axis=0)
        score = 1 - order[0] / np.maximum(order[1], 1e-9) if len(self.langs) > 1 else np.ones(n)
        names = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0), told


def _judge(texts: dict[str, str], size: int = 1_000_000):
    """(batch, names, scores, told) of batches with a column ``text``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        kept = process_cache("cross parsing", "parsers")
        key = hash(tuple(texts.items()))
        if key not in kept:
            kept.clear()
            kept[key] = CrossParser(texts)
        parser = kept[key]
        for batch in batches:
            held: list[str] = []
            found: list[tuple] = []
            total = 0
            for value in batch.column("text"):
                held.append(value.as_py() or "")
                total += len(held[-1])
                if total >= size:
                    found.append(parser.classify(held))
                    held, total = [], 0
            found.append(parser.classify(held))
            names, scores, told = zip(*found, strict=True)
            yield batch, [x for part in names for x in part], np.concatenate(scores), np.concatenate(told)

    return judged


def _predict(texts: dict[str, str], keep: list[str]):
    """The columns ``keep`` with the prediction."""
    judged = _judge(texts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, _ in judged(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return rows


def _select(texts: dict[str, str], languages: frozenset[str] | None):
    """Whole rows whose language is told and wanted, a null ``lang`` filled in."""
    judged = _judge(texts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, _, told in judged(batches):
            at = batch.schema.get_field_index("lang")
            if at >= 0 and pa.types.is_string(batch.schema.field(at).type):
                filled = [pred if own is None else own for own, pred in zip(batch.column(at).to_pylist(), names, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(filled, pa.string()))
            good = [ok and (languages is None or name in languages) for ok, name in zip(told.tolist(), names, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return rows


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang), written as a table.

    A prediction reads the text alone.  A null text, or one without a letter,
    is ``und`` with score 0; without any labelled text everything is ``und``.
    Ties go to the alphabetically first language.  Repeated rows keep a row
    each; other columns are not read; an empty table gives an empty result.
    """
    texts = training_texts(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    found = rows.mapInArrow(tidy(_predict(texts, ["doc_id", "held_out"])), f"doc_id {kind}, held_out boolean, {OUT}")
    return Workspace(docs.sparkSession, "languages").table(found, "found")


def language_counts(identified: DataFrame) -> DataFrame:
    """lang_pred, documents, mean_score of the result of :func:`identify`."""
    return identified.groupBy("lang_pred").agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("mean_score"))


def keep_identified(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in one of ``languages`` (default: any that was learnt), all columns, a null ``lang`` filled in.

    A row goes if its text is null or has no letter, if no language's sample
    describes it in ``CHANCE`` times the bits of one letter out of its alphabet
    after another, or less, with ``SLACK`` phrases to spare (random letters take
    nearly twice these bits), or if its predicted language is not wanted.
    Labels that are not null stay.  Without any labelled text every row goes.
    """
    wanted = None if languages is None else frozenset(languages)
    return docs.mapInArrow(tidy(_select(training_texts(docs), wanted)), docs.schema)
