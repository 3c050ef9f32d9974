"""Hidden Markov language model over words, trained by Baum-Welch on all training documents.

The model emits, from each latent state, one of the most frequent words, the
end of the text, or a rare word; a rare word then is drawn by its add-one
smoothed share of all rare occurrences.  Word counts cover all training
documents: texts are coded chunk by chunk against a dictionary of the chunk,
whose entries are counted across chunks by hash range and come back as codes.
Expected counts are summed across partitions; the scaled forward recursion
gives the exact likelihood of every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .textops import utf8_parts, words
from .workers import tidy

#: Latent states; words with emissions of their own; Baum-Welch passes over the corpus; bytes of text coded together.
STATES, VOCABULARY, PASSES, CHUNK = 6, 2000, 4, 12 << 20
#: Dictionary entries of one exchange partition; tokens whose forward variables are held at once.
BUCKET, HELD = 2_000_000, 600_000


def held_out(doc_id) -> F.Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(7)) == 2, F.lit(False))


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column without nulls."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of ``values`` that end at ``ends``."""
    offsets = np.concatenate([[0], ends * values.itemsize])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


CODED = "chunk long, doc_id long, held boolean, hashes binary, data binary"


def _code(chunk_bytes: int):
    """Per document its words as places in the chunk's dictionary; per chunk the dictionary, by hash, and its training counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 24, 0
        names = [f.split()[0] for f in CODED.split(", ")]

        def emit(parts: list) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            hashes = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            ids = pa.concat_arrays([p[2] for p in parts])
            held = np.concatenate([p[3] for p in parts])
            n = len(counts)
            known, place = np.unique(hashes, return_inverse=True)
            chunk = np.full(n, base + seq)
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(chunk), ids, pa.array(held), pa.nulls(n, pa.binary()), packed(place.astype(np.int32), np.cumsum(counts))], names=names)
            if len(known):
                learnt = np.bincount(place, np.repeat(~held, counts), len(known)).astype(np.int64)
                whole = np.array([len(known)])
                yield pa.RecordBatch.from_arrays([pa.array(chunk[:1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), packed(known, whole), packed(learnt, whole)], names=names)

        parts, size = [], 0
        for batch in batches:
            raw, starts, ends = utf8_parts(batch.column("text"))
            flags = np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)
            ids = batch.column("doc_id").cast(pa.int64())
            i = 0
            while i < len(starts):
                j = i + 1
                while j < len(starts) and ends[j] - starts[i] <= (2 << 20):
                    j += 1
                parts.append((*words(raw, starts[i:j], ends[i:j]), ids.slice(i, j - i), flags[i:j]))
                size += int(ends[j - 1] - starts[i])
                i = j
                if size >= chunk_bytes:
                    yield from emit(parts)
                    parts, size = [], 0
        if parts:
            yield from emit(parts)

    return rows


def _slice(buckets: int):
    """Dictionaries cut at the borders of ``buckets`` equal hash ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-(1 << 64) // buckets)
        for batch in batches:
            raw, at = binary_parts(batch.column("hashes"))
            hashes, counts = raw.view(np.uint64), binary_parts(batch.column("data"))[0].view(np.int64)
            for chunk, low, high in zip(batch.column("chunk").to_pylist(), at[:-1] // 8, at[1:] // 8, strict=True):
                known = hashes[low:high]
                first, last = int(known[0]) // width, int(known[-1]) // width
                ends = np.append(np.searchsorted(known, np.array([b * width for b in range(first + 1, last + 1)], np.uint64)), len(known))
                which = np.arange(first, last + 1, dtype=np.int32)
                filled = np.diff(ends, prepend=0) > 0
                ends, which = ends[filled], which[filled]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), chunk)), pa.array(which), packed(known, ends), packed(counts[low:high], ends)], names=["chunk", "bucket", "hashes", "data"])

    return rows


def _count(top: int):
    """Training counts of each dictionary slice's words over all chunks; per task its totals and most frequent words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "chunk", "bucket", "hashes", "data", "hash", "n"]
        chunks, buckets, hashes, counts, sizes = [], [], [], [], []
        for batch in batches:
            raw, at = binary_parts(batch.column("hashes"))
            hashes.append(raw.view(np.uint64))
            counts.append(binary_parts(batch.column("data"))[0].view(np.int64))
            sizes.append(np.diff(at) // 8)
            chunks.append(batch.column("chunk").to_numpy())
            buckets.append(batch.column("bucket").to_numpy())
        if not hashes:
            return
        hashes, counts, sizes = np.concatenate(hashes), np.concatenate(counts), np.concatenate(sizes)
        known, place = np.unique(hashes, return_inverse=True)
        total = np.bincount(place, counts, len(known)).astype(np.int64)
        m, ends, full = len(sizes), np.cumsum(sizes), total[place]
        step = max(1, (8 << 20) // max(1, int(sizes.mean() * 16)))
        chunks, buckets = np.concatenate(chunks), np.concatenate(buckets)
        for a in range(0, m, step):
            b = min(m, a + step)
            low, high, k = int(ends[a] - sizes[a]), int(ends[b - 1]), b - a
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), pa.array(chunks[a:b]), pa.array(buckets[a:b]), packed(hashes[low:high], ends[a:b] - low), packed(full[low:high], ends[a:b] - low), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        best = np.argsort(-total, kind="stable")[:top]
        best = best[total[best] > 0]
        out_hash = np.concatenate([known[best].view(np.int64), [int((total > 0).sum())]])
        out_n = np.concatenate([total[best], [int(total.sum())]])
        k = len(out_n)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([1] * (k - 1) + [2], np.int8)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(out_hash), pa.array(out_n)], names=names)

    return rows


def _encode_counts(model):
    """Dictionary slices as 32-bit codes: the place of an own word, or -1 - count of a rare one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = model.value
        for batch in batches:
            raw, at = binary_parts(batch.column("hashes"))
            hashes, counts = raw.view(np.uint64), binary_parts(batch.column("data"))[0].view(np.int64)
            where = np.minimum(np.searchsorted(own, hashes), max(0, len(own) - 1))
            hit = own[where] == hashes if len(own) else np.zeros(len(hashes), bool)
            code = np.where(hit, place[where] if len(own) else 0, -1 - np.minimum(counts, (1 << 31) - 2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(np.zeros(batch.num_rows, np.int8)), batch.column("bucket"), pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.bool_()), packed(code, at[1:] // 8)], names=["chunk", "kind", "bucket", "doc_id", "held", "data"])

    return rows


def _sequences(stats: dict, counts):
    """Per document: counts, base score, rare part of the score, and the symbols of the Markov chain."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts.value
        own_n = len(own)
        norm, rare_norm = math.log10(stats["tokens"] + stats["types"] + 1), math.log10(max(1, stats["rare_tokens"] + stats["rare_types"] + 1))
        end_base = math.log10(stats["documents"] + 1) - norm
        chunk, codes = None, []
        for batch in batches:
            which, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(cuts, np.append(cuts[1:], len(which)), strict=True):
                part = batch.slice(a, b - a)
                if which[a] != chunk:
                    chunk, codes = which[a], []
                raw, at = binary_parts(part.column("data"))
                if kind[a] == 0:
                    codes.append(raw.view(np.int32).copy())
                    continue
                table = codes[0] if len(codes) == 1 else np.concatenate(codes) if codes else np.zeros(0, np.int32)
                codes = [table]
                rare = table < 0
                n = np.where(rare, -1 - table, own[np.maximum(table, 0)] if own_n else 0)
                base = np.log10(n + 1.0) - norm
                rarely = np.where(rare, np.log10(n + 1.0) - rare_norm, 0.0)
                place, ends = raw.view(np.int32), at[1:] // 4
                length = np.diff(at) // 4
                sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], ends])])
                symbols = np.empty(len(place) + len(length), np.uint16)
                last = ends + np.arange(len(length))
                inner = np.ones(len(symbols), bool)
                inner[last] = False
                symbols[inner] = np.where(rare, own_n, table)[place]
                symbols[last] = own_n + 1
                known = sums((n > 0)[place].astype(float)) + (stats["documents"] > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held"), pa.array(length + 1), pa.array(np.rint(known).astype(np.int64)), pa.array(sums(base[place]) + end_base), pa.array(sums(rarely[place])), packed(symbols, last + 1)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare_score", "symbols"],
                )

    return rows


SEQUENCES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare_score double, symbols binary"


class Chain:
    """Start, transition and emission probabilities with the forward and backward recursions over many texts at once."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit.T)  # emit: symbol by state

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a worker builds the chain from: broadcasts hold plain arrays, as workers may lack this repository."""
        return self.start, self.move, self.emit.T

    @classmethod
    def initial(cls, share: np.ndarray, states: int, seed: int = 11) -> Chain:
        """Emissions near the symbols' shares, each state tilted by its own noise; sticky transitions."""
        rng = np.random.default_rng(seed)
        emit = share * np.exp(rng.normal(0, 1.0, (states, len(share))))
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts from long to short, and how many are that long at each step."""
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max(initial=0))
        return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), "right")

    def likelihood(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each text: the scaled forward recursion."""
        lengths = np.diff(np.concatenate([[0], ends]))
        order, active = self._order(lengths)
        at, out = (ends - lengths)[order], np.zeros(len(lengths))
        forward = np.broadcast_to(self.start, (len(order), len(self.start)))
        for t, n in enumerate(active):
            forward = (forward[:n] if t == 0 else forward[:n] @ self.move) * self.emit[symbols[at[:n] + t]]
            scale = forward.sum(1)
            out[:n] += np.log10(scale)
            forward = forward / scale[:, None]
        result = np.empty(len(lengths))
        result[order] = out
        return result

    def expect(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, transitions, emissions, and the log10 likelihood of the texts."""
        k = len(self.start)
        starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape), 0.0
        lengths = np.diff(np.concatenate([[0], ends]))
        order, _ = self._order(lengths)
        done = 0
        while done < len(order):
            stop = done + max(1, int(np.searchsorted(np.cumsum(lengths[order[done:]]), HELD, "right")))
            group = order[done:stop]
            done = stop
            _, active = self._order(lengths[group])
            at = (ends - lengths)[group]
            held, scales, forward = [], [], None
            for t, n in enumerate(active):
                forward = (np.broadcast_to(self.start, (n, k)) if t == 0 else forward[:n] @ self.move) * self.emit[symbols[at[:n] + t]]
                scale = forward.sum(1)
                total += float(np.log10(scale).sum())
                forward = forward / scale[:, None]
                held.append(forward.astype(np.float32))
                scales.append(scale)
            seen, weight, after = [], [], None
            for t in range(len(active) - 1, -1, -1):
                n, here = active[t], held[t].astype(np.float64)
                backward = np.ones((n, k))
                if after is not None:
                    m = len(after)
                    moves += here[:m].T @ after
                    backward[:m] = after @ self.move.T
                share = here * backward
                share /= share.sum(1, keepdims=True)
                now = symbols[at[:n] + t]
                seen.append(now)
                weight.append(share.astype(np.float32))
                after = self.emit[now] * backward / scales[t][:, None]
            starts += weight[-1].sum(0, dtype=np.float64)
            seen, weight = np.concatenate(seen), np.concatenate(weight)
            for state in range(k):
                emits[:, state] += np.bincount(seen, weight[:, state], len(emits))
        return starts, moves * self.move, emits.T, total

    def improved(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Chain:
        """Maximisation with a little of the symbols' shares in every state, so nothing is impossible."""
        k = len(self.start)
        emits = emits + 5.0 * share
        return Chain((starts + 0.1) / (starts.sum() + 0.1 * k), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def _texts(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[tuple]:
    """(batches, symbols, ends) of some millions of tokens, so that long texts go together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("symbols").nbytes // 2
        if size >= limit:
            yield _join(held)
            held, size = [], 0
    if held:
        yield _join(held)


def _join(held: list[pa.RecordBatch]) -> tuple:
    parts = [binary_parts(b.column("symbols")) for b in held]
    symbols = np.concatenate([raw.view(np.uint16) for raw, _ in parts])
    return held, symbols, np.cumsum(np.concatenate([np.diff(at) // 2 for _, at in parts]))


def _expectation(chain):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = Chain(*chain.value), None
        for _, symbols, ends in _texts(batches):
            starts, moves, emits, value = model.expect(symbols, ends)
            flat = np.concatenate([starts, moves.ravel(), emits.ravel(), [value]])
            total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "value"])

    return rows


def _score(chain):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*chain.value)
        for held, symbols, ends in _texts(batches):
            value, done = model.likelihood(symbols, ends), 0
            for b in held:
                columns = [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
                score = value[done : done + b.num_rows] + b.column("rare_score").to_numpy()
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return rows


class HiddenMarkovModel:
    """Counts, trained chain and coded documents of one corpus."""

    def __init__(self, docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, passes: int = PASSES, chunk_bytes: int = CHUNK):
        if states < 1 or not 0 <= vocabulary < 65_000 or passes < 0:
            raise ValueError("states, vocabulary or passes out of range")
        spark = docs.sparkSession
        self.work, context = Workspace(spark, "hmm"), spark.sparkContext
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
        coded = self.work.table(rows.mapInArrow(tidy(_code(chunk_bytes)), CODED), "coded")
        texts, dictionaries = coded.where("hashes is null"), coded.where("hashes is not null")
        entries = dictionaries.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / BUCKET))  # so a task's share does not grow
        slices = dictionaries.select("chunk", "hashes", "data").mapInArrow(tidy(_slice(buckets)), "chunk long, bucket int, hashes binary, data binary")
        counted = slices.repartitionById(buckets, "bucket")
        counted = self.work.table(counted.mapInArrow(tidy(_count(vocabulary)), "kind byte, chunk long, bucket int, hashes binary, data binary, hash long, n long"), "counted")
        top = counted.where("kind = 1").orderBy(F.desc("n"), "hash").limit(vocabulary).select("hash", "n").toPandas()  # vocabulary rows
        types, word_tokens = counted.where("kind = 2").agg(F.coalesce(F.sum("hash"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents = texts.where("not held").count()
        own = top.n.to_numpy(np.int64)
        self.stats = {"documents": documents, "tokens": word_tokens + documents, "types": types + (documents > 0), "rare_tokens": word_tokens - int(own.sum()), "rare_types": types - len(own)}
        hashes = top.hash.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        codes = counted.where("kind = 0").select("chunk", "bucket", "hashes", "data").mapInArrow(_encode_counts(context.broadcast((hashes[order], order))), "chunk long, kind byte, bucket int, doc_id long, held boolean, data binary")
        both = codes.union(texts.select("chunk", F.lit(1).cast("byte").alias("kind"), F.lit(0).alias("bucket"), "doc_id", "held", "data"))
        dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
        self.sequences = self.work.table(dealt.mapInArrow(tidy(_sequences(self.stats, context.broadcast(own))), SEQUENCES), "sequences")
        self.work.drop("coded", "counted")
        # The symbols' shares: own words, rare words, the end.
        share = np.concatenate([own, [max(0, self.stats["rare_tokens"]) + 1], [documents + 1]]).astype(float)
        self.share = share / share.sum()
        self.chain, self.history = Chain.initial(self.share, states), []
        for _ in range(passes if documents else 0):
            self._improve(context, states)

    def _improve(self, context, states: int) -> None:
        """One Baum-Welch pass: expected counts of each task, summed by Spark; a fixed number of sums comes back."""
        shared = context.broadcast(self.chain.arrays())
        found = self.sequences.where("not held_out").select("symbols").mapInArrow(tidy(_expectation(shared)), "place int, value double")
        sums = found.groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(states + states * states + states * len(self.share) + 1)
        flat[sums.place.to_numpy(int)] = sums.value
        self.history.append(float(flat[-1]))
        emits = flat[states + states * states : -1].reshape(states, -1)
        self.chain = self.chain.improved(flat[:states], flat[states : states + states * states].reshape(states, states), emits, self.share)

    def scores(self) -> DataFrame:
        """The scored documents, written as a table; without training documents there is no model and every score is 0."""
        shared = self.sequences.sparkSession.sparkContext.broadcast(self.chain.arrays())
        out = self.sequences.mapInArrow(tidy(_score(shared)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        if not self.stats["documents"]:
            out = out.withColumn("score", F.lit(0.0))
        return self.work.table(out.withColumn("train_tokens", F.lit(int(self.stats["tokens"])).cast("long")), "scores")


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Null and empty texts consist of the end alone.  Unseen words share one
    add-one count.  With no training document (an empty table, or all held out)
    every score and base score is 0.  A null doc_id is learnt from and scored
    like any other.  Repeated rows keep a row each; other columns are not read;
    an empty table gives an empty result.
    """
    return HiddenMarkovModel(docs, **options).scores().select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
