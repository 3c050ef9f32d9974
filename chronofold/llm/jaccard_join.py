"""Exact Jaccard self-join of word-shingle sets and its connected components.

1. Documents with equal sets form one class, known by a 64-bit digest of the
   set; only classes are compared.
2. Shingles take one global order: those of rare words first, then by hash;
   those that many texts share come last.
   Two sets of Jaccard 0.75 share a shingle among the first quarter (the
   prefix) of each, so classes meet in groups by prefix shingle.
   Sets that link share at least eight within seven shingles more, so classes
   that meet a few times by chance are not compared.
3. Within a group, signature trees of the sets' bitmaps and sizes are traversed
   in pairs (:mod:`signature_tree`); what the bound leaves is verified on the
   full sets.
4. A first round looks at the few shingles of least hash only, where near
   copies mostly meet, and proposes two partners per class (the most similar
   by bitmaps, and the first); the second looks at all prefixes, gathers the
   groups that still hold several components into clusters, and proposes
   every pair whose two sides are not linked yet.  So large groups of near
   copies are never expanded into all pairs, and no link between components is
   lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, heavy_keys, lookup_join
from .components import connected
from .signature_tree import bitmap, candidate_pairs
from .textops import U64, mix, shingle_sets, utf8_parts, words
from .workers import tidy

#: Shingles that a task holds while it counts which are shared.
COUNTED = 1_500_000
#: Words with a weight of their own, at most: shingles of rare words come first.  Only cost depends on it.
FREQUENT = 4096
#: Shingles counted as common, at most; the order of these goes by their counts.  Only cost depends on it.
COMMON = 200_000
#: Prefix shingles that linked sets share at least (small sets: all that they must share).
SHARED = 8
#: Shingles of least hash of the first round; entries of one exchange partition.
LEADING, BUCKET = 6, 2_000_000
#: Sets of a cell of the first round, and of a cluster that is one group; sets of a block of the second round, whose cells
#: compare one or two; sets of a group dealt over several cells of the first round that are in each of them, so that near
#: copies in different cells meet.
CELL, BLOCK, ANCHORS = 8192, 2048, 8
#: Entries of a shingle above which its group is found by partial aggregation instead of in one task.
LARGE = 100_000
#: Bytes (estimated as hashed in memory) up to which a counted table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Name of the row key in tables that carry foreign columns too.
KEY = "__chronofold_row_key"


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 2 << 20, weigh=None) -> Iterator[tuple]:
    """(rows, word hashes or their sums' weights, sorted shingle sets, set sizes) of runs of texts of about ``size`` bytes."""
    for batch in batches:
        raw, starts, ends = utf8_parts(batch.column("text"))
        i = 0
        while i < len(starts):
            j = i + 1
            while j < len(starts) and ends[j] - starts[i] <= size:
                j += 1
            hashes, counts = words(raw, starts[i:j], ends[i:j])
            if weigh is None:
                yield batch.slice(i, j - i), hashes, *shingle_sets(hashes, counts)
            else:
                keys, sizes, weights = shingle_sets(hashes, counts, weights=weigh(hashes))
                yield batch.slice(i, j - i), weights, keys, sizes
            i = j


def _digests(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit digest per set (0 for the empty set)."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys ^ U64(0x5851F42D4C957F2D)))])
    value = mix((total[ends] - total[ends - sizes]) ^ (sizes.astype(U64) * U64(0x2545F4914F6CDD1D)))
    return np.where(sizes > 0, value, U64(0)).view(np.int64)


def _owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: (doc_id, set size, class, row key); 1: shingles that several classes among some millions share, with their count; 2: frequent words."""
    names = ["kind", "a", "n", "b", "key"]
    held: list[np.ndarray] = []
    seen: set[int] = set()

    def rows(kind: int, a: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(n.astype(np.int64)), none, none], names=names)

    def shared() -> pa.RecordBatch:
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        seen.clear()
        return rows(1, keys[count > 1], count[count > 1])

    for batch, hashes, keys, sizes in _chunks(batches):
        classes = _digests(keys, sizes)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), batch.column("doc_id"), pa.array(sizes), pa.array(classes), batch.column("key")], names=names)
        first = np.zeros(n, bool)
        first[[i for i in np.unique(classes, return_index=True)[1] if int(classes[i]) not in seen]] = True
        seen.update(classes[first].tolist())
        held.append(keys[first[_owners(sizes)]])
        word, times = np.unique(hashes, return_counts=True)
        often = np.argsort(-times, kind="stable")[:FREQUENT]
        yield rows(2, word[often], times[often])
        if sum(map(len, held)) > COUNTED:
            yield shared()
    if held:
        yield shared()


def _prefixes(common, percent: int):
    """Per class first seen by the task: class, n, its shingles of least hash, its prefix in the global order, its bitmap."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank, word, weight = common.value

        def weigh(hashes: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(word, hashes), max(0, len(word) - 1))
            return np.where(word[at] == hashes, weight[at], 0) if len(word) else np.zeros(len(hashes), np.int64)

        maybe = np.zeros(1 << 20, bool)
        maybe[(tokens & U64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for _, weights, keys, sizes in _chunks(batches, weigh=weigh):
            classes = _digests(keys, sizes)
            fresh = np.zeros(len(sizes), bool)
            at = np.unique(classes, return_index=True)[1]
            fresh[[i for i in at if sizes[i] and int(classes[i]) not in seen]] = True
            seen.update(classes[fresh].tolist())
            inside = fresh[_owners(sizes)]
            keys, weights = keys[inside], weights[inside]
            sizes, classes = sizes[fresh], classes[fresh]
            if not len(sizes):
                continue
            ends = np.cumsum(sizes)
            starts, owner = ends - sizes, _owners(sizes)
            late = np.zeros(len(keys), bool)
            guess = np.flatnonzero(maybe[(keys & U64((1 << 20) - 1)).astype(np.int64)])
            place = np.searchsorted(tokens, keys[guess])
            hit = (place < len(tokens)) & (tokens[np.minimum(place, max(0, len(tokens) - 1))] == keys[guess]) if len(tokens) else np.zeros(len(guess), bool)
            late[guess[hit]] = True
            early = np.cumsum(~late)
            before = np.concatenate([[0], early])[starts]
            n_early = np.concatenate([[0], early])[ends] - before
            order = np.empty(len(keys), np.int64)
            light = np.flatnonzero(~late)
            light = light[np.argsort((owner[light] << 12) + weights[light], kind="stable")]  # hashes are in order already
            order[np.repeat(starts - (np.cumsum(n_early) - n_early), n_early) + np.arange(len(light))] = light
            heavy = guess[hit]
            by = np.lexsort((rank[place[hit]], owner[heavy]))
            heavy = heavy[by]
            n_late = sizes - n_early
            order[np.repeat(starts + n_early, n_late) + np.arange(len(heavy)) - np.repeat(np.cumsum(n_late) - n_late, n_late)] = heavy
            take = np.minimum(sizes, sizes - -(-percent * sizes // 100) + SHARED)
            begin = np.cumsum(take) - take
            prefix = keys[order[np.repeat(starts - begin, take) + np.arange(int(take.sum()))]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(prefix))
            maps = [bitmap(keys[a:b]) for a, b in zip(starts, ends, strict=True)]
            few = np.minimum(sizes, LEADING)
            lead = keys[np.repeat(starts - (np.cumsum(few) - few), few) + np.arange(int(few.sum()))].view(np.int64)
            leads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), pa.array(lead))
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(sizes), leads, lists, pa.array(maps, pa.binary())], names=["class", "n", "lead", "prefix", "map"])

    return rows


def _pack(buckets: int, large):
    """Entries (shingle, class) as one binary per exchange partition and some millions of entries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = large.value
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            held.clear()
            bucket = (mix(entries[:, 0].view(U64)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, entries = bucket[order], entries[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            parts = [e.tobytes() for e in np.split(entries, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            lists = batch.column("prefix")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            entries = np.stack([flat[offsets[0] : offsets[-1]], np.repeat(batch.column("class").to_numpy(), np.diff(offsets))], axis=1)
            if len(skip):
                entries = entries[~np.isin(entries[:, 0], skip)]
            held.append(entries)
            if sum(map(len, held)) >= BUCKET // 4:
                yield flush()
        if held:
            yield flush()

    return rows


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (shingle, class) of the groups of several classes; groups of the same members are given once, with their number."""
    held = [np.frombuffer(part, np.int64).reshape(-1, 2) for batch in batches for part in batch.column("entries").to_pylist()]
    if not held:
        return
    entries = np.concatenate(held)
    del held
    entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    first = np.ones(len(entries), bool)
    first[1:] = (entries[1:] != entries[:-1]).any(1)
    entries = entries[first]
    cut = np.flatnonzero(np.concatenate([[True], entries[1:, 0] != entries[:-1, 0]]))
    count = np.diff(np.append(cut, len(entries)))
    with np.errstate(over="ignore"):
        digest = np.add.reduceat(mix(entries[:, 1].view(U64)), cut) + count.astype(U64)
    times = np.zeros(len(cut), np.int64)
    many = np.flatnonzero(count > 1)
    _, first, number = np.unique(digest[many], return_index=True, return_counts=True)
    times[many[first]] = number
    kept = np.repeat(times, count)
    entries, kept = entries[kept > 0], kept[kept > 0]
    for i in range(0, len(entries), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(entries[i : i + 100_000, 0]), pa.array(entries[i : i + 100_000, 1]), pa.array(kept[i : i + 100_000])], names=["token", "class", "times"])


def _propose(percent: int, spanning: bool):
    """Candidate pairs of each cell by dual traversal; rows come sorted by (token, i, j)."""

    def cell(rows: list) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array([r[0] for r in rows])
        sizes = np.array([r[1] for r in rows], np.int64)
        groups = np.array([r[3] for r in rows])
        side = np.array([r[4] for r in rows])
        i, j, likeness = candidate_pairs(sizes, [r[2] for r in rows], groups, side, percent)
        if spanning and len(i):
            who, other, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([likeness, likeness])
            picked = []
            for order in (np.lexsort((other, -score, who)), np.lexsort((ids[other], who))):
                first = np.ones(len(order), bool)
                first[1:] = who[order][1:] != who[order][:-1]
                picked.append(order[first])
            picked = np.concatenate(picked)
            i, j = who[picked], other[picked]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        given: set[tuple[int, int]] = set()  # pairs of the task, as near copies meet in many groups
        names = ("token", "i", "j", "class", "n", "map", "comp", "side")

        def settle() -> None:
            if len(held) > 1:
                if len(given) > 500_000:
                    given.clear()
                for pair in zip(*(x.tolist() for x in cell(held)), strict=True):
                    if pair not in given:
                        given.add(pair)
                        out.append(pair)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        for batch in batches:
            for token, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (token, i, j) != key:
                    settle()
                    if len(out) > 50_000:
                        yield packed()
                        out = []
                    key, held = (token, i, j), []
                held.append(rest)
        settle()
        if out:
            yield packed()

    return rows


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps folded to half their width: the second round sends many and leaves little to them."""
    for batch in batches:
        whole = batch.column("map").to_pylist()
        maps = [m if len(m) <= 8 else (np.frombuffer(m[: len(m) // 2], np.uint8) | np.frombuffer(m[len(m) // 2 :], np.uint8)).tobytes() for m in whole]
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), pa.array(maps, pa.binary())], names=["class", "n", "map"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, set) of each row's text; rows that repeat a class within the task are passed over."""
    seen: set[int] = set()
    for batch, _, keys, sizes in _chunks(batches):
        classes, ends = _digests(keys, sizes), np.cumsum(sizes)
        fresh = [i for i in np.unique(classes, return_index=True)[1].tolist() if int(classes[i]) not in seen]
        seen.update(classes[fresh].tolist())
        sets = [keys[ends[i] - sizes[i] : ends[i]].tobytes() for i in fresh]
        yield pa.RecordBatch.from_arrays([pa.array(classes[fresh]), pa.array(sets, pa.binary())], names=["class", "tokens"])


def _verify(percent: int):
    """Links (a, b) of each hub with the classes it is compared with; the hub's rows come first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            for hub, salt, is_hub, other, tokens in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "is_hub", "class", "tokens")), strict=True):
                tokens = np.frombuffer(tokens, U64)
                if is_hub:
                    key, own = (hub, salt), tokens
                    continue
                if (hub, salt) != key:
                    raise ValueError("a hub's set is missing")
                at = np.minimum(np.searchsorted(own, tokens), max(0, len(own) - 1))
                common = int((own[at] == tokens).sum()) if len(own) else 0
                if 100 * common >= percent * (len(own) + len(tokens) - common):
                    a.append(hub)
                    b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows


def row_key(docs: DataFrame) -> Column:
    """A 64-bit key of a row's doc_id and text.  Rows that repeat both share it; any others have keys of their own."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


class JaccardJoin:
    """State of one join: class table, prefixes, links found so far.

    Rows are known by :func:`row_key`, never by doc_id alone, so repeated and
    null ids keep apart.
    """

    def __init__(self, docs: DataFrame, percent: int = 75):
        if not 0 < percent <= 100:
            raise ValueError("percent must be between 1 and 100")
        self.spark, self.percent = docs.sparkSession, percent
        self.work = Workspace(self.spark, "jaccard", by_workers=True)
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), row_key(docs).alias("key"))
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.work.table(self.docs, "first", _first_rows, "kind byte, a long, n long, b long, key long")
        self.members = rows.where("kind = 0").select(F.col("a").alias("doc_id"), "n", F.col("b").alias("class"), "key")
        filled = self.members.where("n > 0")
        self.heavy = self.work.table(heavy_keys(filled, ["class"]), "heavy")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))  # a null doc_id comes last
        classes = filled.groupBy("class").agg(F.first("n").alias("n"), first.alias("first"))
        self.classes = self.work.table(classes.select("class", "n", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key")), "classes")
        counts = rows.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n"))
        common = counts.orderBy(F.desc("n"), "token").limit(COMMON).toPandas()  # at most COMMON rows
        tokens = common.token.to_numpy(np.int64).view(U64)
        order = np.argsort(tokens)
        rank = np.empty(len(tokens), np.int64)
        rank[::-1] = np.arange(len(tokens))  # the most frequent last
        frequent = rows.where("kind = 2").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()  # at most FREQUENT rows
        word = frequent.word.to_numpy(np.int64).view(U64)
        by = np.argsort(word)
        # A word's weight rises with its frequency: 1 for the rarest of the table, a step for each doubling.
        counts_of = frequent.n.to_numpy(np.int64)
        weight = 1 + np.floor(np.log2(np.maximum(counts_of, 1) / max(1, counts_of.min(initial=1 << 62)))).astype(np.int64) if len(word) else np.zeros(0, np.int64)
        shared = self.spark.sparkContext.broadcast((tokens[order], rank[order], word[by], weight[by]))
        self.large = self.spark.sparkContext.broadcast(common.token[common.n > LARGE].to_numpy(np.int64))
        self.prefixes = self.work.table(self.docs, "prefixes", _prefixes(shared, percent), "class long, n long, lead array<long>, prefix array<long>, map binary")
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    @staticmethod
    def _small(df: DataFrame) -> DataFrame:
        """``df``, of fixed-width columns, for a broadcast if its size allows, else for a shuffle join."""
        return F.broadcast(df) if df.count() * (24 + 8 * len(df.columns)) <= BROADCAST_BYTES else df

    def _gathered(self, members: DataFrame) -> DataFrame:
        """Members of the groups that hold several components, by cluster instead of by shingle.

        Near copies meet in dozens of groups; classes that groups connect form
        a cluster.  A cluster of at most CELL classes becomes one group, so
        each class is compared, and its bitmap sent, once.  Larger clusters keep
        their groups by shingle.
        """
        multi = members.groupBy("token").agg(F.min("class").alias("lead"), F.max("class").alias("last"), F.count(F.lit(1)).alias("m"), F.first("times").alias("times"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        multi = self.work.table(multi, "multi")
        # Chance meetings are few per pair: linked sets share SHARED prefix shingles, or all that they must share.
        least = F.least(F.lit(SHARED), F.ceil(F.col("n") * self.percent / 100))
        twos = multi.where("m = 2").groupBy(F.col("lead").alias("class"), F.col("last").alias("other")).agg(F.sum("times").alias("times"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("token").alias("token"))
        tokens = self._small(multi.select("token"))
        busy = members.join(tokens, "token", "left_semi").groupBy("class").agg(F.sum("times").alias("total")).where(F.col("total") < SHARED)
        scarce = self.work.table(busy.join(self.classes.select("class", "n"), "class").where(F.col("total") < least).select("class"), "scarce")
        twos = self.work.table(twos.join(self.classes.select("class", "n"), "class").where(F.col("times") >= least).select("class", "other", "token"), "twos")
        tied = twos.select("token", "class").union(twos.select("token", F.col("other")))
        wide = members.join(self._small(multi.where("m > 2").select("token")), "token", "left_semi").join(self._small(scarce), "class", "left_anti").select("token", "class")
        open_ = self.work.table(self._with_component(wide.union(tied)), "open0")
        lead = self.work.table(open_.groupBy("token").agg(F.min("class").alias("lead")), "leads")
        open_ = self.work.table(open_.join(self._small(lead), "token"), "open")
        edges = open_.where("class <> lead").select(F.col("class").alias("a"), F.col("lead").alias("b")).distinct()
        clusters = connected(edges, self.work, "cluster")
        large = self.work.table(clusters.groupBy("root").count().where(F.col("count") > CELL).select("root", F.lit(True).alias("is_large")), "large_clusters")
        clusters = self.work.table(clusters.join(large, "root", "left").select(F.col("node").alias("class"), "root", "is_large"), "clusters")
        whole = open_.select("class", "comp").distinct().join(clusters.where("is_large is null"), "class").select(F.col("root").alias("token"), "class", "comp")
        parts = open_.select("token", "class", "comp").join(clusters.where("is_large"), "class", "left_semi")
        return self.work.table(whole.unionByName(parts), "gathered")

    def _cells(self, members: DataFrame, spanning: bool) -> DataFrame:
        """Members (token, class, comp) of groups, dealt to cells, with size and bitmap.

        A group is split by class hash into blocks.  Each pair of blocks is a
        cell; with ``spanning``, each block of at most CELL sets or so, and a
        few sets of the group that all of its cells share.
        """
        sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        sizes = self.work.table(sizes.select("token", "m", F.ceil(F.col("m") / (CELL if spanning else BLOCK)).cast("int").alias("c")), f"sizes{int(spanning)}")
        rows = members.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("class", "token"), F.col("c")).cast("int"))
        if spanning:
            shared = (F.col("c") > 1) & (F.pmod(F.xxhash64("token", "class"), F.col("m")) < ANCHORS)
            at = F.when(shared, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array("block"))
            dealt = rows.select("token", "class", "comp", F.explode(at).alias("i")).select("token", "class", "comp", "i", F.col("i").alias("j"), F.lit(0).alias("side"))
        else:
            cell = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), (F.col("block") > k).cast("int").alias("side")))
            dealt = rows.select("token", "class", "comp", F.explode(cell).alias("at")).select("token", "class", "comp", "at.i", "at.j", "at.side")
        wanted = self.work.table(rows.select("class").distinct(), f"mapped{int(spanning)}")
        maps = self.prefixes.select("class", "n", "map").join(self._small(wanted), "class", "left_semi")
        maps = maps.groupBy("class").agg(F.first("n").alias("n"), F.first("map").alias("map"))
        maps = self.work.table(maps, f"maps{int(spanning)}", *(() if spanning else (_halved, "class long, n long, map binary")))
        return dealt.join(maps, "class")

    def _pairs(self, members: DataFrame, spanning: bool, name: str) -> DataFrame:
        cells = self._cells(members, spanning).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "class")
        return self.work.table(cells.mapInArrow(tidy(_propose(self.percent, spanning)), "a long, b long").distinct(), name)

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those pairs that link, by the whole sets: each class's text goes to the hubs it is compared with."""
        per_hub = self.work.table(pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / 128).cast("int").alias("salts")), f"{name}_hubs")
        salted = pairs.withColumnRenamed("a", "hub").join(per_hub, "hub").select("hub", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("is_hub"), F.col("b").alias("class"))
        hubs = per_hub.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("is_hub"), F.col("hub").alias("class"))
        places = self.work.table(salted.unionByName(hubs), f"{name}_places")
        wanted = self.work.table(places.select("class").distinct().join(self.classes, "class").select("key"), f"{name}_wanted")
        sets = self.docs.join(self._small(wanted), "key", "left_semi").select("text").mapInArrow(tidy(_sets), "class long, tokens binary")
        dealt = sets.join(self._small(places), "class").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
        return self.work.table(dealt, name, _verify(self.percent), "a long, b long")

    def _with_component(self, members: DataFrame) -> DataFrame:
        if self.roots is None:
            return members.withColumn("comp", F.col("class"))
        return members.join(self._small(self.roots.select(F.col("node").alias("class"), "root")), "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")

    def run(self) -> JaccardJoin:
        lead = self.work.table(self.prefixes.select(F.explode("lead").alias("token"), "class").distinct(), "lead")
        several = self.work.table(lead.groupBy("token").count().where("count > 1").select("token"), "several")
        lead = self.work.table(lead.join(self._small(several), "token", "left_semi"), "lead_met")
        # Near copies meet in most of their leading shingles; who meets but once is left to the second round.
        twice = self.work.table(lead.groupBy("class").count().where("count > 1").select("class"), "twice")
        lead = lead.join(self._small(twice), "class", "left_semi")
        pairs = self._pairs(self._with_component(lead), True, "pairs1")
        self.links = self._verified(pairs, "links1")
        self.roots = connected(self.links, self.work, "cc1")
        self.work.drop("lead", "lead_met", "maps1", "sizes1")
        entries = self.prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
        buckets = max(self.parts, math.ceil(entries / BUCKET))
        packed = self.prefixes.select("class", "prefix").mapInArrow(tidy(_pack(buckets, self.large)), "bucket int, entries binary")
        met = self.work.table(packed.repartitionById(buckets, "bucket"), "met", _meet, "token long, class long, times long")
        if len(self.large.value):
            often = self.spark.createDataFrame([(int(t),) for t in self.large.value], "token long")  # at most COMMON rows
            met = met.union(self.prefixes.select(F.explode("prefix").alias("token"), "class").join(F.broadcast(often), "token", "left_semi").distinct().withColumn("times", F.lit(1).cast("long")))
        members = self.work.table(self._with_component(met), "members")
        pairs = self._pairs(self._gathered(members), False, "pairs2")
        if not pairs.isEmpty():
            self.links = self.links.union(self._verified(pairs, "links2"))
            self.roots = connected(self.links, self.work, "cc2")
        self.work.drop("met", "members", "open0", "open", "gathered", "maps0", "sizes0", "prefixes")
        return self

    def placed(self) -> DataFrame:
        """doc_id, n_shingles, component_id, key, keeper: a row per row of the documents.

        ``keeper`` is the key of the component's row of the smallest doc_id
        (then key); it is null for rows without words, which are in no group.
        """
        named = self.classes.join(self.roots.select(F.col("node").alias("class"), "root"), "class", "left")
        named = self.work.table(named.select("class", "rep", "key", F.coalesce("root", "class").alias("root")), "named")
        first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "key")).alias("first")
        least = named.groupBy("root").agg(first).select("root", F.col("first.rep").alias("component_id"), F.col("first.key").alias("keeper"))
        least = self.work.table(least, "least")
        heavy = self.work.table(heavy_keys(named, ["root"]), "heavy_roots")
        ids = lookup_join(named.select("class", "root"), least, ["root"], heavy).select("class", "component_id", "keeper")
        ids = self.work.table(ids, "ids")
        filled = lookup_join(self.members.where("n > 0"), ids, ["class"], self.heavy)
        filled = filled.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "keeper")
        empty = self.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.lit(None).cast("long").alias("keeper"))
        return filled.unionByName(empty)

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id, one row per row of the documents."""
        return self.placed().select("doc_id", "n_shingles", "component_id")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of ``docs`` (doc_id, text) by exact linkage at ``percent``.

    Null and word-less texts have the empty set, link with nothing and are
    their own component.  Repeated rows keep a row each; equal sets are one
    class.  Rows that share a doc_id, or have none, are linked by their texts
    like any others.  A null doc_id never names a component unless no row of it
    has an id.  Other columns are not read.  An empty table gives an empty
    result.
    """
    return JaccardJoin(docs, percent).run().components()


def keep_representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of linked rows of ``docs``, that of the smallest doc_id, all columns as they are.

    Null ids come last; of rows with one doc_id that of the smaller row key
    stays, and one of rows that repeat doc_id and text.  Rows without words
    link with nothing and all stay, repeated or not.  No other row is touched,
    whatever ids it shares.
    """
    join = JaccardJoin(docs, percent).run()
    found = join.work.table(join.placed().where("keeper is not null").select("key", "keeper"), "found")
    gone = join.work.table(found.where("key <> keeper").select(F.col("key").alias(KEY)).distinct(), "gone")
    twins = join.work.table(found.where("key = keeper").groupBy(F.col("key").alias(KEY)).count().where("count > 1").select(KEY), "twins")
    keyed = docs.withColumn(KEY, row_key(docs)).join(join._small(gone), KEY, "left_anti")
    if not twins.isEmpty():
        few = join._small(twins)
        keyed = keyed.join(few, KEY, "left_anti").unionByName(keyed.join(few, KEY, "left_semi").dropDuplicates([KEY]))
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns])
