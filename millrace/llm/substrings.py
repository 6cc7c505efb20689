"""Removal of repeated passages by FM-indexes, one per shard.

A window is `size` consecutive words of one document. Each window is owned by its minimizer, the word 8-gram
of least hash in it, and runs of windows of one minimizer form segments, so equal windows, wherever they are,
share a minimizer and meet in one shard. Minimizers that occur once in the corpus are dropped at once; the
segments of the others are sent to their shards. A shard holds whole minimizer groups up to a bounded number
of words: its distinct segments are sorted to the depth of the longest, their Burrows-Wheeler transform is stored
as a wavelet matrix (bit vectors with sampled ranks), and the segments are streamed against it: backward
search gives their matching statistics, the longest stretches that occur at least twice, and every stretch of
`size` words or more is reported. All segments of a shard move in lockstep, as numpy arrays.

A minimizer with HOT or more occurrences isn't sent to one shard: its windows are counted by their own hashes,
which are pre-aggregated, so no task holds such a group.

Edge cases: null and empty texts have no words and keep none; texts shorter than the window keep all; equal
rows are documents of their own and so repeat each other; windows of a text that repeat inside it count,
overlapping ones too; an empty table gives an empty result; a window of no word is refused. Rows are told apart by a hash of their text, so
null or repeated ids do no harm; equal texts are searched once, each segment with its number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import arrow_pass, store, windows, word_hashes

GRAM, SIZE, HOT = 8, 35, 50_000
BLOCK_WORDS, LONGEST = 250_000, 1 << 22


def text_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D."""
    return text.split() if text else []


def runs(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of one text's word hashes: (minimizer, first window, windows)."""
    gram = min(GRAM, size)
    g = windows(h, gram)
    n, w = len(h) - size + 1, size - gram + 1
    if n <= 0:
        return g[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = []
    for base in range(0, n, LONGEST):  # positions must fit below the hash bits
        part = g[base : base + LONGEST + w - 1]
        packed = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        least, span = packed, 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(packed) - w + 1], least[w - span : len(packed) - span + 1])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out.append((part[at[first]], base + first, np.diff(np.append(first, len(at)))))
    return tuple(np.concatenate(x) for x in zip(*out))


class FmIndex:
    """Of a sequence of word numbers (0: separator), its suffixes sorted to a depth of `depth` words or more.

    Patterns of up to depth words are counted right.
    """

    def __init__(self, t: np.ndarray, letters: int, depth: int = 64):
        n = len(t)
        rank, step = t.astype(np.int64), 1
        while step < depth:
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:] + 1
            key = rank * (n + letters + 2) + later
            order = np.argsort(key, kind="stable")
            up = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = up
            step *= 2
            if up[-1] == n - 1:
                break
        bwt = t[order - 1].astype(np.int64)
        self.n = n
        counts = np.bincount(t, minlength=letters)
        c = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.levels = []
        start = np.zeros(letters, np.int64)
        symbols = np.arange(letters)
        for level in range(max(1, int(letters - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, np.int64)]).astype(np.uint8), bitorder="little").view(np.uint64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]).astype(np.int32)
            zeros = int(n - bit.sum())
            self.levels.append((level, packed, ranks, zeros))
            one = self._ones(packed, ranks, start)
            start = np.where((symbols >> level) & 1, zeros + one, start - one)
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = c - start

    @staticmethod
    def _ones(packed: np.ndarray, ranks: np.ndarray, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return ranks[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)

    def extend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The bounds i after putting the words c before the pattern."""
        for level, packed, ranks, zeros in self.levels:
            one = self._ones(packed, ranks, i)
            i = np.where((c >> level) & 1, zeros + one, i - one)
        return i + self.base[c]


def repeated(index: FmIndex, t: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of t[begin:end] of size or more that occur at least twice: (segment, start, end), maximal to the left."""
    found: list[tuple[np.ndarray, ...]] = []
    lane = np.arange(len(begin))
    b, e, top = begin.copy(), end.copy(), end.copy()
    p, limit, probe = end.copy(), begin.copy(), np.zeros(len(begin), bool)
    bounds = np.stack([np.zeros(len(b), np.int64), np.full(len(b), index.n, np.int64)])
    while len(lane):
        word = t[p - 1].astype(np.int64)
        new = index.extend(np.concatenate([word, word]), bounds.ravel()).reshape(2, -1)
        ok = new[1] - new[0] >= 2
        bounds = np.where(ok, new, bounds)
        p = p - ok
        fail, ended = ~ok, ok & (p == limit)
        whole = ended & ~probe
        mark = (fail | whole) & (e - p >= size)
        if mark.any():
            found.append((lane[mark], (p - b)[mark], (e - b)[mark]))
        # a probe that got past the failing word: search on from here, or from further right
        passed = ended & ~whole
        if passed.any():
            j = limit
            goal = np.minimum(np.minimum(j + size, e + (e - j)), top)
            on = passed & (goal <= e)
            again = passed & ~on
            done = on | (again & (goal >= j + size))
            limit, probe = np.where(done, b, limit), probe & ~done
            e = np.where(again, goal, e)
            p = np.where(again, goal, p)
            bounds = np.where(again, np.array([[0], [index.n]]), bounds)
        if fail.any():
            j = p - 1
            top = np.where(fail, e - 1, top)
            e = np.where(fail, np.minimum(j + 4, top), e)
            probe = np.where(fail, e > j, probe)
            limit = np.where(fail, np.where(e > j, j, b), limit)
            p = np.where(fail, e, p)
            bounds = np.where(fail, np.array([[0], [index.n]]), bounds)
        # a search that starts past its limit's left end and has nothing left to add is over: mark what it spans
        spent = ~whole & ~probe & (p == b)
        if spent.any():
            mark = spent & (e - p >= size)
            found.append((lane[mark], (p - b)[mark], (e - b)[mark]))
        alive = ~whole & ~spent & (top - b >= size)
        if not alive.all():
            lane, b, e, top, p, limit, probe, bounds = lane[alive], b[alive], e[alive], top[alive], p[alive], limit[alive], probe[alive], bounds[:, alive]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def shard_spans(contents: list[bytes], counts: list[int], size: int) -> list[list[tuple[int, int]]]:
    """For distinct segments and how often each occurs: the stretches (start, end) that occur at least twice."""
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(w, len(numbers) + 1) for w in c.split()] for c in contents]
    out = [[(0, len(c))] if n > 1 else [] for c, n in zip(coded, counts)]
    left = np.array([i for i, n in enumerate(counts) if n == 1], np.int64)
    if not len(left) or len(contents) == 1 and not _periodic(coded[0], size):
        return out
    t = np.concatenate([np.array([*c, 0], np.int32) for c in coded])
    ends = np.cumsum([len(c) + 1 for c in coded]) - 1
    begins = ends - np.array([len(c) for c in coded])
    index = FmIndex(t, len(numbers) + 1, max(map(len, coded)))
    for i, s, e in zip(*repeated(index, t, begins[left], ends[left], size)):
        out[left[i]].append((int(s), int(e)))
    return out


def _periodic(words: list, size: int) -> bool:
    return len(words) > size


def _rid(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def _segments(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(mh, rid, start, n) of every segment of every row."""

    def part(batch):
        mh, rid, start, n = [], [], [], []
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for t, h in zip(texts, word_hashes([t or b"" for t in texts])):
            m, s, k = runs(h, size)
            mh.append(m)
            start.append(s)
            n.append(k)
            rid.append(np.full(len(m), _rid(t), np.int64))
        yield {"mh": np.concatenate(mh).view(np.int64), "rid": np.concatenate(rid), "start": np.concatenate(start), "n": np.concatenate(n)}

    return arrow_pass(docs.select(F.col(text).alias("text")), part, "mh long, rid long, start int, n int")


def _repeats(rows: DataFrame) -> DataFrame:
    """Of rows sorted by mh inside partitions that hold whole groups, those of groups of two or more."""

    def run(batches):
        last = None  # the last row so far, and whether its group has another
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None:
                if last[0].column(0)[0].as_py() == key[0]:
                    keep[0] = True
                    if not last[1]:
                        yield last[0]
            yield batch.filter(pa.array(keep))
            last = (batch.slice(len(key) - 1, 1), bool(keep[-1]))

    return rows.mapInArrow(run, rows.schema)


def _shards(rows: DataFrame, size: int, block_words: int) -> DataFrame:
    """(mh, content, rid, start, copies) sorted by (mh, content) -> (rid, spans as a flat list of starts and ends)."""

    def run(batches):
        contents, counts, where, group, total = [], [], [], None, 0

        def done() -> pa.RecordBatch:
            rid, spans = [], []
            for own, places in zip(shard_spans(contents, counts, size), where):
                if own:
                    for r, s in places:
                        rid.append(r)
                        spans.append([s + x for pair in own for x in pair])
            return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["rid", "spans"])

        for batch in batches:
            for m, c, r, s, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if m != group and total > block_words:
                    yield done()
                    contents, counts, where, total = [], [], [], 0
                if m == group and contents and contents[-1] == c:
                    counts[-1] += n
                    where[-1].append((r, s))
                else:
                    contents.append(c)
                    counts.append(n)
                    where.append([(r, s)])
                    total += c.count(b" ") + 1
                group = m
        if contents:
            yield done()

    return rows.mapInArrow(run, "rid long, spans array<int>")


def spans(docs: DataFrame, *, text: str = "text", size: int = SIZE, hot: int = HOT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(rid, spans): for each text with repeated windows lists of the word ranges they cover, start and end in turn."""
    if size < 1:
        raise ValueError("a window has one word or more")
    conf = docs.sparkSession.conf
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    occurring = _segments(docs, text, size).repartition(parts, "mh").sortWithinPartitions("mh")
    found = store(_repeats(occurring), "segments")
    often = found.groupBy("mh").count().where(F.col("count") >= hot).select("mh", F.lit(True).alias("hot"))
    marked = found.join(often, "mh", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    counted = marked.groupBy("rid", "start", "n", "mh", "hot").agg(F.count("*").alias("copies"))
    by_text = counted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "mh", "hot", "copies")).alias("segments"))
    placed = _with_rid(docs, text=text).withColumnsRenamed({"_rid": "rid", "_text": "text"}).dropDuplicates(["rid"]).join(by_text, "rid")

    def part(batch):
        out = {"mh": [], "content": [], "rid": [], "start": [], "copies": [], "hot": []}

        def add(*row):
            for k, v in zip(out, row):
                out[k].append(v)

        for r, t, segs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            words = text_words(t)
            for s in segs:
                a = s["start"]
                if s["hot"]:
                    for i in range(a, a + s["n"]):
                        add(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + size])) - (1 << 63), b"", r, i, s["copies"], True)
                else:
                    add(s["mh"], b" ".join(words[a : a + s["n"] + size - 1]), r, a, s["copies"], False)
        yield out

    rows = arrow_pass(placed.select("rid", "text", "segments"), part, "mh long, content binary, rid long, start int, copies long, hot boolean")
    if often.limit(1).count():
        rows = store(rows, "contents")
        ones = rows.where("hot")
        twice = ones.groupBy("mh").agg(F.sum("copies").alias("count")).where("count >= 2").select("mh")
        extra = ones.join(twice, "mh").select("rid", F.array(F.col("start"), (F.col("start") + size).cast("int")).alias("spans"))
    else:
        extra = None
    cold = rows.where("NOT hot").select("mh", "content", "rid", "start", "copies").repartition(parts, "mh").sortWithinPartitions("mh", "content")
    got = _shards(cold, size, block_words)
    if extra is not None:
        got = got.unionByName(extra)
    return got.groupBy("rid").agg(F.collect_list("spans").alias("spans"))


def _with_rid(docs: DataFrame, keep: dict[str, Column] | None = None, text: str = "text") -> DataFrame:
    """keep's columns, _text, _rid."""
    keep = keep or {}
    kept = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).alias("_text"))
    names = list(keep)
    def part(batch):
        t = batch.column(batch.num_columns - 1)
        yield {n: batch.column(i) for i, n in enumerate(names)} | {"_text": t, "_rid": [_rid(x) for x in t.cast(pa.binary()).to_pylist()]}

    return arrow_pass(kept, part, "_text string, _rid long", kept.schema.fields[:-1])


def remove(docs: DataFrame, *, keep: dict[str, Column], text: str = "text", size: int = SIZE, hot: int = HOT, block_words: int = BLOCK_WORDS, digest: bool = True) -> DataFrame:
    """keep's columns, n_words, n_removed and either kept_sha256 or, without digest, kept: the words left, joined
    by one space where any was removed, else the text as it was (null stays null)."""
    found = spans(docs, text=text, size=size, hot=hot, block_words=block_words)
    rows = _with_rid(docs, keep, text).join(found.withColumnsRenamed({"rid": "_rid", "spans": "_spans"}), "_rid", "left")
    names = list(keep)
    last = "kept_sha256" if digest else "kept"

    def part(batch):
        out = {"n_words": [], "n_removed": [], last: []}
        for t, own in zip(batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            words = text_words(t)
            left = words
            if own:
                cover = np.zeros(len(words) + 1, np.int64)
                ranges = np.concatenate(own)
                np.add.at(cover, ranges[::2], 1)
                np.add.at(cover, ranges[1::2], -1)
                left = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(left))
            joined = b" ".join(left)
            out[last].append(hashlib.sha256(joined).hexdigest() if digest else t if len(left) == len(words) else joined)
        if not digest:
            out[last] = [None if x is None else x.decode() for x in out[last]]
        yield {n: batch.column(i) for i, n in enumerate(names)} | out

    rows = rows.select(*names, "_text", "_spans")
    return arrow_pass(rows, part, f"n_words long, n_removed long, {last} string", rows.schema.fields[:-2])
