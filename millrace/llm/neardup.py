"""Near-duplicate classes by SimHash within minhash groups.

1. Each distinct text gets a 256-bit SimHash of its set of word 5-grams (the whole text when shorter; words as
   in `tokens`), ROUTES minhashes of the same set and as many more for crowded addresses. Two texts of similarity
   0.8 share one of the ROUTES with probability 1 - 0.2**6 = 0.99994, so minhashes are the addresses: a text is
   entered, and asks, in the shards of its own minhashes only, which keeps the work linear in the number of texts.
2. A minhash that more than SHARD texts share (a passage that many documents hold) is no address: its texts go to
   the addresses that it makes with each of their further minhashes, which again two texts of similarity 0.8
   share one of with probability 0.99994. What is still crowded then is cut in blocks, each pair of blocks a shard.
3. A shard holds whole groups, SHARD texts or a little more. Each group is searched exactly, by flooding: whatever
   of it is connected by links within RADIUS is linked. A small-world graph in its place finds too little unless
   its beam is so wide that it costs more than the exact search (figures in the README).
4. Texts linked within RADIUS form families. A family's shingle sets meet in one task (in blocks, pairwise, if
   they are large), where links are verified by exact Jaccard similarity; a pair already connected needs none.
5. Components of the verified links, over equal texts, are the classes.
6. `audit` compares a sample of texts with all others, whatever their addresses and distance in bits, and tells how
   many of the true pairs are in one class.

Edge cases: null, empty and wordless texts are in a class of their own; equal texts are always in one class;
a class is named by its least doc_id (null when it has none); ids may repeat or be null; an empty table gives
an empty result. RADIUS leaves pairs at similarity 0.8 (39 differing bits expected, deviation 6) a chance of
about 0.0005 to be missed, and less above. Few shingles tie and their bits differ more (48 expected where 4 of
5 are shared), so a text of fewer than SHORT shingles has WIDE as its radius, 6 deviations above that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import K1, apart, arrow_pass, mix, store, windows, word_hashes
from millrace.llm.components import components
from millrace.llm.substrings import _rid, _with_rid

SHINGLE, SIMILAR, ROUTES, RADIUS = 5, 0.8, 6, 58
SHORT, WIDE = 64, 88
SHARD = 20_000
FAMILY_WORDS = 2_000_000

_SALTS = mix(np.arange(1, 5, dtype=np.uint64) * K1)
_ROUTE_SALTS = mix(np.arange(11, 11 + 2 * ROUTES, dtype=np.uint64) * K1)


def shingle_set(h: np.ndarray) -> np.ndarray:
    return np.unique(windows(h, min(SHINGLE, len(h)))) if len(h) else h


def shingle_sets(texts: list) -> list[np.ndarray]:
    return [shingle_set(h) for h in word_hashes([apart(t) if t else b"" for t in texts])]


def simhash(s: np.ndarray) -> np.ndarray:
    """256 bits (4 words): the majority of the bits of the shingles' hashes."""
    total = np.zeros(256, np.int64)
    for a in range(0, len(s), 255 * 64):
        bits = np.unpackbits(mix(s[a : a + 255 * 64, None] ^ _SALTS[None, :]).view(np.uint8).reshape(-1, 32), axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 256).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        if whole < len(bits):
            total += bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > len(s)).view(np.uint64)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(rid, n, sim array<long>, routes array<long>, further array<long>) of each distinct text with words."""

    def part(batch):
        out = {"rid": [], "n": [], "sim": [], "routes": [], "further": []}
        for raw, s in zip(batch.column(0).cast(pa.binary()).to_pylist(), shingle_sets(batch.column(0).to_pylist())):
            if len(s):
                least = [int(mix(s ^ r).min().view(np.int64)) for r in _ROUTE_SALTS]
                for k, v in zip(out, (_rid(raw), len(s), simhash(s).view(np.int64), least[:ROUTES], least[ROUTES:])):
                    out[k].append(v)
        yield out

    found = arrow_pass(docs.select(F.col(text).alias("text")), part, "rid long, n int, sim array<long>, routes array<long>, further array<long>")
    return found.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("n", "sim", "routes", "further")])


def _distances(sim: np.ndarray, one: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(sim ^ one)
    return bits[:, 0].astype(np.int32) + bits[:, 1] + bits[:, 2] + bits[:, 3]


def radii(n: np.ndarray) -> np.ndarray:
    """The radius of texts of n shingles; of two texts the wider holds."""
    return np.where(n < SHORT, WIDE, RADIUS)


def spread_links(sim: np.ndarray, radius: int | np.ndarray) -> list[tuple[int, int]]:
    """Exact: links that connect whatever is connected within radius, by flooding; quadratic at worst."""
    left, rest, links = np.arange(len(sim)), sim, []  # rest: the rows of left, cut only when a link takes some
    own = far = np.broadcast_to(radius, len(sim))
    while len(left):
        front, left, rest, far = [int(left[0])], left[1:], rest[1:], far[1:]
        while front and len(left):
            i = front.pop()
            near = _distances(rest, sim[i]) <= np.maximum(far, own[i])
            if not near.any():
                continue
            links += [(i, int(j)) for j in left[near]]
            front += left[near].tolist()
            left, rest, far = left[~near], rest[~near], far[~near]
    return links


def shard_links(group: np.ndarray, sim: np.ndarray, radius: int | np.ndarray = RADIUS) -> set[tuple[int, int]]:
    """Links within radius that connect each group's texts (rows sorted by group)."""
    links: set[tuple[int, int]] = set()
    radius = np.broadcast_to(radius, len(sim))
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        links.update((a + min(i, j), a + max(i, j)) for i, j in spread_links(sim[a:b], radius[a:b]))
    return links


def _roots(links, n: int) -> tuple[list[int], list[tuple[int, int]]]:
    """A root of each of n nodes, and as many of the links as connect the same."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for i, j in links:
        a, b = root(i), root(j)
        if a != b:
            up[b] = a
            kept.append((i, j))
    return [root(i) for i in range(n)], kept


def _thinned(links: set, n: int) -> list[tuple[int, int]]:
    """As many of the links as connect the same."""
    return _roots(sorted(links), n)[1]


def candidates(sigs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect the texts within RADIUS."""
    spark = sigs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = sigs.select("rid", F.explode("routes").alias("route"))
    first = routed.groupBy("route").count()
    crowded = routed.join(first.where(F.col("count") > shard).select("route"), "route").join(sigs.select("rid", "further"), "rid")
    second = crowded.select("rid", F.explode("further").alias("other"), "route").select("rid", F.xxhash64("route", "other").alias("route"))
    second = store(second, "second")
    routed = routed.unionByName(second)
    sizes = first.where((F.col("count") > 1) & (F.col("count") <= shard)).unionByName(second.groupBy("route").count().where("count > 1"))
    routed = routed.join(sigs.select("rid", "sim", "n"), "rid")
    sized = routed.join(sizes, "route").withColumn("m", F.ceil(F.col("count") / shard).cast("int")).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("m")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    placed = sized.select("route", F.explode(pairs).alias("pair"), "rid", "sim", "n").select("route", "pair.i", "pair.j", "rid", "sim", "n")

    def run(batches):
        group, rid, sim, size, last, number = [], [], [], [], None, -1

        def done() -> pa.RecordBatch:
            g, x, ids = np.concatenate(group), np.concatenate(sim), np.concatenate(rid)
            kept = np.array(_thinned(shard_links(g, x, radii(np.concatenate(size))), len(ids)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[kept[:, 0]]), pa.array(ids[kept[:, 1]])], names=["a", "b"])

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            new = np.concatenate([[last is None or (keys[:, 0] != last).any()], (keys[:, 1:] != keys[:, :-1]).any(0)])
            ids, n = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            bits = batch.column(4).values.to_numpy()[batch.column(4).offsets[0].as_py() :][: 4 * len(ids)].reshape(-1, 4).view(np.uint64)
            at = 0
            for cut in [*np.flatnonzero(new).tolist(), len(ids)]:
                if cut > at:
                    group.append(np.full(cut - at, number))
                    rid.append(ids[at:cut])
                    sim.append(bits[at:cut])
                    size.append(n[at:cut])
                    total += cut - at
                if cut < len(ids):
                    if total >= shard:
                        yield done()
                        group, rid, sim, size, total = [], [], [], [], 0
                    number += 1
                at = cut
            last = keys[:, -1]
        if total:
            yield done()

    return placed.repartition(parts, "route", "i", "j").sortWithinPartitions("route", "i", "j").mapInArrow(run, "a long, b long")


def verified_links(rid: list[int], sim: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by similarity, among pairs within their radius; exact similarity."""
    left, links = np.arange(len(rid)), []
    sizes = np.array([len(s) for s in sets])
    radius = radii(sizes)
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop(0)
            near = np.bitwise_count(sim[left] ^ sim[i]).sum(1, dtype=np.int32) <= np.maximum(radius[left], radius[i])
            near &= (np.minimum(sizes[left], sizes[i]) >= similar * np.maximum(sizes[left], sizes[i]))
            some = left[near]
            if not len(some):
                continue
            taken = []
            for a in range(0, len(some), 256):
                part = some[a : a + 256]
                flat = np.concatenate([sets[j] for j in part])
                at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
                common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
                taken.append(part[common >= similar * (sizes[i] + sizes[part] - common)])
            got = np.concatenate(taken)
            links += [(rid[i], rid[j]) for j in got.tolist()]
            front += got.tolist()
            left = np.setdiff1d(left, got, assume_unique=True)
    return links


def _verify(docs: DataFrame, families: DataFrame, sigs: DataFrame, text: str) -> DataFrame:
    """(a, b): verified links inside families (v, l)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = families.join(sigs.select(F.col("rid").alias("v"), "n"), "v")
    blocks = sized.groupBy("l").agg(F.ceil(F.sum("n") / FAMILY_WORDS).cast("int").alias("m"))
    members = sized.join(blocks, "l").select(F.col("v").alias("rid"), F.col("l").alias("family"), "m")
    texts = _with_rid(docs, text=text).withColumnsRenamed({"_rid": "rid", "_text": "text"}).join(members, "rid").dropDuplicates(["rid"])

    def sets(batch):
        out = {"family": [], "i": [], "j": [], "rid": [], "sim": [], "shingles": []}
        rid, text, family, blocks = (batch.column(k).to_pylist() for k in range(4))
        for r, s, f, m in zip(rid, shingle_sets(text), family, blocks):
            own = r % m
            for j in range(m):
                for k, v in zip(out, (f, min(own, j), max(own, j), r, simhash(s).view(np.int64), s.view(np.int64))):
                    out[k].append(v)
        yield out

    rows = arrow_pass(texts.select("rid", "text", "family", "m"), sets, "family long, i int, j int, rid long, sim array<long>, shingles array<long>")

    def run(batches):
        last, rid, sim, own = None, [], [], []

        def done() -> pa.RecordBatch:
            links = verified_links(rid, np.array(sim), own) if len(rid) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for f, i, j, r, b, s in zip(*columns, batch.column(4), batch.column(5)):
                if (f, i, j) != last and rid:
                    yield done()
                    rid, sim, own = [], [], []
                last = (f, i, j)
                rid.append(r)
                sim.append(np.asarray(b.values).view(np.uint64))
                own.append(np.asarray(s.values).view(np.uint64))
        if rid:
            yield done()

    return rows.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "rid").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs of each class, all columns; equal texts under one key are one document."""
    found = classes(docs, text=text, key=key).where("stays").select(F.col("rid").alias("_stays"), F.col(key).alias("_key")).distinct()
    rows = _with_rid(docs, {f"own{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c != text}, text)
    own = f"own{docs.columns.index(key)}"
    kept = rows.join(found, (rows["_rid"] == found["_stays"]) & rows[own].eqNullSafe(found["_key"]), "left_semi").dropDuplicates(["_rid", own])
    return kept.select(*[F.col("_text").alias(c) if c == text else F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """keep's columns (key by default), rid (a hash of the text), class_id, class_size and stays (the row is its
    class's first by key, null last, then rid; equal rows alike), one row for each row of docs."""
    keep = keep or {key: F.col(key)}
    sigs = store(signatures(docs, text), "signatures")
    links = store(candidates(sigs), "candidates")
    families = components(links)
    verified = store(_verify(docs, families, sigs, text), "verified")
    roots = components(verified)
    rows = _with_rid(docs, keep | {"_key": F.col(key)}, text).drop("_text")
    known = sigs.select(F.col("rid").alias("_rid"), F.lit(True).alias("_words"))
    labels = roots.select(F.col("v").alias("_rid"), F.col("l").alias("_l"))
    rows = rows.join(known, "_rid", "left").join(labels, "_rid", "left").withColumn("_root", F.coalesce("_l", "_rid"))
    whole = rows.where("_words")
    order = F.struct(F.col("_key").isNull(), "_key", "_rid")
    least = whole.groupBy("_root").agg(F.min(order).alias("_first"), F.min("_key").alias("_class"), F.count("*").alias("_size"))
    own = [F.col("_rid").alias("rid"), F.col("_class").alias("class_id"), F.col("_size").alias("class_size")]
    done = whole.join(least, "_root").select(*keep, *own, (F.col("_first") == order).alias("stays"))
    alone = rows.where("_words IS NULL").select(*keep, F.col("_rid").alias("rid"), F.col("_key").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return done.unionByName(alone)


def audit(docs: DataFrame, found: DataFrame, *, text: str = "text", key: str = "doc_id", every: int = 100, most: int = 5000) -> tuple[int, int]:
    """(expected, together): pairs of similarity SIMILAR or more between a sample of texts and all others, and how
    many of them found (classes with rid among its columns) has in one class.

    The sample is the texts of rows whose key is divisible by every, most of them at most (a documented bound of
    the sample, chosen by hash), compared with each distinct text by exact similarity.
    """
    chosen = docs.where((F.col(key) % every == 0) & F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(most)
    texts = [t for (t,) in chosen.collect()]
    asked = [(_rid(t.encode()), s) for t, s in zip(texts, shingle_sets(texts)) if len(s)]
    if not asked:
        return 0, 0
    flat = np.concatenate([s for _, s in asked])
    owner = np.repeat(np.arange(len(asked)), [len(s) for _, s in asked])
    order = np.argsort(flat, kind="stable")
    flat, owner, sizes, ids = flat[order], owner[order], np.array([len(s) for _, s in asked]), np.array([r for r, _ in asked])

    def part(batch):
        out = {"a": [], "b": []}
        for raw, s in zip(batch.column(0).cast(pa.binary()).to_pylist(), shingle_sets(batch.column(0).to_pylist())):
            if not len(s):
                continue
            low, high = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                common = np.bincount(np.concatenate([owner[low[i] : high[i]] for i in hit]), minlength=len(ids))
                near, rid = np.flatnonzero(common >= SIMILAR * (sizes + len(s) - common)), _rid(raw)
                near = near[ids[near] != rid]
                out["a"] += ids[near].tolist()
                out["b"] += [rid] * len(near)
        yield out

    pairs = arrow_pass(docs.select(F.col(text).alias("text")), part, "a long, b long").distinct()
    of = found.select("rid", "class_id").distinct()
    both = pairs.join(of.select(F.col("rid").alias("a"), F.col("class_id").alias("x")), "a").join(of.select(F.col("rid").alias("b"), F.col("class_id").alias("y")), "b")
    done = both.agg(F.count("*"), F.count_if(F.col("x").eqNullSafe(F.col("y")))).first()
    return done[0], done[1]
