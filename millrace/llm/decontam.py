"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are cut into n-grams of words (lower-cased runs of ASCII letters, digits and other than ASCII
signs). Documents are read once against them; the passage round each cluster of shared n-grams is kept as
word hashes. Every shared n-gram is a seed, however many documents hold it: leaks raise the frequency of an
item's own n-grams, so a limit on it would lose the edited copies of what leaked most. What an n-gram's rarity
would spare is spared by a bound instead: an alignment's score is at most the number of words (repeats counted)
that passage and item have in common, so passages with fewer than the threshold asks for, which is nearly all
that share a common phrase only, are dropped before they leave their task. Each distinct passage of an item is
aligned once, for all documents that have it, to the item (match +1, other word -1, gap -1), and the score is
the best local alignment over the item's words.

Edge cases: null and empty texts, and items of fewer than n words, match nothing; an item that occurs several
times in a document gives one row, its best passage (the first of equals); repeated rows give repeated results;
the items are read in blocks of bounded size, so the driver and the workers never hold more than one block;
item ids may be of any type; columns that are kept may have any name but those that are added.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField

from millrace.llm.common import Filter64, Hashes, arrow_pass, crossing, in_sorted, store, tokens, windows

BLOCK_MB = 16


def in_common(item: np.ndarray, passage: np.ndarray) -> int:
    """How many words item and passage have in common, repeats counted."""
    words, n = np.unique(item, return_counts=True)
    at = in_sorted(passage, words)
    return int(np.minimum(n, np.bincount(at[at >= 0], minlength=len(words))).sum())


def _hits(docs: DataFrame, items: list[tuple], kind: DataType, keep: dict[str, Column], text: str, n: int, threshold: float) -> DataFrame:
    memo = Hashes()
    words = [memo.of(tokens(t)) for _, t in items]
    grams = [windows(w, n) for w in words]
    key = np.concatenate([*grams, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    size = np.array([len(w) for w in words], np.int64)
    ids = [i for i, _ in items]
    kept = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).alias("_text"))
    names, ready = list(keep), {}

    def part(batch):
        if not ready:
            ready.update(find=Filter64(key), memo=Hashes())
            ready["first"] = np.searchsorted(key, ready["find"].keys)
            ready["last"] = np.searchsorted(key, ready["find"].keys, side="right")
        each = [tokens(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
        lengths = np.array([len(x) for x in each], np.int64)
        h = ready["memo"].of([w for x in each for w in x])
        g = windows(h, n)
        if not len(g):
            return
        at, hit = ready["find"].find(g)
        if not len(at):
            return
        good = crossing(lengths, n)[at]
        at, hit = at[good], hit[good]
        ends = np.cumsum(lengths)
        row = np.searchsorted(ends, at, side="right")
        found = defaultdict(list)
        for p, r, a, b in zip(at.tolist(), row.tolist(), ready["first"][hit].tolist(), ready["last"][hit].tolist()):
            for i in set(owner[a:b].tolist()):
                found[r, i].append(p)
        rows, out = [], {"item_id": [], "item_words": [], "start": [], "passage": []}
        for (r, i), ps in found.items():
            low, high, reach = ends[r] - lengths[r], ends[r], int(size[i])
            cut = [0, *(k for k in range(1, len(ps)) if ps[k] - ps[k - 1] > reach), len(ps)]
            for a, b in zip(cut, cut[1:]):
                s, e = max(low, ps[a] - reach), min(high, ps[b - 1] + n + reach)
                if in_common(words[i], h[s:e]) < threshold * reach:
                    continue
                rows.append(r)
                for k, v in (("item_id", ids[i]), ("item_words", words[i].view(np.int64)), ("start", s - low), ("passage", h[s:e].view(np.int64))):
                    out[k].append(v)
        if rows:
            yield {k: batch.column(j).take(rows) for j, k in enumerate(names)} | out

    return arrow_pass(kept, part, "item_words array<long>, start long, passage array<long>", [*kept.schema.fields[:-1], StructField("item_id", kind)])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, start, end) in the passage; the first of equals."""
    h, origin = np.zeros(len(item) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    index = np.arange(len(item) + 1)
    best = (0, 0, 0)
    for j, word in enumerate(passage):
        step = np.where(item == word, 1, -1)
        new, src = np.zeros_like(h), np.full_like(origin, j + 1)
        diag = h[:-1] + step
        up = h[1:] - 1
        take = diag >= up
        value = np.where(take, diag, up)
        came = np.where(take, np.where(h[:-1] > 0, origin[:-1], j), origin[1:])
        pos = value > 0
        new[1:][pos], src[1:][pos] = value[pos], came[pos]
        # gaps along the item: the best of new[k] - (i - k)
        run = np.maximum.accumulate(new + index)
        better = run - index > new
        if better.any():
            where = np.maximum.accumulate(np.where(new + index == run, index, 0))
            src = np.where(better, src[where], src)
            new = np.where(better, run - index, new)
        h, origin = new, src
        top = int(h.argmax())
        if h[top] > best[0]:
            best = (int(h[top]), int(origin[top]), j + 1)
    return best


def find_leaks(docs: DataFrame, items: DataFrame, *, keep: dict[str, Column] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 4, threshold: float = 0.5) -> DataFrame:
    """(keep's columns, item_id, score, start, end): passages of docs that align to items at threshold or above."""
    keep = keep or {"doc_id": F.col("doc_id")}
    sized = items.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    mb = (sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / 1e6
    parts, kind = 1 + int(mb // BLOCK_MB), sized.schema["i"].dataType
    found = None
    for k in range(parts):
        block = [(r[0], r[1]) for r in sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").collect()]
        hits = _hits(docs, block, kind, keep, text, n, threshold)
        found = hits if found is None else found.unionByName(hits)
    hits = store(found, "passages")
    # few rows with much work each: spread over all tasks by number, which AQE doesn't coalesce
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = hits.select("item_id", "item_words", "passage").distinct().repartition(tasks, "item_id", "passage")

    def part(batch):
        words, passages = batch.column(2), batch.column(3)
        got = [align(np.asarray(w.values), np.asarray(p.values)) for w, p in zip(words, passages)]
        score = [s / len(w.values) for (s, _, _), w in zip(got, words)]
        yield {"item_id": batch.column(0), "item_words": words, "passage": passages, "score": score, "first": [g[1] for g in got], "last": [g[2] for g in got]}

    own = ["item_id", "item_words", "passage"]
    aligned = arrow_pass(chosen.select("item_id", F.lit("").alias("text"), "item_words", "passage"), part, "item_words array<long>, passage array<long>, score double, first long, last long", [StructField("item_id", kind)])
    leaks = aligned.where(F.col("score") >= threshold).select(*[F.col(c).alias(f"_{c}") for c in (*own, "score", "first", "last")])
    same = [F.col(c) == F.col(f"_{c}") for c in own]
    placed = hits.join(leaks, same).select(*keep, "item_id", F.col("_score"), (F.col("start") + F.col("_first")).alias("_from"), (F.col("start") + F.col("_last")).alias("_to"))
    best = placed.groupBy(*keep, "item_id").agg(F.max(F.struct("_score", (-F.col("_from")).alias("back"), "_to")).alias("b"))
    return best.select(*keep, "item_id", F.col("b._score").alias("score"), (-F.col("b.back")).alias("start"), F.col("b._to").alias("end"))
