"""Toxicity by two Kneser-Ney bigram models, one for each class.

All labelled training rows are counted: a count is the number of texts that hold a word or bigram, of texts that
share their smallest hash of word 5-grams one (copies would teach by rote). Modified Kneser-Ney discounts (one
each for counts of 1, 2 and 3 or more) are taken off a class's counts. A word's discounted mass goes to a backoff
distribution that both classes share and that is made of what was discounted in either, with one backoff weight
for both, so an expression that is rare everywhere, or unknown, counts for neither class. A bigram backs off to
the class's own word probability, with the weight of its history.

Every word and bigram of the counted rows is in the model, however rare, so the model grows with the rows. What a
few texts hold says little, though, and would outweigh all else if taken at its face: a word's log ratio, and a
bigram's change to that of its word, are multiplied by the probability that the expression tells the classes apart
at all, given its counts (for a bigram against what its word lets expect). Toxic shares are taken to be either what
is expected or drawn from a beta distribution around it; how often the latter, and how closely, is chosen by
the likelihood of all counts, for words and for bigrams, so no threshold is set by hand. The model is kept in files that workers map into memory (see `keytables`); neither the driver nor a worker has to hold it. Counts
are shuffled packed, the bigrams of a history together, so that its totals need no second shuffle. On
demand `fitted` prunes by relative entropy: a word or bigram stays if its mean probability in the classes times what
it changes in the log-likelihood ratio (at most MOST) exceeds a threshold; `train` asks for none. What wasn't
counted falls back, bigrams on their word, words on a ratio of 0.

A text's evidence is its length-normalised difference of log-likelihoods, and that of its worst passage of
PASSAGE words; a logistic curve, fitted on a fold that the counts leave out, turns both into a score.

Edge cases: a null, empty or wordless text has evidence 0 and gets the score of the intercept. Without
labelled rows of both classes, in the counted folds and in one more, every score is the training share of label 1
(0.0 without any label). Repeated label rows agree or count as toxic if one of them does; labels without a
document, null labels and null ids are ignored; columns other than those named are never read, and those kept
may have any name but mean, worst and score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import K1, arrow_pass, crossing, mix, spread, store, windows, word_hashes, worded
from millrace.llm.keytables import SLOT_BITS, KeyTable, slots, write

MOST, PASSAGE = 8.0, 3
STRENGTHS = 2.0 ** np.arange(9)  # of the beta distribution; 1: as Jeffreys' for two classes
TELLING = 2.0 ** -np.arange(1.0, 25.0)  # share of expressions that tell the classes apart
WORD = 0  # stands for the history of a word counted by itself
START = np.uint64(1)  # history of a text's first word
BROADCAST_ROWS = 2_000_000  # labels are broadcast up to so many rows, and shuffled beyond
MERGED = 1 << 20  # counts of a slot that a task gathers before it adds up equal ones


@dataclass
class KneserNey:
    of_words: KeyTable  # word hash -> log of toxic over ordinary probability
    of_pairs: KeyTable  # hash of a bigram that says other than its word -> the same
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)  # weights of mean and worst, and the intercept

    # the whole tables as arrays, sorted by hash; for small models
    words = property(lambda self: self.of_words.whole()[0])
    word_ratio = property(lambda self: self.of_words.whole()[1][0])
    pairs = property(lambda self: self.of_pairs.whole()[0])
    pair_ratio = property(lambda self: self.of_pairs.whole()[1][0])


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys in the slot of their history."""
    own = np.uint64(64 - SLOT_BITS)
    return (a >> own << own) | (mix(a * K1 + b) >> np.uint64(SLOT_BITS))


def merged(each: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts (a, b, ordinary, toxic), sorted by a, then b, each (a, b) once."""
    a, b, *n = (np.concatenate(x) for x in zip(*each))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], *(np.add.reduceat(x[order], first) for x in n)


def pack(a: np.ndarray, b: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> bytes:
    """Merged counts as bytes: each history once, numbers as short as the greatest allows."""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    sizes = np.diff(np.append(first, len(a)))
    short = [x.astype(np.min_scalar_type(int(x.max()))) for x in (sizes, ordinary, toxic)]
    head = np.array([len(first), len(a), *(x.itemsize for x in short)], np.int64)
    return b"".join(x.tobytes() for x in (head, a[first], b, *short))


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    histories, n, *wide = np.frombuffer(data, np.int64, 5).tolist()
    at, out = 40, []
    for count, kind in ((histories, "u8"), (n, "u8"), *((k, f"u{w}") for k, w in zip((histories, n, n), wide))):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    a, b, sizes, *counts = out
    return np.repeat(a, sizes.astype(np.int64)), b, *(x.astype(np.int64) for x in counts)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame, train_on: Column, label: str, quota: tuple[int, int], *, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled training rows as (key, fold, text, label), and the rows of each label.

    quota: rows of label 0 and of label 1 (expected; chosen by a hash of the key). The sample's labels are
    broadcast: they hold at most about quota rows.
    """
    each = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in each.withColumnRenamed("key", key).where(train_on).groupBy("label").count().collect()}
    share = F.when(F.col("label") == 0, min(1.0, quota[0] / max(1, sizes.get(0, 0)))).otherwise(min(1.0, quota[1] / max(1, sizes.get(1, 0))))
    chosen = each.withColumnRenamed("key", key).where(train_on & (spread(F.col(key)) < share)).select(F.col(key).alias("key"), "label")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    return rows.select("key", (F.crc32(F.col("key").cast("string").cast("binary")) % 5).cast("int").alias("fold"), "text", "label"), sizes


class Hashes(dict):
    """word -> its hash in the model; to look up single words."""

    def __missing__(self, word: str):
        self[word] = h = int(word_hashes([word.encode()])[0][0])
        return h


def _tokens(texts: list) -> list[np.ndarray]:
    return word_hashes([worded(t) if t else b"" for t in texts])


def first_copies(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """(key, fold, label): one row for each smallest hash of word 5-grams (whole text when shorter), the least by label, then key."""

    def part(batch):
        least = []
        for h in _tokens(batch.column(3).to_pylist()):
            grams = windows(h, min(shingle, len(h))) if len(h) else np.zeros(1, np.uint64)
            least.append(int(grams.min().view(np.int64)))
        yield {"key": batch.column(0), "fold": batch.column(1), "label": batch.column(2), "least": least}

    rows = rows.select("key", "fold", "label", "text")
    marked = arrow_pass(rows, part, "least long", rows.schema.fields[:-1])
    return marked.groupBy("least").agg(F.min(F.struct("label", "key", "fold")).alias("row")).select("row.*")


def count_pairs(rows: DataFrame) -> DataFrame:
    """(slot, word, data): packed counts (a, b, ordinary, toxic) of a slot, how many rows (text, label) of each class hold the bigram of a and b, or, where word is true and a is WORD, the word b.

    Partitioned by slot, that of the bigram's or word's key; one row for a slot's bigrams, one for its words.
    """

    def part(batch):
        seen = []
        for h, y in zip(_tokens(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
            if len(h):
                a = np.concatenate([[START], h[:-1]])
                _, first = np.unique(pair_key(a, h), return_index=True)
                own = np.unique(h)
                toxic = np.full(len(first) + len(own), y, np.int64)
                seen.append((np.concatenate([a[first], np.full(len(own), WORD, np.uint64)]), np.concatenate([h[first], own]), 1 - toxic, toxic))
        if seen:
            a, b, *n = merged(seen)
            words = int(np.searchsorted(a, WORD, side="right"))
            out = {"slot": [], "word": [], "data": []}
            for word, lo, hi in ((True, 0, words), (False, words, len(a))):
                at = slots(b[lo:hi] if word else a[lo:hi])  # ascending, as what they are made of
                cuts = (lo + np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))).tolist()
                for i, k in zip(cuts, [*cuts[1:], hi]):
                    out["slot"].append(int(at[i - lo]))
                    out["word"].append(word)
                    out["data"].append(pack(a[i:k], b[i:k], *(x[i:k] for x in n)))
            yield out

    def gather(batches):
        held, now, limit = [], None, MERGED

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]]), pa.array([pack(*merged(held))], pa.binary())], names=["slot", "word", "data"])

        for batch in batches:
            for place, data in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                if held and place != now:
                    yield done()
                    held, limit = [], MERGED
                now = place
                held.append(unpack(data.as_buffer()))
                limit -= len(held[-1][0])
                if limit < 0:
                    held = [merged(held)]
                    limit = max(MERGED, len(held[0][0]))
        if held:
            yield done()

    found = arrow_pass(rows.select("text", "label"), part, "slot int, word boolean, data binary").repartition("slot")
    return found.sortWithinPartitions("slot", "word").mapInArrow(gather, "slot int, word boolean, data binary")


def discounts(n: tuple[int, int, int, int]) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, and 3 or more, given how many have the counts 1 to 4."""
    n1, n2, n3, n4 = (k + 0.1 for k in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 1.0, 2.0, 3.0])


def log_gamma(x: np.ndarray) -> np.ndarray:
    low = np.ones_like(x)
    for j in range(8):
        low = low * (x + j)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def telling(n: np.ndarray, share: np.ndarray, strength: float) -> np.ndarray:
    """Log-likelihood of counts n (a row a class) if the toxic share is drawn around share, over that if it is share."""
    beta = lambda a, b: log_gamma(a) + log_gamma(b) - log_gamma(a + b)
    a, b = strength * share, strength * (1 - share)
    return beta(n[1] + a, n[0] + b) - beta(a, b) - n[1] * np.log(share) - n[0] * np.log1p(-share)


def _share(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.broadcast_to(np.clip(expected[1] / expected.sum(0), 1e-9, 1 - 1e-9), n.shape[1:])


def certainty(n: np.ndarray, expected: np.ndarray, prior: tuple[float, float] | None) -> np.ndarray:
    """0 to 1: how far counts n (a row a class) that differ from the expected proportions are to be believed; prior (see chosen) None: wholly."""
    if prior is None:
        return np.ones(n.shape[1])
    strength, rate = prior
    return 1 / (1 + np.exp(-np.clip(telling(n, _share(n, expected), strength) + math.log(rate / (1 - rate)), -50, 50)))


def likelihoods(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Of each strength and telling share, the log-likelihood of counts n; equal counts at once, shares to 1/16 of log odds."""
    share = _share(n, expected)
    odds = np.round(16 * np.log(share / (1 - share)))
    order = np.lexsort((odds, n[1], n[0]))
    each = np.stack([*n, odds])[:, order]
    first = np.flatnonzero(np.concatenate([[True], (each[:, 1:] != each[:, :-1]).any(0)]))
    times, each = np.diff(np.append(first, n.shape[1])), each[:, first]
    centre = 1 / (1 + np.exp(-each[2] / 16))
    rate = TELLING[:, None]
    return np.stack([np.logaddexp(np.log(rate) + telling(each[:2], centre, k), np.log1p(-rate)) @ times for k in STRENGTHS])


def chosen(rows: DataFrame, against: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """The strength and telling share under which all counts of rows (column data) are likeliest; against gives counts and what is expected."""

    def run(batches):
        total = np.zeros((len(STRENGTHS), len(TELLING)))
        for batch in batches:
            for data in batch.column(0):
                total += likelihoods(*against(data.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["all"])

    # one row of a few numbers a partition
    found = [r[0] for r in rows.select("data").mapInArrow(run, "all array<double>").collect()]
    k, r = divmod(int(np.argmax([math.fsum(x) for x in zip(*found)])), len(TELLING))
    return float(STRENGTHS[k]), float(TELLING[r])


def train(docs: DataFrame, labels: DataFrame, train_on: Column, *, label: str = "toxic", quota: tuple[int, int] = (2500, 2500), word_least: float = 0.0, pair_least: float = 0.0, text: str = "text", key: str = "doc_id") -> KneserNey | float:
    """Counts all labelled rows where train_on holds but one fold of four, on which the curve is fitted.

    quota bounds the sample of that fold (rows of label 0, rows of label 1) that the curve is fitted on.
    word_least, pair_least: thresholds of pruning (0: none). Gives a float, the share of label 1, when a class is missing.
    """
    fold = (F.crc32(F.col("key").cast("string").cast("binary")) % 5).cast("int")
    each = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(label).cast("int").alias("label"))
    each = each.where(train_on).select(F.col(key).alias("key"), "label").withColumn("fold", fold)
    sizes = {(r[0], r[1]): r[2] for r in each.groupBy("label", "fold").count().collect()}
    of = {k: sum(n for (y, _), n in sizes.items() if y == k) for k in (0, 1)}
    share = of[1] / sum(of.values()) if sizes else 0.0
    whole = lambda f, k: of[k] - sizes.get((k, f), 0)
    able = [f for f in range(5) if all(sizes.get((k, f), 0) and whole(f, k) for k in (0, 1))]
    if not able:
        return share
    held = max(able, key=lambda f: (min(sizes[k, f] for k in (0, 1)), f))
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    beside = F.broadcast if sum(of.values()) <= BROADCAST_ROWS else lambda df: df
    kept = store(first_copies(joined.join(beside(each), "key")), "training")
    pairs = count_pairs(joined.join(beside(kept.where(F.col("fold") != held)), "key")).persist()
    model = fitted(pairs, word_least, pair_least, weighted=True)
    pairs.unpersist()
    if model is None:
        return share
    rate = F.when(F.col("label") == 0, min(1.0, quota[0] / sizes[0, held])).otherwise(min(1.0, quota[1] / sizes[1, held]))
    sample = joined.join(F.broadcast(kept.where((F.col("fold") == held) & (spread(F.col("key")) < rate))), "key")
    found = evidence(sample, model, {"label": F.col("label")}).toPandas().sort_values(["label", "mean", "worst"])
    y = found["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return share
    weight = np.where(y == 1, of[1] / y.sum(), of[0] / (1 - y).sum())
    x = np.stack([found["mean"], found["worst"], np.ones(len(y))], axis=1)
    model.curve = tuple(map(float, logistic(x, y, weight / weight.mean(), ridge=1e-2)))
    return model


def fitted(pairs: DataFrame, word_least: float, pair_least: float, weighted: bool = False) -> KneserNey | None:
    """The models of a table of counts (see count_pairs), pruned where a threshold isn't 0; None when a class has no word.

    weighted: ratios count as far as they are certain; else they are those of plain Kneser-Ney.
    """
    by = ("ordinary", "toxic")
    tallies = [*by, *(f"{c}{k}" for c in by for k in (1, 2, 3, 4)), *(f"{c}_more" for c in by)]

    def tally(batches):
        for batch in batches:
            sums = []
            for data in batch.column(1):
                *_, n0, n1 = unpack(data.as_buffer())
                sums.append([int(n0.sum()), int(n1.sum()), *(int((n == k).sum()) for n in (n0, n1) for k in (1, 2, 3, 4)), *(int((n >= 3).sum()) for n in (n0, n1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*sums))], names=["word", *tallies]) if sums else pa.RecordBatch.from_pylist([], pa.schema([("word", pa.bool_()), *((t, pa.int64()) for t in tallies)]))

    each = pairs.select("word", "data").mapInArrow(tally, "word boolean, " + ", ".join(f"{t} long" for t in tallies))
    sums = {r["word"]: r for r in each.groupBy("word").agg(*[F.sum(t).alias(t) for t in tallies]).collect()}
    if True not in sums or not all(sums[True][c] for c in by):
        return None
    cut = {w: {c: discounts(tuple(r[f"{c}{k}"] for k in (1, 2, 3, 4))) for c in by} for w, r in sums.items()}
    total = {c: float(sums[True][c]) for c in by}
    off = lambda r, c, d: d[1] * r[f"{c}1"] + d[2] * r[f"{c}2"] + d[3] * r[f"{c}_more"]
    shared_total = sum(off(sums[True], c, cut[True][c]) for c in by)
    back = float(np.sqrt(np.prod([off(sums[True], c, cut[True][c]) / total[c] for c in by])))
    log_ratio = lambda p: np.clip(np.log(p[1] / p[0]), -MOST, MOST)
    weighs = lambda n, change: sum(n[c] / total[c] for c in by) / 2 * np.abs(change)

    def probable(n: dict[str, np.ndarray]) -> np.ndarray:
        taken = {c: cut[True][c][np.minimum(n[c], 3)] for c in by}
        shared = back * sum(taken.values()) / max(shared_total, 1e-300)
        return np.stack([(n[c] - taken[c]) / total[c] + shared for c in by])

    def counts(data: bytes) -> dict[str, np.ndarray]:
        return dict(zip(("a", "b", *by), unpack(data)))

    def of_classes(n: dict[str, np.ndarray]) -> np.ndarray:
        return np.stack([n[c] for c in by]).astype(float)

    words, bigrams = (pairs.where(which).select("slot", "data") for which in ("word", "not word"))
    all_words = np.array([[total[c]] for c in by])
    prior = chosen(words, lambda data: (of_classes(counts(data)), all_words)) if weighted else None

    def word_ratios(n: dict[str, np.ndarray]):
        p = probable(n)
        plain = log_ratio(p)
        return n["b"], np.stack([plain * certainty(of_classes(n), all_words, prior), *p]), weighs(n, plain) > word_least

    def kept_words(n: dict[str, np.ndarray]):
        keys, values, stays = word_ratios(n)
        return keys[stays], values[:1, stays]

    of_words = write(words, lambda n: kept_words(counts(*n["data"])), 1, "words")
    alone = write(words, lambda n: word_ratios(counts(*n["data"]))[:2], 3, "probabilities")

    def expected(p) -> np.ndarray:
        """A word is expected as often in bigrams as its probabilities say, each class having its own number of bigrams."""
        return np.stack([p[k] * sums[False][c] for k, c in enumerate(by)])

    def against_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = counts(data)
        return of_classes(n), expected(alone.find(n["b"])[0][1:])

    pair_prior = chosen(bigrams, against_words) if weighted else None

    def pair_ratios(n: dict[str, np.ndarray]):
        a, b = n["a"], n["b"]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        of_history = lambda x: np.repeat(np.add.reduceat(x, first), np.diff(np.append(first, len(a))))
        ((lower, *p), _), upper = alone.find(b), []
        for k, c in enumerate(by):
            taken, held = cut[False][c][np.minimum(n[c], 3)], of_history(n[c])
            most = np.maximum(held, 1)
            upper.append((n[c] - taken) / most + np.where(held > 0, of_history(taken) / most, 1.0) * p[k])
        change = log_ratio(upper) - log_ratio(p)
        believed = certainty(of_classes(n), expected(p), pair_prior)
        stays = weighs(n, change) > pair_least
        return pair_key(a, b)[stays], (lower + change * believed)[None, stays]

    of_pairs = write(bigrams, lambda n: pair_ratios(counts(*n["data"])), 1, "pairs")
    alone.delete()
    return KneserNey(of_words, of_pairs)


def evidence(docs: DataFrame, model: KneserNey, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """keep's columns and the evidence: mean double (difference of log-likelihoods a word) and worst double (that
    of the PASSAGE words in which it is greatest; shorter texts count as if words of no weight followed)."""
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    names = list(keep)
    of_words, of_pairs = model.of_words, model.of_pairs

    def part(batch):
        each = _tokens(batch.column(batch.num_columns - 1).to_pylist())
        n = np.array([len(x) for x in each])
        mean, worst = np.zeros(len(each)), np.zeros(len(each))
        full = np.flatnonzero(n)
        if len(full):
            h = np.concatenate(each)
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            before = np.concatenate([[START], h[:-1]])
            before[starts] = START
            (alone,), _ = of_words.find(h)
            (both,), there = of_pairs.find(pair_key(before, h))
            ratio = np.where(there, both, alone)
            total = np.add.reduceat(ratio, starts)
            passage = np.full(len(h), -np.inf)
            if len(h) >= PASSAGE:
                inside = crossing(n[full], PASSAGE)
                passage[: len(inside)] = np.where(inside, sum(ratio[i : i + len(inside)] for i in range(PASSAGE)), -np.inf)
            best = np.maximum.reduceat(passage, starts)
            mean[full], worst[full] = total / n[full], np.where(np.isfinite(best), best, total) / PASSAGE
        yield {k: batch.column(i) for i, k in enumerate(names)} | {"mean": mean, "worst": worst}

    return arrow_pass(kept, part, "mean double, worst double", kept.schema.fields[:-1])


def score(docs: DataFrame, model: KneserNey | float, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """keep's columns and score double (0 to 1) of each row's whole text."""
    if isinstance(model, float):
        return docs.select(*[c.alias(n) for n, c in keep.items()], F.lit(model).alias("score"))
    a, b, c = map(F.lit, model.curve)
    z = a * F.col("mean") + b * F.col("worst") + c
    return evidence(docs, model, keep, text).select(*[F.col(f"`{k}`") for k in keep], (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))).alias("score"))
