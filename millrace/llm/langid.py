"""Language identification by known words first, character n-grams for the rest.

A text is lower-cased and cut into runs of letters. A word seen at least min_count times in training adds
its smoothed log-frequency per language. Any other word backs off: at each of its characters the longest
known n-gram that starts there (max_n characters down to one) adds its log-frequency, and the mean over the
word counts. The language with the largest sum wins.

Edge cases: a null text, or one without a letter, gives `und` with score 0.0, as does everything when no
training row has a language. Equal sums go to the first language in sorted order. Repeated rows are scored
alike, each by itself; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import arrow_pass, spread

LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"
WORDS_HELD = 400_000  # unseen words a worker remembers the scores of


@dataclass
class LanguageModel:
    langs: list[str]
    words: dict[str, int]  # word -> row of word_scores
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    max_n: int

    def backoff(self, word: str) -> np.ndarray:
        padded, rows, get = f"^{word}$", [], self.grams.get
        for i in range(len(padded)):
            for size in range(min(self.max_n, len(padded) - i), 0, -1):
                at = get(padded[i : i + size])
                if at is not None:
                    rows.append(at)
                    break
        return np.add.reduce(self.gram_scores[rows], 0) / max(len(rows), 1)


def _counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over df, counted within batches before the shuffle."""

    def part(batch):
        each: dict[str, Counter] = defaultdict(Counter)
        for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t:
                each[k].update(LETTERS.findall(t.lower()))
        rows = [(k, w, n) for k, c in each.items() for w, n in c.items()]
        yield {"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows]}

    found = arrow_pass(df.select(F.col(text).alias("text"), F.col(lang).alias("lang")), part, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, train_on: Column, *, text: str = "text", lang: str = "lang", key: str = "doc_id", quota: int = 250, min_count: int = 2, max_n: int = 4) -> LanguageModel:
    """Fits the model on rows of docs where train_on holds and lang is not null.

    quota: documented bound of the training sample, rows for each language (expected; chosen by a hash of
    the key). All words of min_count and all n-grams of the sample are in the model.
    """
    rows = docs.where(train_on & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), max_n)
    share = F.lit(1.0)
    for k in langs:
        share = F.when(F.col(lang) == k, F.lit(min(1.0, quota / sizes[k]))).otherwise(share)
    sample = rows.where(spread(F.col(key)) < share)
    of = {k: i for i, k in enumerate(langs)}
    found = _counts(sample, text, lang).toPandas()
    names, row = np.unique(found["word"].to_numpy().astype(str), return_inverse=True)
    counts = np.zeros((len(names), len(langs)))
    np.add.at(counts, (row, found["lang"].map(of).to_numpy(dtype=int)), found["n"].to_numpy())

    def logs(keys: list[str], m: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        return {k: i for i, k in enumerate(keys)}, np.log((m + 0.5) / (m.sum(0) + 0.5 * max(1, len(keys))))

    def gram_table(size: int) -> tuple[list[str], np.ndarray]:
        ids: dict[str, int] = {}
        pairs = [(ids.setdefault(p[i : i + size], len(ids)), r) for r, w in enumerate(names) for p in (f"^{w}$",) for i in range(len(p) - size + 1)]
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        m = np.zeros((len(ids), len(langs)))
        for k in range(len(langs)):
            m[:, k] = np.bincount(at[:, 0], weights=counts[at[:, 1], k], minlength=len(ids))
        return list(ids), m

    often = np.flatnonzero(counts.sum(1) >= min_count)
    known, word_scores = logs([str(names[i]) for i in often], counts[often])
    grams, scores = {}, [np.zeros((0, len(langs)))]
    for size in range(1, max_n + 1):
        at, s = logs(*gram_table(size))
        grams |= {g: i + sum(map(len, scores)) for g, i in at.items()}
        scores.append(s)
    return LanguageModel(langs, known, word_scores.astype(np.float32), grams, np.vstack(scores).astype(np.float32), max_n)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: dict[str, Column]) -> DataFrame:
    """The columns of keep (name -> Column), then lang_pred string and score double of each row's whole text."""
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    names = list(keep)
    state: dict = {}

    def rows_of(words: list[str]) -> np.ndarray:
        if not state:
            state.update(at=dict(model.words), scores=np.zeros((len(model.words) + 4096, len(model.langs)), np.float32), n=len(model.words))
            state["scores"][: len(model.words)] = model.word_scores
        at, scores = state["at"], state["scores"]
        new = [w for w in words if w not in at]
        if new:
            if state["n"] + len(new) > len(model.words) + WORDS_HELD:
                at = state["at"] = dict(model.words)
                state["n"] = len(at)
                new = [w for w in words if w not in at]
            new = list(dict.fromkeys(new))
            if state["n"] + len(new) > len(scores):
                scores = state["scores"] = np.concatenate([scores, np.zeros((max(len(scores), len(new)), scores.shape[1]), np.float32)])
            for w in new:
                scores[state["n"]] = model.backoff(w)
                at[w] = state["n"]
                state["n"] += 1
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def part(batch):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        each = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        lengths = np.array([len(x) for x in each])
        pred, score = [UND] * len(texts), [0.0] * len(texts)
        if model.langs and lengths.sum():
            sums = np.zeros((len(texts), len(model.langs)))
            full = np.flatnonzero(lengths)
            rows = rows_of([w for x in each for w in x])
            starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            for k in range(len(model.langs)):
                sums[full, k] = np.add.reduceat(state["scores"][rows, k].astype(np.float64), starts)
            best = sums.argmax(1)
            share = 1.0 / np.exp(np.minimum(700.0, sums - sums[np.arange(len(best)), best][:, None])).sum(1)
            for i in full:
                pred[i], score[i] = model.langs[best[i]], float(min(1.0, share[i]))
        out = {n: batch.column(i) for i, n in enumerate(names)}
        yield out | {"lang_pred": pred, "score": score}

    return arrow_pass(kept, part, "lang_pred string, score double", kept.schema.fields[:-1])

