"""Each corpus operator against a brute-force version, and on nulls, empty texts, ties, repeated rows, extra columns and empty tables."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, common, decontam, fingerprints, keytables, langid, licenses, mixing, neardup, quality, queries, substrings, toxicity
from millrace.llm.common import held_out, tokens, windows
from millrace.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rid string, size string"
VOCABULARY = {"en": "the of and to house river green walking stone light".split(), "fr": "le de et à maison rivière verte marcher pierre lumière".split()}


def words(rng, lang, n):
    return [rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "er", "tion"]) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts of two languages, some toxic, some poor, copies, and the awkward ones."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 3 else "fr"
        w = words(rng, lang, rng.randint(30, 120))
        toxic, poor = i % 5 == 1, i % 7 == 2
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(["blockhead", "vermin", "rubbish"])
        if poor:
            w = [x + rng.choice(["%%%", "###"]) for x in w]
        rows.append((i, " ".join(w), lang, f"s{i % 3}", 1, "x", "y", "z"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, None, None, None, None, None, None, None), (1001, "", "en", "s0", 0, None, None, None), (1002, " \n\t ", None, None, 3, None, None, None), (1003, "5 % 7", "en", "s1", 5, None, None, None), (None, "the river", None, "s2", 9, None, None, None)]
    rows += [(1004, rows[0][1], "en", None, None, None, None, None), rows[3], (1005, "word " * 30000, "en", "s0", 150000, None, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([*corpus[1], corpus[1][0], (99999, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keep():
    return {"doc_id": F.col("doc_id"), "out": held_out(F.col("doc_id"))}


TRAIN = "crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"


def test_held_out(spark):
    got = {r.i: r.o for r in spark.range(50).select(F.col("id").alias("i"), held_out(F.col("id")).alias("o")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_windows_and_tokens():
    h = np.array([5, 6, 5, 6, 7, 5, 6, 5], np.uint64)
    for w in (1, 2, 3, 5, 8):
        got, own = windows(h, w), [tuple(h[i : i + w]) for i in range(len(h) - w + 1)]
        assert len(got) == len(own) and all((got[i] == got[j]) == (own[i] == own[j]) for i in range(len(own)) for j in range(len(own)))
    assert len(windows(h, 9)) == 0 and tokens("A-b, ÉTÉ  c_1") == [b"a", b"b", "été".encode(), b"c", b"1"]


def test_words_of_whole_texts_are_hashed_as_each_alone(monkeypatch):
    rng = random.Random(3)
    parts = ["a", "ab", "a\0", "\0", "été", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "y" * 256, "y" * 257, "z" * 3000, "\x85", "\xa0"]
    parts += ["".join(rng.choices("ab\0é", k=rng.randint(1, 40))) for _ in range(300)]
    texts = ["".join(x for w in rng.choices(parts, k=rng.randint(0, 60)) for x in (w, rng.choice([" ", "  ", "\t", "\n", "\x0b\x0c", "\r"]))).encode() for _ in range(50)]
    texts = [b"", b"  ", *texts, b"end", b" end", b"end "]
    alone = {w: int(common.word_hashes([w])[0][0]) for t in texts for w in t.split()}
    assert len(set(alone.values())) == len(alone)
    for piece in (1, 100, 1 << 18):
        monkeypatch.setattr(common, "PIECE_BYTES", piece)
        assert [h.tolist() for h in common.word_hashes(texts)] == [[alone[w] for w in t.split()] for t in texts]
    assert common.word_hashes([]) == []


def test_words_of_any_characters():
    rng = random.Random(4)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10FFFF)]]
    texts = ["".join(every[i : i + 999]) for i in range(0, len(every), 999)] + ["x".join(every[i : i + 999]) for i in range(0, len(every), 999)]
    texts += ["".join(rng.choices("aZ_é É-\u03a3\u0130\u00df\u0345\U00010400\u2160\u00b2", k=30)) for _ in range(500)]
    for t in texts:
        assert common.worded(t).split() == [w.encode() for w in common.WORDS.findall(t.lower())]


def test_hashes_of_words_that_differ_little_are_spread():
    h = common.word_hashes([b" ".join(b"%d" % i for i in range(200_000))])[0]
    assert len(np.unique(h)) == 200_000
    for shift in (0, 24, 48, 54):
        seen = np.bincount((h >> np.uint64(shift) & np.uint64(1023)).astype(int), minlength=1024)
        assert 600 < ((seen - 200_000 / 1024) ** 2).sum() / (200_000 / 1024) < 1500  # chi square of 1023 degrees


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.v: r.l for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows):
    sets = [({tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if (w := tokens(r[1] or "")) else set()) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return collections.Counter(tuple(sorted((str(rows[k][0]) for k in g))) for g in _groups(len(rows), root))


def _groups(n, root):
    out = collections.defaultdict(list)
    for i in range(n):
        out[root(i)].append(i)
    return out.values()


def test_near_duplicates(spark, docs, corpus, empty):
    rng = random.Random(9)
    base = [words(rng, "en", 120) for _ in range(12)]
    rows = list(corpus[0][:60]) + corpus[0][400:]
    for g, w in enumerate(base):
        for c in range(6):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = f"edit{rng.random()}"
            rows.append((2000 + 10 * g + c, " ".join(v), "en", "s", 1, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = neardup.classes(df, keep={"id": F.col("doc_id")})
    by = collections.defaultdict(list)
    for i, r in enumerate(got.collect()):
        by[r.class_id if r.class_id is not None else f"none{i}"].append(str(r.id))
    merged = collections.Counter(tuple(sorted(v)) for v in by.values())
    assert merged == brute_classes(rows)
    expected, together = neardup.audit(df, got, every=10)
    assert 0 < expected == together
    assert neardup.audit(empty, neardup.classes(empty)) == (0, 0)
    assert neardup.classes(empty).count() == 0
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1004").count() + kept.where("doc_id = 0").count() == 1


def test_large_groups_are_searched_whole(spark):
    """One shared minhash group many times the shard's size, in blocks, and a beam that has to give way to exact search."""
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    sims = [centre.copy() for _ in range(300)]
    for k, s in enumerate(sims):
        for b in rng.integers(0, 256, k % 12):
            s[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    kind = "rid long, n int, sim array<long>, routes array<long>, further array<long>"
    for further in ([3], [5, 6]):  # all share the further addresses too, so these are cut in blocks
        sigs = spark.createDataFrame([(i, 9, [int(x) for x in s.view(np.int64)], [7, 1000 + i], further) for i, s in enumerate(sims)], kind)
        labels_ = components(neardup.candidates(sigs, shard=40))
        assert labels_.select("l").distinct().count() == 1 and labels_.count() == 300
    links = neardup.shard_links(np.zeros(300, np.int64), np.array(sims))
    assert len(neardup._thinned(links, 300)) == 299
    # a crowded address whose texts differ in their further ones: those who share one meet
    apart = spark.createDataFrame([(i, 9, [int(x) for x in s.view(np.int64)], [7, 1000 + i], [i // 10, 5000 + i]) for i, s in enumerate(sims)], kind)
    assert {(r.v // 10, r.l // 10) for r in components(neardup.candidates(apart, shard=40)).collect()} == {(i, i) for i in range(30)}


def test_isolated_pairs_in_a_large_group_are_found():
    """A group of texts that share much but aren't neighbours, with a few true pairs, beside many small families."""
    rng = np.random.default_rng(3)
    n = 4000
    flip = lambda k, share: np.packbits(rng.random((k, 256)) < share, axis=1).view(np.uint64)
    sim = flip(n, 0.25) ^ flip(1, 0.5)
    pairs = rng.permutation(n)[:80].reshape(-1, 2)
    sim[pairs[:, 1]] = sim[pairs[:, 0]] ^ flip(40, 0.11)
    families = np.repeat(flip(2000, 0.5), 8, axis=0) ^ flip(16000, 0.02)
    group = np.concatenate([np.zeros(n, np.int64), np.repeat(np.arange(1, 2001), 8)])
    links = neardup.shard_links(group, np.concatenate([sim, families]))
    assert {tuple(sorted(p)) for p in pairs.tolist()} <= links


def test_short_texts_at_the_threshold(spark):
    """8 words and the same with one more: 4 of 5 shingles."""
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(8 + k)), "en", "s", 1, None, None, None) for i in range(300) for k in (0, 1)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_language(docs, corpus, empty):
    model = langid.train(docs, F.expr(TRAIN))
    got = {r.doc_id: r for r in langid.identify(docs, model, keep=keep()).collect()}
    held = [r for r in corpus[0][:400] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002, 1003))
    assert got[0].lang_pred == got[1004].lang_pred and all(0 <= r.score <= 1 for r in got.values())
    assert model.backoff("maisonette").argmax() == model.langs.index("fr")
    none = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none, keep=keep()).collect()} == {"und"}
    assert langid.identify(empty, model, keep=keep()).count() == 0


def test_toxicity(docs, labels, corpus, empty):
    model = toxicity.train(docs, labels, F.expr(TRAIN))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, keep()).collect()}
    toxic = {i for i, _, t in corpus[1] if t}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i in toxic) for i in held) >= 0.9 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] == got[1002] and got[0] == got[1004]
    only = toxicity.train(docs, labels.where("toxic = 0"), F.expr(TRAIN))
    assert only == 0.0 and toxicity.score(docs, only, keep()).count() == docs.count()
    assert toxicity.train(empty, labels.limit(0), F.expr(TRAIN)) == 0.0 and toxicity.score(empty, model, keep()).count() == 0


def test_language_scores_are_the_plain_ones(docs, corpus):
    """Counts, smoothing and backoff by dictionaries, over the same training texts."""
    model = langid.train(docs, F.expr(TRAIN), quota=10**6)
    letters = re.compile(r"[^\W\d_]+")
    train = [r for r in corpus[0] if r[0] is not None and r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    langs = sorted({r[2] for r in train})
    n = {k: collections.Counter() for k in langs}
    for r in train:
        n[r[2]].update(letters.findall(r[1].lower()))
    often = {w for w in set().union(*n.values()) if sum(c[w] for c in n.values()) >= 2}
    words_total = {k: sum(n[k][w] for w in often) for k in langs}
    grams = {k: {s: collections.Counter() for s in (1, 2, 3, 4)} for k in langs}
    for k in langs:
        for w, c in n[k].items():
            for s in (1, 2, 3, 4):
                for i in range(len(w) + 3 - s):
                    grams[k][s][f"^{w}$"[i : i + s]] += c
    kinds = {s: set().union(*(grams[k][s] for k in langs)) for s in (1, 2, 3, 4)}

    def word_score(w, k):
        if w in often:
            return math.log((n[k][w] + 0.5) / (words_total[k] + 0.5 * len(often)))
        own, p = [], f"^{w}$"
        for i in range(len(p)):
            for s in (4, 3, 2, 1):
                if i + s <= len(p) and p[i : i + s] in kinds[s]:
                    own.append(math.log((grams[k][s][p[i : i + s]] + 0.5) / (sum(grams[k][s].values()) + 0.5 * len(kinds[s]))))
                    break
        return sum(own) / max(1, len(own))

    for r in langid.identify(docs, model, keep={"t": F.col("text")}).collect():
        w = letters.findall((r.t or "").lower())[:]
        sums = [sum(word_score(x, k) for x in w) for k in langs] if len(w) < 1000 else None
        if not w:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif sums:
            assert r.lang_pred == langs[max(range(len(langs)), key=lambda i: sums[i])]
            assert math.isclose(r.score, 1 / sum(math.exp(min(0, s - max(sums))) for s in sums), rel_tol=1e-3)
    assert [model.langs[int(i)] for i in (model.backoff("zzrivière").argmax(), model.backoff("thewalk").argmax())] == ["fr", "en"]


def plain_kneser_ney(rows):
    """(words, pairs) -> log ratio by plain counters, nothing pruned; rows: (tokens, label), no copies among them."""
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for w, y in rows:
        uni[y].update(set(w))
        bi[y].update(set(zip([None, *w], w)))

    def off(counter):
        n = collections.Counter(counter.values())
        n1, n2, n3, n4 = (n[k] + 0.1 for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0), top) for x, top in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3))]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    d1, d2 = [off(c) for c in uni], [off(c) for c in bi]
    total, taken = [sum(c.values()) for c in uni], [sum(d1[y](c) for c in uni[y].values()) for y in (0, 1)]
    back = math.sqrt(taken[0] / total[0] * taken[1] / total[1])
    clip = lambda p: max(-8.0, min(8.0, math.log(p[1] / p[0])))
    word = lambda y, w: (uni[y][w] - d1[y](uni[y][w])) / total[y] + back * sum(d1[k](uni[k][w]) for k in (0, 1)) / sum(taken)
    words_, pairs = {w: clip([word(y, w) for y in (0, 1)]) for w in uni[0] | uni[1]}, {}
    held, freed = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for y in (0, 1):
        for (a, _), c in bi[y].items():
            held[y][a] += c
            freed[y][a] += d2[y](c)
    for a, w in bi[0] | bi[1]:
        p = [((bi[y][a, w] - d2[y](bi[y][a, w])) / held[y][a] if held[y][a] else 0) + (freed[y][a] / held[y][a] if held[y][a] else 1) * word(y, w) for y in (0, 1)]
        pairs[a, w] = clip(p)
    return words_, pairs


def test_kneser_ney_is_the_plain_one(spark):
    rng = random.Random(12)
    rows = [([rng.choice("abcdefghij") + rng.choice(["", "x"]) * (y and rng.random() < 0.3) for _ in range(rng.randint(1, 25))], y) for y in (0, 1) for _ in range(40)]
    df = spark.createDataFrame([(" ".join(w), y) for w, y in rows], "text string, label int")
    pairs = toxicity.count_pairs(df)
    model = toxicity.fitted(pairs, 0.0, 0.0)
    want_words, want_pairs = plain_kneser_ney(rows)
    memo = toxicity.Hashes()
    code = lambda w: memo[w]
    got = dict(zip(model.words.tolist(), model.word_ratio.tolist()))
    assert all(math.isclose(got.get(code(w), 0.0), r, abs_tol=1e-9) for w, r in want_words.items())
    hashed = lambda a, w: int(toxicity.pair_key(np.array([toxicity.START if a is None else code(a)], np.uint64), np.array([code(w)], np.uint64))[0])
    got = dict(zip(model.pairs.tolist(), model.pair_ratio.tolist()))
    assert all(math.isclose(got.get(hashed(a, w), want_words[w]), r, abs_tol=1e-9) for (a, w), r in want_pairs.items())
    found = toxicity.evidence(df, model, {"label": F.col("label"), "t": F.col("text")}).collect()
    for r in found:
        w = r.t.split()
        each = [want_pairs[a, x] for a, x in zip([None, *w], w)]
        worst = max((sum(each[i : i + toxicity.PASSAGE]) for i in range(len(w) - toxicity.PASSAGE + 1)), default=sum(each)) / toxicity.PASSAGE
        assert math.isclose(r.mean, sum(each) / len(w), abs_tol=1e-9) and math.isclose(r.worst, worst, abs_tol=1e-9)
    pruned = toxicity.fitted(pairs, 0.02, 0.02)
    assert len(pruned.words) <= 2 * toxicity.MOST / 0.02 and set(pruned.words.tolist()) < set(model.words.tolist())


def test_toxicity_counts_rare_expressions(spark):
    """Training prunes nothing: of many texts' words and bigrams the rare ones are in the model too, and change the evidence."""
    rng = random.Random(5)
    texts = [(i, " ".join([f"w{rng.randint(0, 5000)}" for _ in range(60)] + ["vile", "brute"] * (i % 4 == 0))) for i in range(800)]
    texts += [(1000 + i, f"only{i} seen{i} vile") for i in range(4)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 1000)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(df, marks, F.expr("doc_id >= 0"))
    seen, memo = collections.Counter(), toxicity.Hashes()
    for _, t in texts:
        seen.update(set(zip([None, *t.split()], t.split())))
    folds = [zlib.crc32(str(i).encode()) % 5 for i, _ in texts]
    least = min(len({p for (_, t), f in zip(texts, folds) if f != held for p in zip([None, *t.split()], t.split())}) for held in range(5))
    assert len(model.pairs) >= 0.99 * least and len(model.words) > 4500
    word = next(t.split()[0] for (i, t), f in zip(texts, folds) if i >= 1000 and int(memo[t.split()[0]]) in set(model.words.tolist()))
    found = toxicity.evidence(spark.createDataFrame([(word,), ("never",)], "text string"), model, {"t": F.col("text")}).collect()
    got = {r.t: r["mean"] for r in found}
    assert got["never"] == 0.0 < got[word] < 1.0  # counted once: some evidence, far below its plain ratio


def test_toxicity_believes_rare_words_as_far_as_the_counts_say(spark):
    """No threshold on how rare a word is: where many rare words tell the classes apart each counts, where none does none counts much."""
    rng = random.Random(4)
    for tells in (True, False):
        rows = [(" ".join([*(f"w{rng.randint(0, 40)}" for _ in range(20)), *(f"rare{rng.randint(0, 300)}{'xy'[i % 2] if tells else ''}" for _ in range(2))]), i % 2) for i in range(600)]
        pairs = toxicity.count_pairs(spark.createDataFrame(rows, "text string, label int")).persist()
        seen = collections.Counter(w for t, _ in rows for w in set(t.split()) if w.startswith("rare"))
        plain, model = toxicity.fitted(pairs, 0.0, 0.0), toxicity.fitted(pairs, 0.0, 0.0, weighted=True)
        part = {k: m / p for k, p, m in zip(plain.words.tolist(), plain.word_ratio, model.word_ratio) if abs(p) > 1e-6}
        memo = toxicity.Hashes()
        rare = [part[memo[w]] for w, n in seen.items() if 2 <= n <= 4 and memo[w] in part]
        assert len(rare) > 100 and (min(rare) > 0.5 if tells else np.median(rare) < 0.2)


def test_toxicity_counts_travel_packed(spark, monkeypatch):
    """A count takes few bytes, a history's bigrams come together, and adding up part by part loses none."""
    rng = random.Random(8)
    rows = [(" ".join(f"w{rng.randint(0, 300)}" for _ in range(200)), i % 2) for i in range(120)]
    want, memo = collections.Counter(), toxicity.Hashes()
    for t, y in rows:
        h = [memo[w] for w in t.split()]
        want.update((*x, y) for x in {*zip([int(toxicity.START), *h], h)} | {(toxicity.WORD, w) for w in h})
    df = spark.createDataFrame(rows, "text string, label int").repartition(4)
    for limit in (toxicity.MERGED, 50):
        monkeypatch.setattr(toxicity, "MERGED", limit)
        found = toxicity.count_pairs(df).collect()
        got, of = collections.Counter(), {}
        for r in found:
            for a, b, *n in zip(*(x.tolist() for x in toxicity.unpack(r.data))):
                got.update({(a, b, y): k for y, k in enumerate(n) if k})
                assert of.setdefault(a, r.slot) == r.slot or r.word
        assert got == want and len({(r.slot, r.word) for r in found}) == len(found)
        assert sum(len(r.data) for r in found) <= 13 * len({k[:2] for k in want})


def test_key_table_holds_any_slot(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    df = spark.createDataFrame([(int(k.view(np.int64)),) for k in keys], "k long").withColumn("slot", keytables.slot(F.col("k"))).repartition("slot")
    t = keytables.write(df, lambda n: (n["k"].view(np.uint64), np.stack([n["k"] % 97, n["slot"]])), 2, "test")
    values, there = t.find(np.concatenate([keys[::3], keys[::7] + np.uint64(1)]))
    assert len(t) == len(keys) and there[: len(keys[::3])].all() and not there[len(keys[::3]) :].any()
    assert (values[0, there] == keys[::3].view(np.int64) % 97).all() and (values[1, there] == keytables.slots(keys[::3])).all()
    assert (t.whole()[0] == np.sort(keys)).all()
    none = keytables.write(df.limit(0), lambda n: (n["k"].view(np.uint64), n["k"][None]), 1, "test")
    assert not len(none) and not none.find(keys)[1].any() and not none.find(keys[:0])[1].any()


def test_toxicity_with_a_one_class_fold(docs, labels):
    """The fold that fits the curve is one that holds both classes; where none does, the share is the score."""
    of = lambda *folds: F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % 5 in ({','.join(map(str, folds))})")
    some = labels.where(of(1, 2, 3) | (of(4) & (F.col("toxic") == 0)))
    model = toxicity.train(docs, some, F.expr(TRAIN))
    marked = toxicity.score(docs, model, keep()).where("score >= 0.5").count()
    assert not isinstance(model, float) and 0 < marked < 0.5 * docs.count()
    lone = labels.where((of(1) & (F.col("toxic") == 1)) | (of(2, 3, 4) & (F.col("toxic") == 0)))
    assert isinstance(toxicity.train(docs, lone, F.expr(TRAIN)), float)


def test_quality(docs, labels, corpus, empty):
    model = quality.train(docs, labels, F.expr(TRAIN))
    got = {r.doc_id: r.score for r in quality.score(docs, model, keep()).collect()}
    good = {i: q for i, q, _ in corpus[1]}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(good[i]) for i in held) >= 0.95 * len(held)
    assert got[1000] == got[1001] == got[1002] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(empty, model, keep()).count() == 0
    assert quality.train(docs, labels.where("quality = 1"), F.expr(TRAIN)) == 1.0


def test_support_vectors_are_the_plain_ones():
    """Log-count ratios by loops and the dual by projected gradient on the whole Gram matrix."""
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 24, rng.integers(0, 9))).astype(np.uint32) for _ in range(60)]
    y = np.array([int(rng.random() < (0.8 if 3 in r else 0.3)) for r in rows])
    w, b = quality.fit(rows, y, 5, gap=1e-9)
    count = lambda k, v: 1.0 + sum(k in r for r, t in zip(rows, y) if t == v)
    total = [sum(count(k, v) for k in range(32)) for v in (0, 1)]
    ratio = np.array([math.log(count(k, 1) / total[1]) - math.log(count(k, 0) / total[0]) for k in range(32)])
    x = np.array([[ratio[k] / math.sqrt(max(1, len(r))) if k in r else 0.0 for k in range(32)] + [1.0] for r in rows])
    sign = np.where(y == 1, 1.0, -1.0)
    gram = (x @ x.T) * np.outer(sign, sign)
    dual, step = np.zeros(60), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        dual = np.clip(dual - step * (gram @ dual - 1), 0, 1)
    want = x.T @ (dual * sign)
    assert np.allclose(quality.margin(rows, w, b), x @ want, atol=1e-3)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([rng.integers(8, 200, 10), [k % 2]])).astype(np.uint32) for k in range(200)]
    y = np.arange(200) % 2
    w, b = quality.fit(rows, y, 8)
    assert ((quality.margin(rows, w, b) > 0) == (y == 1)).all()


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        t = {s: 2 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        more = {s for s in names if t[s] > 2 * sizes[s] + 1e-9}
        if not more:
            return t
        full |= more


def test_mixing(spark, docs, corpus, empty):
    rows = [*corpus[0], *[(5000 + i, "one two", None, "bulk", 1, None, None, None) for i in range(300)]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df)
    found = [tuple(r) for r in got.select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(dict(sizes))
    assert len(found) == len(rows)
    taken = collections.Counter()
    for i, s, n, total, target, t in found:
        assert total == sizes[s] and math.isclose(target, want[s], rel_tol=1e-9, abs_tol=1e-6) and 0 <= t <= 2 * n
        taken[s] += t
    for s in sizes:
        longest = max(n for _, x, n, *_ in found if x == s)
        assert abs(taken[s] - want[s]) <= max(2, 0.002 * want[s], 0.5 * longest)
    again = sorted(map(repr, (tuple(r) for r in mixing.mix(df.repartition(2)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())))
    assert again == sorted(map(repr, found))
    assert mixing.mix(empty).count() == 0
    wordless = mixing.mix(df.where("doc_id in (1000, 1001, 1002)")).collect()
    assert [r.taken for r in wordless] == [0, 0, 0] and {r.target for r in wordless} == {0.0}


def test_rates_solve_the_dual(spark):
    """Rates and multipliers against bisection in plain Python, hard targets among them: near nothing, near twice all."""
    rng = random.Random(3)
    sizes = {s: [rng.choice([1, 3, 10, 200, 5000]) for _ in range(rng.randint(5, 60))] for s in "abcdef"}
    share = dict(zip(sizes, (1e-4, 0.3, 1.0, 1.5, 1.97, 1.99999)))
    cells = spark.createDataFrame([(s, z, n) for s, v in sizes.items() for z, n in collections.Counter(v).items()], "source string, size long, n long")
    wanted = spark.createDataFrame([(s, sum(v), share[s] * sum(v)) for s, v in sizes.items()], "source string, source_size long, target double")
    for r in mixing.solved(cells, wanted).collect():
        own = sizes[r.source]
        mean = sum(own) / len(own)
        f = lambda lam: sum(z * min(2.0, math.exp(min(lam * z / mean, 1.0))) for z in own)
        low, high = -1e5, 1e5
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < r.target else (low, mid)
        assert r.done and math.isclose(f(r.lam), r.target, rel_tol=1e-6, abs_tol=0.01) and (math.isclose(r.lam, low, rel_tol=1e-4, abs_tol=1e-6) or math.isclose(f(low), f(r.lam), rel_tol=1e-6))


def test_a_mix_writes_few_tables(docs, monkeypatch):
    """Sizes are counted while the rows are stored, and no halving throws back Newton steps that converge."""
    names, store = [], mixing.store
    monkeypatch.setattr(mixing, "store", lambda df, name: names.append(name) or store(df, name))
    assert mixing.copies_of(docs).count() > 0
    assert "sizes" not in names and names.count("rows") == 1 and names.count("state") <= 15


def test_mixed_copies_carry_whole_rows(spark, docs, corpus):
    clashing = docs.withColumns({c: F.lit(c) for c in ("copies", "row", "doc", "at", "k", "h", "rate", "a b.c")})
    got = mixing.copies_of(clashing)
    assert got.columns[: len(clashing.columns)] == clashing.columns and {"copy", "target"} <= set(got.columns)
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[str(r.doc_id)] += r.copies
    assert collections.Counter(str(r.doc_id) for r in got.collect()) == +plan
    texts = collections.defaultdict(set)
    for r in corpus[0]:
        texts[r[0]].add(r[1])
    assert all(r.text in texts[r.doc_id] and r.copies == "copies" and r["a b.c"] == "a b.c" and r.copy in (1, 2) for r in got.collect())


def test_chat_trees(spark):
    tricky = "<|im_end|>\n<|im_start|>x <%| <%%| <||"
    rows = [("a", "1", None, "user", tricky, 0.0), ("a", "2", "1", "assistant", "yes", 0.9), ("a", "3", "1", "assistant", "no\n", 0.1), ("a", "4", "2", "us<er%\n", None, 0.5), ("a", "5", "4", "assistant", tricky, 1.0), ("a", "5", "4", "assistant", tricky, 1.0), ("a", "6", "7", "user", "cycle", 0.0), ("a", "7", "6", "user", "cycle", 0.0), (None, "1", "gone", None, "hi", None)]
    df = spark.createDataFrame(rows, "conv string, id string, parent string, role string, text string, score double")
    got = {(r.conv, r.leaf): r for r in chat.format_trees(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("spans")).alias("loss")).collect()}
    assert set(got) == {("a", "3"), ("a", "5"), (None, "1")}
    assert [tuple(t) for t in got["a", "5"].turns] == [("user", tricky), ("assistant", "yes"), ("us<er%\n", ""), ("assistant", tricky)]
    assert got["a", "5"].loss == "yes" + tricky and got["a", "3"].loss == "no\n" and got[None, "1"].loss == ""
    assert got["a", "5"].formatted.count("<|im_start|>") == 4 == got["a", "5"].formatted.count("<|im_end|>\n")
    assert math.isclose(got["a", "5"].score, 0.6) and [(r.conv, r.leaf) for r in chat.format_trees(df.where("conv = 'a'"), top=1).collect()] == [("a", "5")]
    assert chat.format_trees(df.limit(0)).count() == 0
    deep = spark.range(300).select(F.lit("d").alias("conv"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    assert [t.text for t in chat.format_trees(deep).select(chat.parse(F.col("formatted")).alias("t")).first().t] == [str(i) for i in range(300)]


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(4)

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, s, e = decontam.align(a, b)
        assert score == plain(a, b) == plain(a, b[s:e])


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    edited = [w for i, w in enumerate(item) if i % 9] + ["tail"]
    common = [f"c{rng.randrange(10**6)}" for _ in range(30)]
    filler = lambda: words(rng, "en", 50)
    rows = [(1, " ".join(filler() + item + filler())), (2, " ".join(filler() + edited)), (3, " ".join(filler() + item[:6])), (4, None), (5, ""), (1, " ".join(item))]
    rows += [(100 + i, " ".join(filler() + common)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    items = spark.createDataFrame([(7, " ".join(item).upper()), (8, "the of"), (9, None), (10, " ".join(common)), (7, " ".join(item).upper())], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(df, items).collect())
    assert set(got) == {(1, 7), (2, 7)} | {(100 + i, 10) for i in range(120)}
    best = {r.doc_id: r for r in decontam.find_leaks(df, items).where("item_id = 7").collect()}
    assert best[1].score == 1.0 and 0.6 < best[2].score < 1.0
    assert decontam.find_leaks(df.where("doc_id = 3"), items).count() == 0  # a shared phrase and nothing else
    assert decontam.find_leaks(df, items.limit(0)).count() == 0 and decontam.find_leaks(empty, items).count() == 0


def test_leaks_against_aligning_everything(spark):
    """Each document against each item by the plain recurrence; items of any id, clashing columns."""
    rng = random.Random(21)
    items = {f"item {k}": [rng.choice("the of a in to".split()) if rng.random() < 0.4 else f"v{rng.randrange(300)}" for _ in range(rng.randint(6, 40))] for k in range(12)}
    rows = []
    for i in range(150):
        w = [rng.choice("the of a in to".split()) if rng.random() < 0.4 else f"v{rng.randrange(300)}" for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.7:
            own = [x for x in rng.choice(list(items.values())) if rng.random() > rng.choice([0, 0.05, 0.2, 0.4])]
            at = rng.randint(0, len(w))
            w[at:at] = [x if rng.random() > 0.05 else "other" for x in own]
        rows.append((i, " ".join(w), 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, passage int")
    asked = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(df, asked).collect()}

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h)) / len(a)

    want = {(i, k): s for i, t, *_ in rows for k, w in items.items() if (s := plain(w, t.split())) >= 0.5}
    both = got.keys() & want.keys()
    assert len(want) > 50 and not got.keys() - want.keys() and len(both) >= 0.97 * len(want)
    assert all(math.isclose(got[k], want[k]) for k in both)
    # what is missed has no n-gram of the item left
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    assert all(not grams(items[k]) & grams(rows[i][1].split()) for i, k in want.keys() - got.keys())


def test_edited_copy_of_a_common_leak(spark):
    """An item that leaked everywhere, and one copy that holds none but its most frequent n-grams."""
    item = [f"w{i}" for i in range(43)]
    edited = [f"new{i}" if i % 5 == 4 and i < 35 else w for i, w in enumerate(item)]
    rows = [(i, f"n{i} " + " ".join(item)) for i in range(60)] + [(100, " ".join(edited)), (101, "one two three four")]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {i: 1.0 for i in range(60)} | {100: (43 - 7 - 7) / 43}


def test_fingerprints(spark, docs, corpus, empty):
    got = sorted(fingerprints.fingerprint(docs, bucket_rows=50).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    rows = sorted(corpus[0], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    assert [r.doc_id for r in got] == [r[0] for r in rows] and [r.n_chars for r in got] == [len(t) for t in texts]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    by = dict(zip(texts, (r.fingerprint for r in got)))
    assert all(by[t] == r.fingerprint for t, r in zip(texts, got)) and by[""] == ""
    for r, i in zip(got, range(len(got))):
        assert math.isclose(r.near_next, fingerprints.likeness(fingerprints.decode(r.fingerprint), fingerprints.decode(got[(i + 1) % len(got)].fingerprint)))
        assert math.isclose(r.near_edited, fingerprints.likeness(fingerprints.decode(r.fingerprint), fingerprints.decode(r.edited_fingerprint)))
    assert fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_order_of_documents_of_any_id(spark, kind):
    """A third of the ids null, another third one id, text ids that share their beginnings."""
    rng = random.Random(4)
    of = {"long": lambda i: 2**60 + (i if i < 300 else i * 2**40), "string": lambda i: f"document-{i:04}é"[: 3 + i % 15], "date": lambda i: datetime.date(1960, 1, 1) + datetime.timedelta(37 * i)}[kind]
    rows = [(None if i % 3 == 0 else of(7) if i % 3 == 1 else of(i), f"{rng.choice('abcz')}{rng.randrange(10**6)} {i}") for i in range(600)]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5), bucket_rows=20)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or of(0), r[1]))
    texts = [t for _, t in rows]
    want = collections.Counter((i, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()) for (i, t), u in zip(rows, texts[1:] + texts[:1]))
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got.collect()) == want


def plain_sketch(text):
    """Locally consistent parsing of one text by plain loops over Python integers."""
    top = (1 << 64) - 1
    k1, k2 = int(fingerprints.K1), int(fingerprints.K2)

    def mixed(x):
        x = (x ^ (x >> 29)) * k2 & top
        return x ^ (x >> 32)

    names, out = [ord(c) for c in text], {}
    for level in (1, 2, 3, 4):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mixed((x * k1 + n) & top) if n > 1 else x for x, n in runs]
        labels = names
        for _ in range(4):
            new = []
            for i, c in enumerate(labels):
                before = labels[i - 1] if i else c ^ 1
                d = (before ^ c) or 1
                low = (d & -d).bit_length() - 1
                new.append(2 * low + (c >> low & 1))
            labels = new
        phrases = []
        for i, c in enumerate(labels):
            if i == 0 or (c > labels[i - 1] and (i + 1 == len(labels) or c >= labels[i + 1])):
                phrases.append([])
            phrases[-1].append(names[i])
        names = [mixed(sum(mixed((x + j * k2) & top) for j, x in enumerate(p)) & top) for p in phrases]
        if level in fingerprints.KEPT:
            out[level] = sorted({mixed(x ^ level) >> 32 for x in names})[: fingerprints.KEPT[level]]
    return out


def test_parsing_is_the_plain_one():
    rng = random.Random(31)
    texts = ["".join(rng.choice("ab c" if k % 2 else "abcdefghé\U0001f600 ") for _ in range(rng.choice([1, 2, 5, 40, 300, 6000]))) for k in range(80)]
    texts += ["a" * 500, "ab" * 300, "x"]
    prints = [{k: v.tolist() for k, v in p.items()} for p in fingerprints.sketches(texts)]
    plain = [plain_sketch(t) for t in texts]
    assert prints == plain
    for i in range(len(texts) - 1):
        a, b = plain[i], plain[i + 1]
        want = sum(len(set(sorted(set(a[k]) | set(b[k]))[:n]) & set(a[k]) & set(b[k])) / len(sorted(set(a[k]) | set(b[k]))[:n]) for k, n in fingerprints.KEPT.items()) / len(fingerprints.KEPT)
        assert math.isclose(fingerprints.likeness(*(fingerprints.decode(fingerprints.encode({k: np.array(v, np.uint32) for k, v in p.items()})) for p in (a, b))), want)


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(8)
    inner = "".join(rng.choice("abcdefgh éñ") for _ in range(3000))
    a, b = fingerprints.sketches([inner, "xyz" * 7 + inner + "q" * 11])
    assert fingerprints.likeness(a, b) > 0.8
    c, d = fingerprints.sketches(["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(2)])
    assert fingerprints.likeness(c, d) < 0.1


def test_licenses(spark, empty):
    rng = random.Random(2)
    mit = licenses.TEMPLATES["MIT-text"]
    damaged = " ".join(w for i, w in enumerate(mit.split()) if i != 40)
    rows = [(1, "x y z. Released under the MIT License. a b"), (2, " ".join(words(rng, "en", 200)) + " " + mit), (3, damaged), (4, mit[: len(mit) // 2]), (5, "the MIT License was released"), (6, None), (7, ""), (8, "Released under the MIT License. " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0))
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT-text"), (3, "MIT-text"), (8, "MIT")}
    h = lambda t: set(licenses.shingles(np.array([hash(w) % 2**63 for w in tokens(t)], np.uint64)).tolist())
    assert math.isclose(got[3, "MIT-text"], len(h(mit) & h(damaged)) / len(h(mit)))
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, {"none": "..."})


def test_licenses_against_every_window(spark):
    """Every template against every window, by sets of words; copies damaged to both sides of the threshold, and mixed."""
    rng = random.Random(14)
    filler = lambda: [rng.choice("alpha beta gamma delta the of software license".split()) for _ in range(rng.randint(0, 60))]
    texts = []
    for _ in range(150):
        w = filler()
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2)):
            own = licenses.TEMPLATES[name].split()
            w += [x if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else "edited" for x in own] + filler()
        texts.append(" ".join(w))
    got = {(r.doc_id, r.license): (r.containment, r.start, r.end) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        words_ = tokens(t)
        for name, template in licenses.TEMPLATES.items():
            own = tokens(template)
            n = min(5, len(own))
            cut = lambda w: [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]  # noqa: B023,E731
            grams, here = set(cut(own)), cut(words_)
            top = licenses.reach(len(grams))
            size, step = max(1, top * 3 // 2), max(1, top // 4)
            for s in range(0, len(here), step):
                c = len(grams & set(here[s : s + size])) / len(grams)
                if c >= 0.8 and c > want.get((i, name), (0,))[0]:
                    want[i, name] = c, s, min(s + size + n - 1, len(words_))
    assert len(want) > 60 and got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0]) and got[k][1:] == want[k][1:] for k in want)
    worst = 0.8 / (1.5 * licenses.STEP + 0.2)
    assert (1 - worst**licenses.ROWS) ** licenses.BANDS < 1e-4 and all(licenses.reach(n) <= max(n + 1, 1.25 * n + 1) for n in range(1, 400))


def brute_passages(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    n = collections.Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size,hot,block", [(12, 10**9, 400), (12, 3, 400), (35, 10**9, 10**6), (80, 10**9, 10**6), (200, 10**9, 10**6)])
def test_repeated_passages(spark, size, hot, block, empty):
    rng = random.Random(size + hot % 7)
    texts = []
    for _ in range(120):
        w = [rng.choice("abcdefg") for _ in range(rng.randint(0, 90 + 2 * size * (size > 35)))]
        if texts and rng.random() < 0.6 and (src := rng.choice(texts).split()):
            i = rng.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[i : i + rng.randint(1, max(60, 2 * size))]
        texts.append(" ".join(w))
    texts += ["a " * 80, "", None, "a b " * 40, "é x \x0b\x1cy " * 50, texts[0]]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(df, keep={"doc_id": F.col("doc_id")}, size=size, hot=hot, block_words=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, size)
    assert substrings.remove(empty, keep={"doc_id": F.col("doc_id")}).count() == 0


@pytest.mark.parametrize("hot", [10**9, 3])
def test_spans_of_copies_are_gathered_once(spark, hot):
    texts = [" ".join(f"w{i}" for i in range(100))] * 50 + [" ".join(f"v{i}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substrings.spans(df, hot=hot).collect()
    assert len(found) == 1 and 0 < len(found[0].spans) <= 100
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove(df, keep={"doc_id": F.col("doc_id")}, hot=hot).collect()}
    assert got == {i: (100, 100) for i in range(50)} | {50: (60, 0)}


def test_many_copies_of_one_text(spark):
    """A thousand copies, empty texts as many: each text's spans once, time in proportion."""
    long = " ".join(f"w{i}" for i in range(300))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, long).otherwise("").alias("text"))
    found = substrings.spans(df).collect()
    assert len(found) == 1 and len(found[0].spans) <= 300
    got = substrings.remove(df, keep={"doc_id": F.col("doc_id")}).groupBy("n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(300, 300, 1000), (0, 0, 1000)}


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    t = np.concatenate([rng.integers(1, 5, 300), [0]]).astype(np.int32)
    index, s = substrings.FmIndex(t, 6), t.tolist()
    for _ in range(100):
        i, n = rng.integers(0, 290), rng.integers(1, 9)
        pattern = s[i : i + n]
        bounds = np.array([0, len(t)])
        for c in reversed(pattern):
            bounds = index.extend(np.array([c, c]), bounds)
        assert bounds[1] - bounds[0] == sum(s[k : k + n] == pattern for k in range(len(s)))


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
