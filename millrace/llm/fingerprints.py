"""Document fingerprints by locally consistent parsing.

A text's code points are parsed level by level. On each level runs of one name collapse; deterministic coin
tossing (position and value of the lowest bit in which neighbours differ, four times) turns names into labels
below six, neighbours unlike; local maxima of the labels open phrases; a phrase's name is a hash of its names.
A phrase depends on itself and a few neighbours only, so equal substrings get equal inner phrases wherever
they stand. Of the names of levels 2, 3 and 4 (phrases of about 12, 40 and 150 characters) the smallest hashes
are kept, which estimates how alike two texts' phrases are.

Edge cases: null counts as empty; an empty text has the empty fingerprint, alike (1.0) to an empty one only;
equal texts have equal fingerprints and likeness 1.0; documents are ordered by id, null first, ties by text,
repeated rows included; a single document is its own next one; an empty table gives an empty result; ids may be
numbers, dates, times or text, by code point. Ties of one id are spread over tasks by the beginning of their texts.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DateType, NumericType, StringType, StructField, StructType, TimestampType, _parse_datatype_string

from millrace.llm.common import K1, K2, mix

KEPT = {2: 32, 3: 24, 4: 8}  # level -> hashes kept
CHUNK = 1 << 20  # characters parsed at once
MOST_BUCKETS, TIES = 20_000, 100  # buckets by key; buckets of one frequent key, by text
LEAST = -1.7976931348623157e308


def _level(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names and where texts start -> the same of the level above. No text may be empty."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[starts] = True
    runs = np.flatnonzero(new)
    first = np.searchsorted(runs, starts)
    length = np.diff(np.append(runs, len(x)))
    x = x[runs]
    long = length > 1
    x[long] = mix(x[long] * K1 + length[long].astype(np.uint64))
    c = x
    for k in range(4):
        before = np.roll(c, 1)
        if k:
            before[first] = c[first] ^ 1
        else:
            before[first] = c[first] ^ np.uint64(1)
        d = before ^ c
        d[d == 0] = 1  # labels next to a text's start may coincide
        low = d & (~d + np.array(1, d.dtype))
        at = np.bitwise_count(low - np.array(1, d.dtype))
        c = (2 * at + ((c & low) != 0)).astype(np.uint8)
    left, right = np.roll(c, 1), np.roll(c, -1)
    cut = (c > left) & (c >= right)
    cut[first] = True
    at = np.flatnonzero(cut)
    offset = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    names = np.add.reduceat(mix(x + offset.astype(np.uint64) * K2), at)
    return mix(names), np.searchsorted(at, first)


def sketches(texts: list[str]) -> list[dict[int, np.ndarray]]:
    """The kept hashes (uint32, ascending) of each text's levels."""
    out: list[dict[int, np.ndarray]] = [{} for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    x = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in full])[:-1]]).astype(np.int64)
    for level in range(1, max(KEPT) + 1):
        x, starts = _level(x, starts)
        if level in KEPT:
            short = (mix(x ^ np.uint64(level)) >> np.uint64(32)).astype(np.uint32)
            for i, a, b in zip(full, starts, np.append(starts[1:], len(x))):
                own, k = short[a:b], KEPT[level]
                if len(own) > 8 * k:  # distinct names: more than k of the smallest, or all
                    some = np.unique(np.partition(own, 4 * k)[: 4 * k])
                    own = some if len(some) >= k else np.unique(own)
                else:
                    own = np.unique(own)
                out[i][level] = own[:k]
    return out


def encode(sketch: dict[int, np.ndarray]) -> str:
    return ".".join(sketch[k].astype(">u4").tobytes().hex() for k in KEPT) if sketch else ""


def decode(fingerprint: str) -> dict[int, np.ndarray]:
    return {k: np.frombuffer(bytes.fromhex(p), ">u4").astype(np.uint32) for k, p in zip(KEPT, fingerprint.split("."))} if fingerprint else {}


def likeness(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> float:
    """Mean over levels of the share of the smallest hashes of both that both have."""
    if not a or not b:
        return float(not a and not b)
    total = 0.0
    for k, kept in KEPT.items():
        both = np.union1d(a[k], b[k])[:kept]
        total += np.isin(both, a[k], assume_unique=True)[np.isin(both, b[k], assume_unique=True)].sum() / len(both)
    return total / len(KEPT)


def _number(c: Column, kind: DataType, skip: int = 0) -> Column:
    """A double that grows with the column, never null: numbers as they are, others by six bytes of their text, the first skip passed over."""
    if isinstance(kind, NumericType):
        n = c.cast("double")
    elif isinstance(kind, (TimestampType, DateType)):
        n = c.cast("timestamp").cast("double")
    else:
        n = F.conv(F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), skip + 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.coalesce(n, F.lit(LEAST))


def _place(cuts: list[tuple[float, float]], k: Column, t: Column) -> Column:
    """How many of the sorted cuts are at or before (k, t), by two steps of about the root of their number each."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    shelves = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    as_json = lambda rows: "[" + ",".join(f'{{"k":{a!r},"t":{b!r}}}' for a, b in rows) + "]"
    one, all_ = "array<struct<k:double,t:double>>", "array<array<struct<k:double,t:double>>>"
    heads = F.from_json(F.lit(as_json([s[0] for s in shelves])), one)
    inside = F.from_json(F.lit("[" + ",".join(map(as_json, shelves)) + "]"), all_)
    upto = lambda c: (c["k"] < k) | ((c["k"] == k) & (c["t"] <= t))
    shelf = F.size(F.filter(heads, upto))
    return F.when(shelf == 0, 0).otherwise((shelf - 1) * width + F.size(F.filter(F.try_element_at(inside, F.greatest(shelf, F.lit(1))), upto)))


def _cuts(rows: DataFrame, n: int, bucket_rows: int) -> list[tuple[float, float]]:
    """Where buckets begin, of about bucket_rows rows each and MOST_BUCKETS at most, by key number and, for keys
    that fill several buckets by themselves (null ids, ties), by the beginning of the text."""
    parts = min(MOST_BUCKETS, n // bucket_rows)
    if parts < 2:
        return []
    found = rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts)
    cuts = {(k, 0.0) for k in found}
    if hot := [k for k, m in Counter(found).items() if m > 1]:
        at = [i / TIES for i in range(1, TIES)]
        one_key = (F.count("key") == 0) | ((F.count("key") == F.count("*")) & (F.min("key") == F.max("key")))  # else k is only about the key
        for r in rows.where(F.col("k").isin(hot)).groupBy("k").agg(F.percentile_approx("t", at, 10 * TIES).alias("ts"), one_key.alias("one")).collect():
            cuts |= {(r["k"], t) for t in r["ts"]} if r["one"] else set()
    return sorted(cuts)


def _ordered(docs: DataFrame, text: str, key: str, bucket_rows: int) -> DataFrame:
    """Rows (bucket, guard, key, text) in partitions sorted by all; guard rows repeat the first of the next bucket."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind, skip = rows.schema["key"].dataType, 0
    if not isinstance(kind, (NumericType, TimestampType, DateType)):
        ends = [str(x).encode() for x in rows.agg(F.min("key"), F.max("key")).first()]
        skip = len(os.path.commonprefix(ends))  # what the least and the greatest share, all do
    k, t = _number(F.col("key"), kind, skip), _number(F.col("text"), StringType())
    cuts = _cuts(rows.select("key", k.alias("k"), t.alias("t")), docs.count(), bucket_rows)
    rows = rows.withColumn("bucket", _place(cuts, k, t))
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.col("key").isNotNull(), "key", "text")).alias("f"))
    order = first.select("bucket").withColumn("before", F.lag("bucket").over(Window.orderBy("bucket"))).withColumn("last", F.max("bucket").over(Window.partitionBy()))
    guards = first.join(order, "bucket").select(F.coalesce("before", "last").alias("bucket"), F.lit(1).alias("guard"), F.col("f.key").alias("key"), F.col("f.text").alias("text"))
    return rows.select("bucket", F.lit(0).alias("guard"), "key", "text").unionByName(guards).repartition("bucket").sortWithinPartitions("bucket", "guard", F.col("key").asc_nulls_first(), "text")


def fingerprint(docs: DataFrame, *, text: str = "text", key: str = "doc_id", bucket_rows: int = 4000) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document."""
    rows = _ordered(docs, text, key, bucket_rows)

    def run(batches):
        kept: list[tuple] = []  # (guard, key, text), the last of which has no next row yet

        def done(rows_: list[tuple]) -> pa.RecordBatch:
            texts = [t for _, _, t in rows_]
            edited, mine = [], []
            for i in range(len(rows_) - 1):
                if not rows_[i][0]:
                    half = len(texts[i]) // 2
                    edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
                    mine.append(i)
            prints = sketches(texts + edited)
            own, new = prints[: len(texts)], prints[len(texts) :]
            columns = [
                [rows_[i][1] for i in mine], [len(texts[i]) for i in mine], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                [encode(own[i]) for i in mine], [encode(p) for p in new],
                [likeness(own[i], p) for i, p in zip(mine, new)], [likeness(own[i], own[i + 1]) for i in mine],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        size = 0
        for batch in batches:
            for g, k, t in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3))):
                kept.append((g, k, t))
                size += len(t)
                if size > CHUNK and len(kept) > 1:
                    yield done(kept)
                    kept, size = kept[-1:], len(t)
        if len(kept) > 1:
            yield done(kept)

    made = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = StructType([StructField(key, rows.schema["key"].dataType), *_parse_datatype_string(made).fields])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    return rows.mapInArrow(run, schema)
