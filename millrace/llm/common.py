"""Shared tools of the corpus operators: stored tables, Arrow passes and numpy hashing."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

MEMO_LIMIT = 150_000  # words a worker remembers before it starts afresh
BLOCK_BYTES = 2 << 20  # text handled at once by a worker; Spark's own limit bounds an Arrow batch to 64 MB
PIECE_BYTES, LONG_WORD = 1 << 18, 256  # text whose words are hashed at once; longer words are hashed one by one
WORDS = re.compile(r"[^\W_]+")

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32 = np.uint64(29), np.uint64(32)

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = np.uint16(0xFFFF)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k of eight bytes

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _own_folder[0]


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Deletes a stored table of which nothing will be read again."""
    jvm, conf = stored.sparkSession._jvm, stored.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32(doc_id as text) mod 5 is 0; a null id also."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def spread(key: Column) -> Column:
    """A number in [0, 1) from a key, the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)


class Hashes(dict):
    """word -> 64-bit hash, remembered up to MEMO_LIMIT words."""

    def __missing__(self, word):
        if len(self) >= MEMO_LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def apart(text: str) -> bytes:
    """The tokens of a text with spaces between them."""
    return text.lower().encode("utf-8", "replace").translate(_APART)


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other than ASCII signs, as bytes."""
    return apart(text).split()


@functools.cache
def _plain() -> np.ndarray:
    """Of each UTF-16 unit its lower case, or a space where that is no part of WORDS; _ODD where it takes more than the unit to tell."""
    lower = [chr(c).lower() for c in range(1 << 16)]
    table = np.array([ord(x) if WORDS.fullmatch(x) else 0x20 for x in (x[:1] for x in lower)], np.uint16)
    table[[i for i, x in enumerate(lower) if len(x) > 1]] = table[0x3A3] = table[0xD800:0xE000] = _ODD  # a final sigma is another one
    return table


def worded(text: str) -> bytes:
    """WORDS of the lower-cased text with spaces between them."""
    if text.isascii():
        return apart(text)
    found = _plain()[np.frombuffer(text.encode("utf-16-le"), "<u2")]
    if (found == _ODD).any():
        return " ".join(WORDS.findall(text.lower())).encode()
    return found.astype("<u2").tobytes().decode("utf-16-le").encode()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S29)) * K2
    return x ^ (x >> S32)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text, the 64-bit hashes of its runs of bytes other than 0x20 and 0x09-0x0D; other ones than those of Hashes."""
    out, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > PIECE_BYTES:
            out += _hashed(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    return out + _hashed(held) if held else out


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    data = b" ".join([b"", *texts, bytes(8)])
    space = _SPACE[np.frombuffer(data, np.uint8)[:-8]]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    size = end - start
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    h = mix(((size.astype(np.uint64) * K3) ^ (eight[start] & _FIRST[np.minimum(size, 8)])) * K1)
    on, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(on):
        h[on] = mix((h[on] ^ (eight[start[on] + k] & _FIRST[np.minimum(size[on] - k, 8)])) * K1)
        k += 8
        on = on[size[on] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    cuts = np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)])).tolist()
    return [h[a:b] for a, b in zip(cuts, cuts[1:])]


def windows(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of h[i:i+w] for each i, by doubling; empty when h is shorter than w."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    cur, size, out, done = h, 1, None, 0
    while True:
        if w & size:
            out = cur if out is None else mix(out[: len(h) - done - size + 1]) * K1 + cur[done : done + len(h) - done - size + 1]
            done += size
            if done == w:
                return mix(out[:n])
        cur = mix(cur[:-size]) * K3 + cur[size:]
        size *= 2


def crossing(lengths: np.ndarray, w: int) -> np.ndarray:
    """For words of several texts laid end to end: True where the w words from here lie in one text."""
    total = int(lengths.sum())
    ok = np.ones(max(0, total - w + 1), bool)
    for e in np.cumsum(lengths)[:-1]:
        ok[max(0, e - w + 1) : e] = False
    return ok


def in_sorted(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Filter64:
    """A bit table before a sorted key table: most absent keys cost one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = max(16, min(26, int(len(self.keys)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[(self.keys * K1) >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are in the table: (index into keys, index into the table)."""
        at = np.flatnonzero(self.bits[(keys * K1) >> self.shift])
        hit = in_sorted(keys[at], self.keys)
        return at[hit >= 0], hit[hit >= 0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str, kept: list[StructField] = ()) -> DataFrame:
    """mapInArrow by blocks of bounded text (column _text or text). fn gives dicts of columns: those of kept, then of schema."""
    made = StructType([*kept, *_parse_datatype_string(schema).fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in made.fields])
    text = "_text" if "_text" in df.columns else "text"

    def run(batches):
        for batch in batches:
            for part in blocks(batch, text):
                for out in fn(part):
                    yield pa.RecordBatch.from_arrays([_as(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, made)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if isinstance(values, pa.Array) and values.type == kind else values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
