"""Tables of 64-bit keys with numbers, of any size: files in the shared folder that workers map into memory.

A key's SLOT_BITS highest bits are its slot. A slot lies in one piece in one file: its sorted keys, then their
values, one column after the other. Only where each slot lies is sent to the driver and to the workers; pages are
read as they are asked for, so a table may be larger than a worker's memory. Where the shared folder isn't a local
one, a machine copies a file once.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as files_at
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import shared_folder

SLOT_BITS = 10
SLOTS = 1 << SLOT_BITS


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def slot(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - SLOT_BITS).cast("int")


def _local(uri: str) -> str:
    """A local path of a file of the shared folder."""
    fs, path = files_at.FileSystem.from_uri(uri)
    if isinstance(fs, files_at.LocalFileSystem):
        return path
    own = os.path.join(tempfile.gettempdir(), path.strip("/").replace("/", "_"))
    if not os.path.exists(own):
        files_at.copy_files(path, f"{own}-{os.getpid()}", source_filesystem=fs, destination_filesystem=files_at.LocalFileSystem())
        os.replace(f"{own}-{os.getpid()}", own)
    return own


@dataclass
class KeyTable:
    folder: str
    files: list[str]
    places: np.ndarray  # of each slot: file, first number (8 bytes each), keys
    width: int  # values of a key
    _maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def __len__(self) -> int:
        return int(self.places[:, 2].sum())

    def piece(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """A slot's keys and values (one row a column)."""
        file, first, n = self.places[s].tolist()
        if not n:
            return np.zeros(0, np.uint64), np.zeros((self.width, 0))
        if file not in self._maps:
            self._maps[file] = np.memmap(_local(f"{self.folder}/{self.files[file]}"), np.uint64, "r")
        numbers = self._maps[file][first : first + n * (1 + self.width)]
        return np.asarray(numbers[:n]), np.asarray(numbers[n:]).view(np.float64).reshape(self.width, n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, one row a column and 0 where absent; whether each key is in the table)."""
        asked, back = np.unique(keys, return_inverse=True)
        values, there = np.zeros((self.width, len(asked))), np.zeros(len(asked), bool)
        own = slots(asked)
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(asked) else np.zeros(1, int)
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            k, v = self.piece(int(own[lo]))
            if len(k):
                at = np.minimum(np.searchsorted(k, asked[lo:hi]), len(k) - 1)
                hit = k[at] == asked[lo:hi]
                there[lo:hi] = hit
                values[:, lo:hi] = np.where(hit, v[:, at], 0.0)
        return values[:, back], there[back]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, sorted, and their values (one row a column); for small tables."""
        pieces = [self.piece(s) for s in range(SLOTS)]
        return np.concatenate([k for k, _ in pieces]), np.concatenate([v for _, v in pieces], axis=1)

    def delete(self) -> None:
        fs, path = files_at.FileSystem.from_uri(self.folder)
        fs.delete_dir(path)


def write(rows: DataFrame, fn: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], width: int, name: str) -> KeyTable:
    """The table of what fn makes of a slot's rows (columns as arrays): keys, and values with one row a column.

    rows has its key's slot in the column slot and is partitioned by it.
    """
    folder = f"{shared_folder(rows.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    names = rows.columns

    def run(batches):
        held, now, at, file, made, out = [], None, 0, uuid.uuid4().hex, [], None

        def done():
            nonlocal at, out
            keys, values = fn({c: np.concatenate([h[c] for h in held]) for c in names})
            order = np.argsort(keys)
            if len(keys):
                if out is None:
                    fs, path = files_at.FileSystem.from_uri(folder)
                    fs.create_dir(path)
                    out = fs.open_output_stream(f"{path}/{file}")
                out.write(keys[order].tobytes())
                out.write(np.ascontiguousarray(values[:, order], np.float64).tobytes())
                made.append((now, at, len(keys)))
                at += len(keys) * (1 + width)

        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            own = columns["slot"]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, int)
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                if held and own[lo] != now:
                    done()
                    held = []
                now = int(own[lo])
                held.append({c: v[lo:hi] for c, v in columns.items()})
        if held:
            done()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in range(3)] + [pa.array([file] * len(made))], names=["slot", "first", "n", "file"])

    # the slots' places only: at most SLOTS rows
    found = rows.sortWithinPartitions("slot").mapInArrow(run, "slot long, first long, n long, file string").collect()
    files = sorted({r["file"] for r in found})
    number = {f: i for i, f in enumerate(files)}
    places = np.zeros((SLOTS, 3), np.int64)
    for r in found:
        places[r["slot"]] = number[r["file"]], r["first"], r["n"]
    return KeyTable(folder, files, places, width)
