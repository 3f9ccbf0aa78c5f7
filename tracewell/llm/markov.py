"""Variable-order Markov models of bytes for a few classes at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, to_python

PIECE = 1 << 18
UNIFORM_BITS = 8.0


def codes(data: np.ndarray, length: int, order: int) -> np.ndarray:
    """For each position from ``order`` on, its last ``length`` bytes as one number."""
    out = np.zeros(len(data) - order, np.uint64)
    for back in range(length - 1, -1, -1):
        out = (out << np.uint64(8)) | data[order - back : len(data) - back]
    return out


class HashTable:
    """Open addressing in arrays: find() gives the slot of each key, or -1."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, ~np.uint64(0)), np.zeros((1 << bits, rows.shape[1]), np.float32)
        at, left = self.slot(keys), np.arange(len(keys))
        self.probes = 0
        while left.size:
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == ~np.uint64(0))
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.rows[at[put]] = keys[left[put]], rows[left[put]]
            keep = np.ones(left.size, bool)
            keep[put] = False
            left, at = left[keep], (at[keep] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        open_ = np.flatnonzero((out < 0) & (got != ~np.uint64(0)))
        at = at[open_]
        for _ in range(self.probes - 1):
            if not open_.size:
                break
            at = (at + 1) & self.mask
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = at[hit]
            go = ~hit & (got != ~np.uint64(0))
            open_, at = open_[go], at[go]
        return out


class Trees:
    """Frozen byte context trees of some classes, of orders 0 to ``order``. counts: columns label, gram (order + 1 bytes as a number), n.

    A byte costs -log2 of its probability. With escapes (prediction by partial matching, method C) this is its share in the longest
    context that has seen it, after an escape from each longer context that the class knows. Blended (Witten-Bell), every
    known context mixes its own share with the shorter context's probability. Below order 0 each byte costs eight bits.

    All classes are merged: a hash table for each order holds one row of costs per byte string, a second one the escapes per context, so a byte takes
    a few vectorised look-ups whatever the number of classes.
    """

    def __init__(self, counts: pd.DataFrame, order: int, blend: bool = False):
        self.order, self.labels = order, sorted(counts["label"].unique())
        per = [(g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for _, g in counts.groupby("label", sort=True)]
        wide = len(self.labels)
        lower_keys, lower = np.empty(0, np.uint64), np.full((1, wide), UNIFORM_BITS)
        self.grams, self.contexts = [], []
        for k in range(order + 1):
            keep = ~np.uint64(0) if k == 7 else np.uint64((1 << 8 * (k + 1)) - 1)
            own = []
            for gram, n in per:
                keys, at = np.unique(gram & keep, return_inverse=True)
                own.append((keys, np.bincount(at, n)))
            union = np.unique(np.concatenate([keys for keys, _ in own])) if own else np.empty(0, np.uint64)
            known = np.unique(union >> np.uint64(8))
            cost, escape = np.full((len(union), wide), np.nan), np.zeros((len(known), wide))
            shorter = lower[np.searchsorted(lower_keys, union & np.uint64((1 << 8 * k) - 1))] if k else np.repeat(lower, len(union), 0)
            for j, (keys, n) in enumerate(own):
                contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                here = np.searchsorted(union, keys)
                own_share = n + (kinds[at] * np.exp2(-shorter[here, j]) if blend else 0)
                cost[here, j] = -np.log2(own_share / (total + kinds)[at])
                escape[np.searchsorted(known, contexts), j] = -np.log2(kinds / (total + kinds))
            longer = escape[np.searchsorted(known, union >> np.uint64(8))] + shorter
            cost = np.where(np.isnan(cost), longer, cost)
            self.grams.append(HashTable(union, cost))
            self.contexts.append(HashTable(known, escape))
            lower_keys, lower = union, cost

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ``order``, for each class."""
        out = np.zeros((len(data) - self.order, len(self.labels)), np.float32)
        key, left = codes(data, self.order + 1, self.order), None
        for k in range(self.order, -1, -1):
            table, known = self.grams[k], self.contexts[k]
            at = table.find(key)
            miss = np.flatnonzero(at < 0)
            if left is None:
                out[:] = table.rows[at]
                out[miss] = 0
                left = miss
            else:
                hit = at >= 0
                out[left[hit]] += table.rows[at[hit]]
                left = left[miss]
            key = key[miss]
            context = known.find(key >> np.uint64(8))
            seen = context >= 0
            out[left[seen]] += known.rows[context[seen]]
            key = key & np.uint64((1 << 8 * k) - 1)
            if not left.size:
                return out
        out[left] += UNIFORM_BITS
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each class, in pieces of bounded size."""
        order = self.order
        out, pieces, size = np.zeros((len(texts), len(self.labels))), [], 0

        def flush() -> None:
            data = np.frombuffer(b"".join(x for _, x in pieces), np.uint8).astype(np.uint64)
            starts = np.cumsum([0] + [len(x) for _, x in pieces[:-1]])
            bits = np.concatenate([np.zeros((order, out.shape[1]), np.float32), self.costs(data)])
            for back in range(order):
                bits[starts + back] = 0
            np.add.at(out, [i for i, _ in pieces], np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            pieces.clear()

        for i, text in enumerate(texts):
            text = b" " * order + text
            for at in range(order, len(text), PIECE):
                pieces.append((i, text[at - order : at + PIECE]))
                size += len(pieces[-1][1])
                if size >= PIECE:
                    flush()
                    size = 0
        if pieces:
            flush()
        return out


def gram_counts(rows: DataFrame, order: int, prepare: Callable[[str], bytes]) -> DataFrame:
    """(label, gram, n) of the rows' columns label and text: counts are summed in each batch, then over all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            parts: dict[str, list[np.ndarray]] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data := prepare(text):
                    parts.setdefault(label, []).append(codes(np.frombuffer(b" " * order + data, np.uint8).astype(np.uint64), order + 1, order))
            for label, found in parts.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["label", "gram", "n"])

    return to_python(rows.select("label", "text")).mapInArrow(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
