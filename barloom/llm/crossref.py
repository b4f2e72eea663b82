"""Which tokens of a text occur elsewhere in the corpus, and how often.

Documents are taken in blocks, tokens in buckets of their hash; the two are transposed:

1. a task hashes the texts of a block, drops what repeats inside it to one entry with a count,
   and sends each bucket one packed row (4 bytes a token, 1 for its document);
2. a bucket's task counts its tokens over all blocks and sends back those found more than once,
   with a byte for their frequency (eighths of its binary logarithm);
3. a block's task puts its documents together again and hands them to the caller's function.

A token that a third of all documents hold reaches its bucket once from each block, so no token
is gathered by document. The number of buckets follows the size of the corpus; a group holds
about ``SHARE`` bytes of text in blocks as in buckets. Nothing is broadcast or collected.

Tokens are told apart by their bucket and 32 bits of their hash, at least 38 bits in all. Block
numbers come from partition and order, so the input must be a table, not a plan that deals its
rows at random.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import U, chunks, release, small_batches, tidied

SHARE = 8 << 20
LEAST_BUCKETS = 64
MOST_DOCS = 1 << 14
DIGEST = 24
_PARTS = ("a", "b", "c", "d", "e", "f", "texts")
_SCHEMA = "g long, block long, bucket int, " + ", ".join(f"{p} binary" for p in _PARTS)

#: (bytes, offsets) of some texts -> tokens, their row numbers, and for each row a count and a
#: ``DIGEST``-byte digest. Rows ascend; a token that repeats in a row counts each time.
Extract = Callable[[np.ndarray, np.ndarray],
                   tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]


def level(count: np.ndarray) -> np.ndarray:
    """Frequency of a token found ``count`` >= 2 times, in a byte from 2 on."""
    return np.minimum(255, 2 + np.floor(8 * np.log2(count / 2))).astype(np.uint8)


def names_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each token, by which tokens are told apart."""
    return (((tokens >> U(40)) * U(buckets) >> U(24)) << U(32)) | (tokens & U(0xFFFFFFFF))


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _gaps(docs: np.ndarray) -> np.ndarray:
    """Ascending row numbers as gaps, in bytes where they fit."""
    gaps = np.diff(docs, prepend=0)
    return gaps.astype(np.uint8 if not len(gaps) or gaps.max() < 256 else np.uint16)


def _ungap(raw: bytes, n: int) -> np.ndarray:
    kind = np.uint8 if len(raw) == n else np.uint16
    return np.cumsum(np.frombuffer(raw, kind).astype(np.int64))


def bucket_count(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(LEAST_BUCKETS, min(1 << 20, -(-size // SHARE)))


def _split(extract: Extract, buckets: int, block: int, ids: pa.Array, texts: pa.Array,
           carry: bool):
    tokens, rows, counts, digests = [], [], [], []
    for row, buf, offs in chunks(texts):
        t, r, n, d = extract(buf, offs)
        tokens.append(t)
        rows.append(r + row)
        counts.append(n)
        digests += d
    tok, row = np.concatenate(tokens), np.concatenate(rows)
    key = names_of(tok, buckets)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    times = np.diff(np.append(starts, len(key)))
    once = np.repeat(times == 1, times)
    # Tokens held twice or more stay here by document; their bucket gets token and count.
    held, held_n = key[starts[times > 1]], times[times > 1].astype(np.uint32)
    held_rows = row[~once].astype(np.uint16)
    key, row = key[once], row[once]
    order = np.argsort(((key >> U(32)) << U(16)) | row.astype(U), kind="stable")
    key, row = key[order], row[order]
    bounds = np.arange(buckets + 1, dtype=U) << U(32)
    # Both lists are grouped by bucket, so the bucket borders split them.
    cut, held_cut = np.searchsorted(key >> U(32), bounds >> U(32)), np.searchsorted(held, bounds)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    out = [(-1 - block, block, -1, *_pack(
        ids.fill_null(0).to_numpy(zero_copy_only=False), known.astype(np.uint8),
        np.concatenate(counts).astype(np.int64)), b"".join(digests), *_pack(held_rows, held_n),
        pack_texts(texts) if carry else b"")]
    for b in range(buckets):
        s, h = slice(cut[b], cut[b + 1]), slice(held_cut[b], held_cut[b + 1])
        if s.stop > s.start or h.stop > h.start:
            out.append((b, block, b, *_pack(key[s].astype(np.uint32), _gaps(row[s]),
                                            held[h].astype(np.uint32), held_n[h]), b"", b"", b""))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in range(3 + len(_PARTS))]
    kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * len(_PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["g", "block", "bucket", *_PARTS])


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: the tokens found more than once, for each block."""
    rows = table.to_pylist()
    if rows[0]["g"] < 0:
        return table
    single = [np.frombuffer(r["a"], np.uint32) for r in rows]
    held = [np.frombuffer(r["c"], np.uint32) for r in rows]
    times = [np.frombuffer(r["d"], np.uint32) for r in rows]
    every = np.concatenate(single + held)
    weigh = np.concatenate([np.ones(sum(map(len, single)), np.int64), *times])
    order = np.argsort(every, kind="stable")
    sorted_ = every[order]
    first = np.ones(len(every), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(first)
    total = np.add.reduceat(weigh[order], starts)
    count = np.empty(len(every), np.int64)
    count[order] = np.repeat(total, np.diff(np.append(starts, len(every))))
    cuts = np.cumsum([0, *map(len, single), *map(len, held)])
    out = []
    for i, r in enumerate(rows):
        j = len(rows) + i
        mine, theirs = count[cuts[i]:cuts[i + 1]], count[cuts[j]:cuts[j + 1]]
        more = mine > 1
        docs = _ungap(r["b"], len(single[i]))[more]
        out.append((r["g"], r["block"], r["bucket"], *_pack(
            single[i][more], _gaps(docs), level(np.maximum(mine[more], 2)), held[i],
            level(np.maximum(theirs, 2))), b"", b""))
    return pa.Table.from_batches([_batch(out)])


def pack_texts(texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    with pa.ipc.new_stream(sink, batch.schema,
                           options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_texts(packed: bytes) -> pa.Array:
    return pa.ipc.open_stream(packed).read_all().column("t").combine_chunks()


class Block:
    """Documents of a block: ids (with ``known``), counts, digests, and for document ``i`` the
    tokens found elsewhere with their levels; ``texts`` are packed, if they were carried."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        side = rows[0]
        self.ids = np.frombuffer(side["a"], np.int64)
        self.known = np.frombuffer(side["b"], np.uint8).astype(bool)
        self.counts = np.frombuffer(side["c"], np.int64)
        self.texts = side["texts"]
        self.digests = [side["d"][i:i + DIGEST] for i in range(0, len(side["d"]), DIGEST)]
        held_rows, held_n = np.frombuffer(side["e"], np.uint16), np.frombuffer(side["f"], np.uint32)
        keys, docs, levels, held, held_levels = [], [], [], [], []
        for r in rows[1:]:
            high = U(r["bucket"]) << U(32)
            tok = np.frombuffer(r["a"], np.uint32)
            keys.append(tok.astype(U) | high)
            docs.append(_ungap(r["b"], len(tok)))
            levels.append(np.frombuffer(r["c"], np.uint8))
            held.append(np.frombuffer(r["d"], np.uint32).astype(U) | high)
            held_levels.append(np.frombuffer(r["e"], np.uint8))
        keys += [np.repeat(np.concatenate(held), held_n)] if held else []
        docs += [held_rows.astype(np.int64)] if held else []
        levels += [np.repeat(np.concatenate(held_levels), held_n)] if held else []
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        order = np.argsort(doc, kind="stable")
        self._tokens = np.concatenate(keys)[order] if keys else np.zeros(0, U)
        self._levels = np.concatenate(levels)[order] if keys else np.zeros(0, np.uint8)
        self._cut = np.searchsorted(doc[order], np.arange(len(self.ids) + 1))

    def __len__(self) -> int:
        return len(self.ids)

    def id(self, i: int) -> int | None:
        return int(self.ids[i]) if self.known[i] else None

    def found(self) -> np.ndarray:
        """All tokens of the block that occur more than once in the corpus."""
        return np.unique(self._tokens)

    def tokens(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self._cut[i], self._cut[i + 1])
        return self._tokens[s], self._levels[s]


def cross(docs: DataFrame, key: str, text: str, extract: Extract,
          finish: Callable[[Block, int], pa.RecordBatch], schema: str, buckets: int,
          carry: bool = False) -> DataFrame:
    """Apply ``finish`` to every block of documents, whose tokens know their frequency, and its
    number. ``carry`` takes the texts along with the block."""
    rows = small_batches(docs).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 28, 0
        for b in tidied(batches):
            at = 0
            sizes = pa.compute.binary_length(b.column("t")).fill_null(0).to_numpy(
                zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < b.num_rows:
                base = ends[at - 1] if at else 0
                end = min(max(at + 1, int(np.searchsorted(ends, base + SHARE, "right"))),
                          at + MOST_DOCS)
                part = b.slice(at, end - at)
                yield _batch(_split(extract, buckets, task + n, part.column("k"),
                                    part.column("t"), carry))
                n, at = n + 1, end

    def finished(key: tuple, table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([finish(Block(table), key[0].as_py())])
        release()
        return out

    counted = rows.mapInArrow(split, _SCHEMA).groupBy("g").applyInArrow(_count, _SCHEMA)
    return counted.groupBy("block").applyInArrow(finished, schema)
