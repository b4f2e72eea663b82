"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents are laid end to end within each input partition, each closed by an end token, and cut
into sequences of ``length`` ids. Sequence ``s`` of ``M`` goes to slot ``P(s)``, where P is a
keyed Feistel permutation on the smallest even power of two that holds M, walked along its cycle
until it falls below M: a random order without a sort, a table or a second pass, computable for
any sequence alone and invertible. A range of slots is a shard; one task writes it, and slot
``i`` lies at byte ``(i mod per_shard) * stride`` of shard ``i div per_shard``, so a reader starts
or resumes anywhere with one seek and then reads in order.

Sequences are counted first (one number for each input partition comes to the driver) and then
numbered by partition, so the input must be a table; a partition whose count has changed stops
the job. The shuffle carries one compressed block for each batch and shard. A shard is bounded
by ``shard_bytes``, whatever the documents; a long text is many sequences. Shard files are
written under another name and renamed, so a lost or repeated task leaves whole files only; the
folder must be one that all executors share.

Defined cases: null and empty texts are documents of one end token. Repeated rows are repeated
documents. The last sequence of a partition is filled with the end token. An empty table gives
no shard.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import U, mix, small_batches, tidied
from barloom.plans.storage import scratch

LENGTH = 1024
SHARD_BYTES = 16 << 20
ROUNDS = 4
_INDEX = "doc_id long, doc_offset long, slot long, seq_offset int, n_tokens int"


def _half_bits(count: int) -> int:
    return max(1, -(-max(count - 1, 1).bit_length() // 2))


def _round(right: np.ndarray, key: int, i: int) -> np.ndarray:
    return mix(right + U((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & (2 ** 64 - 1)))


def permute(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots of sequences ``numbers`` among ``count``."""
    w = U(_half_bits(count))
    mask = (U(1) << w) - U(1)
    x = numbers.astype(U)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> w, x[walk] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, i) & mask)
        x[walk] = (left << w) | right
        walk[walk] = x[walk] >= U(count)
    return x.astype(np.int64)


def restore(slots: np.ndarray, count: int, key: int) -> np.ndarray:
    """The sequences in ``slots``: the inverse of ``permute``."""
    w = U(_half_bits(count))
    mask = (U(1) << w) - U(1)
    x = slots.astype(U)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> w, x[walk] & mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ (_round(left, key, i) & mask), left
        x[walk] = (left << w) | right
        walk[walk] = x[walk] >= U(count)
    return x.astype(np.int64)


def _lengths(ids: str, kinds: dict[str, str]) -> F.Column:
    c = F.col(ids)
    n = F.size(c) if kinds[ids].startswith("array") else F.octet_length(c)
    return F.when(c.isNull(), 0).otherwise(n).cast("long") + 1


def _flat(column: pa.Array, dtype: np.dtype, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, each document closed by ``end``, and the documents' offsets."""
    if pa.types.is_list(column.type):
        column = column.fill_null([]) if column.null_count else column
        offs = column.offsets.to_numpy()
        ids = column.values.to_numpy(zero_copy_only=False).astype(dtype)[offs[0]:offs[-1]]
    else:
        column = column.cast(pa.large_binary()).fill_null(b"")
        bufs = column.buffers()
        offs = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        ids = data[offs[0]:offs[-1]].astype(dtype)
    offs = offs - offs[0]
    return np.insert(ids, offs[1:], end), offs + np.arange(len(offs))


def materialise(docs: DataFrame, ids: str, folder: str, key: int, dtype: str = "<u2",
                length: int = LENGTH, end: int = 0, shard_bytes: int = SHARD_BYTES,
                doc_id: str = "doc_id") -> DataFrame:
    """Write the shards and return their index, one row for each document and sequence:
    (doc_id, doc_offset, slot, seq_offset, n_tokens, shard, byte_offset, crc32 of the sequence
    as read back). ``ids`` is an array of token ids, or binary or text whose bytes are ids."""
    kind = np.dtype(dtype)
    stride = length * kind.itemsize
    per_shard = max(1, shard_bytes // stride)
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("k"), F.col(ids).alias("t"))
    tokens = rows.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum(_lengths("t", dict(rows.dtypes))).alias("n"))
    sizes = {r.p: -(-r.n // length) for r in tokens.collect()}
    count, first = 0, {}
    for p in sorted(sizes):
        first[p], count = count, count + sizes[p]
    shared = docs.sparkSession.sparkContext.broadcast((first, sizes))

    def packed(number: int, ids_: np.ndarray, segments: list[np.ndarray]) -> pa.RecordBatch:
        """Sequences from ``number`` on, sorted into shards."""
        n = len(ids_) // length
        slots = permute(np.arange(number, number + n), count, key)
        order = np.argsort(slots)
        cut = np.flatnonzero(np.diff(slots[order] // per_shard, prepend=-1))
        seq = segments[0]
        out = []
        for a, b in zip(cut, np.append(cut[1:], n)):
            at = order[a:b]
            mine = np.isin(seq, at)
            place = np.empty(n, np.int64)
            place[at] = slots[at]
            out.append((int(slots[at[0]] // per_shard), slots[at].tobytes(),
                        zstandard.compress(ids_.reshape(n, length)[at].tobytes(), 1),
                        *[x.tobytes() for x in (place[seq[mine]], *(s[mine] for s in
                                                                    segments[1:]))]))
        kinds = [pa.int64(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          names=["shard", "slots", "ids", "place", "doc", "known",
                                                 "at", "span"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        starts, wanted = shared.value
        number = starts.get(p, 0)
        rest = np.zeros(0, kind)
        carried: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        for b in tidied(batches):
            if not b.num_rows:
                continue
            flat, offs = _flat(b.column("t"), kind, end)
            # Segments: borders are those of documents and of sequences.
            lead = len(rest)
            borders = np.union1d(offs, np.arange(-(lead % length), len(flat), length))
            borders = borders[(borders >= 0) & (borders <= len(flat))]
            doc = np.searchsorted(offs, borders[:-1], "right") - 1
            known = b.column("k").is_valid().to_numpy(zero_copy_only=False)
            k = b.column("k").fill_null(0).to_numpy(zero_copy_only=False)
            new = [borders[:-1] + lead, k[doc], known[doc].astype(np.int64),
                   borders[:-1] - offs[doc], np.diff(borders)]
            carried = [np.concatenate(x) for x in zip(carried, new)]
            rest = np.concatenate([rest, flat])
            n = len(rest) // length
            if n:
                done = carried[0] < n * length
                yield packed(number, rest[:n * length], [carried[0][done] // length] + [
                    carried[i][done] for i in (1, 2, 3)] + [
                    carried[4][done] | (carried[0][done] % length) << 32])
                carried = [x[~done] for x in carried]
                carried[0] = carried[0] - n * length
                rest, number = rest[n * length:], number + n
        if len(rest):
            last = np.full(length, end, kind)
            last[:len(rest)] = rest
            yield packed(number, last, [carried[0] // length, *carried[1:4],
                                        carried[4] | (carried[0] % length) << 32])
            number += 1
        if number != starts.get(p, 0) + wanted.get(p, 0):
            raise RuntimeError("the input's partitions changed between two readings")

    def write(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        slots = np.concatenate([np.frombuffer(r["slots"], np.int64) for r in rows])
        ids_ = np.concatenate([np.frombuffer(zstandard.decompress(r["ids"]), kind).reshape(
            -1, length) for r in rows])
        shard = rows[0]["shard"]
        order = np.argsort(slots)
        if not np.array_equal(slots[order], np.arange(shard * per_shard,
                                                      shard * per_shard + len(slots))):
            raise RuntimeError(f"shard {shard} is not whole")
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/{shard_name(shard)}"
        name = f"{final}.{uuid.uuid4().hex}"
        with store.open_output_stream(name) as f:
            f.write(ids_[order].tobytes())
        store.move(name, final)
        crc = [zlib.crc32(s) for s in _read(store, final, stride, 0)]
        place, doc, known, at, span = (np.concatenate([np.frombuffer(r[c], np.int64)
                                                       for r in rows])
                                       for c in ("place", "doc", "known", "at", "span"))
        check = np.array(crc, np.int64)[place - shard * per_shard]
        return pa.table({
            "doc_id": pa.array(doc, mask=known == 0), "doc_offset": at, "slot": place,
            "seq_offset": (span >> 32).astype(np.int32),
            "n_tokens": (span & 0xFFFFFFFF).astype(np.int32),
            "shard": np.full(len(doc), shard), "byte_offset": (place % per_shard) * stride,
            "crc32": check})

    dealt = rows.mapInArrow(deal, "shard long, slots binary, ids binary, place binary, "
                                  "doc binary, known binary, at binary, span binary")
    return dealt.groupBy("shard").applyInArrow(
        write, _INDEX + ", shard long, byte_offset long, crc32 long")


def shard_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def _read(store: pa.fs.FileSystem, path: str, stride: int, first: int) -> Iterator[bytes]:
    with store.open_input_file(path) as f:
        f.seek(first * stride)
        while block := f.read(stride):
            yield block


def read(folder: str, count: int, dtype: str = "<u2", length: int = LENGTH, start: int = 0,
         shard_bytes: int = SHARD_BYTES) -> Iterator[np.ndarray]:
    """Sequences in training order from slot ``start`` on, ``count`` in all shards."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(dtype).itemsize
    per_shard = max(1, shard_bytes // stride)
    slot = start
    while slot < count:
        for block in _read(store, f"{root}/{shard_name(slot // per_shard)}", stride,
                           slot % per_shard):
            yield np.frombuffer(block, dtype)
            slot += 1


def byte_shards(docs: DataFrame, key: int = 20240229) -> DataFrame:
    """Shards of UTF-8 byte ids in a new folder of the shared storage; returns their index."""
    return materialise(docs, "text", scratch(docs.sparkSession), key, dtype="u1")
