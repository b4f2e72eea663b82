"""Removal of repeated byte strings by column-wise construction over many documents.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else goes. The order of
the suffixes of a collection is built column by column: each round takes one symbol of every
document, moves the documents stably by it, and updates the common length of neighbours (one
more where the symbols agree, the minimum over what lay between, else nothing). A document whose
common length with a neighbour reaches ``LENGTH`` repeats there.

Built over whole documents that would take as many rounds as the longest text has bytes, each
over files as long as all texts. Here documents are first cut into pieces that may match: each
window of ``LENGTH`` bytes picks the smallest hash among its ``LENGTH``/2-byte strings, its
anchor, so equal windows pick the same anchor at the same place. Anchors that occur once in the
corpus (``crossref``) rule their windows out. The windows of any other anchor form a piece, at
most ``COLUMNS`` bytes aligned at the anchor; pieces are sent to buckets by anchor, and the
column-wise rounds run over each bucket, so there are ``COLUMNS`` rounds whatever the texts.
Equal pieces of a block are sent once with a mark, so copies, however many, cost one piece for
each block. The packed rows of the shuffle are the external files that are read in sequence.

All comparisons that decide are made on bytes; a hash decides only which anchors are alone and
which pieces of one block are equal. Strings are judged on the input, overlaps count, matches
never cross documents.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` loses nothing. Repeated rows
are repeated documents: all of their windows repeat. Texts of any length are cut into pieces.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.blocks import BYTE_CODE, U, Rolling, chunks, mix
from barloom.llm.crossref import (DIGEST, Block, bucket_count, cross, names_of,
                                  pack_texts, unpack_texts)

LENGTH = 200
GRAM = LENGTH // 2
WINDOW = LENGTH - GRAM + 1
COLUMNS = LENGTH + WINDOW - 1
STRETCH = 8 << 20
ABSENT = 256
#: Buckets of pieces for each bucket of text, since pieces overlap.
FINER = 4


def _stretches(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents, and overlapping parts of a document beyond ``STRETCH``."""
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + STRETCH, "right")) - 1)
        if j > i + 1 or offs[j] - offs[i] <= STRETCH:
            yield int(offs[i]), int(offs[j])
        else:
            for a in range(int(offs[i]), int(offs[j]), STRETCH):
                if a == offs[i] or offs[j] - a >= LENGTH:
                    yield a, min(a + STRETCH + LENGTH - 1, int(offs[j]))
        i = j


def anchors(buf: np.ndarray, offs: np.ndarray):
    """Tokens, places, first and last window starts and rows of the anchors of some texts."""
    out: list[tuple[np.ndarray, ...]] = []
    for a, z in _stretches(offs):
        n = z - a
        if n < LENGTH:
            continue
        roll = Rolling(BYTE_CODE[buf[a:z]])
        at = np.arange(n - GRAM + 1)
        grams = roll.of(at, at + GRAM)
        smallest = (grams & ~U((1 << 24) - 1)) | at.astype(U)
        size = 1
        while size * 2 <= WINDOW:
            smallest = np.minimum(smallest[:-size], smallest[size:])
            size *= 2
        if size < WINDOW:
            step = WINDOW - size
            smallest = np.minimum(smallest[:-step], smallest[step:])
        starts = np.arange(len(smallest))
        row = np.searchsorted(offs, starts + a, "right") - 1
        whole = starts + a + LENGTH <= offs[row + 1]
        starts, row = starts[whole], row[whole]
        place = (smallest[whole] & U((1 << 24) - 1)).astype(np.int64)
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        # An anchor may serve windows of one document only.
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        p = place[first]
        out.append((mix(grams[p]), p + a, starts[first] + a, starts[last] + a, row[first]))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchor_tokens(buf: np.ndarray, offs: np.ndarray):
    tokens, _, _, _, row = anchors(buf, offs)
    n = np.diff(offs).astype(np.int64)
    return tokens, row, n, [b"\0" * DIGEST] * len(n)


def repeated(symbols: np.ndarray, group: np.ndarray, low: np.ndarray,
             size: np.ndarray) -> np.ndarray:
    """Which windows of which pieces also occur in another piece of the same group.

    ``symbols``: pieces x columns, ``ABSENT`` outside ``low`` .. ``low + size``. One round for
    each column: ``order`` lists the pieces by their reversed prefixes within their group,
    ``common`` holds the length that each shares with the one before it.
    """
    m = len(group)
    hit = np.zeros((m, COLUMNS - LENGTH + 1), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int64)
    key_group = group[order].astype(np.int64) * 512
    for j in range(COLUMNS):
        key = key_group + symbols[order, j]
        if (key[1:] < key[:-1]).any():
            move = np.argsort(key, kind="stable")
            key = key[move]
            longest = common[move]
            apart = np.flatnonzero((move[1:] != move[:-1] + 1) & (key[1:] == key[:-1])) + 1
            if len(apart):
                # The least common length over what lay between the two.
                pairs = np.empty(2 * len(apart), np.int64)
                pairs[0::2], pairs[1::2] = move[apart - 1] + 1, move[apart] + 1
                padded = np.append(common, 0)
                longest[apart] = np.minimum.reduceat(padded, pairs)[0::2]
            order, common = order[move], longest
        same = np.zeros(m, bool)
        same[1:] = key[1:] == key[:-1]
        common = np.where(same, common + 1, 0)
        start = j - LENGTH + 1
        if start >= 0:
            found = np.flatnonzero(common >= LENGTH)
            both = np.concatenate([order[found], order[found - 1]])
            both = both[(low[both] <= start) & (j < low[both] + size[both])]
            hit[both, start] = True
    return hit


_PACKED = "g long, block long, bucket int, token binary, low binary, size binary, many binary, " \
          "data binary, ids binary, known binary, texts binary, place binary"
_FIELDS = ["g", "block", "bucket", "token", "low", "size", "many", "data", "ids", "known",
           "texts", "place"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _FIELDS)


def _pieces(block: Block, number: int, buckets: int, with_bytes: bool) -> pa.RecordBatch:
    """The pieces of a block's repeated anchors, one packed row for each bucket of pieces, and
    a row that stays with the block: where its pieces lie, the texts that have any, and the
    sizes and digests of the others, which stay as they are."""
    found = block.found()
    texts = unpack_texts(block.texts)
    parts: list[tuple[np.ndarray, ...]] = []
    data: list[bytes] = []
    for first_row, buf, offs in chunks(texts):
        token, place, first, last, row = anchors(buf, offs)
        keep = np.isin(names_of(token, buckets), found)
        token, place, first, last, row = (x[keep] for x in (token, place, first, last, row))
        size = last - first + LENGTH
        low = first - place + LENGTH - GRAM
        content = Rolling(BYTE_CODE[buf]).of(first, first + size)
        parts.append((token, low, size, content, row + first_row, first - offs[row]))
        data += [buf[a:a + n].tobytes() for a, n in zip(first.tolist(), size.tolist())]
    token, low, size, content, row, start = (np.concatenate(x) for x in zip(*parts))
    to = ((mix(token + U(1)) >> U(40)) * U(buckets * FINER) >> U(24)).astype(np.int64)
    order = np.lexsort((size, low, content, token, to))
    same = np.zeros(len(order), bool)
    for x in (token, content, low, size):
        y = x[order]
        same[1:] = (y[1:] == y[:-1]) if x is token else same[1:] & (y[1:] == y[:-1])
    lead = np.flatnonzero(~same)
    times = np.diff(np.append(lead, len(order)))
    piece = order[lead]
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(piece)), times)
    place_ = np.stack([row, start, which, low]).astype(np.int64) if len(row) else np.zeros(
        (4, 0), np.int64)
    rest = np.ones(len(block), bool)
    rest[row] = False
    if with_bytes:
        rest[:] = False
    digests = b"".join([hashlib.sha256((texts[i].as_py() or "").encode()).digest()
                        for i in np.flatnonzero(rest).tolist()])
    out = [(-1 - number, number, -1, b"", b"", block.counts.tobytes(), rest.tobytes(), digests,
            block.ids.tobytes(), block.known.tobytes(),
            pack_texts(texts.take(pa.array(np.flatnonzero(~rest)))), place_.tobytes())]
    cut = np.searchsorted(to[piece], np.arange(buckets * FINER + 1))
    for b in np.unique(to[piece]).tolist():
        at = piece[cut[b]:cut[b + 1]]
        raw = b"".join([data[i] for i in at.tolist()])
        out.append((b, number, b, token[at].tobytes(), low[at].astype(np.uint8).tobytes(),
                    size[at].astype(np.uint16).tobytes(),
                    (times[cut[b]:cut[b + 1]] > 1).tobytes(),
                    pa.compress(raw, "zstd", asbytes=True), b"", b"", b"",
                    len(raw).to_bytes(8, "little")))
    return _batch(out)


def _rounds(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: the repeated windows of its pieces, for each block."""
    rows = table.to_pylist()
    if rows[0]["g"] < 0:
        return table
    token = np.concatenate([np.frombuffer(r["token"], U) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.uint8) for r in rows]).astype(np.int64)
    size = np.concatenate([np.frombuffer(r["size"], np.uint16) for r in rows]).astype(np.int64)
    many = np.concatenate([np.frombuffer(r["many"], bool) for r in rows])
    data = np.concatenate([np.frombuffer(pa.decompress(
        r["data"], int.from_bytes(r["place"], "little"), "zstd", asbytes=True), np.uint8)
        for r in rows])
    m = len(token)
    symbols = np.full((m, COLUMNS), ABSENT, np.uint16)
    column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbols[np.repeat(np.arange(m), size), column + np.repeat(low, size)] = data
    _, group = np.unique(token, return_inverse=True)
    hit = repeated(symbols, group, low, size)
    starts = np.arange(hit.shape[1])
    hit[many] = (starts >= low[many, None]) & (starts <= (low + size - LENGTH)[many, None])
    # Runs of window starts for each piece.
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    piece, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    at = np.cumsum([0, *(len(r["low"]) for r in rows)])
    out = []
    for i, r in enumerate(rows):
        mine = slice(*np.searchsorted(piece, [at[i], at[i + 1]]))
        out.append((r["g"], r["block"], r["bucket"], (piece[mine] - at[i]).astype(
            np.uint32).tobytes(), begin[mine].astype(np.uint8).tobytes(),
            (end[mine] - 1).astype(np.uint8).tobytes(), len(r["low"]).to_bytes(8, "little"),
            b"", b"", b"", b"", b""))
    return pa.Table.from_batches([_batch(out)])


_SPANS = "array<struct<start:long, end:long>>"
_RESULT = f"doc_id long, n_bytes long, n_removed long, spans {_SPANS}, kept_sha256 string, " \
          "kept binary"


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _results(table: pa.Table, with_bytes: bool) -> pa.Table:
    """Of one block: what goes from each document."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    side = rows[0]
    ids, known = np.frombuffer(side["ids"], np.int64), np.frombuffer(side["known"], bool)
    row, start, which, low = np.frombuffer(side["place"], np.int64).reshape(4, -1)
    at, runs = 0, []
    for r in rows[1:]:
        runs.append((np.frombuffer(r["token"], np.uint32).astype(np.int64) + at,
                     np.frombuffer(r["low"], np.uint8), np.frombuffer(r["size"], np.uint8)))
        at += int.from_bytes(r["many"], "little")
    piece, begin, end = (np.concatenate(x).astype(np.int64) for x in zip(*runs)) if runs else [
        np.zeros(0, np.int64)] * 3
    # Pieces to the places that hold them.
    first = np.searchsorted(piece, which)
    count = np.searchsorted(piece, which, "right") - first
    ref = np.repeat(np.arange(len(which)), count)
    run = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    a = start[ref] - low[ref] + begin[run]
    z = start[ref] - low[ref] + end[run] + LENGTH
    doc = row[ref]
    order = np.argsort(doc, kind="stable")
    doc, a, z = doc[order], a[order], z[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    rest = np.frombuffer(side["many"], bool)
    sizes = np.frombuffer(side["size"], np.int64)
    names_ = [int(x) if ok else None for x, ok in zip(ids, known)]
    out: list[tuple] = [
        (names_[i], int(sizes[i]), 0, [], side["data"][32 * j:32 * j + 32].hex(), None)
        for j, i in enumerate(np.flatnonzero(rest).tolist())]
    carried = np.flatnonzero(~rest)
    for first_row, buf, offs in chunks(unpack_texts(side["texts"])):
        for i in range(len(offs) - 1):
            text = buf[offs[i]:offs[i + 1]]
            number = carried[first_row + i]
            s = slice(cut[number], cut[number + 1])
            lo, hi = _merge(a[s], z[s]) if s.stop > s.start else (a[:0], a[:0])
            gone = np.zeros(len(text) + 1, np.int8)
            gone[lo] += 1
            gone[hi] -= 1
            kept = text[np.cumsum(gone[:-1]) == 0].tobytes() if len(lo) else text.tobytes()
            out.append((names_[number], len(text), int((hi - lo).sum()),
                        [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())],
                        hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text",
           with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept) for every row; ``kept`` holds the
    remaining bytes if asked for. Spans are byte offsets, end exclusive."""
    buckets = bucket_count(docs, text)
    pieces = cross(docs, key, text, _anchor_tokens,
                   lambda block, number: _pieces(block, number, buckets, with_bytes), _PACKED,
                   buckets, carry=True)
    return (pieces.groupBy("g").applyInArrow(_rounds, _PACKED)
            .groupBy("block").applyInArrow(
                lambda key_, table: _results(table, with_bytes), _RESULT))
