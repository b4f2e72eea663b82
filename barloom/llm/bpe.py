"""Byte-level BPE by longest match and backtracking.

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds
the longest token at any place. A pre-token is encoded by longest matches from the left; a token
may follow another only if the two are *compatible*, that is, if merging the bytes
of both by rank gives exactly these two. Compatibility of a pair is memoised. Where no token
fits, the last one gives way to its next shorter prefix; a place found to be a dead end is
marked and never entered again, so the work is linear in the pre-token. A sequence whose
neighbours are all compatible is the one that the merges give.

Only tokens that the merges can make are used inside a pre-token; a whole pre-token in the
vocabulary is one id, as in the library. Encoded pre-tokens are kept in a table of bounded size
during a task. Texts are independent rows: one pass, no shuffle, nothing collected.

Defined cases: a null text encodes like an empty one, to no ids. Repeated rows get equal
results. A pre-token of any length is encoded whole.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import small_batches, tidied

KEPT = 200_000
PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Repeated merging of the adjacent pair of lowest rank, down to ``least`` parts; for short
    pieces only."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best = min(range(len(parts) - 1),
                   key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) * 2 + 1))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


def narrow(pattern: str) -> re.Pattern | None:
    """The same splits of texts whose characters all lie below U+0100, for the faster engine: its
    classes are written out for these 256 characters. None where the pattern has others."""
    one = [chr(c) for c in range(256)]
    sets = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        sets[name] = "".join(re.escape(c) for c in one if regex.fullmatch(name, c))
    out = pattern.replace(r"(?!\S)", f"(?![^{sets[chr(92) + 's']}])")
    parts = regex.split(r"(\[[^\]]*\])", out)
    for name, chars in sets.items():
        parts = [x.replace(name, chars if x.startswith("[") and name in pattern and not x.startswith(
            f"[^{sets[chr(92) + 's']}]") else f"[{chars}]") for x in parts]
    out = "".join(parts)
    if regex.search(r"\\[a-zA-Z]|\(\?[^!:=]", out):
        return None
    return re.compile(out)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"vocabulary lacks bytes {lacking}")
        self.ranks, self.kept = ranks, kept
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._wide, near = regex.compile(pattern).findall, narrow(pattern)
        self._near = near and near.findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, list[tuple[bytes, float]]] = {}
        self._pairs: dict[int, bool] = {}
        self._shorter: dict[int, int | None] = {}
        self._pieces: dict[str, tuple[bytes, int, bytes]] = {}
        self._older: dict[str, tuple[bytes, int, bytes]] = {}

    def split(self, text: str) -> list[str]:
        if self._near is not None and (text.isascii() or max(text) < "\u0100"):
            return self._near(text)
        return self._wide(text)

    def _last(self, i: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins into token ``i``; none for a single byte, and
        for one that the merges of its bytes don't give."""
        if i not in self._halves:
            b = self.bytes_of[i]
            parts = merge(b, self.ranks, 2)
            whole = len(parts) == 2 and parts[0] + parts[1] in self.ranks
            self._halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else None
        return self._halves[i]

    def _made(self, i: int) -> bool:
        """Do the merges of its own bytes give this token?"""
        return len(self.bytes_of[i]) == 1 or self._last(i) is not None

    def _edge(self, i: int, side: int) -> list[tuple[bytes, float]]:
        """The parts of token ``i`` that stand at its left (0) or right (1) edge while the merges
        run, from a single byte up, each with the rank of the merge that takes it in."""
        found = self._edges.get(i << 1 | side)
        if found is None:
            found, until, at = [], float("inf"), i
            while True:
                found.append((self.bytes_of[at], until))
                last = self._last(at)
                if last is None:
                    break
                until, at = at, last[side]
            found.reverse()
            self._edges[i << 1 | side] = found
        return found

    def _fits(self, i: int, j: int) -> bool:
        """May token ``j`` follow token ``i``? They may unless, at some time of the merges, a part
        at the right edge of ``i`` and one at the left edge of ``j`` would be joined before either
        is taken into its own token; of equal ranks the merge farther left goes first."""
        ok = self._pairs.get(i << 32 | j)
        if ok is None:
            ok = self._made(j)
            if ok:
                left, right, ranks = iter(self._edge(i, 1)), iter(self._edge(j, 0)), self.ranks
                (a, until_a), (b, until_b) = next(left), next(right)
                while True:
                    joined = ranks.get(a + b)
                    if joined is not None and joined < until_a and joined <= until_b:
                        ok = False
                        break
                    if until_a <= until_b:
                        if until_a == float("inf"):
                            break
                        a, until_a = next(left)
                    else:
                        b, until_b = next(right)
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[i << 32 | j] = ok
        return ok

    def _next_shorter(self, i: int) -> int | None:
        """The longest token that is a proper prefix of token ``i``."""
        if i not in self._shorter:
            b = self.bytes_of[i]
            self._shorter[i] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1)
                                     if b[:k] in self.ranks), None)
        return self._shorter[i]

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        out = [i for _, i in self.automaton.iter_long(text)]
        good = 0
        if out and self._made(out[0]):
            good = 1
            pairs = self._pairs
            for i, j in zip(out, out[1:]):
                ok = pairs.get(i << 32 | j)
                if not (self._fits(i, j) if ok is None else ok):
                    break
                good += 1
        return out if good == len(out) else self._backtrack(text, out[:good])

    def _backtrack(self, text: str, out: list[int]) -> list[int]:
        """Finish an encoding whose first tokens ``out`` are compatible longest matches."""
        size, n = self.bytes_of, len(text)
        at = sum(len(size[i]) for i in out)
        places = [0]
        for i in out:
            places.append(places[-1] + len(size[i]))
        dead = bytearray(n + 1)
        longest = self.automaton.iter_long
        option: int | None = next(longest(text, at))[1]
        while True:
            if option is None:
                dead[places.pop()] = 1  # never the start: single bytes are tokens
                option = self._next_shorter(out.pop())
                continue
            after = places[-1] + len(size[option])
            if not dead[after] and (self._fits(out[-1], option) if out else self._made(option)):
                out.append(option)
                if after == n:
                    return out
                places.append(after)
                option = next(longest(text, after))[1]
            else:
                option = self._next_shorter(option)

    def _piece(self, piece: str) -> tuple[bytes, int, bytes]:
        """(decimal ids joined by commas, their number, decoded bytes) of a pre-token."""
        value = self._older.get(piece)
        if value is None:
            ids = self.encode_bytes(piece.encode())
            value = (",".join(map(str, ids)).encode(), len(ids), self.decode(ids))
        if len(self._pieces) >= self.kept:  # the last full table stays readable
            self._older, self._pieces = self._pieces, {}
        if len(piece) <= 64:
            self._pieces[piece] = value
        return value

    def pieces(self, text: str) -> list[tuple[bytes, int, bytes]]:
        get, make = self._pieces.get, self._piece
        return [get(p) or make(p) for p in self.split(text)]

    def columns(self, text: str) -> tuple:
        """The pieces' written ids, their numbers and their decoded bytes, each by itself."""
        return tuple(zip(*self.pieces(text))) or ((), (), ())

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.encode_bytes(p.encode())]

    def forget(self) -> None:
        """Empty the tables; the automaton stays."""
        for table in (self._pieces, self._older, self._pairs):
            table.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, kept: int = KEPT) -> Encoder:
    """One encoder for each Python worker; the vocabulary lies with the installed package."""
    return Encoder(read_ranks(path), pattern, kept)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row."""
    rows = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in tidied(batches):
            n, ids, decoded = [], [], []
            for t in b.column("t"):
                one, many, back = enc.columns(t.as_py() or "")
                n.append(sum(many))
                ids.append(hashlib.sha256(b",".join(one)).hexdigest())
                decoded.append(hashlib.sha256(b"".join(back)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())], names=["k", "n", "i", "d"])
        enc.forget()

    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(run, f"k {kind}, n long, i string, d string").select(
        F.col("k").alias(key), F.col("n").alias("n_tokens"), F.col("i").alias("ids_sha256"),
        F.col("d").alias("decoded_sha256"))


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text",
           kept: int = KEPT) -> DataFrame:
    """The columns ``keep`` and ``ids``, an array of token ids. ``kept`` bounds the worker's
    table of pre-tokens (about 0.7 kB each)."""
    rows = small_batches(docs).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                       F.col(text).alias("t"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, kept)
        for b in tidied(batches):
            ids = [np.fromstring(b",".join([p[0] for p in enc.pieces(t.as_py() or "")]).decode(),
                                 np.int32, sep=",") for t in b.column("t")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(ids, pa.list_(pa.int32()))],
                names=[*names, "ids"])
        enc.forget()

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return rows.mapInArrow(run, f"{schema}, ids array<int>").select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], "ids")


def decode(rows: DataFrame, path: str, pattern: str, keep: list[str],
           ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``text`` out of token ids; null ids give an empty text."""
    names = [f"k{i}" for i in range(len(keep))]
    frame = rows.select(*[F.col(c).alias(n) for n, c in zip(names, keep)], F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in tidied(batches):
            text = [enc.decode(x.as_py() or []).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(text, pa.string())],
                names=[*names, "text"])

    kinds = dict(frame.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return frame.mapInArrow(run, f"{schema}, text string").select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], "text")
