"""Personal data: base patterns, and terms that give an entity away.

Base spans are e-mail, IP, card and phone numbers. Information-theoretic sanitisation adds
terms: over the whole corpus, the words of a document are counted with every entity it holds,
and a term's point-wise mutual information with the entity is held against the entity's own
information content. With ``d(x)`` the number of documents with x and N that of all, PMI =
log2(N d(e,t) / (d(e) d(t))) and IC = log2(N / d(e)). A term discloses when PMI >= ``SHARE`` IC
in at least ``SUPPORT`` different surroundings (``REACH`` words on either side) of the entity,
so copies of one passage prove nothing. Most entities stand in one document only and can give no
term; so the groups they belong to (``group``: a mail domain, the network of an address, the leading
digits of a number) are protected in the same way. Every occurrence in a document that holds the entity is
marked: removed when the term determines the entity (PMI >= IC), else generalised.

A word is a run of characters other than blanks and punctuation, with apostrophes and hyphens
inside. A word below ``LEAST_LETTERS`` characters is a term unless it is all lower-case letters.
Words inside base spans are not counted with an entity and not marked, but count in d(t).

All counts cover all documents. Only entities with ``SUPPORT`` surroundings can give a term, so
the texts that hold one are set aside and read again, once for the counts and once for the
marks. PMI is at most log2(N / max(d(e), d(t))), which rules out terms with d(t) > N^(1-SHARE)
d(e)^SHARE: the most frequent ``COMMON`` of them go to the tasks, which skip them, and the rest
are dropped by the final comparison. Pairs are added up in the tasks, keeping ``SUPPORT``
surroundings of each, before they are shuffled, and again in a map-side step. All words of the
corpus are counted by document, whatever the entities. The list of disclosing terms goes to the
tasks when it is at most ``LISTED`` hashes (its size is checked), else all words are joined.

Defined cases: a null text is empty and has no spans. Rows are told apart by key and text, so
repeated rows get equal results and null keys stay. A very long text is one row like any other;
every pattern runs in time linear in its length.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import (BYTE_CODE, FOLDED_CODE, Rolling, chunks, small_batches, tidied,
                                word_hashes, words)
from barloom.plans.storage import cut

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REACH = 8
SUPPORT = 3
SHARE = 0.9
#: Digits of a card or phone number that name its group.
LEADING = 6
LEAST_LETTERS = 4
LISTED = 1_000_000
COMMON = 100_000
#: Pairs a task holds before it adds them up.
HELD = 1 << 20
GENERAL = "[TERM]"

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BREAK = r"\x00-\x20!\"#$%&()*+,./:;<=>?\[\\\]^`{|}~\x7f" + "\u00a0«»“”„‘…–—¿¡、。，"
_INNER = r"'’\-"
_TERM = re.compile(f"[^{_BREAK}{_INNER}]+(?:[{_INNER}]+[^{_BREAK}{_INNER}]+)*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with a domain after it takes the whole run before it that is still free;
    what the pattern finds from the left, without trying every start of a long run."""
    free = at = 0
    while (at := text.find("@", max(at, free))) >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL_SET:
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at += 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """Texts whose runs without white space are the words that ``_TERM`` finds."""
    out = column.cast(pa.large_string())
    for pattern, by in ((f"[{_BREAK}]+", " "), (f"[{_INNER}]+( |$)", r"\1"),
                        (f"(^| )[{_INNER}]+", r"\1")):
        out = pa.compute.replace_substring_regex(out, pattern, by)
    return out


def group(kind: str, value: str) -> str:
    """What an entity shares with others of its owner or place: the mail domain, the network of
    an address, the leading digits of a number."""
    if kind == "email":
        return value.rsplit("@", 1)[-1]
    if kind == "ip":
        return value.rsplit(".", 2)[0]
    return re.sub(r"[^0-9]", "", value)[:LEADING]


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """One record for each entity of a text and for each entity group: a digest of the words near
    its mentions, ``REACH`` whole words on either side."""
    ordered = sorted(spans, key=lambda s: s[1])
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in places], [e for _, e in places]
    found: dict[tuple[str, str], dict[int, str]] = {}
    for kind, a, b in ordered:
        before, after = bisect_left(starts, a), bisect_right(ends, b)
        # A word that the mention cuts counts with the part outside.
        near = [(s, min(e, a)) for s, e in places[max(0, before - REACH):before]]
        near += [(max(s, b), e) for s, e in places[after:after + REACH]]
        value = re.sub(r"[^0-9a-z@+._-]", "", text[a:b].lower())
        for name in ((kind, value), (f"{kind} group", group(kind, value))):
            around = found.setdefault(name, {})
            for s, e in near:
                word = text[s:e].strip(".,;:!?()[]\"'")
                if len(word) < LEAST_LETTERS or not word.isalpha():
                    continue
                start = s + text[s:e].index(word)
                if not any(x < start + len(word) and start < y for _, x, y in ordered):
                    around[start] = word
    return [{"kind": kind, "value": value, "around": int.from_bytes(hashlib.md5(
        " ".join(around.values()).encode()).digest()[:8], "big", signed=True)}
        for (kind, value), around in found.items()]


_BASE = ("k {kind}, th long, " + ", ".join(f"n_{k} long" for k in KINDS)
         + ", base string, found array<struct<kind:string, value:string, around:long>>, t string")


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = small_batches(docs).select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("th"),
                       F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    entity = pa.struct([("kind", pa.string()), ("value", pa.string()), ("around", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            base, found, held = [], [], []
            for t in b.column("t"):
                text_ = t.as_py() or ""
                spans = base_spans(text_)
                for i, k in enumerate(KINDS):
                    counts[i].append(sum(s[0] == k for s in spans))
                base.append(written(spans))
                found.append(contexts(text_, spans) if spans else [])
                held.append(text_ if spans else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("th"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(base, pa.string()), pa.array(found, pa.list_(entity)),
                 pa.array(held, pa.string())],
                names=["k", "th", *[f"n_{k}" for k in KINDS], "base", "found", "t"])

    return rows.mapInArrow(run, _BASE.format(kind=kind))


def _listed(hashes: DataFrame) -> np.ndarray | None:
    """The hashes in order when they are at most ``LISTED``."""
    few = hashes.limit(LISTED + 1).toArrow().column(0).to_numpy()
    return np.sort(few.astype(np.int64)) if len(few) <= LISTED else None


def _in(want: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(want, h)
    hit = np.zeros(len(h), bool)
    inside = at < len(want)
    hit[inside] = want[at[inside]] == h[inside]
    return hit


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once for each row, in the order of the rows."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _term_counts(docs: DataFrame, text: str) -> DataFrame:
    """Documents with each word of the corpus: added up by the tasks for ``HELD`` words at a
    time, then in a map-side step. The rows follow the text, whatever entities it holds."""
    def added(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))],
                                          names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for b in tidied(batches):
            for _, buf, offs in chunks(plain(b.column("t"))):
                h, row = word_hashes(buf, offs)
                parts.append(_distinct(h.view(np.int64), row)[0])
                if sum(map(len, parts)) >= HELD:
                    yield added(parts)
                    parts = []
        if parts:
            yield added(parts)

    return (small_batches(docs).select(F.col(text).alias("t")).mapInArrow(run, "h long, n long")
            .groupBy("h").agg(F.sum("n").alias("d_t")))


def _outside(text: str, base: str) -> str:
    """A text without its base spans."""
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in base.split(","))):
        out.append(text[at:max(at, a)])
        at = max(at, b)
    return " ".join([*out, text[at:]])


def _may_be_terms(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words are not short runs of lower-case letters."""
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    short = np.flatnonzero(points[end] - points[start] < LEAST_LETTERS)
    ok = np.ones(len(start), bool)
    _, first, which = np.unique(Rolling(BYTE_CODE[buf]).of(start[short], end[short]),
                                return_index=True, return_inverse=True)
    found = [buf[start[i]:end[i]].tobytes().decode() for i in short[first].tolist()]
    ok[short] = np.array([not (w.isalpha() and w.islower()) for w in found], bool)[which]
    return ok


def _terms(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of the distinct terms outside base spans) of every text of a batch."""
    texts = pa.array([_outside(t.as_py(), s.as_py())
                      for t, s in zip(b.column("t"), b.column("base"))], pa.large_string())
    for first, buf, offs in chunks(plain(texts)):
        start, end, row = words(buf, offs)
        ok = _may_be_terms(buf, start, end)
        h = Rolling(FOLDED_CODE[buf]).of(start[ok], end[ok]).view(np.int64)
        h, row = _distinct(h, row[ok])
        cut_ = np.searchsorted(row, np.arange(len(offs)))
        for i in range(len(offs) - 1):
            yield first + i, h[cut_[i]:cut_[i + 1]]


def _added(parts: list[tuple], support: int) -> pa.RecordBatch:
    """Pairs with their documents, and at most ``support`` surroundings of each."""
    e, d_e, h, around = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((around, h, e))
    e, d_e, h, around = (x[order] for x in (e, d_e, h, around))
    pair = np.ones(len(e), bool)
    pair[1:] = (e[1:] != e[:-1]) | (h[1:] != h[:-1])
    new = pair.copy()
    new[1:] |= around[1:] != around[:-1]
    nth = np.cumsum(new)
    nth -= np.repeat(nth[pair], np.diff(np.append(np.flatnonzero(pair), len(e))))
    at = np.flatnonzero(new & (nth < support))
    n = np.diff(np.append(at, len(e)))
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (e[at], d_e[at], h[at], around[at], n)],
        names=["e", "d_e", "h", "around", "n"])


def _together(held: DataFrame, counts: DataFrame, total: float, support: int,
              share: float) -> DataFrame:
    """(e, d_e, h, d_et) of the pairs with enough surroundings."""
    def most(d_e):
        return total ** (1 - share) * d_e ** share * (1 + 1e-9)

    common = (counts.where(F.col("d_t") > F.lit(most(float(support)))).orderBy(F.desc("d_t"))
              .limit(COMMON).toArrow())
    h_, d_ = (common.column(c).to_numpy().astype(np.int64) for c in ("h", "d_t"))
    order_ = np.argsort(h_)
    shared = held.sparkSession.sparkContext.broadcast((h_[order_], d_[order_]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        parts: list[tuple] = []
        size = 0
        for b in tidied(batches):
            entities = b.column("es")
            for i, h in _terms(b):
                d_t = np.zeros(len(h), np.int64)
                hit = _in(known, h)
                d_t[hit] = often[np.searchsorted(known, h[hit])]
                for x in entities[i].as_py():
                    mine = h[d_t <= most(float(x["d_e"]))]
                    parts.append(tuple(np.full(len(mine), v, np.int64) if v is not None else mine
                                       for v in (x["e"], x["d_e"], None, x["around"])))
                    size += len(mine)
                    if size >= HELD:
                        yield _added(parts, support)
                        parts, size = [], 0
            if parts:
                yield _added(parts, support)
                parts, size = [], 0

    return (small_batches(held).select("t", "base", "es")
            .mapInArrow(run, "e long, d_e long, h long, around long, n long")
            .groupBy("e", "d_e", "h", "around").agg(F.sum("n").alias("n"))
            .groupBy("e", "d_e", "h")
            .agg(F.sum("n").alias("d_et"), F.count(F.lit(1)).alias("places"))
            .where(F.col("places") >= support).drop("places"))


def _holders(held: DataFrame, telling: DataFrame) -> DataFrame:
    """(k, th, hits): the disclosing terms (h, removed) of each text that holds their entity."""
    shared = held.sparkSession.sparkContext.broadcast(_listed(telling.select("h").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        for b in tidied(batches):
            entities = b.column("es")
            for i, h in _terms(b):
                h = h if want is None else h[_in(want, h)]
                for x in entities[i].as_py() if len(h) else []:
                    rows = pa.array(np.full(len(h), i))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("k").take(rows), b.column("th").take(rows),
                         pa.array(np.full(len(h), x["e"], np.int64)), pa.array(h)],
                        names=["k", "th", "e", "h"])

    kind = dict(held.dtypes)["k"]
    return (small_batches(held).select("k", "th", "t", "base", "es")
            .mapInArrow(run, f"k {kind}, th long, e long, h long")
            .join(telling, ["e", "h"])
            .groupBy("k", "th", "h").agg(F.max("removed").alias("removed"))
            .groupBy("k", "th").agg(F.collect_list(F.struct("h", "removed")).alias("hits")))


def _marks(held: DataFrame) -> DataFrame:
    """(k, th, terms): where the terms ``hits`` of each text stand, outside base spans."""
    kind = dict(held.dtypes)["k"]
    mark = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("removed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            out = []
            for t, base, hits in zip(b.column("t"), b.column("base"), b.column("hits")):
                text = t.as_py()
                found = list(_TERM.finditer(text))
                raw = np.frombuffer(" ".join([m[0] for m in found]).encode(), np.uint8)
                h = word_hashes(raw, np.array([0, len(raw)]))[0].view(np.int64).tolist()
                removed = {x["h"]: x["removed"] for x in hits.as_py()}
                covered = np.zeros(len(text) + 1, np.int32)
                for x in base.as_py().split(","):
                    _, a, z = x.split(":")
                    covered[int(a)] += 1
                    covered[int(z)] -= 1
                inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
                out.append([{"s": m.start(), "e": m.end(), "removed": removed[x]}
                            for m, x in zip(found, h)
                            if x in removed and inside[m.start()] == inside[m.end()]])
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("th"), pa.array(out, pa.list_(mark))],
                names=["k", "th", "terms"])

    return (small_batches(held).select("k", "th", "t", "base", "hits").mapInArrow(
        run, f"k {kind}, th long, terms array<struct<s:int,e:int,removed:boolean>>")
        .where(F.size("terms") > 0).groupBy("k", "th").agg(F.first("terms").alias("terms")))


def _beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` with what ``right`` has for the same key, null too, and text."""
    out = left.join(right.withColumnsRenamed({"k": "k2", "th": "th2"}),
                    F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), how)
    return out.drop("k2", "th2")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT,
         share: float = SHARE) -> DataFrame:
    """(k, th, n_email .. n_phone, base, terms): ``terms`` are (s, e, removed) of the terms
    that give away an entity of the same document; one row for each input row."""
    base = cut(_found(docs, key, text))
    total = float(docs.count())
    near = base.select("k", "th", F.explode("found").alias("x")).select(
        "k", "th", F.xxhash64("x.kind", "x.value").alias("e"), "x.around")
    live = (near.groupBy("e", "around").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("e").agg(F.sum("n").alias("d_e"), F.count(F.lit(1)).alias("places"))
            .where((F.col("places") >= support) & (F.col("d_e") < total)).drop("places"))
    holders = (near.join(live, "e").groupBy("k", "th")
               .agg(F.collect_set(F.struct("e", "around", "d_e")).alias("es")))
    held = cut(_beside(base.where("t is not null").select("k", "th", "base", "t"), holders,
                       "inner"))
    counts = cut(_term_counts(docs, text))
    together = _together(held, counts, total, support, share)
    pmi = F.log2(F.lit(total) * F.col("d_et") / (F.col("d_e") * F.col("d_t")))
    content = F.log2(F.lit(total) / F.col("d_e"))
    telling = cut(together.join(counts, "h").where(pmi >= share * content)
                  .select("e", "h", (pmi >= content - 1e-9).alias("removed")))
    hits = _holders(held, telling)
    marks = _marks(_beside(held.select("k", "th", "base", "t"), hits, "inner"))
    return _beside(base.drop("found", "t"), marks, "left").select(
        "k", "th", *[f"n_{k}" for k in KINDS], "base", "terms")


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row of a table (doc_id, text)."""
    extra = F.transform(F.coalesce("terms", F.array().cast(
        "array<struct<s:int,e:int,removed:boolean>>")),
        lambda x: F.concat(F.lit(f"{TERM}:"), x["s"], F.lit(":"), x["e"]))
    listed = F.array_join(F.filter(F.concat(F.array("base"), extra), lambda x: x != ""), ",")
    return find(docs).select(
        F.col("k").alias("doc_id"), *[f"n_{k}" for k in KINDS],
        F.sha2("base", 256).alias("base_sha256"), listed.alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def mask(text: str, base: str, terms: list) -> str:
    """The text with every span replaced; spans of different kinds may overlap, and the
    stretch they cover together takes the name of the first."""
    spans = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in
             (x.split(":") for x in base.split(",") if x)]
    spans += [(t["s"], t["e"], "" if t["removed"] else GENERAL) for t in terms]
    out, at = [], 0
    for a, b, name in sorted(spans):
        if a >= at:
            out += [text[at:a], name]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, keep: list[str], key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The columns ``keep``, ``key`` and the text among them, with the text masked; a null text
    stays null."""
    spans = find(docs, key, text).where("base != '' or terms is not null").dropDuplicates(
        ["k", "th"]).select("k", "th", "base", "terms")
    rows = docs.select(*keep).withColumn("_th", F.xxhash64(F.col(text)))

    @F.udf("string", useArrow=True)
    def masked(t, base, terms):
        return t if t is None or base is None else mask(t, base, terms or [])

    out = rows.join(spans, F.col(key).eqNullSafe(F.col("k")) & (F.col("_th") == F.col("th")),
                    "left")
    # Only texts with a span go to Python.
    sent = F.when(F.col("base").isNotNull(), F.col(text))
    return out.withColumn(text, F.coalesce(masked(sent, "base", "terms"), F.col(text))).select(
        *keep)
