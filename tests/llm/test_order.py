from __future__ import annotations

import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import order


@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 1000, 4096, 70001])
def test_permutation_and_its_inverse(count):
    n = np.arange(count)
    slots = order.permute(n, count, 7)
    assert sorted(slots) == list(range(count))
    assert (order.restore(slots, count, 7) == n).all()
    if count > 1000:
        assert (order.permute(n, count, 8) != slots).mean() > .9
        assert abs(np.corrcoef(n, slots)[0, 1]) < .1


def rebuilt(folder, index, dtype, length, shard_bytes):
    count = max(r.slot for r in index) + 1
    slots = list(order.read(folder, count, dtype, length, 0, shard_bytes))
    assert len(slots) == count
    parts = defaultdict(list)
    for r in index:
        assert r.crc32 == zlib.crc32(slots[r.slot].tobytes())
        parts[r.doc_id].append((r.doc_offset, slots[r.slot][r.seq_offset:r.seq_offset + r.n_tokens]))
    return count, slots, {d: np.concatenate([x for _, x in sorted(p, key=lambda p: p[0])])
                          for d, p in parts.items()}


def test_shards_hold_every_text(docs, rows):
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/shards"
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3, "doc_id")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    once.write.parquet(path)
    table = docs.sparkSession.read.parquet(path)
    index = order.materialise(table, "text", folder, 5, "u1", 64, 0, 64 * 50).collect()
    count, slots, texts = rebuilt(folder, index, "u1", 64, 64 * 50)
    want = {r.doc_id: (r.text or "").encode() + b"\0" for r in table.collect()}
    assert {d: x.tobytes() for d, x in texts.items()} == want
    assert {(r.shard, r.byte_offset) for r in index} == {
        (s // 50, s % 50 * 64) for s in {r.slot for r in index}}
    # Resuming anywhere continues the same order.
    again = list(order.read(folder, count, "u1", 64, 137, 64 * 50))
    assert all((a == b).all() for a, b in zip(again, slots[137:])) and len(again) == count - 137


def test_token_ids_and_awkward_rows(docs, rows, empty):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/ids"
    ids = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.transform(
        F.split("text", ""), lambda c: F.ascii(c) % 60000)).alias("ids"))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    ids.write.parquet(path)
    table = docs.sparkSession.read.parquet(path)
    index = order.materialise(table, "ids", folder, 1, "<u2", 32, 7, 32 * 2 * 9).collect()
    n = table.selectExpr("sum(coalesce(size(ids), 0) + 1)").first()[0]
    if any(r.ids is None for r in table.collect()):
        n = sum(len(r.ids or []) + 1 for r in table.collect())
    assert sum(r.n_tokens for r in index) == n
    count, _, texts = rebuilt(folder, [r for r in index], "<u2", 32, 32 * 2 * 9)
    one = next(r for r in table.collect() if r.doc_id == 82)
    assert list(texts[82][:-1]) == one.ids and texts[82][-1] == 7
    assert order.byte_shards(empty).collect() == []
