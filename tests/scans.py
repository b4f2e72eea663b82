"""How often a query reads a table: leaves of its own plan and of every table it writes."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql.readwriter import DataFrameWriter


def leaves(df, name: str) -> int:
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = 0
    for i in range(found.size()):
        leaf = found.apply(i)
        if leaf.getClass().getSimpleName().startswith("LogicalRelation"):
            n += f"/{name}.parquet" in leaf.relation().location().rootPaths().mkString(",")
    return n


@contextmanager
def counted(name: str):
    """Counts reads of ``name`` by everything written inside the block."""
    total = [0]
    kept = {m: getattr(DataFrameWriter, m) for m in ("parquet", "csv", "json", "text", "save")}

    def counting(method):
        def write(self, *args, **kwargs):
            total[0] += leaves(self._df, name)
            return kept[method](self, *args, **kwargs)
        return write

    for m in kept:
        setattr(DataFrameWriter, m, counting(m))
    try:
        yield total
    finally:
        for m, f in kept.items():
            setattr(DataFrameWriter, m, f)


def reads(query, spark, sf_dir: str, name: str) -> int:
    with counted(name) as total:
        df = query(spark, sf_dir)
    return total[0] + leaves(df, name)
