"""Copies of the smallest tables that are empty, or hold null rows, repeats and columns of clashing names."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq

CLASHING = "change reason lang text value item basket n label stated bin block key day ref_key rank id_ keep_id total lift sum name query code".split()


def write(sf_dir: str, out: str, kind: str) -> str:
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        t = pq.read_table(f)
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            nulls = pa.table({c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names}, schema=t.schema)
            t = pa.concat_tables([t, nulls])
            for c in CLASHING:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * t.num_rows))
        pq.write_table(t, f"{out}/{os.path.basename(f)}")
    return out
