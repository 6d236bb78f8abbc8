"""SHA-256 of long ordered lists, one for each key, without gathering a list: rows are sorted by key and order (on disk where they must be) and stream
through one hash state. A digest over an order is sequential, so a key is one task's pass; its memory is a hash state however many rows it has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, name: str = "digest", separator: str = "\n", tail: str = "", distinct: bool = False) -> DataFrame:
    """keys, name (lowercase hex), n_<name> (pieces) and chars_<name> (characters that were hashed): the pieces of each key in the given order, joined by separator, then
    tail. Null and empty pieces go; a key of nothing else has the digest of the tail alone. distinct: of neighbours that are equal in the order one counts; with order [piece]
    that is the digest of the set. Of all rows together, if there are no keys (an empty table has no row then)."""
    by = [F.col(k) for k in keys] or [F.lit(0)]
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, *order) if keys else rows.repartition(1).sortWithinPartitions(*order)
    fields = [f for f in rows.schema.fields if f.name in keys]
    kept = sorted_rows.select(*keys, F.col(piece).cast("string").alias("_piece"))
    made = [name, f"n_{name}", f"chars_{name}"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` string", f"`{made[1]}` bigint", f"`{made[2]}` bigint"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, head, engine, n, chars, before = False, None, None, 0, 0, None

        def close() -> pa.RecordBatch:
            engine.update(tail.encode())
            ends = [pa.array([engine.hexdigest()]), pa.array([n], pa.int64()), pa.array([chars + len(tail)], pa.int64())]
            return pa.RecordBatch.from_arrays([*head, *ends], [*names, *made])

        current = None
        for batch in batches:
            columns = [batch.column(c) for c in names]
            values = list(zip(*(c.to_pylist() for c in columns), strict=True)) if names else [()] * batch.num_rows
            for i, (key, text) in enumerate(zip(values, batch.column("_piece").to_pylist(), strict=True)):
                if not open_ or key != current:
                    if open_:
                        yield close()
                    open_, current, engine, n, chars, before = True, key, hashlib.sha256(), 0, 0, None
                    head = [c.slice(i, 1) for c in columns]
                if not text or (distinct and text == before):
                    continue
                before = text
                part = separator + text if n else text
                engine.update(part.encode())
                n, chars = n + 1, chars + len(part)
        if open_:
            yield close()

    return kept.mapInArrow(run, schema)


def fingerprints(rows: DataFrame, key: str, url: str, pos: str) -> DataFrame:
    """key, ordered_fingerprint, set_fingerprint, n_urls and n_distinct of the URLs of each key: in the order of pos with repeats, and as a set."""
    ordered = streamed(rows, [key], [pos, url], url, "ordered_fingerprint").select(key, "ordered_fingerprint", F.col("n_ordered_fingerprint").alias("n_urls"))
    as_set = streamed(rows, [key], [url], url, "set_fingerprint", distinct=True).select(F.col(key).alias("_key"), "set_fingerprint", F.col("n_set_fingerprint").alias("n_distinct"))
    return ordered.join(as_set, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
