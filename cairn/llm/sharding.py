"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id, hash of the row's number): equal texts lie side by side, equal rows too. The splitters between shards are
found by counting, not by sorting: each round counts exactly the bytes below a grid of candidate boundaries, over all
partitions, and the next grid lies inside the cells that hold a splitter not yet within tolerance. A cell is a prefix of
the key's bits, so a round reads only the rows of open cells, and what comes back is at most n_shards * 2**STEP_BITS
sums, whatever the input. When a cell is a single text hash and still too heavy (a hot group of copies), its rounds go on
over the id hash, which splits the group, and where rows share the id too (or have none), over the row's number. Then one exchange
moves each row to its shard, and inside it to its piece: some first bits of the text's hash, and of a hash of the two others, so that a
piece has about PIECE_ROWS rows and neither a shard nor a group of copies nor one of equal rows is one task's work. Rows are numbered inside pieces,
and a piece's first number is the count of the rows before it, so slots have no gaps.

Law `bytes`: each splitter lies within TOLERANCE of its share, or as near as whole rows allow. A group of equal texts is
split only if keeping it whole would leave that tolerance. With weight=None the same search balances row counts.

Null texts weigh the fixed bytes of a row and count as empty; null ids hash like any value. Rows equal in text and id are copies like others: which
of them lies where is arbitrary (the row's number is Spark's, fixed by a checkpoint), how many is not. An empty table gives an empty result. `shard_documents` reads only doc_id and text, whatever
other columns there are; in `exchange` further columns come along, unless they bear the names _high, _low, _copy, _size, _a, _b,
_first, shard or slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import stored

N_SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 0.002
STEP_BITS = 8
FIRST_BITS = 12
PIECE_ROWS = 1 << 17
#: Of the bits that name a piece, at most so many are taken from id and number.
ID_BITS = 6
PARTS = ("_high", "_low", "_copy")
_BITS = 62
KEY_BITS = _BITS * len(PARTS)


def _digits(depth: int, bits: int) -> Column:
    """The `bits` bits that follow the first `depth` ones of the key; a digit never straddles its parts."""
    return F.shiftright(PARTS[depth // _BITS], _BITS - depth % _BITS - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _prefix(part: int, depth: int) -> Column:
    """What the first `depth` bits of the key hold of a part; 0 if nothing."""
    bits = min(_BITS, max(0, depth - part * _BITS))
    return F.shiftright(PARTS[part], _BITS - bits) if bits else F.lit(0).cast("long")


def _steps() -> list[tuple[int, int]]:
    """(depth, bits) of each round."""
    out, depth = [], 0
    while depth < KEY_BITS:
        bits = FIRST_BITS if depth == 0 else STEP_BITS
        bits = min(bits, _BITS - depth % _BITS)
        out.append((depth, bits))
        depth += bits
    return out


def keyed(documents: DataFrame) -> DataFrame:
    """documents with the three parts of its sort key, 62 bits each, and the size of each row."""
    part = lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)
    return documents.withColumn("_copy", F.monotonically_increasing_id()).withColumns({"_high": part(F.col("text")), "_low": part(F.col("doc_id")), "_copy": part(F.col("_copy")), "_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES})


def splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """The n_shards - 1 boundaries (high, low, copy) of keys (_high, _low, _copy, _size): a row belongs to the shard numbered by how many boundaries are not above its key."""
    total = None
    found: dict[int, int] = {}
    #: Open cell (key prefix) -> (bytes below it, shards whose splitter it holds).
    cells: dict[int, tuple[int, list[int]]] = {0: (0, list(range(1, n_shards)))}
    for depth, bits in _steps():
        # Rows of open cells: by each part of the key that their prefixes reach. Few rows besides pass where cells share parts.
        rows = keys
        for part in range(-(-depth // _BITS)):
            seen = min(depth, (part + 1) * _BITS)
            rows = rows.filter(_prefix(part, depth).isin(list({(c >> (depth - seen)) & ((1 << (seen - part * _BITS)) - 1) for c in cells})))
        names = [f"c{i}" for i in range(len(PARTS))]
        sums = rows.groupBy(*(_prefix(i, depth).alias(c) for i, c in enumerate(names)), _digits(depth, bits).alias("digit")).agg(F.sum("_size").alias("size")).collect()
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in sums:
            cell = 0
            for i, c in enumerate(names):
                cell = (cell << min(_BITS, max(0, depth - i * _BITS))) | r[c]
            counts.setdefault(cell, []).append((r["digit"], r["size"]))
        if total is None:
            total = sum(size for _, size in counts.get(0, []))
            if not total:
                return []
        slack = tolerance * total / n_shards
        following: dict[int, tuple[int, list[int]]] = {}
        for cell, (below, shards) in cells.items():
            grid = sorted(counts.get(cell, []))
            edges, at = [], below
            for digit, size in grid:
                edges.append((digit, at, at + size))
                at += size
            for shard in shards:
                want = total * shard / n_shards
                digit, low, high = next((e for e in edges if e[2] >= want), edges[-1])
                here = (cell << bits) | digit
                left, right = want - low, high - want
                if min(left, right) <= slack or depth + bits == KEY_BITS:
                    found[shard] = (here if left <= right else here + 1) << (KEY_BITS - depth - bits)
                else:
                    following.setdefault(here, (low, []))[1].append(shard)
        cells = following
        if not cells:
            break
    mask = (1 << _BITS) - 1
    return [(found[s] >> (2 * _BITS), (found[s] >> _BITS) & mask, found[s] & mask) for s in sorted(found)]


def shard_of(bounds: list[tuple[int, int, int]]) -> Column:
    """Number of boundaries that are not above the key: a binary tree of comparisons, as deep as the logarithm of their number."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        a, b, c = bounds[mid]
        x, y, z = (F.col(part) for part in PARTS)
        reached = (x > a) | ((x == a) & ((y > b) | ((y == b) & (z >= c))))
        return F.when(reached, tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(bounds)).cast("int")


def exchange(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """keys (from `keyed`, cheap to read again) with shard and slot, moved once."""
    bounds = splitters(keys, n_shards, tolerance)
    bits = max(0, (keys.count() // (n_shards * piece_rows)).bit_length())
    id_bits = min(ID_BITS, bits)
    cell = {"_a": F.shiftright("_high", _BITS - bits), "_b": F.pmod(F.xxhash64("_low", "_copy"), F.lit(1 << id_bits))}
    piece = ["shard", "_a", "_b"]
    placed = keys.withColumn("shard", shard_of(bounds)).withColumns(cell)
    # One row for each piece: how many rows of its shard lie in pieces before it.
    before = Window.partitionBy("shard").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(*piece).agg(F.count("*").alias("_n")).select(*piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy(*PARTS)).cast("long") - 1
    return placed.withColumn("slot", inside).join(first, piece).withColumn("slot", F.col("_first") + F.col("slot")).drop("_a", "_b", "_first")


def shard_documents(documents: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of documents (doc_id, text), by law `bytes`."""
    slim = keyed(documents.select("doc_id", "text")).select("doc_id", *PARTS, "_size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = exchange(stored(slim), n_shards, tolerance)
    return placed.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
