"""K-d tree sharding by bytes, in DataFrame functions only.

A row's place in each metadata dimension is a number from 0 to 1 that rises with the column's value:
the share of rows with lesser values, however many values there are and however far apart. Rows with equal values, copies of one row too, are spread over their value's
stretch by a hash of the row and its place in the input, so a value or a row that holds a third of
the table is cut like any other.

A node is split across its widest dimension (the largest distance between its extreme places) at the
weighted median. All nodes of a level are done together: one pass gives every node's histogram in
each dimension, and the bin with the crossing is refined until it holds one row or less than CLOSE
of its node's bytes. Nodes get shares of the shards; a leaf is one shard. What goes to the driver is
a histogram a node and dimension; a node's number is an expression over the places, so the rows are
written once.

Law: bytes. Each split adds at most a text's size or CLOSE of its node to the difference of sizes.

Defined results: a null text has no bytes (its row counts EXTRA); null metadata (and numbers that
aren't finite) sort first; repeated rows are placed each on its own; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize

EXTRA, BINS = 16, 256
#: A crossing is refined down to this share of its node's bytes.
CLOSE = 1e-4
DIMENSIONS = ("source", "lang", "doc_id")
#: Rows in one numbering group of a shard, in expectation, and the least number of groups.
SLOT_ROWS, SLOT_GROUPS = 100_000, 16

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass
class _Node:
    """A node's first shard, its shards, and the stretch of places it covers in each dimension."""

    first: int
    shards: int
    bounds: list[tuple[float, float]]


class _Tree:
    """All splits so far, by place: the dimension, the cut and the places of both sides; a leaf leads to itself."""

    def __init__(self) -> None:
        self.dim, self.cut, self.sides, self.depth = [0], [0.0], [(0, 0)], [0]

    def split(self, place: int, dim: int, cut: float) -> tuple[int, int]:
        below = len(self.dim)
        self.dim[place], self.cut[place], self.sides[place] = dim, cut, (below, below + 1)
        for k in (below, below + 1):
            self.dim.append(0)
            self.cut.append(0.0)
            self.sides.append((k, k))
            self.depth.append(self.depth[place] + 1)
        return below, below + 1

    def leaf(self, n_dims: int) -> Column:
        """The place of the leaf that a row's p_0, p_1, ... lie in: a walk, so the expression doesn't grow with the tree."""
        places = F.array(*[f"p_{d}" for d in range(n_dims)])

        def step(at: Column, _: Column) -> Column:
            return F.when(F.element_at(places, _pick(self.dim, at) + 1) >= _pick(self.cut, at), _pick([r for _, r in self.sides], at)).otherwise(_pick([x for x, _ in self.sides], at))

        return F.aggregate(F.array(*[F.lit(0)] * max(self.depth)), F.lit(0), step) if max(self.depth) else F.lit(0)


def _unit(*parts: Column | str) -> Column:
    """A number from 0 up to 1 by hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _number(x: Column, kind: str) -> Column:
    """A number as a value that sorts and joins by itself; null and what isn't finite are one value below all others."""
    x = F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x) if kind in ("float", "double") else x
    return F.struct(x.isNotNull().alias("known"), F.coalesce(x, F.lit(0).cast(kind)).alias("value"))


def _places(base: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(doc_id, size, text_crc32, tie, p_0, p_1, ...) of rows (doc_id, size, text_crc32, tie, d_0, d_1, ...)."""
    n = base.count()
    out = base
    for k in range(len(dimensions)):
        spread = _unit("doc_id", "text_crc32", "tie", F.lit(k))
        out = out.join(_shares(base, k), f"d_{k}", "left")
        out = out.withColumn(f"p_{k}", (F.col(f"before_{k}") + spread * F.col(f"rows_{k}")) / F.lit(float(max(1, n))))
    return out.select("doc_id", "size", "text_crc32", "tie", *[f"p_{k}" for k in range(len(dimensions))])


def _shares(base: DataFrame, k: int) -> DataFrame:
    """(d_k, before_k, rows_k): for each value the rows with lesser values and with it.

    Values are sorted over the cluster; only a count for each partition meets in one place.
    """
    counted = base.groupBy(f"d_{k}").agg(F.count("*").alias(f"rows_{k}")).repartitionByRange(f"d_{k}")
    values = materialize(counted.withColumn("part", F.spark_partition_id()), "values")
    parts = values.groupBy("part").agg(F.sum(f"rows_{k}").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum(f"rows_{k}").over(Window.partitionBy("part").orderBy(f"d_{k}")) - F.col(f"rows_{k}")
    return values.withColumn("inside", inside).join(F.broadcast(ahead), "part").select(f"d_{k}", (F.col("ahead") + F.col("inside")).alias(f"before_{k}"), f"rows_{k}")


def _pick(values: list, index: Column) -> Column:
    """The literal at a place (from 0)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _binned(rows: DataFrame, nodes: list[_Node], live: list[int], dims: dict[int, list[int]], bounds: dict[tuple[int, int], tuple[float, float]], n_dims: int) -> dict[tuple[int, int], list[tuple]]:
    """By (node, dimension), the bins (size, rows, least, most) of rows (node, size, p_0, ...) inside the bounds, in order."""
    lows = [[bounds[k, d][0] if k in dims and d in dims[k] else 2.0 for d in range(n_dims)] for k in range(len(nodes))]
    highs = [[bounds[k, d][1] if k in dims and d in dims[k] else -2.0 for d in range(n_dims)] for k in range(len(nodes))]
    each = rows.where(_pick([k in dims for k in range(len(nodes))], F.col("node")))
    each = each.select("node", "size", F.posexplode(F.array(*[f"p_{d}" for d in range(n_dims)])).alias("dim", "p"))
    at = F.col("node") * n_dims + F.col("dim")
    each = each.select("node", "dim", "size", "p", _pick([x for row in lows for x in row], at).alias("lo"), _pick([x for row in highs for x in row], at).alias("hi")).where("p >= lo and p < hi")
    bin_ = F.least(F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
    found: dict[tuple[int, int], list[tuple]] = {}
    for r in each.groupBy("node", "dim", bin_.alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most")).collect():
        found.setdefault((r.node, r.dim), []).append((r.bin, r["size"], r.n, r.least, r.most))
    return {k: [b[1:] for b in sorted(v)] for k, v in found.items()}


def _above(x: float) -> float:
    return math.nextafter(x, math.inf)


def _cuts(rows: DataFrame, nodes: list[_Node], n_dims: int) -> dict[int, tuple[int, float, list[tuple[float, float]]]]:
    """For each node with several shards: its widest dimension, the place below which its left shards' bytes lie, its rows' true bounds."""
    live = [k for k, n in enumerate(nodes) if n.shards > 1]
    dims = {k: list(range(n_dims)) for k in live}
    bounds = {(k, d): nodes[k].bounds[d] for k in live for d in range(n_dims)}
    found = _binned(rows, nodes, live, dims, bounds, n_dims)
    out, target, size, below = {}, {}, {}, {}
    for k in live:
        if (k, 0) not in found:
            out[k] = (0, 0.0, nodes[k].bounds)
            continue
        true = [(min(b[2] for b in found[k, d]), max(b[3] for b in found[k, d])) for d in range(n_dims)]
        d = max(range(n_dims), key=lambda d: (true[d][1] - true[d][0], -d))
        size[k] = sum(b[0] for b in found[k, d])
        target[k], below[k] = size[k] * (nodes[k].shards // 2) / nodes[k].shards, 0.0
        out[k] = (d, 0.0, [(lo, _above(hi)) for lo, hi in true])
    open_ = set(target)
    while open_:
        again: dict[int, list[int]] = {}
        for k in open_:
            d, _, true = out[k]
            for bytes_, n, least, most in found[k, d]:
                if below[k] + bytes_ < target[k]:
                    below[k] += bytes_
                    continue
                # Cut before the bin or after it, whichever is nearer, unless it is worth a closer look.
                nearer = target[k] - below[k] <= below[k] + bytes_ - target[k]
                out[k] = (d, least if nearer else _above(most), true)
                if n > 1 and least < most and bytes_ > CLOSE * size[k]:
                    again[k], bounds[k, d] = [d], (least, _above(most))
                break
            else:
                out[k] = (d, true[d][1], true)
        open_ = set(again)
        found = _binned(rows, nodes, live, again, bounds, n_dims) if again else {}
    return out


def assign(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for all docs (doc_id, text and the dimensions)."""
    n_dims, kinds = len(dimensions), dict(docs.dtypes)
    bytes_ = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    values = [_number(F.col(d), kinds[d]) if kinds[d] in _NUMBERS else F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dimensions]
    rows = docs.select("doc_id", *[v.alias(f"d_{k}") for k, v in enumerate(values)], (F.octet_length(bytes_) + EXTRA).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    # Written at once, as places in the input tell copies of a row apart.
    base = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "sizes")
    placed = materialize(_places(base, dimensions), "places")
    discard(base)
    tree, front = _Tree(), [(0, _Node(0, shards, [(0.0, 2.0)] * n_dims))]
    while any(n.shards > 1 for _, n in front):
        spot = {place: k for k, (place, _) in enumerate(front)}
        node = _pick([spot.get(k, -1) for k in range(len(tree.dim))], tree.leaf(n_dims))
        nodes = [n for _, n in front]
        cuts = _cuts(placed.withColumn("node", node), nodes, n_dims)
        after: list[tuple[int, _Node]] = []
        for k, (place, n) in enumerate(front):
            if n.shards == 1:
                after.append((place, n))
                continue
            d, cut, true = cuts[k]
            left = n.shards // 2
            below, above = tree.split(place, d, cut)
            after.append((below, _Node(n.first, left, [(lo, min(hi, cut)) if j == d else (lo, hi) for j, (lo, hi) in enumerate(true)])))
            after.append((above, _Node(n.first + left, n.shards - left, [(max(lo, cut), hi) if j == d else (lo, hi) for j, (lo, hi) in enumerate(true)])))
        front = after
    firsts = {place: n.first for place, n in front}
    shard = _pick([firsts.get(k, 0) for k in range(len(tree.dim))], tree.leaf(n_dims)).cast("int")
    out = placed.select("doc_id", "size", "text_crc32", "tie", shard.alias("shard"))
    return _slots(out, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Gapless numbers within each shard: within hash groups by a window, after the groups before them."""
    groups = max(SLOT_GROUPS, -(-rows.count() // (shards * SLOT_ROWS)))
    grouped = rows.withColumn("part", F.floor(_unit("doc_id", "text_crc32", "tie", F.lit(-1)) * groups).cast("int"))
    sizes = grouped.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "tie")
    return grouped.withColumn("nth", F.row_number().over(order) - 1).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("nth")).cast("long"))
