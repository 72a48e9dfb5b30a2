"""Embedding near-duplicates by a subspace pigeonhole join, exact at any threshold.

Vectors of equal label and length are scaled to length one and rotated (a seeded random rotation spreads every
difference evenly), then split into ``blocks`` of neighbouring components. A cosine of at least ``threshold`` is a
squared distance of at most ``2 - 2 threshold``; each block gets the share of that budget that it has of the
components, so a linked pair is within budget in at least one block. Each block is range-joined under its budget and
what it finds is verified by the cosine of the vectors as given, in double precision.

A pair can be within budget in several blocks. It belongs to the first of them, and as both vectors travel whole, the
task that meets it sees that by itself: links are counted where they are met, no list of pairs is made or shuffled,
and the union over blocks needs no distinct. Block distances are taken from rotated components rounded once, in the
table that all tasks read, so every task decides alike.

The range join of a block: a label of few vectors is one cell. In one of many, cells are boxes over the block's first
components, as many of them as its count asks for, each side twice the block's radius; a vector goes to its own cell
and to those that begin within a radius above it, and a pair counts in the one cell that both reach first. A cell's
rows are dealt into chunks of bounded bytes, each pair of chunks to its own group, so neither a hot label nor a
crowd of near copies is one task. In a group, rows are halved by medians into leaves; leaves whose boxes are farther
apart than the radius are passed over, the rest are compared.

A group of n near copies has n (n - 1) / 2 links, each of which is met once and counted; what leaves a task are counts
by vector and a spanning forest. Exact copies are one class from the start (by label and components), whatever their
number, and their links are counted by arithmetic.

Vectors that are null, empty, all zero, or hold a null, NaN or infinite component link with nothing, and so do those
of null label; each is a component of its own. Vectors of different lengths aren't compared. A null ``vec_id`` is kept,
and is a component's id only if no other id is in it; ``kept`` compares null-safely, so rows of one repeated id are
kept or dropped together. An empty table gives no rows. Only ``vec_id``, ``embedding`` and ``label`` are read, whatever
other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.llm.common import HOT, join_hot, table, written
from warrantlake.llm.simhash import components

THRESHOLD, BLOCKS = 0.98, 8
#: Vectors of a label from which on its blocks are cut into cells, and the components that cells may use.
CELL, AXES = 50_000, 4
#: Bytes of a chunk of vectors, of which a task holds two, and rows of a leaf.
CHUNK_BYTES, LEAF = 16 << 20, 256
#: Cells of more than one chunk that are broadcast; were there more, they are joined.
FEW_CELLS = 500_000
#: What rounding the rotated components to single precision can add to a squared distance.
SLACK = 4e-6


def rotation(dimensions: int, seed: int = 3) -> np.ndarray:
    """A random rotation, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def block_edges(dimensions: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, dimensions, min(blocks, dimensions) + 1).astype(int)


def _rows(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec, k): ``k`` is a 128-bit hash of label and components, null with ``vec`` where a row can't link."""
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # no negative noughts
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    known = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull() & usable, x.cast(vectors.schema["embedding"].dataType)).alias("vec"))
    both = F.struct(F.xxhash64("label", "vec").alias("a"), F.xxhash64(F.reverse("vec"), "label").alias("b"))
    return known.withColumn("k", F.when(F.col("vec").isNotNull(), both))


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), np.ascontiguousarray(rows).ravel())


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which is exact, so that no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(cid, k, label, vec, n, first_id): one row for each label and vector that can link."""
    classes = keyed(vectors).where("vec is not null").groupBy("k", "label", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    return classes.select(F.monotonically_increasing_id().alias("cid"), "*")


def placed(classes: DataFrame, blocks: int, threshold: float, axes: DataFrame, slim: bool = False) -> DataFrame:
    """A row for each vector, block and cell: ``own``, the vector's own cell; ``cell``, this one; ``turned``, rotated.

    With ``slim`` the cells alone, in order to count them.
    """
    whole = ["cid", "label", "vec", "n", "turned", "d", "block", "own", "cell"]
    names = ["label", "d", "block", "cell"] if slim else whole

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                x = _scaled(_rows(part.column("vec")))
                if d not in turns:
                    turns[d] = rotation(d)
                turned = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) @ turns[d]).astype(np.float32)
                edges, many = block_edges(d, blocks), part.column("axes").to_numpy()
                for b, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    radius = np.sqrt((2 - 2 * threshold) * (high - low) / d + SLACK)
                    side, used = 2.01 * radius, min(AXES, high - low)
                    y = np.where(np.arange(used) < many[:, None], turned[:, low : low + used].astype(np.float64), 0.0)
                    own, upto = np.floor(y / side).astype(np.int32), np.floor((y + radius) / side).astype(np.int32)
                    upto = np.where(np.arange(used) < many[:, None], upto, own)
                    for corner in range(1 << used):
                        up = (corner >> np.arange(used)) & 1
                        at = np.flatnonzero((upto > own)[:, up == 1].all(axis=1))
                        if len(at):
                            kept = {c: part.column(c).take(pa.array(at)) for c in ("cid", "label", "vec", "n") if c in names}
                            kept |= {"turned": _lists(turned[at]), "d": pa.array(np.full(len(at), d, np.int32)), "block": pa.array(np.full(len(at), b, np.int32)), "own": _lists(own[at]), "cell": _lists(own[at] + up.astype(np.int32))}
                            yield pa.RecordBatch.from_arrays([kept[c] for c in names], names)

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("cid", "label", "vec", "n")} | {"turned": "array<float>", "d": "int", "block": "int", "own": "array<int>", "cell": "array<int>"}
    known = classes.select("cid", "label", "vec", "n", F.size("vec").alias("d")).join(F.broadcast(axes), ["label", "d"], "left")
    known = known.select("cid", "label", "vec", "n", F.coalesce("axes", F.lit(0)).alias("axes"))
    return known.mapInArrow(cells, ", ".join(f"{c} {kinds[c]}" for c in names))


def axes_of(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """(label, d, axes): labels of more than ``cell`` vectors, or than a ten-thousandth of all, so that few are many."""
    counts = classes.groupBy("label", F.size("vec").alias("d")).agg(F.count("*").alias("size"))
    most = max(cell, (classes.count() + 9_999) // 10_000)
    return counts.where(F.col("size") > most).select("label", "d", F.least(F.lit(AXES), F.ceil(F.log2(F.col("size") / most))).cast("int").alias("axes"))


def _leaves(y: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers in leaves of at most ``leaf`` rows, halved at the median of the widest component."""
    out, open_ = [], [np.arange(len(y))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = y[rows]
        order = np.argpartition(part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))], len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def range_pairs(y: np.ndarray, budget: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within a squared distance of about ``budget``: every pair below it, each once."""
    leaves = _leaves(y, leaf)
    low, high = np.array([y[r].min(axis=0) for r in leaves]), np.array([y[r].max(axis=0) for r in leaves])
    squares = [(y[r] ** 2).sum(axis=1) for r in leaves]
    for i, rows in enumerate(leaves):
        gap = np.maximum(np.maximum(low[i:] - high[i], low[i] - high[i:]), 0)
        for j in (i + np.flatnonzero((gap**2).sum(axis=1) <= budget + 1e-9)).tolist():
            d = squares[i][:, None] + squares[j][None, :] - 2 * (y[rows] @ y[leaves[j]].T)
            a, b = np.nonzero(d <= budget + 1e-9)
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield rows[a], leaves[j][b]


def spanning(a: np.ndarray, b: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b those that join two trees; ``roots`` (row to root of its tree) is brought up to date."""
    low, high = [], []
    while len(open_ := np.flatnonzero(roots[a] != roots[b])):
        a, b = a[open_], b[open_]
        # Each tree hooks on to one of a smaller root, so no circle comes about.
        tree, at = np.unique(np.maximum(roots[a], roots[b]), return_index=True)
        roots[tree] = np.minimum(roots[a[at]], roots[b[at]])
        low.append(a[at])
        high.append(b[at])
        while (roots != roots[roots]).any():
            roots[:] = roots[roots]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *low]), np.concatenate([none, *high])


class _Group:
    """The rows of one cell and pair of chunks."""

    def __init__(self, batch: pa.RecordBatch, blocks: int, threshold: float):
        self.cid, self.n, self.chunk = (batch.column(c).to_numpy() for c in ("cid", "n", "chunk"))
        self.own, self.cell = _rows(batch.column("own"), np.int64), _rows(batch.column("cell"), np.int64)
        self.block, self.low, self.high = (int(batch.column(c)[0].as_py()) for c in ("block", "low", "high"))
        self.vec = _scaled(_rows(batch.column("vec")))
        self.norm = np.sqrt((self.vec**2).sum(axis=1))
        self.turned = np.ascontiguousarray(_rows(batch.column("turned"), np.float32).T)
        self.edges, self.threshold = block_edges(len(self.turned), blocks), threshold

    def budget(self, block: int) -> float:
        return (2 - 2 * self.threshold) * (self.edges[block + 1] - self.edges[block]) / self.edges[-1] + SLACK

    def within(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Whether pairs are within the budget of a block: sums in a fixed order, alike in every task."""
        total = np.zeros(len(a))
        for component in self.turned[self.edges[block] : self.edges[block + 1]]:
            total += (component[a].astype(np.float64) - component[b]) ** 2
        return total <= self.budget(block)

    def counted_here(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates those of this cell, pair of chunks and block that are links."""
        here = (np.maximum(self.own[a], self.own[b]) == self.cell[a]).all(axis=1)
        here &= (np.minimum(self.chunk[a], self.chunk[b]) == self.low) & (np.maximum(self.chunk[a], self.chunk[b]) == self.high)
        a, b = a[here], b[here]
        for block in range(self.block + 1):
            mine = self.within(a, b, block) == (block == self.block)
            a, b = a[mine], b[mine]
        cosine = np.einsum("nd,nd->n", self.vec[a], self.vec[b]) / (self.norm[a] * self.norm[b])
        return a[cosine >= self.threshold], b[cosine >= self.threshold]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row, copies linked here; and the links of a spanning forest."""
        counts, roots, low, high = np.zeros(len(self.cid), np.int64), np.arange(len(self.cid)), [], []
        y = np.ascontiguousarray(self.turned[self.edges[self.block] : self.edges[self.block + 1]].T).astype(np.float64)
        for a, b in range_pairs(y, self.budget(self.block)):
            a, b = self.counted_here(a, b)
            np.add.at(counts, a, self.n[b])
            np.add.at(counts, b, self.n[a])
            for side, new in zip((low, high), spanning(a, b, roots), strict=True):
                side.append(new)
        none = np.empty(0, np.int64)
        return counts, np.concatenate([none, *low]), np.concatenate([none, *high])


def links(classes: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, cell: int = CELL, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(u, v, links): with ``u = v`` the copies linked to class ``u``, as partial counts; else a link of a spanning forest."""
    axes = written(axes_of(classes, cell), "axes")
    row_bytes = 4 * F.col("d") + F.col("d") * (4 if classes.schema["vec"].dataType.elementType.typeName() == "float" else 8) + 64
    sizes = placed(classes, blocks, threshold, axes, slim=True).groupBy("label", "d", "block", "cell").agg((F.count("*") * F.first(row_bytes)).alias("bytes"))
    split = written(sizes.select("label", "d", "block", "cell", F.ceil(F.col("bytes") / chunk_bytes).cast("int").alias("chunks")).where("chunks > 1"), "split")
    rows = placed(classes, blocks, threshold, axes).join(F.broadcast(split) if split.count() <= FEW_CELLS else split, ["label", "d", "block", "cell"], "left")
    dealt = rows.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    group = ["label", "d", "block", "cell", "low", "high"]
    dealt = dealt.select("cid", "vec", "n", "turned", "block", "own", "cell", "chunk", "low", "high", F.xxhash64(*group).alias("grp"), F.xxhash64(F.lit(1), *group).alias("grp2"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches):
            if whole.num_rows < 2:
                continue
            found = _Group(whole, blocks, threshold)
            counts, a, b = found.links()
            met = np.flatnonzero(counts)
            u, v = np.concatenate((found.cid[met], found.cid[a])), np.concatenate((found.cid[met], found.cid[b]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate((counts[met], np.zeros(len(a), np.int64))))], ["u", "v", "links"])

    return dealt.repartition("grp", "grp2").sortWithinPartitions("grp", "grp2").mapInArrow(compared, "u long, v long, links long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``grp`` and ``grp2``, as one batch for each group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        one, two = batch.column("grp").to_numpy(), batch.column("grp2").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)]).tolist()
        for at, upto in zip(starts, [*starts[1:], len(one)], strict=True):
            if held and (one[at], two[at]) != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(at, upto - at))
            last = (one[at], two[at])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, cell: int = CELL, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    classes = written(distinct_vectors(vectors), "classes")
    found = written(links(classes, threshold, blocks, cell, chunk_bytes), "links")
    linked = found.where("u = v").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("others"))
    roots = written(components(found.where("u <> v").select("u", "v")), "roots").select(F.col("node").alias("cid"), "root")
    rooted = classes.select("cid", "k", "n", "first_id").join(linked, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = written(rooted.join(least, "root").select("k", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "ids")
    told = join_hot(keyed(vectors).select("vec_id", "k"), ids.select("k", "n_links", "component_id", F.lit(True).alias("met")), "k", ids.select("k", "n"), "left", hot)
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("vec_id"))
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
