"""Product codes of vectors: codebooks by exact rounds of assignment over metric trees.

Vectors become whole numbers and are cut into equal parts; each part position has its own codebook.
Rows are gathered into blocks, and for every part of a block an anchors hierarchy is built once:
the root's points are dealt to about sqrt(n) anchors, each new one the point furthest from its
anchor; anchors are merged two by two up to the root and split the same way further down. A ball
caches the sum and the count of its points. The trees are written to the shared folder.

An assignment walks down from the root with the entries that can still be the nearest of some point
of the ball. A ball inherits its parent's list and drops every entry that is further from all its
points than another one is. With one entry left the ball is wholly owned: its cached sum and count
go to that entry without looking at a point. Leaves compare their points with the list they got.
Balls are compared in floating point with a margin, points in whole numbers, so results equal a
comparison of every point with every entry, ties included.

What a round sends on is a sum and a count per entry and task; the driver sees the codebooks alone,
whose size is a parameter. Any cutting into blocks and tasks gives the same result.

Defined results: rows whose vector is null, empty or holds null or non-finite components are
dropped, as are rows whose vector has not the length of the first kept one, or a length that the
parts don't divide. The first rows by vec_id, then components, make the first codebook, null ids
aside; fewer rows make a smaller one. Repeated rows are coded each on their own and count each.
Extra columns are not read. An empty table gives an empty result. Components may be up to 2^23 in
absolute value, so that squared distances stay whole numbers of 64 bits; larger ones raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.llm.shared import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Components are multiples of one over this.
SCALE = 256
#: Rows of a block; its trees are held in memory.
BLOCK = 4096
#: Points of a ball that is not split further.
LEAF = 64
LARGEST = 1 << 23
#: Rows a label's total is repeated for, so that a label of very many rows is no hot key.
SALTS = 64
ARRAYS = ("order", "sums", "counts", "radius", "child", "start")


@dataclass
class Tree:
    """A metric tree over points. Balls are numbered; the root comes last, children before parents.

    A ball's points are ``order[start : start + counts]``. ``child`` is -1, -1 for a leaf.
    """

    order: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    start: np.ndarray


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - centre).sum(axis=1))


def _anchors(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Places of the points of each anchor: every point goes to its nearest anchor found so far.

    A new anchor is the point furthest from its own. Only points further from their anchor than
    half the way from there to the new one can change over, so only they are measured.
    """
    n = len(points)
    wanted = max(2, min(int(np.ceil(np.sqrt(n))), 2 * n // leaf))
    owner, pivots = np.zeros(n, np.intp), [0]
    far = _away(points, points[0])
    for new in range(1, wanted):
        pivot = int(far.argmax())
        if far[pivot] == 0:
            break
        half = _away(points[pivots], points[pivot]) / 2
        near = np.flatnonzero(far >= half[owner])
        way = _away(points[near], points[pivot])
        won = way < far[near]
        moved = near[won]
        owner[moved], far[moved] = new, way[won]
        pivots.append(pivot)
    by_owner = np.argsort(owner, kind="stable")
    return np.split(by_owner, np.searchsorted(owner[by_owner], np.arange(1, len(pivots))))


class _Builder:
    def __init__(self, points: np.ndarray, leaf: int):
        self.whole, self.points, self.leaf = points, points.astype(np.float64), leaf
        self.sums, self.counts, self.radius, self.child, self.own = [], [], [], [], []

    def _ball(self, total, count: int, radius: float, child: tuple, own) -> int:
        self.sums.append(total)
        self.counts.append(count)
        self.radius.append(radius)
        self.child.append(child)
        self.own.append(own)
        return len(self.counts) - 1

    def ball(self, places: np.ndarray) -> int:
        """The ball of the points at these places, with everything below it."""
        total = self.whole[places].sum(axis=0)
        radius = float(_away(self.points[places], total / len(places)).max())
        if len(places) <= self.leaf or radius == 0:
            return self._ball(total, len(places), radius, (-1, -1), places)
        groups = _anchors(self.points[places], self.leaf)
        if len(groups) < 2:
            return self._ball(total, len(places), radius, (-1, -1), places)
        return self.merged([self.ball(places[g]) for g in groups])

    def merged(self, balls: list[int]) -> int:
        """Balls joined two by two, always the pair that fits the smallest ball, up to one."""
        n = len(balls)
        ids = list(balls)
        sums = np.array([self.sums[b] for b in balls], np.float64)
        counts = np.array([self.counts[b] for b in balls], np.float64)
        radius = np.array([self.radius[b] for b in balls])
        alive = np.ones(n, bool)

        def joint(i: int) -> np.ndarray:
            """Radius of the ball around i and each other one."""
            both = counts + counts[i]
            centre = (sums + sums[i]) / both[:, None]
            own = _away(centre, sums[i] / counts[i]) + radius[i]
            r = np.maximum(own, _away(centre, sums / counts[:, None]) + radius)
            r[~alive] = np.inf
            r[i] = np.inf
            return r

        size = np.array([joint(i) for i in range(n)])
        for _ in range(n - 1):
            i, j = divmod(int(size.argmin()), n)
            r = size[i, j]
            a, b = ids[i], ids[j]
            ids[i] = self._ball(self.sums[a] + self.sums[b], self.counts[a] + self.counts[b], r, (a, b), None)
            sums[i], counts[i], radius[i] = sums[i] + sums[j], counts[i] + counts[j], r
            alive[j] = False
            size[j, :] = size[:, j] = np.inf
            size[i, :] = size[:, i] = joint(i)
        return ids[i] if n > 1 else ids[0]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over the rows of an integer matrix, at least one."""
    made = _Builder(points.astype(np.int64), leaf)
    root = made.ball(np.arange(len(points)))
    start = np.zeros(root + 1, np.int32)
    order = np.empty(len(points), np.int32)
    for b in range(root, -1, -1):
        left, right = made.child[b]
        if left < 0:
            order[start[b] : start[b] + made.counts[b]] = made.own[b]
        else:
            start[left], start[right] = start[b], start[b] + made.counts[left]
    return Tree(
        order,
        np.array(made.sums, np.int64),
        np.array(made.counts, np.int32),
        np.array(made.radius, np.float64),
        np.array(made.child, np.int32),
        start,
    )


def _members(tree: Tree, balls: np.ndarray) -> np.ndarray:
    """Places of the points of these balls, ball by ball."""
    n = tree.counts[balls]
    first = np.repeat(tree.start[balls] - (np.cumsum(n) - n), n)
    return tree.order[first + np.arange(n.sum())]


def nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """The nearest allowed entry of each point, of equal ones the first, without rounding.

    Products of numbers this small are whole in floating point, where a matrix product is fast.
    """
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 22:
        e = entries.astype(np.float64)
        way = np.square(e).sum(axis=1) - 2 * (points.astype(np.float64) @ e.T)
        if allowed is not None:
            way[~allowed] = np.inf
        return way.argmin(axis=1)
    out = np.empty(len(points), np.intp)
    for i, x in enumerate(points):
        left = np.flatnonzero(allowed[i]) if allowed is not None else np.arange(len(entries))
        out[i] = left[np.square(entries[left] - x).sum(axis=1).argmin()]
    return out


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of each point, and the sum and count of each entry's points."""
    k = len(entries)
    code = np.empty(len(points), np.intp)
    sums, counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
    floats = entries.astype(np.float64)
    balls = np.array([len(tree.counts) - 1])
    lists = np.ones((1, k), bool)
    while len(balls):
        centre = tree.sums[balls] / tree.counts[balls, None]
        way = np.sqrt(np.square(centre[:, None, :] - floats[None]).sum(axis=2))
        radius = tree.radius[balls][:, None]
        best = np.where(lists, way, np.inf).min(axis=1, keepdims=True)
        # The margin covers rounding, so no entry that ties for a point is dropped.
        lists = lists & (way - radius <= best + radius + 1e-6 + 1e-9 * (way + radius))
        owned = lists.sum(axis=1) == 1
        whole, owner = balls[owned], lists[owned].argmax(axis=1)
        code[_members(tree, whole)] = np.repeat(owner, tree.counts[whole])
        np.add.at(sums, owner, tree.sums[whole])
        np.add.at(counts, owner, tree.counts[whole])
        leaf = ~owned & (tree.child[balls, 0] < 0)
        mine = _members(tree, balls[leaf])
        x = points[mine]
        e = nearest(x, entries, np.repeat(lists[leaf], tree.counts[balls[leaf]], axis=0))
        code[mine] = e
        np.add.at(sums, e, x)
        counts += np.bincount(e, minlength=k)
        down = ~owned & ~leaf
        balls = tree.child[balls[down]].ravel()
        lists = np.repeat(lists[down], 2, axis=0)
    return code, sums, counts


def _packed(tree: Tree) -> list[bytes]:
    return [getattr(tree, a).tobytes() for a in ARRAYS]


def _unpacked(parts: list[bytes], width: int) -> Tree:
    types = (np.int32, np.int64, np.int32, np.float64, np.int32, np.int32)
    order, sums, counts, radius, child, start = (
        np.frombuffer(b, t) for b, t in zip(parts, types, strict=True)
    )
    return Tree(order, sums.reshape(-1, width), counts, radius, child.reshape(-1, 2), start)


def _numbers(vectors: pa.Array, length: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    numbers = np.floor(flat * SCALE)
    if len(numbers) and np.abs(numbers).max() > LARGEST * SCALE:
        raise ValueError(f"a vector has a component beyond {LARGEST}")
    return numbers.astype(np.int64).reshape(-1, length)


def _blocks(length: int, parts: int, rows: int, schema: pa.Schema):
    """Rows (vec_id, label, vector) in blocks of at most ``rows`` with the trees of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while len(batch):
                head = batch.slice(0, rows - size)
                batch = batch.slice(len(head))
                held.append(head)
                size += len(head)
                if size == rows:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, vectors = (table.column(i).combine_chunks() for i in range(3))
        numbers = _numbers(vectors, length)
        cut = [np.ascontiguousarray(p) for p in np.split(numbers, parts, axis=1)]
        whole = pa.array([0, len(numbers)], pa.int32())
        columns = [
            pa.ListArray.from_arrays(whole, ids),
            pa.ListArray.from_arrays(whole, labels),
            pa.array([[p.astype(np.int32).tobytes() for p in cut]], pa.list_(pa.binary())),
            pa.array([[_packed(build(p)) for p in cut]], pa.list_(pa.list_(pa.binary()))),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _part(batch: pa.RecordBatch, row: int, p: int, width: int) -> tuple[Tree, np.ndarray]:
    points = np.frombuffer(batch["c_points"][row][p].as_py(), np.int32).reshape(-1, width)
    return _unpacked(batch["c_trees"][row][p].as_py(), width), points.astype(np.int64)


def _summed(books: np.ndarray):
    """Per task: part, entry, count and component sums of the points nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for p in range(parts):
                    _, s, c = assign(*_part(batch, row, p, width), books[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        columns = [p.astype(np.int32), e.astype(np.int32), counts[p, e], *sums[p, e].T]
        names = ["c_part", "c_entry", "c_count", *(f"c_sum{i}" for i in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return run


def _coded(books: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            for row in range(len(batch)):
                ids, labels = batch["c_ids"][row].values, batch["c_labels"][row].values
                codes, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p in range(parts):
                    tree, points = _part(batch, row, p, width)
                    codes[:, p], _, _ = assign(tree, points, books[p])
                    error += np.square(points - books[p][codes[:, p]]).sum(axis=1)
                text = codes.tobytes().hex()
                hexed = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                columns = [ids, labels, pa.array(hexed, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _finite(vector: str) -> Column:
    return F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )


def kept(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and vector of the rows whose vector is whole."""
    rows = df.select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").alias("vector"),
    )
    return rows.where((F.size("vector") > 0) & _finite("vector"))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The first codebooks, part by entry by component: at most ``entries`` rows reach the driver."""
    lead = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(entries)
    vectors = [r.vector for r in lead.collect()]
    if not vectors or len(vectors[0]) % parts:
        return None
    length = len(vectors[0])
    if any(len(v) != length for v in vectors):
        return first_books(rows.where(F.size("vector") == length), parts, entries)
    numbers = _numbers(pa.array(vectors, pa.list_(pa.float64())), length)
    return numbers.reshape(len(vectors), parts, -1).transpose(1, 0, 2).copy()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every kept row, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is two hex digits: at most 256 entries")
    rows = kept(df, vec_id, vector, label)
    ids, labels = rows.schema["vec_id"].dataType, rows.schema["label"].dataType
    out = T.StructType([T.StructField("vec_id", ids), T.StructField("label", labels)])
    out = out.add("code", T.StringType()).add("error", T.LongType())
    books = first_books(rows, parts, entries)
    if books is None:
        return df.sparkSession.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    length, width = books.shape[0] * books.shape[2], books.shape[2]
    binary = T.ArrayType(T.BinaryType())
    form = T.StructType([T.StructField("c_ids", T.ArrayType(ids))])
    form = form.add("c_labels", T.ArrayType(labels)).add("c_points", binary)
    form = form.add("c_trees", T.ArrayType(binary))
    arrow = pa.schema(
        [
            ("c_ids", pa.list_(_arrow(ids))),
            ("c_labels", pa.list_(_arrow(labels))),
            ("c_points", pa.list_(pa.binary())),
            ("c_trees", pa.list_(pa.list_(pa.binary()))),
        ]
    )
    same = rows.where(F.size("vector") == length)
    trees = stored(same.mapInArrow(_blocks(length, parts, block, arrow), form), "trees")
    summed = "c_part int, c_entry int, c_count long, " + ", ".join(f"c_sum{i} long" for i in range(width))
    names = [f"c_sum{i}" for i in range(width)]
    for _ in range(rounds):
        found = trees.select("c_points", "c_trees").mapInArrow(_summed(books), summed)
        means = found.groupBy("c_part", "c_entry").agg(
            F.sum("c_count").alias("c_count"), *(F.sum(n).alias(n) for n in names)
        )
        books = books.copy()
        for r in means.collect():  # at most parts x entries rows
            books[r.c_part, r.c_entry] = [r[n] // r.c_count for n in names]
    result = pa.schema(
        [("vec_id", _arrow(ids)), ("label", _arrow(labels)), ("code", pa.string()), ("error", pa.int64())]
    )
    return trees.mapInArrow(_coded(books, result), out), books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with the error summed over the rows of equal label, nulls together.

    Codes are written once. Totals are made with map-side combine and go back to the rows by label and salt, so that the
    rows of one label are spread over tasks. Spark broadcasts the totals if they are small.
    """
    coded = stored(coded, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    totals = totals.select(F.col("label").alias("c_label"), "label_error", salts.alias("c_salt"))
    rows = coded.withColumn("c_row_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    on = F.col("label").eqNullSafe(F.col("c_label")) & (F.col("c_row_salt") == F.col("c_salt"))
    return rows.join(totals, on).drop("c_label", "c_salt", "c_row_salt")
