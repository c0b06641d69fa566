"""Near-duplicate vectors by NN-descent.

A neighbour list per vector is refined by joins of neighbours with neighbours: in each round, the vectors that meet in
somebody's list, or that have somebody in theirs, are compared, and each keeps the nearest it has seen. The first lists come from several
sorted orders of sign patterns. A list full of near copies is saturated and may hide more: vectors that are linked form
a group, and each vector has a second list, of the nearest outside its group, which doubles in each round that finds the first
one saturated. The audit holds links known to exist: those of a sample of vectors that are compared with all others, and
partners planted at the threshold beside others, so that tables without a link are audited too. Rounds go on until these links
are in and nothing new comes; where they bring in nothing new too early, all lists double and more orders are added.

Lists lead to groups, and within a group every pair is compared in blocks in double precision: this is where saturated lists
end up complete, whatever their length. Blocks give counts and a spanning forest, never their pairs.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import components, drawn, usable
from quillrank.operators.placement import top_k
from quillrank.session import settled

LOG = logging.getLogger(__name__)
THRESHOLD = 0.98
NEIGHBOURS = 8
#: At least so many orders; more where labels have many rows, so that at most a MISS of lone pairs stands apart in all.
ORDERS, MISS = 8, 0.001
SIGNS = 60
WINDOW = 2
#: Vectors of the sample, links that the audit takes of each, and planted partners.
AUDIT_VECTORS, AUDIT_LINKS, PLANTED = 256, 64, 1024
RECALL = 0.995
#: Lists hold vectors in half precision; a pair that may reach the threshold is kept, and compared exactly later.
SLACK = 0.004
MEET = 48
BLOCK, LABEL_BLOCK = 256, 1024


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype).reshape(len(column), -1)


def _halves(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float16) for x in column.to_pylist()]).astype(np.float32)


_EDGES = ["u", "v", "sim"]


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=_EDGES)


def orders_for(rows: int, threshold: float) -> int:
    """Orders in which a pair at the threshold, among so many rows of a label, comes together but for a MISS.

    Neighbours in an order share about log2(rows / WINDOW) signs; a pair shares each with one chance.
    """
    same = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    together = same ** np.log2(max(rows / WINDOW, 2))
    return max(ORDERS, int(np.ceil(np.log(MISS) / np.log1p(-min(together, 1 - 1e-9)))))


def _first_lists(reps: DataFrame, dim: int, orders: int, seed: int = 11) -> DataFrame:
    """(u, v, sim) of vectors that stand next to each other in one of the sorted orders."""
    planes = np.random.default_rng(seed).normal(size=(orders, dim, SIGNS)).astype(np.float32)
    powers = (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _halves(batch.column(2))
                for t in range(orders):
                    keys = ((matrix @ planes[t]) > 0) @ powers
                    columns = [pa.array(np.full(batch.num_rows, t, np.int32)), batch.column(1), pa.array(keys), batch.column(0), batch.column(2)]
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "label", "key", "id", "vec"])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, label, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            matrix = _halves(batch.column(4))
            if tail is not None:
                t, label, ids = (np.concatenate(x) for x in zip(tail[:3], (t, label, ids)))
                matrix = np.concatenate([tail[3], matrix])
            found = []
            for step in range(1, WINDOW + 1):
                same = np.flatnonzero((t[step:] == t[:-step]) & (label[step:] == label[:-step]))
                if len(same):
                    sims = (matrix[same] * matrix[same + step]).sum(axis=1).astype(np.float32)
                    found += [(ids[same], ids[same + step], sims), (ids[same + step], ids[same], sims)]
            if found:
                yield _edges(found)
            tail = (t[-WINDOW:], label[-WINDOW:], ids[-WINDOW:], matrix[-WINDOW:])

    order = reps.select("id", "label", "vec").mapInArrow(sign, "t int, label long, key long, id long, vec binary")
    order = order.repartitionByRange("t", "label", "key", "id").sortWithinPartitions("t", "label", "key", "id")
    return order.mapInArrow(link, "u long, v long, sim float")


def _sided(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v, sim, own): whether the ends are in one group. A vector without a link is a group of its own."""
    side = lambda c: groups.select(F.col("id").alias(c), F.col("g").alias(f"g{c}"))
    met = graph.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return met.select("u", "v", "sim", (F.col("gu").isNotNull() & (F.col("gu") == F.col("gv"))).alias("own"))


def _best(edges: DataFrame, groups: DataFrame, k: int, widths: DataFrame, widest: int) -> DataFrame:
    """(u, v, sim, own, k): per vector the k nearest of its group and outside it the k nearest, or as many as `widths` says.

    However many near copies a vector has, its list goes on outside their group: the next link out is never hidden.
    """
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    kept = top_k(_sided(distinct, groups), ["u", "own"], [F.desc("sim"), F.col("v")], widest)
    kept = kept.join(widths, "u", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    return kept.where(F.col("rank") <= F.when(F.col("own"), F.lit(k)).otherwise(F.col("k"))).drop("rank")


def _widened(graph: DataFrame, k: int, near: float) -> DataFrame:
    """(u, k): twice the length for the outer list of a vector whose inner list is full of links."""
    inner = graph.where("own").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"), F.first("k").alias("k"))
    grown = inner.where((F.col("n") >= k) & (F.col("least") >= near)).select("u", (2 * F.col("k")).cast("int").alias("grown"))
    held = graph.where(F.col("k") > k).select("u", F.col("k").alias("held")).distinct()
    return grown.join(held, "u", "full").select("u", F.coalesce("grown", "held").alias("k"))


def _meetings(graph: DataFrame, groups: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(u, v, sim) of pairs that meet in the list of a third, or point at it, and beat the worst entry of either list."""
    back = graph.select(F.col("v").alias("p"), F.col("u").alias("m"))
    # Many vectors can have the same one in their lists: those are dealt out to several meetings, each with its list.
    tables = back.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("n"))
    own = graph.select(F.col("u").alias("p"), F.col("v").alias("m"))
    own = own.union(own.select("p", F.col("p").alias("m")).distinct()).join(tables, "p", "left")
    own = own.select("p", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("q"), "m")
    back = back.join(tables, "p").select("p", F.pmod(F.xxhash64("m"), "n").cast("int").alias("q"), "m")
    # A list that is not full takes anything.
    entries = lambda own, full: F.when(F.count(F.when(F.col("own") == own, 1)) >= full, F.min(F.when(F.col("own") == own, F.col("sim"))))
    width = F.first("k")
    worst = graph.groupBy("u").agg(entries(True, k).alias("inner"), entries(False, width).alias("outer"), width.alias("k"))
    known = reps.join(worst, reps["id"] == worst["u"], "left").join(groups.select(F.col("id").alias("of"), "g"), F.col("id") == F.col("of"), "left")
    bound = lambda c: F.coalesce(c, F.lit(-1.0)).cast("float").alias(c)
    known = known.select(F.col("id").alias("m"), F.coalesce("g", "id").alias("g"), bound("inner"), bound("outer"), F.coalesce("k", F.lit(k)).cast("int").alias("k"), "vec")
    seats = own.union(back).distinct().join(known, "m").select("p", "q", "m", "g", "inner", "outer", "k", "vec")

    def compare(ids: np.ndarray, group: np.ndarray, inner: np.ndarray, outer: np.ndarray, width: np.ndarray, matrix: np.ndarray):
        sims = matrix @ matrix.T
        np.fill_diagonal(sims, -2)
        same = group[:, None] == group[None, :]
        # Of each seat the k best it meets, in its group and outside: a list of k takes no more from one meeting.
        found = []
        for side, worst, most in ((same, inner, k), (~same, outer, int(width.max()))):
            take = min(most, len(ids) - 1)
            seen = np.where(side, sims, -2)
            best = np.argpartition(-seen, take - 1, axis=1)[:, :take]
            row = np.repeat(np.arange(len(ids)), take)
            col = best.ravel()
            better = seen[row, col] > np.maximum(worst[row], -1.5)
            found.append((ids[row[better]], ids[col[better]], seen[row[better], col[better]].astype(np.float32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(7)] + [_halves(batch.column(7))]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            starts = np.append(0, change)
            found = [compare(*(x[a:b] for x in rows[2:])) for a, b in zip(starts, starts[1:]) if b - a > 1]
            if found:
                yield _edges(found)
            rest = [x[starts[-1] :] for x in rows]
        if rest is not None and len(rest[0]) > 1:
            yield _edges([compare(*rest[2:])])

    return seats.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(meet, "u long, v long, sim float")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links, in order, that join what was apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = root(x), root(y)
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append((x, y))
    return kept


def _compare_groups(groups: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows (id, n, other): links of a vector counted in one pair of blocks, and links of a spanning forest (other)."""
    sizes = groups.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    dealt = groups.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("id"), "n").cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    mine, others = F.col("block"), F.sequence(F.lit(0), F.col("n") - 1)
    pairs = F.transform(others, lambda o: pair(F.least(mine, o), F.greatest(mine, o)))
    held = dealt.select("g", "id", "block", F.explode(pairs).alias("at")).select("g", "at.i", "at.j", "block", "id")
    held = held.join(reps.select("id", "exact", "size"), "id").select("g", "i", "j", "block", "id", "size", "exact")

    def block_pair(i: int, block: np.ndarray, ids: np.ndarray, size: np.ndarray, matrix: np.ndarray):
        matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
        first = block == i
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        inside = not len(b)
        if inside:
            b = a
        near = matrix[a] @ matrix[b].T >= threshold
        if inside:
            np.fill_diagonal(near, False)
        x, y = np.nonzero(near)
        count = [(ids[a], near @ size[b])] + ([] if inside else [(ids[b], near.T @ size[a])])
        return count, _forest(ids[a[x]], ids[b[y]])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(rows: list[np.ndarray], starts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            ids, n, other = [], [], []
            for s, e in starts:
                counts, links = block_pair(rows[1][s], *(x[s:e] for x in rows[3:]))
                for who, much in counts:
                    some = np.flatnonzero(much)
                    ids += who[some].tolist()
                    n += much[some].tolist()
                    other += [None] * len(some)
                for x, y in links:
                    ids.append(x)
                    n.append(0)
                    other.append(y)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, n, other)], names=["id", "n", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in range(6)] + [_matrix(batch.column(6))]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            differs = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            starts = np.append(0, np.flatnonzero(differs) + 1)
            yield from out(rows, list(zip(starts, starts[1:])))
            rest = [x[starts[-1] :] for x in rows]
        if rest is not None:
            yield from out(rest, [(0, len(rest[0]))])

    dealt = held.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(compare, "id long, n long, other long")


def _known_links(asked: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of the sampled vectors, in double precision; of each the AUDIT_LINKS ones with the smallest hash."""
    audit = asked.toPandas().sort_values("label", kind="stable")
    ids, labels = audit["id"].to_numpy(dtype=np.int64), audit["label"].to_numpy(dtype=np.int64)
    matrix_of = lambda rows: rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    asked = matrix_of(np.stack(audit["exact"].to_list())) if len(audit) else np.zeros((0, 1))

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, label, matrix = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix_of(_matrix(batch.column(2)))
            order = np.argsort(label, kind="stable")
            starts = np.append(0, np.flatnonzero(np.diff(label[order])) + 1)
            for rows in np.split(order, starts[1:]):
                low, high = np.searchsorted(labels, label[rows[0]], "left"), np.searchsorted(labels, label[rows[0]], "right")
                for at in range(0, len(rows) if high > low else 0, 4096):
                    some = rows[at : at + 4096]
                    a, b = np.nonzero(asked[low:high] @ matrix[some].T >= threshold)
                    a, b = ids[low + a], who[some[b]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    links = reps.select("id", "label", "exact").mapInArrow(brute, "a long, b long")
    return top_k(links, ["a"], [F.xxhash64("b").asc(), F.asc("b")], AUDIT_LINKS).select("a", "b")


def _planted(beside: DataFrame, dim: int, threshold: float, first_id: int) -> DataFrame:
    """Rows like those of `reps`, of size 0: beside each given vector one at the threshold, with `beside` for its id."""
    rows = sorted(beside.collect(), key=lambda r: r["id"])
    rng = np.random.default_rng(23)
    out = []
    for i, row in enumerate(rows):
        vector = np.array(row["exact"])
        vector = vector / np.sqrt((vector * vector).sum())
        away = rng.normal(size=dim)
        away -= (away @ vector) * vector
        length = np.sqrt((away * away).sum())
        if length > 1e-6:
            vector = threshold * vector + np.sqrt(max(0.0, 1 - threshold * threshold)) * away / length
        out.append((first_id - i, row["label"], vector.tolist(), 0, bytearray(vector.astype(np.float16).tobytes()), row["id"]))
    schema = "id long, label long, exact array<double>, size long, vec binary, beside long"
    return settled(beside.sparkSession.createDataFrame(out, schema), "planted")


def _links(reps: DataFrame, dim: int, threshold: float, neighbours: int, recall: float, exhaustive: bool) -> DataFrame:
    """(id, n, other) of all groups of vectors of one length, see `_compare_groups`."""
    whole = lambda: _compare_groups(reps.select("id", F.col("label").alias("g")), reps, threshold, LABEL_BLOCK)
    if exhaustive:
        return whole()
    near = threshold - SLACK
    facts = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).agg(F.max("n"), F.min("low")).first()
    largest, lowest = facts
    # More orders for larger labels; the planted rows count as well.
    orders = orders_for(largest + PLANTED, threshold)
    sample = settled(drawn(reps.select("id", "label", "exact"), max(AUDIT_VECTORS, PLANTED), "id"), "sample")
    planted = _planted(sample.limit(PLANTED), dim, threshold, lowest - 1)
    truth = _known_links(sample.orderBy("id").limit(AUDIT_VECTORS), reps, threshold)
    truth = settled(truth.union(planted.select("beside", "id")), "truth")
    points = reps.union(planted.drop("beside"))
    edges = settled(_first_lists(points, dim, orders), "edges")
    k = widest = neighbours
    widths = reps.sparkSession.createDataFrame([], "u long, k int")
    groups = before = None
    for turn in itertools.count():
        links = edges.where(F.col("sim") >= near).select(F.col("u").alias("a"), F.col("v").alias("b"))
        if groups is not None:
            # What was joined stays so, also where a list has no room for the link.
            links = links.union(groups.select("id", "g"))
        groups = settled(components(links).select(F.col("node").alias("id"), F.col("component").alias("g")), "groups")
        ends = truth.join(groups.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a", "left")
        ends = ends.join(groups.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b", "left")
        found = ends.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("ga") == F.col("gb"), 1)).alias("in")).first()
        full = found["in"] >= recall * found["all"]
        joined = groups.agg(F.count(F.lit(1)), F.countDistinct("g")).first()
        LOG.info("round %d: %d of %d known links, %d vectors in %d groups, lists of %d to %d", turn, found["in"], found["all"], *joined, k, widest)
        # Rounds that still join groups go on; their number is bounded by that of the groups.
        if joined == before and full:
            return _compare_groups(groups.join(planted.select("id"), "id", "left_anti"), reps, threshold)
        if joined == before and k >= largest + PLANTED:
            # Lists as long as a label hold all of it.
            return whole()
        if joined == before:
            k *= 2
            edges = edges.union(_first_lists(points, dim, orders, 11 + turn))
        before, widest = joined, max(k, widest)
        graph = settled(_best(edges, groups, k, widths, widest), "lists")
        widths = settled(_widened(graph, k, near), "widths")
        widest = max(widest, widths.agg(F.max("k")).first()[0] or 0)
        edges = settled(graph.select("u", "v", "sim").union(_meetings(graph, groups, points, k)), "edges")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    recall: float = RECALL,
    exhaustive: bool = False,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Two vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    `threshold`. `n_links` counts the other vectors linked directly, `component_id` is the smallest id that links lead
    to, `kept` says that it is the vector's own. Vectors that are null, empty, all zero or hold a null or
    non-finite component, and rows without an id, link with nothing, nor do vectors of different length. Rows that
    repeat are one vector. Vectors that are exactly equal are one point with a size; they are linked, whatever
    the threshold up to 1. An empty table gives no rows. Only the three named columns are read; labels are whole numbers.

    Every link between vectors that come into one group is found; the audit measures the share of links whose ends do.
    The descent does not end before that share of the known links is in, see `recall`. With `exhaustive`, all vectors of a
    label are compared in blocks instead. On the driver: PLANTED vectors at most, chosen by the hash of their id.
    """
    fine = F.coalesce(usable(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(fine, vector).alias("exact"), fine.alias("fine")
    )
    rows = settled(rows.distinct(), "vectors")
    classes = rows.where("fine").groupBy("label", "exact").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    largest = F.array_max(F.transform("exact", F.abs))

    def halved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = []
            for x in batch.column(2).to_pylist():
                x = np.array(x) / max(map(abs, x))
                packed.append((x / np.sqrt((x * x).sum())).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=["id", "label", "exact", "size", "vec"])

    # Scaled by the largest component, so that squares neither overflow nor vanish.
    scaled = F.transform("exact", lambda x: x / F.col("largest"))
    classes = classes.withColumn("largest", largest).select("id", "label", scaled.alias("exact"), "size", F.col("exact").alias("raw"))
    classes = settled(classes, "classes")
    reps = classes.select("id", "label", "exact", "size").mapInArrow(halved, "id long, label long, exact array<double>, size long, vec binary")
    reps = settled(reps, "reps")
    links = None
    for row in sorted(reps.select(F.size("exact").alias("n")).distinct().collect()):
        own = _links(reps.where(F.size("exact") == row["n"]), row["n"], threshold, neighbours, recall, exhaustive)
        links = own if links is None else links.union(own)
    if links is None:
        links = reps.sparkSession.createDataFrame([], "id long, n long, other long")
    links = settled(links, "links")
    counts = links.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    whole = components(links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    points = classes.select("id", "label", "raw", "size").join(counts, "id", "left").join(whole.withColumnRenamed("node", "id"), "id", "left")
    points = points.select(
        F.col("label").alias("l"), F.col("raw").alias("r"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    # A null or unusable vector meets no point.
    met = rows.where("fine").join(points, (F.col("label") == F.col("l")) & (F.col("exact") == F.col("r"))).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = met.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
