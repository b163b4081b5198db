"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. A neighbour graph starts from a forest of orders by
random hyperplane codes (each node with the next ones in every order), as many orders as a pair at the
threshold needs to meet with near certainty. Rounds of descent join the neighbours of a node with each
other; what beats the end of either's list, or is over the threshold, goes on. Lists keep the best; one
that holds nothing but neighbours over the threshold is saturated and is doubled. Links are the threshold edges met in any round,
whether or not a list has kept them.

Nodes whose lists are saturated at their full length stand in dense groups, the pairs of which would be too many to emit. Their
lists are enlarged to whole components at once: block-wise products count the links within the component, and with the dense components
near enough (by centre and radius, which the triangle inequality makes exact), and hand on numbers alone.

An audit compares nodes with all others of their class, more of them until it has met enough links. While it finds too few of them in the
graph, further orders and rounds follow; after that the classes in which it missed one are compared in blocks as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, connected_components

#: Length of the lists at first and at most, neighbours taken from each order, vectors of a block and of a product's left side.
LIST, DENSE, NEXT, BLOCK, STRIP = 8, 64, 4, 4096, 256
#: Nodes of an audit at first, the links that it has to meet, and its bytes of vectors at most: it grows up to these.
AUDIT, AUDIT_LINKS, AUDIT_BYTES = 500, 200, 32 << 20
#: Parts that the rows of copied vectors are salted into.
SALTS = 16


def _units(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_BAD = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
_USABLE = f"(vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and not coalesce({_BAD}, true) and exists(embedding, x -> x <> 0))"
_V = "transform(embedding, x -> cast(x as double) + 0D)"


def nodes_of(vectors: DataFrame, tables: Tables) -> DataFrame:
    """(node, first, copies, cls, h, g, v): distinct usable vectors by label, written down. first: the smallest vec_id; cls: number of the label and the dimension; h and g: hashes of label and vector."""
    v = vectors.where(_USABLE).selectExpr("vec_id", "label", f"{_V} v")
    one = v.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    made = tables.write(one.selectExpr("monotonically_increasing_id() node", "first", "copies", "struct(label, size(v) as d) class", "xxhash64(label, v) h", "xxhash64(reverse(v), label) g", "v"))
    classes = tables.write(made.select("class").distinct().selectExpr("class", "monotonically_increasing_id() cls"))
    return tables.write(made.join(classes, "class").select("node", "first", "copies", "cls", "h", "g", "v"))


def _held(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of whole groups of rows with one key, of which the last goes on with the next batch."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if len(t):
            k = np.stack([t.column(c).to_numpy() for c in key], 1)
            last = int(np.flatnonzero((k != k[-1]).any(1))[-1]) + 1 if (k != k[-1]).any() else 0
            if last:
                yield t.slice(0, last)
            held = t.slice(last)
    if held is not None and len(held):
        yield held


def _groups(t: pa.Table, key: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    k = np.stack([t.column(c).to_numpy() for c in key], 1)
    cuts = [0, *(np.flatnonzero((np.diff(k, axis=0) != 0).any(1)) + 1).tolist(), len(t)]
    return zip(cuts, cuts[1:])


def forest(nodes: DataFrame, orders: int, seed: int, parts: int) -> DataFrame:
    """(a, b, sim) of nodes of one class that stand close in one of the orders."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = (1 << np.arange(62, -1, -1, dtype=np.int64)).astype(np.int64)
        for b in batches:
            sizes = np.diff(b.column("v").offsets.to_numpy())
            for d in np.unique(sizes):
                some = b.filter(pa.array(sizes == d))
                x = _units(some.column("v"))
                u = pa.array([r.tobytes() for r in x], pa.binary())
                for o in range(orders):
                    if (d, o) not in planes:
                        planes[d, o] = np.random.default_rng([seed, o, int(d)]).normal(size=(int(d), 63))
                    code = ((x @ planes[d, o]) > 0) @ weights
                    yield pa.RecordBatch.from_pydict({"ord": pa.array([o] * len(x), pa.int32()), "code": pa.array(code, pa.int64()), "node": some.column("node"), "cls": some.column("cls"), "u": u})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            n, fresh = len(t), len(t) - b.num_rows
            key = np.stack([t.column("ord").to_numpy(), t.column("cls").to_numpy()], 1)
            ids, u = t.column("node").to_numpy(), t.column("u").to_pylist()
            for k in range(1, NEXT + 1):
                same = np.flatnonzero((key[k:] == key[:-k]).all(1)) if n > k else np.zeros(0, int)
                same = same[same + k >= fresh]
                sizes = np.array([len(u[i]) for i in same.tolist()])
                for d in np.unique(sizes):
                    at = same[sizes == d]
                    x = np.frombuffer(b"".join(u[i] for i in at), np.float64).reshape(len(at), -1)
                    y = np.frombuffer(b"".join(u[i + k] for i in at), np.float64).reshape(len(at), -1)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(ids[at]), "b": pa.array(ids[at + k]), "sim": pa.array((x * y).sum(1))})
            held = t.slice(max(0, n - NEXT))

    coded = nodes.select("node", "cls", "v").mapInArrow(codes, "ord int, code long, node long, cls long, u binary")
    placed = coded.repartitionByRange(parts, "ord", "cls", "code", "node").sortWithinPartitions("ord", "cls", "code", "node")
    return placed.mapInArrow(near, "a long, b long, sim double")


def best(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b, sim) in both directions: the best of each node's list, as many as its length k in lists(node, k)."""
    from pyspark.sql import Window

    both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    one = both.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    some = one.withColumn("rank", rank).where(F.col("rank") <= DENSE)  # of a hub's rows no more than these are shuffled
    return some.join(lists, F.col("a") == F.col("node")).where("rank <= k").select("a", "b", "sim")


def linked(edges: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b, once: edges at the threshold, however many a node has."""
    return edges.where(F.col("sim") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ends(graph: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(node, k, low, full) for lists(node, k): the least similarity that enters the node's list (-2: any), and whether the list is saturated."""
    counted = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    full = F.coalesce(F.col("n") >= F.col("k"), F.lit(False))
    return lists.join(counted, lists.node == counted.a, "left").select("node", "k", F.when(full, F.col("least")).otherwise(-2.0).alias("low"), (full & (F.col("least") >= threshold)).alias("full"))


def descend(graph: DataFrame, nodes: DataFrame, lows: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b, sim) of neighbours of neighbours: the vectors of each node's list meet at the node. Pairs over the threshold, or that enter one of their lists."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches, ("a",)):
            ids, low, v = t.column("b").to_numpy(), t.column("low").to_numpy(), t.column("v").combine_chunks()
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in _groups(t, ("a",)):
                if hi - lo > 1:
                    x = _units(v.slice(lo, hi - lo))
                    s, end = x @ x.T, low[lo:hi]
                    i, j = np.nonzero(np.triu((s >= threshold) | (s > end[:, None]) | (s > end[None, :]), 1))
                    out[0].append(ids[lo + i])
                    out[1].append(ids[lo + j])
                    out[2].append(s[i, j])
            if out[0]:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(c)) for k, c in zip(("a", "b", "sim"), out)})

    there = nodes.join(lows, "node").select(F.col("node").alias("b"), "v", "low")
    sent = graph.join(there, "b").select("a", "b", "low", "v")
    return sent.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(meet, "a long, b long, sim double")


def block_pairs(members: DataFrame, pairs: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """work on each two blocks of groups that pairs(left, right) names, left and right being the same for a group's own.

    members(part, node, component, copies, reach, v), part being the group. work gets the rows of two blocks, side telling which; of a
    block with itself, once. No task holds more than two blocks.
    """
    sizes = members.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = members.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    jobs = pairs.join(sizes.select(F.col("part").alias("left"), F.col("blocks").alias("nl")), "left").join(sizes.select(F.col("part").alias("right"), F.col("blocks").alias("nr")), "right")
    rows = ("node", "component", "copies", "reach", "v")
    left = member.join(jobs, F.col("part") == F.col("left")).selectExpr("left", "right", "block i", "explode(sequence(if(left = right, block, 0), nr - 1)) j", "0 side", *rows)
    right = member.join(jobs, F.col("part") == F.col("right")).where("left <> right or block > 0").selectExpr("left", "right", "explode(sequence(0, if(left = right, block, nl) - 1)) i", "block j", "1 side", *rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("left", "right", "i", "j")
        for t in _held(batches, key):
            for lo, hi in _groups(t, key):
                yield from work(t.slice(lo, hi - lo))

    return left.unionByName(right).repartition(parts, "left", "right", "i", "j").sortWithinPartitions("left", "right", "i", "j").mapInArrow(run, schema)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = t.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) or t.column("left")[0] != t.column("right")[0] or t.column("i")[0] != t.column("j")[0] else left


_KINDS = ("node", "n", "a", "b", "pairs", "missed")


def compare(members: DataFrame, pairs: DataFrame, threshold: float, parts: int) -> DataFrame:
    """All nodes of the groups that pairs names with each other, in products of blocks. Three kinds of rows:

    (node, n): exact numbers of linked vectors; (a, b): components that a link joins, as
    many as it takes to join them; (pairs, missed): links of nodes, and those of them that lie between components.
    """

    def rows(**columns: object) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({k: pa.array(columns[k], pa.int64()) if k in columns else pa.nulls(size, pa.int64()) for k in _KINDS})

    def joined(found: np.ndarray, now: np.ndarray) -> tuple[list, np.ndarray]:
        """The pairs of found that join components, and the components after that."""
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        kept = []
        for x, y in found.tolist():
            x, y = sorted((top(x), top(y)))
            if x != y:
                root[y] = x
                kept.append((x, y))
        names, at = np.unique(now, return_inverse=True)
        return kept, np.array([top(c) for c in names.tolist()], np.int64)[at]

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = _sides(t)
        if not len(left) or not len(right):
            return
        x, own, copies, was = _units(t.column("v")), t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("component").to_numpy()
        n, now, met, missed, joins = np.zeros(len(x), np.int64), was, 0, 0, []
        for lo in range(0, len(left), STRIP):
            strip = left[lo : lo + STRIP]
            r, c = np.nonzero(x[strip] @ x[right].T >= threshold)
            r, c = strip[r], right[c]
            if left is right:
                r, c = r[r < c], c[r < c]
            n += np.bincount(r, weights=copies[c], minlength=len(x)).astype(np.int64) + np.bincount(c, weights=copies[r], minlength=len(x)).astype(np.int64)
            met += len(r)
            missed += int((was[r] != was[c]).sum())
            if (apart := now[r] != now[c]).any():
                more, now = joined(np.unique(np.stack([now[r[apart]], now[c[apart]]], 1), axis=0), now)
                joins += more
        some = np.flatnonzero(n)
        yield rows(node=own[some], n=n[some])
        yield rows(pairs=[met], missed=[missed])
        if joins:
            yield rows(a=[x for x, _ in joins], b=[y for _, y in joins])

    return block_pairs(members, pairs, work, ", ".join(f"{k} long" for k in _KINDS), parts)


def near_groups(members: DataFrame, threshold: float, tables: Tables, parts: int) -> DataFrame:
    """(left, right), left < right: groups of members(part, cls, node, ..., v) of one class, between which there may be a link.

    A group lies in a ball around one of its members. Angles obey the triangle inequality, so balls further apart than the
    threshold's angle hold no link.
    """
    first = members.groupBy("part").agg(F.min("node").alias("node"))
    centres = tables.write(members.join(first, ["part", "node"]).select("part", "cls", "v"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column("v").offsets.to_numpy())
            for d in np.unique(sizes):
                some = b.filter(pa.array(sizes == d))
                angle = np.arccos(np.clip((_units(some.column("v")) * _units(some.column("c"))).sum(1), -1, 1))
                yield pa.RecordBatch.from_pydict({"part": some.column("part"), "angle": pa.array(angle)})

    reach = members.join(centres.select("part", F.col("v").alias("c")), "part").select("part", "v", "c").mapInArrow(angles, "part long, angle double").groupBy("part").agg(F.max("angle").alias("reach"))
    balls = centres.join(reach, "part").selectExpr("cls part", "part node", "0L component", "0L copies", "reach", "v")
    limit = math.acos(threshold) + 1e-6

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = _sides(t)
        if len(left) and len(right):
            x, own, radius = _units(t.column("v")), t.column("node").to_numpy(), t.column("reach").to_numpy()
            for lo in range(0, len(left), STRIP):
                strip = left[lo : lo + STRIP]
                angle = np.arccos(np.clip(x[strip] @ x[right].T, -1, 1))
                r, c = np.nonzero(angle <= limit + radius[strip][:, None] + radius[right][None, :])
                r, c = own[strip[r]], own[right[c]]
                keep = r < c if left is right else r != c
                yield pa.RecordBatch.from_pydict({"left": pa.array(np.minimum(r, c)[keep]), "right": pa.array(np.maximum(r, c)[keep])})

    classes = balls.select(F.col("part").alias("left"), F.col("part").alias("right")).distinct()
    return block_pairs(balls, classes, work, "left long, right long", parts)


def audit(nodes: DataFrame, counted: DataFrame, threshold: float) -> tuple[int, int, list[int]]:
    """(links, links found, classes with links not found): nodes by their hashes, each compared with all nodes of its class.

    counted(node, n): the numbers of linked vectors found. As many nodes as it takes to meet AUDIT_LINKS links, or as AUDIT_BYTES hold.
    """
    size = AUDIT
    while True:
        picked = nodes.orderBy(F.xxhash64("first"), "node").limit(size).select("node", "cls", "v").toArrow()
        ids, cls, vectors = picked.column("node").to_numpy(), picked.column("cls").to_numpy(), picked.column("v").combine_chunks()
        at = {int(c): np.flatnonzero(cls == c) for c in np.unique(cls)}
        sets = {c: (ids[k], _units(vectors.take(pa.array(k)))) for c, k in at.items()}

        def count(batches: Iterator[pa.RecordBatch], sets: dict = sets) -> Iterator[pa.RecordBatch]:
            for b in batches:
                classes, own, copies = (b.column(k).to_numpy() for k in ("cls", "node", "copies"))
                for c in np.unique(classes):
                    if int(c) in sets:
                        rows = np.flatnonzero(classes == c)
                        q, x = sets[int(c)]
                        hit = (x @ _units(b.column("v").take(pa.array(rows))).T >= threshold) & (q[:, None] != own[rows][None, :])
                        n = hit @ copies[rows]
                        some = np.flatnonzero(n)
                        yield pa.RecordBatch.from_pydict({"node": pa.array(q[some]), "true": pa.array(n[some], pa.int64()), "cls": pa.array(np.full(len(some), c, np.int64))})

        true = nodes.select("node", "cls", "copies", "v").mapInArrow(count, "node long, true long, cls long").groupBy("node", "cls").agg(F.sum("true").alias("true"))
        rows = true.join(counted, "node", "left").select("cls", "true", F.least("true", F.coalesce("n", F.lit(0))).alias("found")).collect()  # of the audit's nodes
        links, found = sum(r.true for r in rows), sum(r.found for r in rows)
        if links >= AUDIT_LINKS or len(ids) < size or size * vectors.nbytes / max(1, len(ids)) * 4 > AUDIT_BYTES:
            return links, found, sorted({r.cls for r in rows if r.found < r.true})
        size *= 4


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999, most_rounds: int = 8, tries: int = 2, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings(vec_id, embedding, label, ...).

    Vectors of equal labels and dimensions link at a cosine of threshold or more, in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link with
    nothing: 0 links, their own component. Equal vectors are links of each other; repeated rows count as rows; rows of one
    vec_id with several vectors have the links of each. Other columns aren't looked at; an empty table gives no rows.

    Descent ends when a round adds no more than a thousandth to the links, after most_rounds at most. If the audit then finds a share of the links below
    recall, further orders and rounds follow, so many tries in all; then the classes that miss links are compared as a whole, in blocks, until it is reached.
    report: gets the audits' (links, found) under audits, and under links the same of all nodes of the classes compared as a whole, found being
    the links that lie within the components of the descent.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    nodes = nodes_of(vectors, tables)
    report = {} if report is None else report
    largest = nodes.groupBy("cls").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    meet = agree ** math.log2(max(2, largest))
    orders = max(4, math.ceil(math.log(1e-4) / math.log(1 - meet))) if meet < 1 else 4

    graph = known = spark.createDataFrame([], "a long, b long, sim double")
    known = known.select("a", "b")
    lists = nodes.select("node", F.lit(LIST).alias("k"))
    counted = components = None
    exact: list[int] = []
    attempt = 0
    while True:
        if attempt < tries and largest > 1:
            met = tables.write(forest(nodes, orders, 1 + attempt, parts))
            graph = tables.replace(graph, best(graph.unionByName(met), lists))
            known = tables.replace(known, known.unionByName(linked(met, threshold)).distinct())
            tables.drop(met)
            links = known.count()
            for k in range(most_rounds):
                state = tables.write(ends(graph, lists, threshold))
                met = tables.write(descend(graph, nodes, state.select("node", "low"), threshold, parts))
                lists = tables.replace(lists, state.select("node", F.when(F.col("full"), F.least(2 * F.col("k"), F.lit(DENSE))).otherwise(F.col("k")).alias("k")))
                graph = tables.replace(graph, best(graph.unionByName(met), lists))
                known = tables.replace(known, known.unionByName(linked(met, threshold)).distinct())
                tables.drop(met)
                tables.drop(state)
                links, before = known.count(), links
                if k and links - before <= 0.001 * links:
                    break
        components, counted, whole = _settle(nodes, graph, lists, known, exact, threshold, tables, parts)
        if whole:
            report["links"] = whole
        if largest < 2:
            break
        n, found, missing = audit(nodes, counted, threshold)
        report.setdefault("audits", []).append((n, found))
        if found >= recall * n:
            break
        attempt += 1
        if attempt >= tries:
            exact = sorted({*exact, *missing})

    named = nodes.select("node", "first", "copies", "h", "g").join(components, "node", "left").join(counted, "node", "left").selectExpr("node", "first", "copies", "h", "g", "coalesce(component, node) component", "coalesce(n, 0L) + copies - 1 n")
    least = named.groupBy("component").agg(F.min("first").alias("c"))
    ids = tables.write(named.join(least, "component").select("first", "copies", "h", "g", "c", "n"))
    keyed = vectors.selectExpr("vec_id", f"if({_USABLE}, xxhash64(label, {_V}), null) h", f"if({_USABLE}, xxhash64(reverse({_V}), label), null) g", f"pmod(xxhash64(vec_id), {SALTS}) salt")
    own = ids.selectExpr("first vec_id", "h", "g", "c c1", "n n1")
    copied = ids.where("copies > 1").selectExpr("h", "g", f"explode(sequence(0L, {SALTS - 1}L)) salt", "c c2", "n n2")  # a vector that most rows copy is no single key
    out = keyed.join(own, ["vec_id", "h", "g"], "left").join(copied, ["h", "g", "salt"], "left").selectExpr("vec_id", "coalesce(c1, c2, vec_id) c", "coalesce(n1, n2, 0L) n")
    return out.selectExpr("vec_id", "n n_links", "c component_id", "coalesce(vec_id = c, false) kept")


def _settle(nodes: DataFrame, graph: DataFrame, lists: DataFrame, known: DataFrame, exact: list[int], threshold: float, tables: Tables, parts: int) -> tuple[DataFrame, DataFrame, tuple[int, int] | None]:
    """((node, component), (node, n), links of the exact classes): of threshold edges, with blocks for components of saturated lists and for the exact classes."""
    components = connected_components(known, tables)
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_edges = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"))
    placed = nodes.select("node", "cls", "copies", "v").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    in_class = F.col("cls").isin(exact) if exact else F.lit(False)
    dense = ends(graph, lists, threshold).where("full").join(components, "node").select("component").distinct()
    groups = tables.write(placed.where(~in_class).join(dense, "component", "left_semi").selectExpr("component part", "cls", "node", "component", "copies", "0D reach", "v"))
    whole = placed.where(in_class).selectExpr("cls part", "node", "component", "copies", "0D reach", "v")
    own = lambda m: m.select(F.col("part").alias("left"), F.col("part").alias("right")).distinct()
    made = []
    if not groups.isEmpty():
        pairs = own(groups).unionByName(tables.write(near_groups(groups, threshold, tables, parts)))
        made.append(tables.write(compare(groups.drop("cls"), pairs, threshold, parts)))
    if exact:
        made.append(tables.write(compare(whole, own(whole), threshold, parts)))
    if not made:
        return components, by_edges, None
    met = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    in_blocks = groups.select("node").unionByName(whole.select("node"))
    counted = by_edges.join(in_blocks, "node", "left_anti").unionByName(met.where("node is not null").groupBy("node").agg(F.sum("n").alias("n")))
    joins = met.where("a is not null").select("a", "b")
    if not joins.isEmpty():
        merged = connected_components(joins, tables).select(F.col("node").alias("part"), F.col("component").alias("into"))
        everyone = placed.select("node", F.col("component").alias("part"))
        components = tables.write(everyone.join(merged, "part", "left").select("node", F.coalesce("into", "part").alias("component")))
    total = None
    if exact:
        t = made[-1].agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed")).first()
        total = (t.n, t.n - t.missed)
    return components, tables.write(counted), total
