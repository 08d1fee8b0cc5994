"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

Three steps. (1) Components: every node has one parent, so pointer doubling labels each node with
its root, or with the smallest id of the circle it runs into, in log2(depth) self-joins. (2) Each
component is co-located by its label. (3) An iterative, colour-marking depth-first walk emits the
paths, descendant counts and back-edge circles of every component of a task's sorted stream.

A component of more than ``max_component`` nodes never enters one task: its paths are climbed by
the same doubling, with the ancestors collected on the way, which costs what the result's own
paths cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut

SCHEMA = "id bigint, shape string, root_id bigint, depth bigint, slug_path string, n_desc bigint"
FULL_SCHEMA = SCHEMA + ", descendants array<bigint>, back_edge_to bigint"

WHITE, GREY, BLACK = 0, 1, 2


def clean_nodes(rows: DataFrame, id_col: str, parent_col: str, label_col: str) -> DataFrame:
    """``(id, parent, slug)``: one row per id, and a parent that names no row made null.

    Rows with a null id are no nodes. Of several rows of one id the smallest (parent, label) holds;
    a null label reads as the empty string. Other columns of ``rows`` are ignored.
    """
    one = (
        rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(parent_col).cast("bigint").alias("parent"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("slug"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min(F.struct("parent", "slug")).alias("v"))
        .select("id", "v.parent", "v.slug")
    )
    ids = one.select(F.col("id").alias("there"))
    return one.join(ids, one.parent == ids.there, "left").select("id", F.col("there").alias("parent"), "slug")


def label_components(nodes: DataFrame) -> DataFrame:
    """``(id, parent, slug, label, cyclic, onward)`` of clean nodes.

    ``label`` is the root's id, or for nodes that run into a circle the smallest id on it;
    ``onward`` is, for the latter, a node on the circle.
    """
    # ptr: the node 2^k steps up (a root points at itself); low: smallest id among those passed.
    start = cut(nodes.select("id", "parent", "slug", F.coalesce("parent", "id").alias("ptr"), F.coalesce("parent", "id").alias("low"), F.col("parent").isNull().alias("done")))
    settled, active = start.where("done"), start.where("not done")
    left = active.count()
    while left:
        jump = settled.unionByName(active).select(F.col("id").alias("j_id"), F.col("ptr").alias("j_ptr"), F.col("low").alias("j_low"), F.col("done").alias("j_done"))
        moved = cut(
            active.join(jump, F.col("ptr") == F.col("j_id")).select(
                "id", "parent", "slug", F.col("j_ptr").alias("ptr"), F.least("low", "j_low").alias("low"), F.col("j_done").alias("done")
            )
        )
        settled, active = settled.unionByName(moved.where("done")), moved.where("not done")
        now = active.count()
        if now == left:  # while a node of a tree is left, some node of half its depth settles: only circles are left
            break
        left = now
    trees = settled.select("id", "parent", "slug", F.col("ptr").alias("label"), F.lit(False).alias("cyclic"), F.lit(None).cast("bigint").alias("onward"))
    if not left:
        return trees
    # Circles: double on until the smallest id seen from the landing node is the same for child and parent.
    while True:
        land = active.select(F.col("id").alias("l_id"), F.col("ptr").alias("l_ptr"), F.col("low").alias("l_low"))
        seen = cut(
            active.join(land, F.col("ptr") == F.col("l_id")).select(
                "id", "parent", "slug", F.col("ptr").alias("onward"), F.col("l_low").alias("label"), F.col("l_ptr").alias("ptr"), F.least("low", "l_low").alias("low")
            )
        )
        up = seen.select(F.col("id").alias("u_id"), F.col("label").alias("u_label"))
        n = seen.agg(F.countDistinct("onward").alias("before"), F.countDistinct("ptr").alias("after")).first()
        # as many landing nodes after twice the steps: the step is one-to-one on them, so all lie on circles
        if n.before == n.after and seen.join(up, F.col("parent") == F.col("u_id")).where("label <> u_label").isEmpty():
            break
        active = seen.select("id", "parent", "slug", "ptr", "low", F.lit(False).alias("done"))
    return trees.unionByName(seen.select("id", "parent", "slug", "label", F.lit(True).alias("cyclic"), "onward"))


def walk(ids: list[int], parents: list[int | None], slugs: list[str], full: bool) -> list[tuple]:
    """Rows of SCHEMA (FULL_SCHEMA if ``full``) of whole components, by an iterative depth-first walk.

    Nodes turn grey when entered and black when left. Descents start at roots; what stays white
    runs into a circle, and there the climb along the parents meets a grey node: the back edge.
    """
    at = {x: k for k, x in enumerate(ids)}
    children: dict[int, list[int]] = {}
    for k, p in enumerate(parents):
        if p is not None:
            children.setdefault(at[p], []).append(k)
    colour = [WHITE] * len(ids)
    out: list[tuple] = []
    for root in (k for k, p in enumerate(parents) if p is None):
        order: list[int] = []  # pre-order: a node's descendants follow it without a gap
        place: dict[int, int] = {}
        trail: list[str] = []
        stack = [(root, False)]
        found: dict[int, tuple] = {}
        while stack:
            k, leave = stack.pop()
            if leave:
                colour[k] = BLACK
                n = len(order) - place[k] - 1
                found[k] = (len(trail) - 1, "/".join(trail), n)
                trail.pop()
                continue
            colour[k] = GREY
            place[k] = len(order)
            order.append(ids[k])
            trail.append(slugs[k])
            stack.append((k, True))
            stack.extend((c, False) for c in children.get(k, ()))
        for k, (depth, path, n) in found.items():
            row = (ids[k], "tree", ids[root], depth, path, n)
            out.append(row + (sorted(order[place[k] + 1 : place[k] + 1 + n]), None) if full else row)
    circle: dict[int, int] = {}  # node to the smallest id of the circle it runs into
    for start in range(len(ids)):
        if colour[start] != WHITE:
            continue
        climb, k = [], start
        while colour[k] == WHITE:
            colour[k] = GREY
            climb.append(k)
            k = at[parents[k]]
        ring: list[int] = []
        back = None
        if colour[k] == GREY:  # the edge from the last climbed node to k closes a circle
            ring = climb[climb.index(k) :]
            back = climb[-1]
            smallest = min(ids[i] for i in ring)
        else:
            smallest = circle[k]
        on = set(ring)
        for i in climb:
            colour[i] = BLACK
            circle[i] = smallest
            row = (ids[i], "cycle" if i in on else "tail", smallest, -1, "", -1)
            out.append(row + ([], ids[k] if i == back else None) if full else row)
    return out


def _walker(full: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + ([pa.list_(pa.int64()), pa.int64()] if full else [])
    names = [x.split()[0] for x in (FULL_SCHEMA if full else SCHEMA).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            done = walk(*rows, full)
            for a in range(0, len(done), 5000):
                part = list(zip(*done[a : a + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], names=names)

        held: list[list] = [[], [], []]
        last = None
        for b in batches:
            labels = b.column("label").to_pylist()
            cols = [b.column(c).to_pylist() for c in ("id", "parent", "slug")]
            if not labels:
                continue
            if last is not None and labels[0] != last:
                yield from emit(held)
                held = [[], [], []]
            edge = len(labels)  # the last component may go on in the next batch
            while edge and labels[edge - 1] == labels[-1]:
                edge -= 1
            if edge:
                for h, c in zip(held, cols):
                    h.extend(c[:edge])
                yield from emit(held)
                held = [[], [], []]
            for h, c in zip(held, cols):
                h.extend(c[edge:])
            last = labels[-1]
        if held[0]:
            yield from emit(held)

    return run


def ancestors(nodes: DataFrame) -> DataFrame:
    """``id, slug, label, up`` of the tree nodes among ``nodes``: their ancestors, nearest first, collected by doubling."""
    tree = nodes.where("not cyclic")
    none = F.array().cast("array<struct<id:bigint,slug:string>>")
    state = cut(tree.select("id", "slug", F.coalesce("parent", "id").alias("ptr"), F.col("parent").isNull().alias("done"), "label", none.alias("up")))
    while not state.where("not done").isEmpty():
        jump = state.select(F.col("id").alias("j_id"), F.struct("id", "slug").alias("j_self"), F.col("ptr").alias("j_ptr"), F.col("done").alias("j_done"), F.col("up").alias("j_up"))
        moved = (
            state.where("not done")
            .join(jump, F.col("ptr") == F.col("j_id"))
            .select("id", "slug", F.col("j_ptr").alias("ptr"), F.col("j_done").alias("done"), "label", F.concat("up", F.array("j_self"), "j_up").alias("up"))
        )
        state = cut(state.where("done").unionByName(moved))
    return state.select("id", "slug", "label", "up")


def climb_large(nodes: DataFrame, full: bool = False) -> DataFrame:
    """SCHEMA (FULL_SCHEMA if ``full``) rows of components too large for one task (columns of :func:`label_components`).

    A node's number of descendants is the number of ancestor lists that name it, counted with a
    partial aggregate. The back edge of a circle leads from the node whose parent is the smallest id.
    """
    state = ancestors(nodes)
    below = state.select(F.explode("up.id").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    names = F.concat(F.reverse(F.col("up.slug")), F.array("slug"))
    trees = state.join(below, "id", "left").select(
        "id", F.lit("tree").alias("shape"), F.col("label").alias("root_id"), F.size("up").cast("bigint").alias("depth"), F.array_join(names, "/").alias("slug_path"), F.coalesce("n", F.lit(0)).alias("n_desc"), F.lit(None).cast("bigint").alias("back_edge_to")
    )
    rings = nodes.where("cyclic")
    on = rings.select(F.col("onward").alias("id")).distinct().withColumn("on", F.lit(True))
    minus = F.lit(-1).cast("bigint")
    loops = rings.join(on, "id", "left").select(
        "id", F.when(F.col("on"), "cycle").otherwise("tail").alias("shape"), F.col("label").alias("root_id"), minus.alias("depth"), F.lit("").alias("slug_path"), minus.alias("n_desc"),
        F.when(F.col("on") & (F.col("parent") == F.col("label")), F.col("label")).alias("back_edge_to"),
    )
    rows = trees.unionByName(loops)
    if not full:
        return rows.drop("back_edge_to")
    lists = state.select(F.explode("up.id").alias("id"), F.col("id").alias("d")).groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("descendants"))
    none = F.array().cast("array<bigint>")
    return rows.join(lists, "id", "left").select(*[c.split()[0] for c in SCHEMA.split(", ")], F.coalesce("descendants", none).alias("descendants"), "back_edge_to")


def _by_size(rows: DataFrame, id_col: str, parent_col: str, label_col: str, max_component: int) -> tuple[DataFrame, DataFrame | None]:
    """Labelled nodes of the components up to ``max_component``, and of the larger ones if there are any."""
    nodes = cut(label_components(clean_nodes(rows, id_col, parent_col, label_col)))
    big = nodes.groupBy("label").count().where(F.col("count") > max_component).select("label")
    if big.isEmpty():
        return nodes, None
    return nodes.join(big, "label", "left_anti"), cut(nodes.join(big, "label", "left_semi"))


def _walked(small: DataFrame, full: bool) -> DataFrame:
    return small.select("label", "id", "parent", "slug").repartition("label").sortWithinPartitions("label").mapInArrow(_walker(full), FULL_SCHEMA if full else SCHEMA)


def descendant_rows(rows: DataFrame, id_col: str = "id", parent_col: str = "supersedes", label_col: str = "slug", max_component: int = 50_000) -> DataFrame:
    """``id, descendant_id``: one row per tree node and descendant, of components of any size."""
    small, large = _by_size(rows, id_col, parent_col, label_col, max_component)
    out = _walked(small, True).select("id", F.explode("descendants").alias("descendant_id"))
    if large is None:
        return out
    return out.unionByName(ancestors(large).select(F.explode("up.id").alias("id"), F.col("id").alias("descendant_id")))


def hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "supersedes", label_col: str = "slug", max_component: int = 50_000, full: bool = False) -> DataFrame:
    """One row per id: shape (tree / cycle / tail), root_id, depth, slug_path and n_desc.

    ``tree``: a root is reached; root_id, depth (0 at the root), the labels from the root joined by
    ``/`` and the number of direct and indirect descendants. ``cycle`` (on a circle) and ``tail``
    (leads into one): root_id is the circle's smallest id, depth and n_desc -1, slug_path empty.
    A null parent or one that names no row makes a root; a row that is its own parent is a circle
    of one. Null ids are dropped, repeated rows count once, an empty table gives no rows.

    ``full`` adds the sorted array of all descendants and, on the node whose parent link closes a
    circle, ``back_edge_to``. The array of a node with very many descendants is one large value;
    :func:`descendant_rows` gives the same as rows.
    """
    small, large = _by_size(rows, id_col, parent_col, label_col, max_component)
    out = _walked(small, full)
    return out if large is None else out.unionByName(climb_large(large, full))
