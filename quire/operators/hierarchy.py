"""Parent-child links to hierarchies: root, depth, path pieces and cycles, by contraction of fragments.

Nodes are dealt into buckets. Inside a bucket, chains of parents are followed to the fragment's exit, the last node whose
parent lies in the same bucket. The exits form a smaller forest with weighted edges, which is solved the same way, and its
solution is expanded to all nodes of the fragments. An edge also has the smallest id on the way it stands for, without the
node it starts from, so that a cycle of exits gets the smallest id of all nodes on it. A level deals nodes out by blocks of neighbouring ids while that
keeps enough parents local, else by coin tosses: a tail joins the bucket of its parent if that is a head, so at least about
a quarter of the inner nodes is contracted whatever the ids are. What fits in BASE nodes is solved by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.common import cut, parallelism, skew_lookup
from quire.operators.storage import dense_ids

#: Nodes of a quotient forest that one task solves: four arrays of 8 bytes each.
BASE = 50_000
#: Ids per block at the first level, as a power of two; blocks of a quotient are wider.
BLOCK_BITS = 15
#: Share of edges that must be inside blocks for a level to deal nodes out by blocks.
LOCAL = 0.35
#: Nodes a bucket of coin tosses should hold.
BUCKET = 100_000


#: Smallest id of a way without edges.
NONE = np.iinfo(np.int64).max


def follow(ids: np.ndarray, parents: np.ndarray, weights: np.ndarray, leasts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node the last node of its chain of parents within `ids`, the distance to it, the smallest of `leasts` of the
    edges to it (NONE: no edge), and the smallest one of the cycle the chain ends in (-1: none; top, distance and smallest
    mean nothing then). Parents: -1 for none. `ids` are distinct."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parents)
    at[at == n] = 0
    up = order[at] if n else at
    local = (parents >= 0) & (ids[up] == parents) if n else np.zeros(0, bool)
    here = np.arange(n)
    up = np.where(local, up, here)
    far = np.where(local, weights, 0)
    low = np.where(local, leasts, NONE)
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        if (up[up] == up).all() and not local[up].any():
            break
        far = far + far[up]
        low = np.minimum(low, low[up])
        up = up[up]
    cycle = np.full(n, -1, np.int64)
    endless = np.flatnonzero(local[up])  # a chain that has not ended after n steps is on or before a cycle
    if len(endless):
        step = np.where(local, order[at], here)
        least, jump = np.where(local, leasts, NONE), step.copy()
        for _ in range(max(1, math.ceil(math.log2(n + 1)))):
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        cycle[endless] = least[up[endless]]  # n steps on, the chain is on the cycle, and all that follows is the cycle
    return ids[up], far, low, cycle


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets (bucket, id, parent, weight, least) -> (id, top, dist, low, exit_parent, exit_weight, exit_least, cycle)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    bucket, ids, parents, weights, leasts = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
    # a node follows its parent only inside its bucket, so the result does not depend on which buckets share a task
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        i, p, w, m = ids[part], parents[part], weights[part], leasts[part]
        top, dist, low, cycle = follow(i, p, w, m)
        back = np.argsort(i, kind="stable")
        end = back[np.searchsorted(i[back], top)]
        out_p, out_w, out_m = p[end], w[end], m[end]
        none = (out_p < 0) | (cycle >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(top), pa.array(dist), pa.array(low), pa.array(out_p, mask=none), pa.array(out_w), pa.array(out_m), pa.array(cycle, mask=cycle < 0)], ["id", "top", "dist", "low", "exit_parent", "exit_weight", "exit_least", "cycle"])


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    ids, parents, weights, leasts = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
    top, dist, _, cycle = follow(ids, parents, weights, leasts)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(cycle >= 0, cycle, top)), pa.array(np.where(cycle >= 0, -1, dist))], ["id", "root", "depth"])


_SOLVED = "id long, root long, depth long"
_LEVEL = "id long, top long, dist long, low long, exit_parent long, exit_weight long, exit_least long, cycle long"


def _solve(nodes: DataFrame, n: int, bits: int, level: int, base: int, bucket: int) -> DataFrame:
    """(id, root, depth) of a forest (id, parent, weight, least); parent -1: none, any other may be missing. `nodes` is cut."""
    spark = nodes.sparkSession
    if n <= base and level:
        return nodes.repartition(1).mapInArrow(_base, _SOLVED)
    block = lambda c: F.shiftright(c, bits)
    edges, inside = nodes.where("parent >= 0").agg(F.count(F.lit(1)), F.count(F.when(block(F.col("id")) == block(F.col("parent")), 1))).first()
    if not edges or inside >= LOCAL * edges or (not level and inside >= 0.1 * edges):
        dealt, leaves = nodes.select(block(F.col("id")).alias("bucket"), "id", "parent", "weight", "least"), None
    else:
        # leaves wait until their parents are solved; so a parent of very many nodes does not keep the forest large
        children = nodes.where("parent >= 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        marked = cut(nodes.join(children.select(F.col("parent").alias("id"), F.lit(True).alias("inner_")), "id", "left"))
        leaves = marked.where("inner_ is null").select("id", "parent", "weight")
        nodes = marked.where("inner_").select("id", "parent", "weight", "least")
        # the parents of most nodes, a bounded list, draw no nodes to their bucket
        hot = F.broadcast(children.orderBy(F.desc("n"), "parent").limit(512).where(F.col("n") > bucket // 8).select("parent", F.lit(True).alias("hot_")))
        head = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
        anchor = F.when(~head(F.col("id")) & (F.col("parent") >= 0) & head(F.col("parent")) & F.col("hot_").isNull(), F.col("parent")).otherwise(F.col("id"))
        buckets = max(1, -(-n // bucket))
        dealt = nodes.join(hot, "parent", "left").select(F.pmod(F.xxhash64(anchor), F.lit(buckets)).alias("bucket"), "id", "parent", "weight", "least")
    parts = max(parallelism(spark), -(-n // 500_000))
    contracted = cut(dealt.repartition(parts, "bucket").mapInArrow(_contract, _LEVEL))

    exits = contracted.where("id = top and exit_parent is not null").select("id", "exit_parent", "exit_weight", "exit_least")
    counts = exits.groupBy("exit_parent").agg(F.count(F.lit(1)).alias("n"))
    ends = contracted.select(F.col("id").alias("exit_parent"), F.col("top").alias("p_top"), F.col("dist").alias("p_dist"), F.col("low").alias("p_low"), F.col("cycle").alias("p_cycle"))
    found = skew_lookup(exits, "exit_parent", ends, counts=counts)
    # a parent that is nowhere makes a root; one on the way into a cycle passes the cycle on as a root of weight null
    quotient = found.select("id", F.when(F.col("p_cycle").isNull(), F.coalesce("p_top", F.lit(-1))).otherwise(-1).alias("parent"), F.when(F.col("p_top").isNull(), 0).otherwise(F.col("exit_weight") + F.col("p_dist")).alias("weight"), F.least("exit_least", "p_low").alias("least"), F.col("p_cycle").alias("cycle"))
    quotient = cut(quotient.unionByName(contracted.where("id = top and exit_parent is null and cycle is null").join(found.select(F.col("p_top").alias("id")).distinct(), "id", "left_semi").select("id", F.lit(-1).cast("long").alias("parent"), F.lit(0).cast("long").alias("weight"), F.lit(int(NONE)).cast("long").alias("least"), F.lit(None).cast("long").alias("cycle"))))
    m = quotient.count()
    above = _solve(quotient.select("id", "parent", "weight", "least"), m, min(bits + 4, 60), level + 1, base, bucket)
    loops = quotient.where("cycle is not null").select("id", "cycle")
    above = above.join(loops.withColumnRenamed("id", "root"), "root", "left").select(F.col("id").alias("top"), F.coalesce("cycle", "root").alias("root"), F.when(F.col("cycle").isNotNull(), -1).otherwise(F.col("depth")).alias("depth"))
    solved = contracted.select("id", "top", "dist", "cycle").join(above, "top", "left").select(
        "id",
        F.coalesce("cycle", "root", "top").alias("root"),
        F.when(F.col("cycle").isNotNull() | (F.col("depth") < 0), -1).otherwise(F.coalesce("depth", F.lit(0)) + F.col("dist")).alias("depth"),
    )
    if leaves is None:
        return solved
    solved = cut(solved)
    rest = skew_lookup(leaves, "parent", solved.select(F.col("id").alias("parent"), "root", "depth"), counts=leaves.groupBy("parent").agg(F.count(F.lit(1)).alias("n")))
    return solved.unionByName(rest.select("id", F.coalesce("root", "id").alias("root"), F.when(F.col("depth") < 0, -1).when(F.col("root").isNull(), 0).otherwise(F.col("depth") + F.col("weight")).alias("depth")))


def links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row (id, parent) per id: rows without an id are left out, parent is -1 for none (null or 0).

    If one id comes with several parents, the greatest is taken."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent")).where("id is not null and id >= 0").groupBy("id").agg(F.max(F.when(F.col("parent") > 0, F.col("parent")).otherwise(-1)).alias("parent"))


def hierarchy(df: DataFrame, *, id_col: str = "id", parent_col: str = "previous_id", base: int = BASE, bits: int = BLOCK_BITS, bucket: int = BUCKET) -> DataFrame:
    """(`id`, `root_id`, `depth`) for each distinct id of `df`.

    A node without a parent, or whose parent is not in `df`, is its own root at depth 0. Where the chain of parents ends in
    a cycle, `root_id` is the smallest id on it and `depth` -1. Null ids are left out; an empty table gives no rows;
    repeated rows count once; other columns are not read. Ids must not be negative.
    """
    nodes = cut(links(df, id_col, parent_col).withColumns({"weight": F.lit(1).cast("long"), "least": F.col("parent")}))
    n = nodes.count()
    return _solve(nodes, n, bits, 0, base, bucket).select(F.col("id").alias("id"), F.col("root").alias("root_id"), "depth")


def _forest(df: DataFrame, id_col: str, parent_col: str, how: dict) -> tuple[DataFrame, DataFrame]:
    """`hierarchy` of `df`, and the links (id, parent) between nodes whose history ends; both written."""
    whole = cut(hierarchy(df, id_col=id_col, parent_col=parent_col, **how))
    return whole, cut(links(df, id_col, parent_col).join(whole.where("depth > 0").select("id"), "id", "left_semi"))


def _sizes(whole: DataFrame, edges: DataFrame, how: dict) -> DataFrame:
    """(`id`, `size`): nodes of the subtree of each node whose history ends, itself included.

    A walk around each tree enters and leaves every node once; it is a list of twice as many steps, and the distance of a step
    to the end of the list is its depth in a forest without branches. So the shape of the trees is no matter: a subtree has
    half as many nodes as there are steps from entering to leaving it."""
    enter, leave = (lambda c: F.col(c) * 2 + 2), (lambda c: F.col(c) * 2 + 3)
    first = edges.groupBy("parent").agg(F.min("id").alias("child")).withColumnRenamed("parent", "id")
    # the next child of the same parent: the next edge in order, so that a parent of very many children is no window of one task
    listed = cut(dense_ids(edges.select(F.col("id").alias("node"), "parent"), 0, [F.col("parent"), F.col("node")]))
    after = listed.select((F.col("id") - 1).alias("id"), F.col("node").alias("next"), F.col("parent").alias("of"))
    siblings = listed.join(after, "id", "left").select(F.col("node").alias("id"), "parent", F.when(F.col("of") == F.col("parent"), F.col("next")).alias("next"))
    nodes = whole.where("depth >= 0").select("id").join(first, "id", "left").join(siblings, "id", "left")
    there = F.struct(enter("id").alias("step"), F.coalesce(enter("child"), leave("id")).alias("then"))
    back = F.struct(leave("id").alias("step"), F.coalesce(enter("next"), leave("parent")).alias("then"))
    steps = nodes.select(F.explode(F.array(there, back)).alias("s")).select("s.*")
    walked = hierarchy(steps, id_col="step", parent_col="then", **how)
    # both steps of a node are rows of one key
    return walked.groupBy(F.shiftright(F.col("id") - 2, 1).alias("id")).agg(((F.max("depth") - F.min("depth") + 1) / 2).cast("long").alias("size"))


def path_pieces(df: DataFrame, *, id_col: str = "id", parent_col: str = "previous_id", **how) -> DataFrame:
    """Full paths in linear space: (`id`, `piece_id`, `position`, `from_piece`, `from_position`, `root_id`, `depth`).

    Each node passes its line on to the child with the largest subtree (ties: the smallest id), so the forest falls into pieces
    without branches, and a path over n nodes changes its piece at most log2 n times. `piece_id` is the first node of the
    node's piece and `position` its place there; the piece hangs below the node at `from_position` of piece `from_piece`
    (null: it starts at a root). The path of a node is the piece's part up to it, before that the part of `from_piece` up to
    `from_position`, and so on; its descendants are the nodes after it on its piece and those of all pieces below one of
    these. Nodes of endless histories have null pieces and depth -1.
    """
    whole, edges = _forest(df, id_col, parent_col, how)
    sized = edges.join(_sizes(whole, edges, how), "id")
    heirs = sized.groupBy("parent").agg(F.min_by("id", F.struct(-F.col("size"), "id")).alias("id")).select("id", F.col("parent").alias("heir_of"))
    lines = whole.where("depth >= 0").join(heirs, "id", "left").select("id", F.col("heir_of").alias("parent"))
    placed = cut(hierarchy(lines, id_col="id", parent_col="parent", **how).select("id", F.col("root_id").alias("piece_id"), F.col("depth").alias("position")))
    heads = edges.join(placed.where("position = 0").select("id"), "id", "left_semi")
    table = placed.select(F.col("id").alias("parent"), F.col("piece_id").alias("from_piece"), F.col("position").alias("from_position"))
    hung = skew_lookup(heads, "parent", table, counts=heads.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))).select(F.col("id").alias("piece_id"), "from_piece", "from_position")
    sizes = placed.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(skew_lookup(placed, "piece_id", hung, counts=sizes), "id", "left").select("id", "piece_id", "position", "from_piece", "from_position", "root_id", "depth")


#: Positions of a piece are worked off in blocks of this length, so that a long piece is no single join key.
SPAN = 1024


def _along(front: DataFrame, table: DataFrame, piece: str, place: str) -> DataFrame:
    """Rows of `table` on the piece of each row of `front` (id, piece, low, high) at places from `low` to `high`."""
    f = front.select("*", F.explode(F.sequence(F.floor(F.col("low") / SPAN), F.floor(F.col("high") / SPAN))).alias("span"))
    t = table.withColumn("span", F.floor(F.col(place) / SPAN)).withColumnRenamed(piece, "piece")
    return f.join(t, ["piece", "span"]).where((F.col(place) >= F.col("low")) & (F.col(place) <= F.col("high")))


def _look(front: DataFrame, table: DataFrame) -> DataFrame:
    return skew_lookup(front, "piece", table, counts=front.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), how="inner")


def ancestors(pieces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(`id`, `ancestor_id`, `distance`) for each id of `nodes` (id) and each node on its path, itself at distance 0.

    `pieces` comes from `path_pieces` and should be stored. At most log2 n rounds, one per change of piece on a path; the result is as
    large as the paths are long, so `nodes` should be a part of the forest. Nodes of endless histories have no path."""
    member = pieces.where("piece_id is not null").select(F.col("piece_id").alias("of_piece"), "position", F.col("id").alias("ancestor_id"), F.col("depth").alias("at"))
    heads = pieces.where("position = 0 and from_piece is not null").select(F.col("piece_id").alias("piece"), "from_piece", "from_position")
    front = cut(nodes.select("id").distinct().join(pieces.where("piece_id is not null"), "id").select("id", F.col("depth").alias("own"), F.col("piece_id").alias("piece"), F.lit(0).cast("long").alias("low"), F.col("position").alias("high")))
    out = None
    while out is None or not front.isEmpty():
        part = _along(front, member, "of_piece", "position").select("id", "ancestor_id", (F.col("own") - F.col("at")).alias("distance"))
        out = part if out is None else out.unionByName(part)
        front = cut(_look(front, heads).select("id", "own", F.col("from_piece").alias("piece"), "low", F.col("from_position").alias("high")))
    return out


def descendants(pieces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(`id`, `descendant_id`, `distance`) for each id of `nodes` (id) and each node after it; see `ancestors`."""
    member = pieces.where("piece_id is not null").select(F.col("piece_id").alias("of_piece"), "position", F.col("id").alias("descendant_id"), F.col("depth").alias("at"))
    length = pieces.where("piece_id is not null").groupBy(F.col("piece_id").alias("piece")).agg(F.max("position").alias("last"))
    hung = pieces.where("position = 0 and from_piece is not null").select(F.col("piece_id").alias("next"), "from_piece", "from_position")
    start = nodes.select("id").distinct().join(pieces.where("piece_id is not null"), "id").select("id", F.col("depth").alias("own"), F.col("piece_id").alias("piece"), F.col("position").alias("low"))
    front = cut(_look(start, length).select("id", "own", "piece", "low", F.col("last").alias("high")))
    out = None
    while out is None or not front.isEmpty():
        part = _along(front, member, "of_piece", "position").where("at > own").select("id", "descendant_id", (F.col("at") - F.col("own")).alias("distance"))
        out = part if out is None else out.unionByName(part)
        below = _along(front, hung, "from_piece", "from_position").select("id", "own", F.col("next").alias("piece"))
        front = cut(_look(below, length).select("id", "own", "piece", F.lit(0).cast("long").alias("low"), F.col("last").alias("high")))
    return out


def descendant_counts(df: DataFrame, *, id_col: str = "id", parent_col: str = "previous_id", **how) -> DataFrame:
    """(`id`, `descendants`) for each id of `df`: how many nodes come after it, -1 for nodes of endless histories. The result is
    linear in size, and no round depends on how trees branch."""
    whole, edges = _forest(df, id_col, parent_col, how)
    return whole.select("id").join(_sizes(whole, edges, how), "id", "left").select("id", F.coalesce(F.col("size") - 1, F.lit(-1).cast("long")).alias("descendants"))
