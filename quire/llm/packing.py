"""Texts of varying length put into containers of fixed capacity, by patterns fitted with non-negative least squares.

Only the histogram of sizes, at most one number per possible size, reaches the driver. Patterns are sets of few different
sizes that fill a container exactly; their repeat counts are fitted to the histogram, rounded down, and what is left is
packed best fit first, whole counts at a time. The plan tells which ranks of a size go where, so its length does not follow
the number of texts, and every text finds its container from its size and its rank among those of the size.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.common import cut, slices, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with the default vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts from this length are split into pieces here and not by the tokenizer library; the tokens are the same.
LONG_TEXT = 20_000
#: Rows that share a size are ranked in parts of about so many.
RANK_ROWS = 100_000
#: Patterns that are fitted, about.
PATTERNS = 400_000
#: Distinct specifications, and the largest capacity, a call accepts: the histogram has at most this many cells each.
MAX_SPECS, MAX_CAPACITY = 100, 1 << 20


@lru_cache(maxsize=2)
def counter(path: str, pattern: str):
    """Function from a list of texts to their numbers of tokens; the library follows from the file's ending."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda texts: [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t)) for t in texts]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    import regex

    split = regex.compile(pattern)

    def one(text: str) -> int:
        if len(text) < LONG_TEXT:
            return len(encoding.encode_ordinary(text))
        # the library's own splitting overflows its stack on endless runs of one kind of character
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return sum(len(encoding._encode_single_piece(x)) for x in map(str.encode, split.findall(text)))

    return lambda texts: [one(t) for t in texts]


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(`doc_id`, `tokens`) of every row; null and empty texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count([t or "" for t in batch.column(1).to_pylist()]), pa.int64())], ["doc_id", "tokens"])

    return spread(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, tokens long")


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of at most three different sizes, each some times, that fill `capacity` exactly: indexes of sizes (-1: none) and times,
    three of each per pattern. Their number is bounded, whatever the capacity: the more sizes there are, the fewer partners each
    is tried with."""
    n = len(sizes)
    partners = int(np.clip(PATTERNS // (8 * max(1, n)), 1, 12))
    where = np.full(capacity + 1, -1, np.int64)
    where[sizes] = np.arange(n)
    most = capacity // sizes
    i = np.repeat(np.arange(n), 4)
    times = np.stack([most, np.maximum(1, most - 1), np.maximum(1, most // 2), np.ones_like(most)], 1).ravel()
    rest = capacity - times * sizes[i]
    whole = rest == 0
    single = np.stack([i[whole], times[whole]], 1)
    top = np.searchsorted(sizes, rest, "right")
    some = ~whole & (top > 0)
    i, times, rest, top = i[some], times[some], rest[some], top[some]
    # partners are spread over the histogram by weight, so frequent sizes are met more often; the largest that fits is one too
    weight = np.cumsum(counts)
    share = (np.arange(partners) + 0.5) / partners
    j = np.concatenate([np.minimum(np.searchsorted(weight, share[None, :] * weight[top - 1][:, None]), top[:, None] - 1), top[:, None] - 1], 1)
    first, b = np.broadcast_to(rest[:, None], j.shape), sizes[j]
    found = []
    for k in (first // b, np.ones_like(b)):
        last = first - k * b
        l = np.where(last > 0, where[last], -1)
        ok = (last == 0) | (l >= 0)
        found.append(np.stack([np.broadcast_to(i[:, None], j.shape)[ok], np.broadcast_to(times[:, None], j.shape)[ok], j[ok], k[ok], l[ok]], 1))
    t = np.concatenate(found)
    index = np.concatenate([np.stack([single[:, 0], np.full(len(single), -1), np.full(len(single), -1)], 1), t[:, [0, 2, 4]]])
    number = np.concatenate([np.stack([single[:, 1], np.zeros(len(single), np.int64), np.zeros(len(single), np.int64)], 1), np.stack([t[:, 1], t[:, 3], (t[:, 4] >= 0).astype(np.int64)], 1)])
    for a, b in ((0, 1), (0, 2), (1, 2)):  # one size named twice is one entry
        same = (index[:, a] == index[:, b]) & (index[:, b] >= 0)
        number[same, a] += number[same, b]
        index[same, b], number[same, b] = -1, 0
    order = np.argsort(-index, axis=1, kind="stable")
    index, number = np.take_along_axis(index, order, 1), np.take_along_axis(number, order, 1)
    rows = np.ascontiguousarray(np.concatenate([index, number], 1))
    rows = np.unique(rows.view(f"V{rows.itemsize * 6}").ravel()).view(np.int64).reshape(-1, 6) if len(rows) else rows
    return rows[:, :3], rows[:, 3:]


def fit(index: np.ndarray, number: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with least squares between their sizes and the histogram (accelerated projected
    gradient; rows are scaled so that rare sizes count too)."""
    column, slot = np.nonzero(index >= 0)
    row, value, n = index[column, slot], number[column, slot].astype(float), len(index)
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))
    value = value * scale[row]
    goal = counts * scale
    # columns are scaled to length one, which bounds the step by the number of patterns that share a size
    norm = np.sqrt(np.bincount(column, value**2, n))
    value = value / norm[column]
    times = lambda x: np.bincount(row, value * x[column], len(counts))
    back = lambda r: np.bincount(column, value * r[row], n)
    v = np.ones(n)
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ back(times(v))) + 1e-12)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - goal))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / later * (new - x), new, later
    return x / norm


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (size, first rank, number of ranks, first container, ranks per container) and the number of containers."""
    sizes = np.array(sorted(s for s in histogram if s > 0), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    rank = np.zeros(len(sizes), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0

    def place(i: int, containers: int, base: int, per: int) -> None:
        n = min(containers * per, int(left[i]))
        rows.append((int(sizes[i]), int(rank[i]), n, base, per))
        rank[i] += n
        left[i] -= n

    if len(sizes):
        index, number = patterns(sizes, left.astype(float), capacity)
        if len(index):
            x = fit(index, number, left.astype(float))
            for j in np.argsort(-x, kind="stable")[: int((x >= 1).sum())]:
                parts = [(int(i), int(m)) for i, m in zip(index[j], number[j], strict=True) if i >= 0]
                n = min([int(x[j]), *[int(left[i]) // m for i, m in parts]])
                if n > 0:
                    for i, m in parts:
                        place(i, n, used, m)
                    used += n
    # the rest, largest first: the fullest container that still has room; containers alike are handled as one group
    room: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def keep(space: int, base: int, n: int) -> None:
        if n and space:
            if space not in groups:
                bisect.insort(room, space)
                groups[space] = []
            groups[space].append((base, n))

    for i in range(len(sizes) - 1, -1, -1):
        s = int(sizes[i])
        while left[i]:
            at = bisect.bisect_left(room, s)
            if at < len(room):
                space = room[at]
                base, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    room.pop(at)
            else:
                space, base = capacity, used
                n = max(1, -(-int(left[i]) // (capacity // s)))
                used += n
            per = min(space // s, int(left[i]))
            fill = min(n, int(left[i]) // per)
            place(i, fill, base, per)
            keep(space - per * s, base, fill)
            keep(space, base + fill, n - fill)
    if histogram.get(0):
        used = max(used, 1)
        rows.append((0, 0, int(histogram[0]), 0, -used))  # texts without tokens: dealt over all containers
    return rows, used


def pack(sizes: DataFrame, specs: DataFrame, *, spec_key: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(`spec_id`, `container_id`, `doc_id`, `piece_no`, `start_token`, `tokens`) of every piece, for every specification.

    `sizes` (`doc_id`, `tokens`). A text is split, into pieces of the capacity and a rest, only if it alone exceeds the
    capacity. Texts without tokens take no space and are dealt over the containers. Container ids start at 0 in each
    specification. Empty tables give no rows; repeated ids are packed as texts of their own; specifications must have
    positive capacities.
    """
    spark = sizes.sparkSession
    wanted = [(int(a), int(b)) for a, b in specs.select(spec_key, capacity).where(F.col(capacity).isNotNull()).distinct().limit(MAX_SPECS + 1).collect()]
    if len(wanted) > MAX_SPECS or any(not 0 < c <= MAX_CAPACITY for _, c in wanted):
        raise ValueError("too many specifications, or a capacity out of range")
    sizes = cut(sizes)
    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"spec_id int, container_id long, doc_id {kind}, piece_no int, start_token long, tokens long"
    if not wanted:
        return spark.createDataFrame([], schema)
    spec = F.explode(F.array(*[F.struct(F.lit(a).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("c")) for a, c in wanted])).alias("s")
    each = sizes.select("doc_id", "tokens", spec).select("doc_id", "tokens", "s.spec_id", "s.c")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("c")).cast("int") - 1))
    pieces = each.select("*", F.explode(parts).alias("piece_no")).select(
        "spec_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("c")).alias("start_token"), F.least("c", F.col("tokens") - F.col("piece_no") * F.col("c")).alias("tokens")
    )
    rows = sizes.count()
    salts = max(4, -(-rows // RANK_ROWS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    cells = cut(pieces.groupBy("spec_id", "tokens", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram: dict[int, dict[int, int]] = {}
    for a, s, n in cells.groupBy("spec_id", "tokens").agg(F.sum("n")).collect():  # at most the sum of the capacities
        histogram.setdefault(a, {})[int(s)] = int(n)
    arrays = {}
    for a, c in wanted:
        got, _ = plan(histogram.get(a, {}), c)
        got.sort()
        t = np.array(got, np.int64).reshape(-1, 5)
        arrays[a] = ((t[:, 0] << 40) + t[:, 1], t[:, 1], t[:, 3], t[:, 4])
    held = spark.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spec_id, size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("spec_id", "tokens", "rank"))
            box = np.zeros(len(rank), np.int64)
            for a in np.unique(spec_id):
                key, first, base, per = held.value[int(a)]
                mine = np.flatnonzero(spec_id == a)
                at = np.searchsorted(key, (size[mine] << 40) + rank[mine], "right") - 1
                place = rank[mine] - first[at]
                box[mine] = base[at] + np.where(per[at] > 0, place // np.maximum(per[at], 1), place % np.maximum(-per[at], 1))
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([col("spec_id"), pa.array(box), col("doc_id"), col("piece_no"), col("start_token"), col("tokens")], ["spec_id", "container_id", "doc_id", "piece_no", "start_token", "tokens"])

    from pyspark.sql import Window

    before = cells.withColumn("offset", F.sum("n").over(Window.partitionBy("spec_id", "tokens").orderBy("part")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("spec_id", "tokens", "part").orderBy("doc_id", "piece_no")) - 1
    ranked = pieces.withColumn("local", local).join(before, ["spec_id", "tokens", "part"])
    return ranked.select("spec_id", "doc_id", "piece_no", F.col("start_token").cast("long").alias("start_token"), F.col("tokens").cast("long").alias("tokens"), (F.col("local") + F.col("offset")).alias("rank")).mapInArrow(run, schema)


def usage(packed: DataFrame, specs: DataFrame, *, spec_key: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(`spec_id`, `containers`, `tokens`, `unused`): containers per specification and the share of space left unused."""
    boxes = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = boxes.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    size = specs.select(F.col(spec_key).alias("spec_id"), F.col(capacity).alias("c"))
    return total.join(size, "spec_id").select("spec_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("c"))).alias("unused"))


def faults(packed: DataFrame, sizes: DataFrame, specs: DataFrame, *, spec_key: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(`spec_id`, `texts`, `over_full`, `lost`, `torn`) of each specification: texts packed, containers that hold more than they may,
    texts of `sizes` (`doc_id`, `tokens`) whose pieces are not all there, and texts split although they fit."""
    size = specs.select(F.col(spec_key).alias("spec_id"), F.col(capacity).alias("c"))
    boxes = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t")).join(size, "spec_id")
    over = boxes.groupBy("spec_id").agg(F.count(F.when(F.col("t") > F.col("c"), 1)).alias("over_full"))
    texts = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("tokens")).alias("end"))
    want = sizes.crossJoin(F.broadcast(size))  # a few specifications
    both = want.join(texts, ["spec_id", "doc_id"], "left")
    bad = F.col("got").isNull() | (F.col("got") != F.col("tokens")) | (F.col("end") != F.col("tokens"))
    out = both.groupBy("spec_id").agg(F.count("got").alias("texts"), F.count(F.when(bad, 1)).alias("lost"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("c")), 1)).alias("torn"))
    return out.join(over, "spec_id").select("spec_id", "texts", "over_full", "lost", "torn")
