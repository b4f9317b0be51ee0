"""Near-duplicate detection with BagMinHash signatures of shingle multisets.

Signatures. A multiset gives every shingle an integer weight w. For each shingle
the weight axis is cut into the dyadic levels [0,1), [1,2), [2,4), [4,8), ... and
each level below w carries a Poisson process of points (time, position in the
level), generated from a hash of shingle and level alone. Positions are refined
hierarchically, halving by halving (the bits of one uniform integer); points at or
above w are passed over, so two multisets share exactly the points below the
smaller weight. Every point goes to one of ``m`` registers, which keeps its
earliest point. Two registers agree with the probability of the weighted Jaccard
similarity sum(min)/sum(max). Processes stop at the time by which all registers
are filled, so the cost is the number of distinct levels plus O(m log m).

Bands of the registers propose, an exact comparison of the multisets decides.

Groups. Texts are compared by their 128-bit digest, so exact copies are one node
before any band is looked at; nodes have a number each. Each bucket (band value) has a
hub, its member of most bucket mates; the members of all buckets of one hub form a group,
which holds every pair that shares a bucket. A group is first compared with its hub: what
is linked to it is of its class, and pairs of such members need no test. Then every other
member is compared with the whole group. Both times the group is cut into blocks of
bounded rows and bytes, and each pair of blocks that holds pairs to be tested is a task:
register agreement of a pair of blocks is one matrix operation. First only the nodes with
a partner of enough agreement are found (signatures only), then these nodes' multisets
are compared. A block pair emits no pairs but a spanning forest of its verified links, at
most one row a node; links within one class are not tested again. So n near copies of a
text cost n comparisons, not n^2. No cap is set on group sizes.

Classes are the connected components of the links, found by alternating large-star
and small-star steps each written to the shared folder; nothing is collected.

Defined results: null and empty texts, and those of white space only, have no
shingles and equal nothing (each row is its own class); texts below five words are
one shingle of all their words. Null ids are kept; a class's id is its smallest
non-null id. Rows that repeat an id with another text are judged each by its text.
Empty tables give no rows; extra columns are ignored or, in ``keep_one_per_class``,
carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import plain_columns, sized, small_batches, thrifty, written

U64 = np.uint64
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
BLOCK_NODES, BLOCK_BYTES = 128, 8 << 20
# Joins over nodes and links ask for sort-merge: both sides grow with the data, and the many
# small broadcasts that small tables would get fill the driver's memory.

#: Standard deviations of register agreement below the threshold that still pass.
SLACK = 5.0
#: Parts of a group, by number of the node, when members meet the sizes of large groups.
SALT = 64


def _run_processes(times: np.ndarray, m: int, seed: np.ndarray, row: np.ndarray, stop: np.ndarray, low: int, size: int, limit: np.ndarray | None) -> None:
    """Runs one level's Poisson processes (rate ``size``) up to their rows' stop times.

    Processes that expect more points draw more at a time.
    """
    expected = stop[row] * size
    for least, most, points in ((0, 2, 1), (2, 16, 4), (16, np.inf, 32)):
        own = np.flatnonzero((expected >= least) & (expected < most))
        if len(own):
            _run_alike(times, m, seed[own], row[own] * m, stop[row[own]], low, size, None if limit is None else limit[own], points)


def _run_alike(times: np.ndarray, m: int, seed: np.ndarray, slot: np.ndarray, stop: np.ndarray, low: int, size: int, limit: np.ndarray | None, points: int) -> None:
    """``points`` points a round from each process. 44 bits of a hash give the waiting
    time, 20 the register; a second hash refines the position where a level is wider
    than one unit."""
    at, drawn = np.zeros(len(seed)), 0
    while len(seed):
        numbers = np.arange(drawn + 1, drawn + 1 + points, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
        drawn += points
        bits = textkit.mix(seed[:, None] + numbers)
        waits = np.log(((bits >> U64(20)).astype(np.float64) + 0.5) * 2.0**-44)
        waits *= -1.0 / size
        arrivals = at[:, None] + (np.cumsum(waits, axis=1) if points > 1 else waits)
        process, k = np.nonzero(arrivals < stop[:, None])
        bits, arrived = bits[process, k], arrivals[process, k]
        register = slot[process] + ((bits & U64(0xFFFFF)) * U64(m) >> U64(20)).astype(np.int64)
        if limit is not None:
            place = ((textkit.mix(~bits) >> U64(20)).astype(np.float64) * (2.0**-44 * size)).astype(np.int64) + low
            valid = place < limit[process]
            register, arrived = register[valid], arrived[valid]
        np.minimum.at(times, register, arrived)
        at = arrivals[:, -1]
        live = np.flatnonzero(at < stop)
        seed, slot, stop, at = seed[live], slot[live], stop[live], at[live]
        limit = None if limit is None else limit[live]


def bag_signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (uint64, one row of ``m`` a multiset) of multisets given as distinct
    (hash, row) with integer weights, ordered by row. Rows without elements keep infinity."""
    times = np.full(n_rows * m, np.inf)
    total = np.bincount(rows, weights, n_rows)
    stop = m * (np.log(m) + 3.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        picked = slice(None) if todo.all() else todo[rows]
        h, r, w = hashes[picked], rows[picked], weights[picked]
        _run_processes(times, m, textkit.mix(h + U64(0xA24BAED4963EE407)), r, stop, 0, 1, None)
        low = 1
        while len(h := h[more := w > low]):
            r, w = r[more], w[more]
            seed = textkit.mix(h + U64((low + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
            _run_processes(times, m, seed, r, stop, low, low, w)
            low *= 2
        todo &= ~np.isfinite(times).reshape(n_rows, m).all(axis=1)
        stop[todo] *= 1.6  # these rows run again, from the same hashes
    return times.reshape(n_rows, m).view(np.uint64)


def band_values(registers: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit value a band (int64, ``bands`` columns)."""
    value = np.broadcast_to(textkit.mix(np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)), (len(registers), bands))
    for k in range(width):
        value = textkit.mix(value + registers[:, k : bands * width : width])
    return value.view(np.int64)


def signatures(documents: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """``doc_id, node, weight, registers, bands`` for every row; texts without words
    have null ``node``. Registers are 16-bit prints, enough to estimate agreement."""
    m = bands * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, end, hashes, rows in textkit.words_by_row(texts):
                n = end - first
                grams, own = textkit.shingles(hashes, rows, shingle)
                h, r, w = textkit.multisets(grams, own)
                registers = bag_signatures(h, r, w, n, m)
                values = band_values(registers, bands, width)
                prints = (textkit.mix(registers) >> U64(48)).astype(np.uint16)
                weight = np.bincount(r, w, n).astype(np.int64)
                data, offsets = textkit.text_buffer(texts.slice(first, n))
                nodes = [hashlib.md5(data[offsets[k] : offsets[k + 1]]).digest() if weight[k] else None for k in range(n)]
                bare = weight == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(nodes, pa.binary()),
                        pa.array(weight),
                        pa.array([None if b else p.tobytes() for b, p in zip(bare, prints)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(values.ravel())),
                    ],
                    ["doc_id", "node", "weight", "registers", "bands"],
                )
    kind = documents.select("doc_id").dtypes[0][1]
    return small_batches(documents).select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind}, node binary, weight long, registers binary, bands array<long>")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by ``keys``, each as one table; only one is held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for row in range(len(values)):
            if values[row] != last:
                if row > start:
                    held.append(batch.slice(start, row - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], values[row], row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def agreeing_pairs(prints: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, agreeing registers) of one block, or between two, that may be similar."""
    m = prints.shape[1]
    least = m * similarity - SLACK * np.sqrt(m * similarity * (1 - similarity))
    a_all, b_all, n_all = [], [], []
    same = left is right
    for k, a in enumerate(left):
        others = right[k + 1 :] if same else right
        w = weights[others]
        others = others[np.minimum(w, weights[a]) >= similarity * np.maximum(w, weights[a])]
        if not len(others):
            continue
        agree = (prints[others] == prints[a]).sum(axis=1)
        good = agree >= least
        if good.any():
            b_all.append(others[good])
            n_all.append(agree[good])
            a_all.append(np.full(int(good.sum()), a))
    if not a_all:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(a_all), np.concatenate(b_all), np.concatenate(n_all)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as sorted hashes and counts."""
    (ha, wa), (hb, wb) = a, b
    at = np.searchsorted(ha, hb)
    at[at == len(ha)] = 0
    shared = ha[at] == hb
    common = int(np.minimum(wa[at[shared]], wb[shared]).sum())
    return common / (int(wa.sum()) + int(wb.sum()) - common)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block = table.column("block").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j)


def _prints(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(table.num_rows, -1)


def similar_nodes(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The nodes of each block pair that have a partner of enough agreement."""
    for table in sorted_groups(batches, ["hub", "i", "j"]):
        left, right = _sides(table)
        a, b, _ = agreeing_pairs(_prints(table), table.column("weight").to_numpy(), left, right, similarity)
        if len(a):
            yield from table.select(["hub", "id"]).take(pa.array(np.unique(np.concatenate([a, b])))).to_batches()


def verified_links(batches: Iterator[pa.RecordBatch], similarity: float, known: bool) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each block pair's links of at least ``similarity``. ``known``
    says that the members which are not open are of one class already."""
    for table in sorted_groups(batches, ["hub", "i", "j"]):
        left, right = _sides(table)
        a, b, n = agreeing_pairs(_prints(table), table.column("weight").to_numpy(), left, right, similarity)
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        root = list(range(table.num_rows))
        if known and len(one := np.flatnonzero(~table.column("open").to_numpy())):
            for k in one.tolist():
                root[k] = int(one[0])

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found: list[tuple[int, int]] = []
        for k in np.argsort(-n, kind="stable"):
            x, y = int(a[k]), int(b[k])
            rx, ry = find(x), find(y)
            if rx == ry:
                continue
            for v in (x, y):
                if v not in bags:
                    bags[v] = (
                        np.frombuffer(table.column("grams")[v].as_py(), np.uint64),
                        np.frombuffer(table.column("counts")[v].as_py(), np.uint32).astype(np.int64),
                    )
            if jaccard(bags[x], bags[y]) >= similarity:
                root[ry] = rx
                found.append((x, y))
        if found:
            ids = table.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[[f[0] for f in found]]), pa.array(ids[[f[1] for f in found]])], ["a", "b"])


def bags(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, grams, counts`` of each ``(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, rows in textkit.words_by_row(batch.column(1)):
                h, r, w = textkit.multisets(*textkit.shingles(hashes, rows, shingle))
                cut = np.searchsorted(r, np.arange(end - first + 1))
                spans = list(zip(cut[:-1], cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array([h[x:y].tobytes() for x, y in spans], pa.binary()),
                        pa.array([w[x:y].astype(np.uint32).tobytes() for x, y in spans], pa.binary()),
                    ],
                    ["id", "grams", "counts"],
                )

    return small_batches(texts).select("id", "text").mapInArrow(thrifty(run), "id long, grams binary, counts binary")


def block_pairs(members: DataFrame, cost: str) -> DataFrame:
    """Cuts each hub's members (``hub, id, open, ...``) into blocks of bounded rows and
    ``cost`` bytes, open members apart from others, and deals every pair of blocks
    (``i`` <= ``j``) with an open one to a task of its own, sorted by pair.

    Groups of one block each are not looked up; members of larger ones meet their group's
    figures in ``SALT`` parts, so that no task gets a whole group.
    """

    def blocks(kind: str) -> Column:
        return F.greatest(F.ceil(F.col(f"n_{kind}") / BLOCK_NODES), F.ceil(F.col(f"bytes_{kind}") / BLOCK_BYTES)).cast("long")

    sizes = members.groupBy("hub").agg(
        *[F.sum(F.when(c, 1).otherwise(0)).alias(f"n_{k}") for k, c in (("open", F.col("open")), ("shut", ~F.col("open")))],
        *[F.sum(F.when(c, F.col(cost)).otherwise(0)).alias(f"bytes_{k}") for k, c in (("open", F.col("open")), ("shut", ~F.col("open")))],
    )
    counts = sizes.select("hub", blocks("open").alias("n_i"), blocks("shut").alias("n_j"))
    several = counts.where("n_i != 1 OR n_j > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    one = F.lit(1).cast("long")
    placed = members.withColumn("salt", F.expr(f"pmod(xxhash64(id), {SALT})")).join(several, ["hub", "salt"], "left")
    placed = placed.withColumns({"n_i": F.coalesce("n_i", one), "n_j": F.coalesce("n_j", one)}).where("n_i > 0")
    spread = F.expr("CASE WHEN open THEN pmod(xxhash64(id, 1), n_i) ELSE n_i + pmod(xxhash64(id, 1), greatest(n_j, 1)) END")
    placed = placed.withColumn("block", spread.cast("long"))
    last = F.expr("CASE WHEN open THEN n_i + n_j - 1 ELSE n_i - 1 END")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.drop("n_i", "n_j", "other", "salt").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def hub_members(nodes: DataFrame) -> DataFrame:
    """``hub, id``: all nodes of the buckets of one hub. ``nodes`` has ``id, bands``."""
    placed = nodes.select("id", F.explode("bands").alias("band"))
    full = placed.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    mates = written(placed.join(full.hint("merge"), "band"), "bucket-mates")
    degree = mates.groupBy("id").agg(F.sum("mates").alias("degree"))
    by_degree = mates.select("band", "id").join(degree.hint("merge"), "id")
    most = by_degree.groupBy("band").agg(F.max("degree").alias("degree"))
    hubs = by_degree.join(most.hint("merge"), ["band", "degree"]).groupBy("band").agg(F.max("id").alias("hub"))
    return mates.select("band", "id").join(hubs.hint("merge"), "band").select("hub", "id").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, root`` of every node of ``links`` (a, b), by alternating star steps."""

    def both(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        return pairs.join(least.hint("merge"), "u")

    edges = written(links.where("a != b").distinct(), "edges")
    seen = None
    while True:
        large = star(both(edges)).where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        starred = star(down)
        small = starred.select(F.col("v").alias("a"), F.col("low").alias("b")).union(starred.select(F.col("u").alias("a"), F.col("low").alias("b")))
        edges = written(small.where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = now


def open_links(members: DataFrame, nodes: DataFrame, documents: DataFrame, similarity: float, shingle: int, known: bool) -> DataFrame:
    """Links (``a, b``) of every open member of ``members`` (``hub, id, open``) with the
    members of its group."""
    signed = members.join(nodes.select("id", "weight", "registers").hint("merge"), "id").withColumn("cost", F.lit(2 * REGISTERS))
    pairs = block_pairs(signed, "cost").select("hub", "i", "j", "block", "id", "weight", "registers")
    likely = written(pairs.mapInArrow(thrifty(lambda x: similar_nodes(x, similarity)), "hub long, id long").distinct(), "likely-nodes")
    wanted = sized(likely.select("id").distinct().join(nodes.select("id", "node").hint("merge"), "id"))
    texts = documents.select(F.unhex(F.md5("text")).alias("node"), "text").join(wanted, "node").dropDuplicates(["id"])
    full = members.join(likely.hint("merge"), ["hub", "id"]).join(nodes.select("id", "weight", "registers").hint("merge"), "id").join(bags(texts, shingle).hint("merge"), "id")
    full = full.withColumn("cost", F.octet_length("grams") + F.octet_length("counts"))
    pairs = block_pairs(full, "cost").select("hub", "i", "j", "block", "id", "open", "weight", "registers", "grams", "counts")
    return written(pairs.mapInArrow(thrifty(lambda x: verified_links(x, similarity, known)), "a long, b long"), "links")


def _classes(documents: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``doc_id, node, root, class_id`` for every row; null node without words."""
    signed = written(signatures(documents, shingle), "bag-signatures")
    worded = signed.where("node IS NOT NULL")
    first = worded.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    distinct = worded.dropDuplicates(["node"]).select(F.monotonically_increasing_id().alias("id"), "node", "weight", "registers", "bands")
    nodes = written(distinct, "bag-nodes")  # written, so the numbers stay
    members = written(hub_members(nodes), "hub-members")
    stars = open_links(members.withColumn("open", F.expr("id = hub")), nodes, documents, similarity, shingle, known=False)
    joined = stars.select(F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("id")), F.struct(F.col("b").alias("hub"), F.col("a").alias("id")))).alias("x")).select("x.*").distinct()
    rest = members.join(joined.withColumn("met", F.lit(True)).hint("merge"), ["hub", "id"], "left").select("hub", "id", F.expr("met IS NULL AND id != hub").alias("open"))
    links = stars.unionByName(open_links(rest, nodes, documents, similarity, shingle, known=True))
    roots = components(links)
    linked = nodes.select("id", "node").join(roots.hint("merge"), "id", "left").select("node", F.coalesce("root", "id").alias("root")).join(first.hint("merge"), "node")
    least = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = linked.join(least.hint("merge"), "root").select("node", "root", "class_id")
    return (
        signed.select("doc_id", "node")
        .join(named.hint("merge"), "node", "left")
        .withColumn("class_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    )


def near_duplicate_classes(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, class_id`` for every row of ``documents`` (doc_id, text)."""
    return _classes(documents, similarity, shingle).select("doc_id", "class_id")


def keep_one_per_class(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents``, all columns, less all but one row of each class.

    The row of the smallest id stays. Where rows repeat an id and text, one of them.
    """
    documents, restore = plain_columns(documents, "doc_id", "text")
    classes = written(_classes(documents, similarity, shingle).where("node IS NOT NULL"), "classes")
    gone = classes.where("NOT doc_id <=> class_id").select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone_node")).distinct()
    node = F.unhex(F.md5("text"))
    kept = documents.join(sized(gone), documents["doc_id"].eqNullSafe(F.col("_gone_id")) & (node == F.col("_gone_node")), "left_anti")
    twice = classes.where("doc_id <=> class_id").groupBy("root").count().where("count > 1").select("root")
    if twice.isEmpty():
        return restore(kept)
    # Repeated rows: one row of each class that several rows could stand for.
    several = classes.where("doc_id <=> class_id").join(twice, "root", "left_semi").select(F.col("node").alias("_node"), F.col("root").alias("_root")).distinct()
    marked = kept.withColumn("_key", node).join(several, F.col("_key") == F.col("_node"), "left")
    plain = marked.where("_root IS NULL").select(*kept.columns)
    return restore(plain.unionByName(marked.where("_root IS NOT NULL").dropDuplicates(["_root"]).select(*kept.columns)))
