"""N-gram Jaccard join with adaptive multi-match prefixes.

Each text is the set of its distinct 5-word shingles. Shingles have one global order: estimated frequency (a counter
table of fixed size, filled over all documents), then hash. If two sets of similarity t link, their prefixes of
n - ceil(t n) + l shingles share at least l of them, for every l. Each document takes the l that costs least: the longer
prefix stored, the postings it meets, and the verifications left after asking for l matches; a pair is held to the smaller
of its two l. Equal sets are one node from the start, so copies are never paired.

Components are wanted, not every link. Postings are dealt by shingle to shards. A first pass compares each node with one
leader, the most central node of all its posting lists (the one whose prefix has most frequent shingles: the text that others
are copies of); that joins groups of near copies by at most one comparison for each member. The second pass takes every pair of
the prefix index whose two nodes are still in different components, with the full matching rule, so that no link between
components is missed. Two nodes of one leader meet there only if they can link within the leader's shingles: they share at most
what each of them shares with the leader, and shingles outside it. Pairs that need the latter are found through these few
shingles, in prefixes and with counted matches of their own (`besides`). So members that fail their leader are not paired with
its whole group. Verification compares whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearlens.session import written

from .spread import bit_set, components, dealt, few_rows, in_bit_set, joined, shard_groups, stored
from .textscan import SPACED, Words, give_back, mix, text_chunks

N = 5
PERCENT = 75
#: Bytes kept of a shingle's 64-bit hash: two sets of 500 shingles meet by chance once in four million comparisons.
BYTES = 5
#: The counter table has 2^SKETCH entries, one bit more for every further fourfold of SKETCHED shingles, and 2^MOST_SKETCH at most:
#: beyond that, what is counted too high costs time only.
SKETCH, MOST_SKETCH, SKETCHED = 20, 24, 1 << 28
BLOCK = 12
SHARDS = 256
POSTINGS = 500_000
FLUSH = 400_000
MOST_MATCHES = 8
#: Costs of a stored token and of a verified pair. A token is met by CHANCE texts that have nothing to do with the document, and
#: every further match by chance is RARER times as rare.
STORED, VERIFIED, CHANCE, RARER = 0.25, 4.0, 0.1, 10.0
#: Bit sets of nodes have SPARE bits a node, between these powers of two.
SPARE, FEWEST_BITS, MOST_BITS = 8, 20, 27
#: Nodes with less of their shingles in their leader than FAMILY percent are paired as if they had none.
FAMILY = 60
#: A leader has to be met in as many lists as the node wants matches, three at most: meetings weigh MET over that number.
MET = 6
PAIRS = 200
SEEN = 1 << 18


def packed(tokens: np.ndarray, width: int = 6) -> bytes:
    """The low bytes of each number."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(cell: bytes, width: int = 6) -> np.ndarray:
    raw = np.zeros((len(cell) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(cell, np.uint8).reshape(-1, width)
    return raw.reshape(-1).view("<u8").astype(np.uint64)


def shingle_sets(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingles as 64-bit hashes; fewer words than n make one shingle, no word makes none."""
    for chunk in text_chunks(column):
        words = Words(chunk, SPACED)
        hashes = words.hashes()
        grams, whole = words.ngrams(hashes, n)
        for d in range(chunk.docs):
            a, b = int(words.first[d]), int(words.first[d + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                h = hashes[a : a + 1] + np.uint64(b - a)
                for j in range(a + 1, b):
                    h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + 1])
                yield mix(h)
            else:
                yield np.empty(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, node (hash of the set) and the set's top BYTES bytes, the latter only once for copies that a task meets soon."""
    seen: set[int | None] = set()
    for batch in batches:
        sizes, nodes, sets = [], [], []
        for tokens in shingle_sets(batch.column("text"), n):
            cell = packed(tokens >> np.uint64(64 - 8 * BYTES), BYTES)
            node = xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None
            sizes.append(len(tokens))
            nodes.append(node)
            sets.append(cell if node is not None and node not in seen else None)
            if len(seen) > SEEN:
                seen.clear()
            seen.add(node)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
            names=["doc_id", "n_shingles", "node", "set"],
        )


def sketch_bits(shingles: int) -> int:
    return min(MOST_SKETCH, SKETCH + max(0, (shingles // SKETCHED).bit_length() // 2))


def slots(tokens: np.ndarray, size: int) -> np.ndarray:
    """Places of tokens in a table of `size` counters."""
    return (tokens >> np.uint64(8 * BYTES - size.bit_length() + 1)).astype(np.int64)


def _counters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << bits, np.uint32)
    for batch in batches:
        for cell in batch.column("set"):
            np.add.at(table, slots(unpacked(cell.as_py(), BYTES), len(table)), 1)
    give_back()
    blocks = [b for b in range(1 << (bits - BLOCK)) if table[b << BLOCK : (b + 1) << BLOCK].any()]
    cells = [zlib.compress(table[b << BLOCK : (b + 1) << BLOCK].tobytes(), 1) for b in blocks]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["shard", "cell"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, parts in _streamed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([parts.tobytes()], pa.binary())], names=["shard", "cell"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Sums per shard; one block of counters is held at a time."""
    current, total = None, None
    for batch in batches:
        for shard, cell in zip(batch.column("shard").to_pylist(), batch.column("cell"), strict=True):
            if shard != current:
                if current is not None:
                    yield current, total
                current, total = shard, np.zeros(1 << BLOCK, np.uint64)
            total += np.frombuffer(zlib.decompress(cell.as_buffer()), np.uint32)
    if current is not None:
        yield current, total


def frequencies(sets: DataFrame, shingles: int) -> np.ndarray:
    """Shingle counts by the top bits of the hash, over all documents, which have so many shingles."""
    bits = sketch_bits(shingles)
    parts = sets.where("set is not null").select("set").mapInArrow(lambda b: _counters(b, bits), "shard int, cell binary")
    with few_rows(sets.sparkSession):
        rows = dealt(parts).mapInArrow(_added, "shard int, cell binary").collect()
    table = np.zeros(1 << bits, np.float32)
    for r in rows:
        table[r.shard << BLOCK : (r.shard + 1) << BLOCK] = np.frombuffer(r.cell, np.uint64)
    del rows
    give_back()
    return table


def in_order(tokens: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens in the global order (count, hash), and their counts."""
    counts = table[slots(tokens, len(table))]
    order = np.argsort(counts, kind="stable")
    return tokens[order], counts[order]


def prefix(tokens: np.ndarray, table: np.ndarray, usual: float, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """The prefix of the cheapest number of matches, that number, and how central the set is (0 to 255)."""
    n = len(tokens)
    tokens, counts = in_order(tokens, table)
    needed = -(-percent * n // 100)
    most = min(MOST_MATCHES, needed)
    length = n - needed + np.arange(1, most + 1)
    met = np.cumsum(np.maximum(counts - usual, 0))[length - 1]
    matches = np.arange(1, most + 1)
    cost = STORED * length + met + VERIFIED * (met / matches + CHANCE * length / RARER ** (matches - 1))
    best = int(np.argmin(cost))
    part = slice(length[best])
    central = int(255 * (counts[part] > usual + 4 * np.sqrt(usual)).mean())
    return tokens[part].copy(), best + 1, central  # a view would hold the whole set


#: What is known of each posting, as byte strings per shard.
POSTING = {"tokens": np.uint32, "nodes": np.int64, "central": np.uint8, "sizes": np.uint32, "matches": np.uint8}


def _postings(batches: Iterator[pa.RecordBatch], table: np.ndarray, shards: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens with their nodes, and the nodes' set sizes and wanted matches, a row per shard and batch."""
    usual = float(np.median(table)) + 1
    parts: list[tuple] = []
    held = 0
    for batch in batches:
        for cell, node in zip(batch.column("set"), batch.column("node").to_pylist(), strict=True):
            tokens = unpacked(cell.as_py(), BYTES)
            part, matches, rank = prefix(tokens, table, usual, percent)
            parts.append((part, node, rank, len(tokens), matches))
            held += len(part)
        if held > FLUSH:
            yield _dealt_out(parts, shards)
            parts, held = [], 0
    if parts:
        yield _dealt_out(parts, shards)
    del parts
    give_back()


def _dealt_out(parts: list[tuple], shards: int) -> pa.RecordBatch:
    tokens, *facts = zip(*parts, strict=True)
    lengths, token = [len(t) for t in tokens], np.concatenate(tokens)
    shard = (mix(token) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edges))
    columns = [pa.array(full, pa.int32())]
    for values, kind in zip((token, *(np.repeat(np.array(f), lengths) for f in facts)), POSTING.values(), strict=True):
        values = values[order].astype(kind)
        columns.append(pa.array([values[edges[s] : edges[s + 1]].tobytes() for s in full], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["shard", *POSTING])


def _best(node: np.ndarray, leader: np.ndarray, rank: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, ...]:
    """One leader per node, the one of the highest rank, and the weight of the lists in which they meet."""
    order = np.lexsort((rank, node))
    node, leader, rank, met = node[order], leader[order], rank[order], met[order]
    starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (rank[1:] != rank[:-1]))) if len(node) else np.empty(0, int)
    total = np.add.reduceat(met, starts) if len(node) else met
    node, leader, rank = node[starts], leader[starts], rank[starts]
    last = np.append(node[1:] != node[:-1], True) if len(node) else np.empty(0, bool)
    return node[last], leader[last], rank[last], total[last]


def _rows(kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray, matches: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(x), kind, np.int32)), *(pa.array(v.astype(np.int64)) for v in (x, y, z)), pa.array(matches.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "x", "y", "z", "matches"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, int)
    return starts, np.diff(np.append(starts, len(values)))


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Postings (kind 1) of tokens that several nodes have, without the nodes that are too large or small for every other one of
    the list, and per node its best leader in the task's shards (kind 0)."""
    found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    for shard, parts in shard_groups(batches):
        token, node, central, size, matches = (joined(parts, name, kind) for name, kind in POSTING.items())
        order = np.lexsort((node, size, token))  # a node's rows follow each other, since it has one size
        order = order[np.append(True, (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1]))] if len(order) else order
        _, lengths = _runs(token[order])
        order = order[np.repeat(lengths > 1, lengths)]
        if not len(order):
            continue
        token, node, central, size, matches = token[order], node[order], central[order], size[order].astype(np.int64), matches[order]
        starts, lengths = _runs(token)
        # distinct nodes never have the same rank but for a chance of 2^-56
        rank = (central.astype(np.uint64) << np.uint64(56)) | (mix(node.view(np.uint64)) >> np.uint64(8))
        top = np.repeat(np.maximum.reduceat(rank, starts), lengths)
        leader = np.repeat(node[rank == top], lengths)
        led = (leader != node) & (100 * np.repeat(size[rank == top], lengths) >= FAMILY * size)
        weight = MET // np.clip(matches[led].astype(np.int64), 1, 3)
        found = _best(*(np.concatenate(v) for v in zip(found, (node[led], leader[led], top[led], weight), strict=True)))
        near = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])  # sizes rise within a list
        kept = np.append(near, False) | np.append(False, near)
        key = (np.int64(shard) << np.int64(32)) | token[kept].astype(np.int64)
        yield _rows(1, key, node[kept], size[kept], matches[kept])
    yield _rows(0, found[0], found[1], found[2] >> np.uint64(1), found[3])
    del found
    give_back()


def _compared(batches: Iterator[pa.RecordBatch], table: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Per pair: shingles of both, whether they link, b's size, and for a family member its shingles that a does not have, rarest first."""
    for batch in batches:
        both, link, sizes, rest = [], [], [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            p, q = unpacked(x.as_py(), BYTES), unpacked(y.as_py(), BYTES)
            hit = p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q
            n = int(hit.sum())
            both.append(n)
            link.append(100 * n >= percent * (len(p) + len(q) - n))
            sizes.append(len(q))
            rest.append(in_order(q[~hit], table)[0].astype(np.int64) if 100 * n >= FAMILY * len(q) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(link, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
            names=["a", "b", "both", "link", "size_b", "rest"],
        )
    give_back()


def node_bits(nodes: DataFrame) -> Broadcast:
    """A bit set of the nodes, with SPARE bits for each; from 2^MOST_BITS / SPARE nodes on it lets more and more others through."""
    named = nodes.distinct()
    bits = min(MOST_BITS, max(FEWEST_BITS, (SPARE * named.count()).bit_length()))
    return nodes.sparkSession.sparkContext.broadcast(bit_set(named, "node", bits))


def compared(pairs: DataFrame, sets: DataFrame, table: Broadcast, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes with what their whole sets have in common.

    Bit sets filled with the nodes of either side keep most other sets from being shuffled; what they let through besides only
    costs time.
    """
    def sets_of(side: str) -> DataFrame:
        wanted = node_bits(pairs.select(F.col(side).alias("node")))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node = batch.column("node").to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(in_bit_set(wanted.value, node)))

        few = sets.select("node", "set").where("set is not null").mapInArrow(pick, "node bigint, set binary")
        return few.groupBy(F.col("node").alias(side)).agg(F.first("set").alias(f"set_{side}"))

    full = pairs.join(sets_of("b"), "b").join(sets_of("a"), "a").select("a", "b", "set_a", "set_b")
    return full.mapInArrow(lambda batches: _compared(batches, table.value, percent), "a bigint, b bigint, both bigint, link boolean, size_b bigint, rest array<bigint>")


def crossing(lists: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `lists` (key, node, label, ...) whose key is met in several components."""
    of_key = Window.partitionBy(*key)
    mixed = lists.withColumn("low", F.min("label").over(of_key)).withColumn("high", F.max("label").over(of_key)).where("low <> high")
    return mixed.drop("low", "high")


def besides(first: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one leader's family, in different components, that can link only through shingles their leader lacks.

    Two members share at most the smaller of their numbers of the leader's shingles, so they need a known number of others. These
    are met in prefixes of their own, again rarest first: of k such shingles, at least l of the needed m are among the first
    k - m + l, on both sides. All of it is a condition of the join, so pairs that cannot link make no rows.
    """
    member = first.where("rest is not null").select(
        F.col("a").alias("leader"), F.col("b").alias("node"), "both", F.col("size_b").alias("size"), F.size("rest").alias("k"), F.posexplode("rest").alias("place", "token")
    )
    # whatever the partner, this many outside shingles are needed at least
    alone = f"greatest(ceil({percent} * size / 100) - both - {MOST_MATCHES}, 0)"
    few = member.where(f"place < k - {alone}").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    one = written(crossing(few, ["leader", "token"]), "open-rests")
    two = one.toDF(*(c if c in ("leader", "token") else f"{c}2" for c in one.columns))
    need = f"ceil({percent} * (size + size2) / {100 + percent}) - least(both, both2)"
    matches = f"least({need}, {MOST_MATCHES})"
    near = f"100 * least(size, size2) >= {percent} * greatest(size, size2) and {need} >= 1 and {need} <= least(k, k2)"
    places = f"place < k - ({need}) + {matches} and place2 < k2 - ({need}) + {matches}"
    met = one.join(two, ["leader", "token"]).where(f"label < label2 and {near} and {places}")
    counted = met.groupBy(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).agg(F.count("*").alias("met"), F.first(F.expr(matches)).alias("least"))
    return counted.where("met >= least").select("a", "b")


def linked(documents: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    A null or empty text, or one without words, has no shingles, links with nothing and is its own component; so is a row
    alone in its component. Repeated rows are linked as copies; a null doc_id takes its component's smallest id, or null.
    Other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    spark = documents.sparkSession
    sets = stored(
        documents.select("doc_id", "text").mapInArrow(lambda b: _sets(b, n), f"doc_id {kind}, n_shingles bigint, node bigint, set binary"), "shingle-sets"
    )
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    table = spark.sparkContext.broadcast(frequencies(sets, total))
    shards = max(SHARDS, -(-total * (105 - percent) // 100 // POSTINGS))
    full = sets.where("set is not null")
    cells = ", ".join(f"{name} binary" for name in POSTING)
    postings = full.select("node", "set").mapInArrow(lambda b: _postings(b, table.value, shards, percent), f"shard int, {cells}")
    shared = stored(dealt(postings).mapInArrow(lambda b: _shared(b, percent), "kind int, x bigint, y bigint, z bigint, matches int"), "shared-postings")

    # a leader met less often is met by chance, mostly; such pairs, if they can link, come with the second pass
    several = shared.where("kind = 0").groupBy("x", "y", "z").agg(F.sum("matches").alias("met")).where(F.col("met") >= MET)
    best = several.groupBy("x").agg(F.max_by("y", "z").alias("leader"))
    led = written(best.select(F.col("leader").alias("a"), F.col("x").alias("b")), "leader-pairs")
    first = stored(compared(led, sets, table, percent), "compared", PAIRS)
    links = first.where("link").select("a", "b")
    labels = components(links)

    lists = shared.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("node"), F.col("z").alias("size"), "matches")
    family = first.where("rest is not null").select(F.col("b").alias("node"), F.col("a").alias("leader"), "both")
    placed = lists.join(written(labels.join(family, "node", "full"), "placed-nodes"), "node", "left").select(
        "token", "node", "size", "matches", F.coalesce("label", "node").alias("label"), F.coalesce("leader", "node").alias("leader"), F.coalesce("both", "size").alias("both")
    )
    left = written(crossing(placed, ["token"]), "open-postings")
    right = left.toDF(*(c if c == "token" else f"{c}2" for c in left.columns))
    enough = f"{100 + percent} * least(both, both2) >= {percent} * (size + size2)"
    crossed = (
        left.join(right, "token")
        .where(f"label < label2 and 100 * least(size, size2) >= {percent} * greatest(size, size2) and (leader <> leader2 or {enough})")
        .groupBy(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        .agg(F.count("*").alias("met"), F.first(F.least("matches", "matches2")).alias("least"))
        .where(F.col("met") >= F.col("least")).select("a", "b")
    )
    beside = besides(first, labels, percent)
    pairs = written(crossed.unionAll(beside).distinct(), "crossed-pairs")
    more = stored(compared(pairs, sets, table, percent).where("link").select("a", "b"), "links", PAIRS)
    labels = components(links.unionAll(more)) if more.limit(1).count() else labels

    least = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named_nodes = least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    lowest = named_nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = named_nodes.join(lowest, "label").select("node", "component_id")
    return sets.drop("set").join(by_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
