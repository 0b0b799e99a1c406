"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Each distinct shingle set is sketched into `bins` coordinates. Round i < bins throws every
shingle into a hashed bin with a value in [i, i+1); round bins + j puts every shingle into bin j,
so every coordinate is filled after 2 * bins rounds, and usually after one or two. The share of
equal coordinates of two sketches is an unbiased estimate of the Jaccard similarity and is
concentrated as that of independent MinHash values (Dahlgaard, Knudsen and Thorup, 2017).

Bands of four coordinates form buckets. Within a bucket no set of all pairs is made: a few hubs
are compared with the members outside their own component, linked members fall together, and
only what is still apart meets the next, larger, number of hubs. Members of a bucket are dealt
into as many parts as hubs are wanted, and the best of each part is one, by plain aggregation, so
that no task holds a bucket; in a bucket of no more members than that each is a hub, and the bucket is
done after the round. The rounds end when all buckets are, so all pairs of members in different
components have been compared and no candidate is dropped. Before texts are read, pairs go that cannot
be linked by their sizes or parity maps: maps of two sets differ in no more bits than the sets in members.

A round costs the driver memory for each task and plan, whatever the rows. So there are few of both:
links are joined into components in one task as long as they are few enough for its memory, and
only what a later step needs again is stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, cut, release, slices, text_bytes, worker_cache

U = np.uint64
ROWS = 4
#: Hubs of a bucket in the first round, and by how much they grow from round to round.
HUBS, GROWTH = 4, 32
#: Links that one task joins into components (about 250 MB there); more are joined by label spreading.
UNION = 2_000_000
#: Pairs whose ids are broadcast, so that only their texts are shuffled; with more all texts are.
FEW_PAIRS = 20_000
#: Bits of the parity map of a set.
BITS = 512
EMPTY = np.iinfo(np.uint64).max
#: Odd 64-bit multipliers and the finaliser of a published 64-bit hash (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FINALISER = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = worker_cache(_WordHashes())


def _begin() -> None:
    alone(_hashes)


def _mix(x: np.ndarray) -> np.ndarray:
    for m in FINALISER:
        x = (x ^ (x >> U(33))) * U(m)
    return x ^ (x >> U(33))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z lower-cased.

    A text with fewer words than `width` has its whole word sequence as its one shingle; a text
    without words has none.
    """
    words = text_bytes(text).lower().split()
    if not words:
        return np.empty(0, U)
    hashes = np.fromiter(map(_hashes.__getitem__, words), U, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    state = np.full(n, span, U)
    for k in range(span):
        state = _mix(state * U(MULTIPLIERS[0]) + hashes[k : k + n] * U(MULTIPLIERS[1]))
    return np.unique(state)


@lru_cache(maxsize=4)
def _seeds(bins: int) -> np.ndarray:
    return _mix(np.arange(1, 2 * bins + 1, dtype=U) * U(MULTIPLIERS[0]))


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out, seeds = np.full(bins, EMPTY, U), _seeds(bins)
    for i in range(2 * bins):
        h = _mix(items ^ seeds[i])
        value = (U(i) << U(48)) | (h >> U(16))
        if i < bins:
            np.minimum.at(out, (h % U(bins)).astype(np.int64), value)
        else:
            out[i - bins] = min(out[i - bins], value.min())
        if i + 1 < bins and out.max() != EMPTY:
            break
    return out


def parity_map(items: np.ndarray) -> np.ndarray:
    """Which of BITS classes of hashes hold an odd number of the set, as 64-bit integers."""
    odd = np.bincount((items >> U(17)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands_for(threshold_pct: int, miss: float = 1e-6) -> int:
    """Bands of ROWS coordinates so that a pair at the threshold shares none with odds < miss."""
    hit = (threshold_pct / 100) ** ROWS
    return math.ceil(math.log(miss) / math.log(1 - hit))


def _signatures(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        numbers = np.arange(bands, dtype=U) * U(MULTIPLIERS[1])
        for whole in batches:
            for batch in slices(whole):
                sizes, keys, marks, maps = [], [], [], []
                for text in batch.column("text").to_pylist():
                    items = shingle_hashes(text, width)
                    sizes.append(len(items))
                    maps.append(parity_map(items) if len(items) else None)
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    if len(items):
                        state = numbers
                        for column in sketch(items, bands * ROWS).reshape(bands, ROWS).T:
                            state = _mix(state * U(MULTIPLIERS[0]) + column)
                        marks.append(state.view(np.int64))
                    else:
                        marks.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(marks, pa.list_(pa.int64())),
                        pa.array(maps, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "set_key", "bands", "odd"],
                )

    return run


def shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, as shingle_hashes() hashes them."""
    words = text_bytes(text).lower().split()
    span = min(width, len(words))
    return set(zip(*(words[k:] for k in range(span)))) if words else set()


def _verified(width: int, threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        items = lru_cache(maxsize=64)(lambda text: shingle_hashes(text, width))
        full = lru_cache(maxsize=4)(lambda text: shingles(text, width))
        for whole in batches:
            for batch in slices(whole, 256):
                keep = []
                for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                    a, b = items(x), items(y)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    linked = 100 * common >= threshold_pct * (len(a) + len(b) - common)
                    if linked:  # confirmed on the shingles
                        a, b = full(x), full(y)
                        common = len(a & b)
                        linked = 100 * common >= threshold_pct * (len(a) + len(b) - common)
                    keep.append(linked)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bits_apart(a: str, b: str) -> Column:
    """In how many bits two parity maps differ; null where one is null."""
    apart = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)]
    return reduce(Column.__add__, apart)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links(a, b), by label spreading.

    Each pass takes the least label of the neighbours and then the label of that label, so long
    chains shorten; it ends when a pass changes nothing.
    """
    both = cut(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(links.select(F.col("b"), F.col("a")))
        .where("node <> other")
        .distinct()
    )
    labels = cut(both.select("node").distinct().select("node", F.col("node").alias("component")))
    while True:
        least = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("least"))
        )
        step = labels.join(least, "node").select(
            "node", "component", F.least("component", "least").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("over"))
        new = cut(
            step.join(jump, "next", "left").select(
                "node", "component", F.least("next", F.coalesce("over", "next")).alias("next")
            )
        )
        labels = new.select("node", F.col("next").alias("component"))
        if new.where("next <> component").isEmpty():
            release(nodes.sparkSession)
            return nodes.join(labels, "node", "left").select(
                "node", F.coalesce("component", "node").alias("component")
            )


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes, about one for each node.

    A node with several links keeps that to the smallest partner, and its other partners are linked
    with that one instead; many nodes have the same partners, so those links fall together.
    """
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    met = links.join(least, "b")
    return met.select(F.col("least").alias("a"), "b").union(met.where("least <> a").select("least", F.col("a").alias("b"))).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the nodes of all links that are not the smallest of their component."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*ends) for x in pair]), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)  # roots hang on smaller ones, then every node on its root
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    for start in range(0, len(moved), 10_000):
        part = moved[start : start + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["node", "component"])


def united(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b) that are not the smallest of their component, stored."""
    links = links.select("a", "b")
    if links.count() <= UNION:
        return cut(links.coalesce(1).mapInArrow(_united, "node long, component long"))
    links = cut(thinned(links))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return cut(components(nodes, links).where("node <> component"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold_pct: int = 80,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A & B| >= threshold_pct * |A | B| over their sets of
    distinct shingles of `width` words; component_id is the smallest id reachable. Null, empty
    and white-space-only texts have no shingles and are linked with nothing. Rows that repeat an
    id are one document, linked wherever one of their texts is. Rows with a null id are linked
    with nothing, have a null component and are kept. Ids are whole numbers. Other columns are not
    read. An empty table gives an empty result.

    Equal sets are found by a 128-bit digest of their 64-bit shingle hashes; other links are found
    by those hashes and confirmed on the shingles themselves. A pair at the threshold has no common band with odds below 1e-6, and less the
    more similar it is.
    """
    spark, bands = docs.sparkSession, bands_for(threshold_pct)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = cut(
        source.mapInArrow(_signatures(width, bands), "id long, n long, set_key binary, bands array<long>, odd array<long>")
    )
    sets = cut(
        signed.where("n > 0 and id is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    )
    buckets = sets.select("node", "n", F.explode("bands").alias("bucket"))
    # What is aggregated by a key is stored before it is joined by it: the join then deals both sides
    # anew, so that Spark can split the rows of a hot key.
    shared = cut(
        buckets.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
        .where("low <> high")
        .select("bucket", "size")
    )
    members = cut(buckets.join(shared, "bucket"))
    # Two sets under one id: the id joins both classes.
    repeated = cut(
        signed.where("id is not null")
        .groupBy("id")
        .agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"))
        .where("low <> high")
        .select("id")
    )
    moved = None  # (node, component) of nodes that are known to be linked with a smaller one
    if not repeated.isEmpty():
        twins = (
            signed.where("n > 0 and id is not null")
            .select("id", "set_key")
            .distinct()
            .join(repeated, "id", "left_semi")
            .join(sets.select("set_key", "node"), "set_key")
            .where("id <> node")
            .select(F.col("node").alias("a"), F.col("id").alias("b"))
        )
        moved = united(cut(twins))
    facts = cut(
        members.groupBy("node")
        .agg(F.sum("size").alias("rank_by"))
        .join(sets.groupBy("node").agg(F.min("odd").alias("odd"), F.max("odd").alias("other")), "node")
        .select("node", "rank_by", F.when(F.col("odd") == F.col("other"), F.col("odd")).alias("odd"))
    )
    texts = cut(source.join(facts.select(F.col("node").alias("id")), "id", "left_semi").distinct())
    members = cut(members.join(facts, "node"))
    tested, hubs = None, HUBS
    while True:
        if moved is None:
            now = members.withColumn("component", F.col("node"))
        else:
            now = cut(
                members.drop("size").join(moved, "node", "left").withColumn("component", F.coalesce("component", "node"))
            )
            apart = cut(
                now.groupBy("bucket")
                .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
                .where("low <> high")
                .select("bucket", "size")
            )
            now = cut(now.join(apart, "bucket"))
        if now.isEmpty():
            break
        # In a small bucket each member is a hub. Members of a larger one are dealt into `hubs` parts; the
        # best of each part is a hub: of the component that has least members there, the one that shares
        # most buckets.
        small = F.col("size") <= hubs
        part = F.when(small, F.struct("node", "n")).otherwise(F.struct(F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("node"), F.lit(-1).cast("long").alias("n")))
        best = F.min_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("odd").alias("hub_odd")), F.struct(-F.col("rank_by"), "node", "n"))
        each = now.groupBy("bucket", "component", part.alias("part")).agg(
            F.count("*").alias("held"), best.alias("best"), F.max("rank_by").alias("rank_by")
        )
        hub = F.struct("best.*", F.col("component").alias("hub_component"))
        order = F.struct("held", -F.col("rank_by"), "best.hub", "best.hub_n")
        chosen = cut(each.groupBy("bucket", "part").agg(F.min_by(hub, order).alias("h")).select("bucket", "h.*"))
        pairs = (
            now.join(chosen, "bucket")
            .where("component <> hub_component")
            .where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * threshold_pct)
            .where(F.coalesce(_bits_apart("odd", "hub_odd") * (100 + threshold_pct) <= (F.col("n") + F.col("hub_n")) * (100 - threshold_pct), F.lit(True)))
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        n_pairs = pairs.count()
        if n_pairs:
            read = texts
            if n_pairs <= FEW_PAIRS:
                ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                read = texts.join(F.broadcast(ids), "id", "left_semi")
            linked = cut(
                pairs.join(read.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
                .join(read.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
                .select("a", "b", "text_a", "text_b")
                .mapInArrow(_verified(width, threshold_pct), "a long, b long")
            )
            if not linked.isEmpty():
                before = [] if moved is None else [moved.select(F.col("component").alias("a"), F.col("node").alias("b"))]
                moved = united(reduce(DataFrame.union, before, linked))
        members = now.where(~small).drop("component")
        hubs *= GROWTH
        release(spark)
    classes = sets.select("set_key", "node")
    if moved is not None:
        classes = classes.join(moved, "node", "left").select("set_key", F.coalesce("component", "node").alias("node"))
    classes = cut(classes)
    return (
        signed.join(classes, "set_key", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("node", "id").alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are not the representative of their class.

    All columns stay. Rows with a null id stay; so do all rows that repeat a kept id.
    """
    ident = F.col(f"`{options.get('id_col', 'doc_id')}`").cast("long")
    dropped = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("id"))
    return rows.join(cut(dropped), "id", "left_anti").select("row.*")
