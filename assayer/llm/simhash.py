"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit value lies
within r bits of both. So every distinct fingerprint stands for all its variants
within r flipped bits, and fingerprints that share a variant are a verified pair.

The variants are shuffled in two steps so that none is ever written to disk. A
fingerprint is sent to each *cell* that one of its variants falls into, a cell being
the value of a few chosen bits; inside the cell, the variants over the other bits are
made, sorted and compared. The number of chosen bits grows with the logarithm of the
number of fingerprints, so a cell stays about the same size at any scale.

All fingerprints that share a variant are within 2r of each other, so linking each to
the smallest of them loses no connection, and no group is expanded into its pairs.

Texts that share most but not nearly all of their shingles differ in more bits than a
ball can hold. ``similar_groups`` finds them by several shorter fingerprints, of which a
few come close, and holds every pair that meets against its whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, partitions, shared_dir, stored

SEED = 42
#: Variants that a cell may hold on average, and that are sorted at once at most.
CELL_VARIANTS = 1 << 20
SORT_VARIANTS = 1 << 22
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def text_fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """SimHash of one text as a signed 64-bit integer.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A null or
    wordless text has the fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), CHUNK):
        some = last[at : at + CHUNK]
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + len(some)], some)), np.uint64, len(some))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (2 * ones > len(last)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """doc_id, row_key and fp (SimHash as long) of every row of ``docs``; repeated rows stay."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [text_fingerprint(t.as_py(), shingle_words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fps, pa.int64())], ["doc_id", "row_key", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(hashed, "doc_id long, row_key long, fp long")


def _masks(bits: list[int], most: int) -> np.ndarray:
    """All 64-bit masks over ``bits`` with at most ``most`` ones."""
    found = [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(bits, k)]
    return np.array(found, np.uint64)


def _shared(own: np.ndarray, moved: np.ndarray, spent: np.ndarray, free: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slot and owner of every variant that several owners have, by slot and owner.

    moved: the owners' fingerprints, already moved into the cell by ``spent`` flips of
    the bits that are not ``free``; each may still flip ``radius - spent`` free bits. Too
    many variants to sort at once are split by a free bit; each part counts slots anew.
    """
    per = [sum(math.comb(len(free), k) for k in range(radius - s + 1)) for s in range(radius + 1)]
    if free and len(own) > 1 and sum(per[s] * int((spent == s).sum()) for s in range(radius + 1)) > SORT_VARIANTS:
        bit = np.uint64(1 << free[0])
        for side in (np.uint64(0), bit):
            flip = (moved & bit) != side
            keep = spent + flip <= radius
            yield from _shared(own[keep], np.where(flip, moved ^ bit, moved)[keep], (spent + flip)[keep], free[1:], radius)
        return
    variants, owners = [], []
    for s in range(radius + 1):
        at = np.flatnonzero(spent == s)
        if len(at):
            masks = _masks(free, radius - s)
            variants.append((moved[at, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own[at], len(masks)))
    if not variants:
        return
    v, who = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(v)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return
    slot = np.searchsorted(shared, v)
    hit = np.flatnonzero(shared[np.minimum(slot, len(shared) - 1)] == v)
    slot, who = slot[hit], who[hit]
    order = np.lexsort((who, slot))
    yield slot[order], who[order]


def _starts(slot: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], slot[1:] != slot[:-1]))


def _to_least(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Pairs of each slot's smallest owner and every other one."""
    found = [np.empty((0, 2), np.uint64)]
    for slot, own in parts:
        new = _starts(slot)
        least = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        found.append(np.unique(np.stack([least, own], 1)[least != own], axis=0))
    return np.unique(np.concatenate(found), axis=0)


#: What a cell says of an owner: the most popular and the rarest that it meets, and the least and greatest.
PARTNERS = "own long, popular long, popularity double, rare long, crowd long, least long, greatest long"


def _to_few(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """PARTNERS of every owner that shares a slot.

    The most popular one meets the most others: in a crowd of near copies that is their
    original, which is nearer to each of them than they are to each other. The rarest one
    is a neighbour at the variant that the fewest share: outside of crowds, or at their
    edge, that is the copy itself.
    """
    slots, owners, base = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    for slot, own in parts:
        slots.append(slot + base)
        owners.append(own)
        base = int(slots[-1][-1]) + 1
    slot = np.concatenate(slots)
    names, who = np.unique(np.concatenate(owners), return_inverse=True)
    crowd = np.bincount(slot) if base else np.empty(0, np.int64)
    popular = np.bincount(who, weights=crowd[slot] - 1.0, minlength=len(names))

    def of_slots(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots and owners in an order by slot, and each one's place in its slot and that slot's first place."""
        at, own = slot[order], who[order]
        new = np.flatnonzero(_starts(at)) if len(at) else np.empty(0, np.int64)
        first = new[np.cumsum(_starts(at)) - 1] if len(at) else new
        return at, own, np.arange(len(at)) - first, first

    def best(own: np.ndarray, partner: np.ndarray, *by: np.ndarray) -> np.ndarray:
        """Each owner's partner that is first by the keys."""
        order = np.lexsort((partner, *by, own))
        return partner[order][_starts(own[order])] if len(own) else partner

    at, own, place, first = of_slots(np.lexsort((who, -popular[who], slot)))
    leader = own[np.where(place == 0, first + 1, first)] if len(own) else own
    beside = own[np.where(place > 0, np.arange(len(own)) - 1, np.arange(len(own)) + 1)] if len(own) else own
    chosen, rare = best(own, leader, -popular[leader]), best(own, beside, crowd[at])
    rarity = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(rarity, own, crowd[at])
    at, own, place, first = of_slots(np.lexsort((who, slot)))
    last = first + crowd[at] - 1
    least = np.full(len(names), len(names))
    greatest = np.full(len(names), -1)
    np.minimum.at(least, own, own[np.where(place == 0, first + 1, first)] if len(own) else own)
    np.maximum.at(greatest, own, own[np.where(np.arange(len(own)) == last, last - 1, last)] if len(own) else own)
    signed = names.view(np.int64)
    columns = [signed, signed[chosen], popular[chosen], signed[rare], rarity, signed[least], signed[greatest]]
    kinds = [pa.float64() if "double" in c else pa.int64() for c in PARTNERS.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PARTNERS.split(", ")])


def _to_all(parts: Iterator[tuple[np.ndarray, np.ndarray]], names: np.ndarray, fp: np.ndarray, root: np.ndarray, size: np.ndarray, sketches: Sketches, similarity: float, max_bits: int) -> np.ndarray:
    """Every pair of owners that meet, of different roots, that may be as similar.

    The owners are places in the other arrays. Pairs whose set sizes or sketches rule the
    similarity out are left out here. Owners that meet in a crowd are held against each other by
    their bits, so that a pair is made once and not at each of its variants; those of the
    crowd's largest group against the others only.
    """
    found, crowded = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.flatnonzero((root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])))
        a, b = a[keep], b[keep]
        near = sketches.may_reach(a, b, size, similarity)
        return np.sort(np.stack([a[near], b[near]], 1), axis=1)

    for slot, own in parts:
        own = own.astype(np.int64)
        starts = np.flatnonzero(_starts(slot))
        sizes = np.diff(np.append(starts, len(slot)))
        mixed = np.repeat(np.minimum.reduceat(root[own], starts) != np.maximum.reduceat(root[own], starts), sizes)
        slot, own, many = slot[mixed], own[mixed], np.repeat(sizes, sizes)[mixed]
        crowded.append(np.unique(own[many > CROWD]))
        slot, own = slot[many <= CROWD], own[many <= CROWD]
        some = []
        for apart in range(1, min(CROWD, len(own))):
            same = np.flatnonzero(slot[apart:] == slot[:-apart])
            if not len(same):
                break
            some.append(np.sort(np.stack([own[same], own[same + apart]], 1), axis=1))
        if some:
            pairs = np.unique(np.concatenate(some), axis=0)
            found.append(fit(pairs[:, 0], pairs[:, 1]))
    crowd = np.unique(np.concatenate(crowded))
    groups, counts = np.unique(root[crowd], return_counts=True)
    smaller = crowd[root[crowd] != groups[counts.argmax()]] if len(crowd) else crowd
    for at in range(0, len(smaller), CROWD_ROWS):
        a = smaller[at : at + CROWD_ROWS]
        for beside in range(0, len(crowd), CROWD_ROWS):
            b = crowd[beside : beside + CROWD_ROWS]
            i, j = np.nonzero(np.bitwise_count(fp[a, None] ^ fp[None, b]) <= max_bits)
            found.append(np.unique(fit(a[i], b[j]), axis=0))
    return np.sort(names[np.unique(np.concatenate(found), axis=0)], axis=1)


def ball_links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links a < b (as unsigned numbers) between fingerprints at ``max_bits`` or less.

    distinct: one column fp, no value twice. The links connect exactly what all pairs
    within ``max_bits`` connect; a pair whose two sides are both linked to a smaller
    fingerprint of the same ball may be left to that one.
    """
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be an even number: the two balls meet in the middle")
    radius = max_bits // 2
    n, *ones = distinct.agg(F.count("fp"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)) for i in range(64)]).first()
    per = sum(math.comb(64, k) for k in range(radius + 1))
    chosen = min(40, max(0, math.ceil(math.log2(max(1, n * per / CELL_VARIANTS)))))
    balanced = sorted(range(64), key=lambda i: (abs(2 * (ones[i] or 0) - n), i))
    picked, free = balanced[:chosen], balanced[chosen:]
    whole = np.array([sum(1 << b for b in picked)], np.uint64)
    flips = _masks(picked, radius).astype(np.int64).tolist()
    picked_mask = int(whole.astype(np.int64)[0])

    def in_cell(cell: pa.Table) -> pa.Table:
        fp = cell.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        flip = cell.column("flip").to_numpy().astype(np.int64).view(np.uint64)
        spent = np.unpackbits(flip.view(np.uint8).reshape(-1, 8), axis=1).sum(1).astype(np.int64)
        pairs = _to_least(_shared(fp, fp ^ flip, spent, free, radius)).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    cells = distinct.select("fp", F.explode(F.lit(flips)).alias("flip")).withColumn("cell", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(picked_mask)))
    return cells.groupBy("cell").applyInArrow(in_cell, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node of ``links``.

    links: a long, b long. Alternates large-star and small-star steps until every node
    has one link down at most, and none that has one has links up. Each step joins the
    links with one row a node; those of a node of a high degree are dealt to many tasks.
    Each step is written to the shared folder.
    """
    shared_dir(links.sparkSession)
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("up"), F.count_if(F.col("v") < F.col("u")).alias("down"))
        if least.where("down > 1 or up > 0 and down > 0").isEmpty():
            break
        n = edges.count()
        # Large star: every neighbour above u is linked to the least of u and its neighbours.
        large = join_hot(edges.withColumnRenamed("b", "u"), least, "u", F.col("up"), n).select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        # Small star: every smaller neighbour of u, and u, are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("down"))
        joined = join_hot(large, least, "u", F.col("down"), n)
        edges = stored(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def row_key() -> Column:
    """Hash of a row's doc_id and text, which tells rows apart that share a doc_id or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _named(rows: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """Columns of ``rows`` plus component_id and leads.

    rows: a stored table with doc_id, row_key and ``key``; roots: node (a key) and root,
    of the keys that are linked. component_id is the smallest doc_id of all rows whose
    keys have one root; leads is true for the row of the smallest (doc_id, row_key), null
    doc_ids being last.
    """
    place = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.col("row_key").alias("at"))
    keys = rows.groupBy(key).agg(F.min(place).alias("own"), F.count(F.lit(1)).alias("copies"))
    keys = stored(keys.join(roots, F.col(key) == F.col("node"), "left").select(key, "own", "copies", F.coalesce("root", key).alias("root")), "group-keys")
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.sum("copies")).first()
    groups = keys.groupBy("root").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("keys"))
    labels = stored(join_hot(keys.select(key, "root", "copies"), groups, "root", F.col("keys"), n_keys).select(key, "copies", "first"), "group-labels")
    joined = join_hot(rows, labels, key, F.col("copies"), n_rows or 0)
    return joined.select(*rows.columns, F.col("first.id").alias("component_id"), (F.col("row_key") == F.col("first.at")).alias("leads"))


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, row_key, fp (long), component_id and leads of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links between fingerprints that
    differ in at most ``max_bits`` bits. Null and wordless texts share the fingerprint
    0 and are linked like any other. Rows with a null doc_id keep it and never name a
    component unless no other row is in it. Rows that share a doc_id are rows of their
    own. leads is true for one row of a component, and for its exact repetitions. Other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    hashed = stored(fingerprints(docs, shingle_words), "simhash")
    links = ball_links(hashed.select("fp").distinct(), max_bits)
    return _named(hashed, "fp", components(links))


#: Similarity of near copies, words of their shingles, and fingerprints a text has for it.
SIMILARITY, SIMILAR_WORDS, TABLES = 0.8, 5, 10
#: Share of the pairs just at the similarity that meet, whatever the number of texts.
RECALL = 0.98
#: Variants of a table that a cell may hold on average.
TABLE_CELL_VARIANTS = 1 << 29
#: Owners of a variant from which they are held against each other at once, and how many are.
CROWD, CROWD_ROWS = 16, 2048
#: Least and most bits of a sketch.
SKETCH_BITS = (256, 1 << 16)
#: Parts that the tables are dealt to; in each a class is paired with two of those that it meets.
TABLE_PARTS = 3
#: Pairs whose sketches are compared at once.
SKETCH_PAIRS = 1 << 15


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parities of how many shingles fall to each of two bits a shingle, or a little more.

    The sketches of two sets differ in no more bits than the sets have elements that only
    one of them has, and a sketch folds to half its bits by adding its halves.
    """
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << (2 * len(shingles) - 1).bit_length())) if len(shingles) else SKETCH_BITS[0]
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """The sketches of many sets, compared by numbers of pairs at once."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        raw = column.to_pylist()
        self.width = np.fromiter(map(len, raw), np.int64, len(raw))
        self.at = np.zeros(len(raw), np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.rows[w, w] = np.frombuffer(b"".join(raw[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)

    def _folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.rows:
            longer = self._folded(width, to * 2)
            self.rows[width, to] = longer[:, : longer.shape[1] // 2] ^ longer[:, longer.shape[1] // 2 :]
        return self.rows[width, to]

    def may_reach(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the pairs (a, b) whose sketches don't rule out that they are as similar."""
        most = (size[a] + size[b]) * (1 - similarity) / (1 + similarity) + 1e-6
        kind = self.width[a] << 20 | self.width[b]
        kept = [np.empty(0, np.int64)]
        for k in np.unique(kind).tolist():
            wa, wb = k >> 20, k & (1 << 20) - 1
            x, y = (self._folded(w, min(wa, wb)) for w in (wa, wb))
            some = np.flatnonzero(kind == k)
            for at in range(0, len(some), SKETCH_PAIRS):
                part = some[at : at + SKETCH_PAIRS]
                apart = np.bitwise_count(x[self.at[a[part]]] ^ y[self.at[b[part]]]).sum(1, dtype=np.int64)
                kept.append(part[apart <= most[part]])
        return np.sort(np.concatenate(kept))


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles; none for a wordless text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, last)), np.uint64, len(last)))


def tables_for(width: int, radius: int, similarity: float, least: int, recall: float = RECALL) -> int:
    """Tables, ``least`` or more, in one of which ``recall`` of the pairs at ``similarity`` meet.

    A bit differs with probability acos(c) / pi, c being the cosine of the sets; for a
    given similarity it is the greatest for sets of equal size.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    meet = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(2 * radius + 1))
    return least if meet >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def class_of(shingles: np.ndarray) -> int:
    """Hash of a whole shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def short_fingerprints(shingles: np.ndarray, tables: int, width: int) -> list[int]:
    """SimHashes of ``width`` bits each; every bit is of another hash of the shingles."""
    ones = []
    for m in range(-(-tables * width // 64)):
        total = np.zeros(64, np.int64)
        for at in range(0, len(shingles), CHUNK):
            x = shingles[at : at + CHUNK] + np.uint64((0x9E3779B97F4A7C15 * (m + 1)) % 2**64)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            total += np.unpackbits(x.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        ones.append(2 * total > len(shingles))
    bits = np.concatenate(ones)[: tables * width].reshape(tables, width)
    return (bits.astype(np.int64) << np.arange(width, dtype=np.int64)).sum(1).tolist()


def _cells(classes: DataFrame, n: int, width: int, radius: int) -> tuple[DataFrame, list[int]]:
    """The rows of ``classes`` once for each cell of a table that they fall into, and the free bits.

    classes: cls, fps and whatever else the cells need. There are as many cells as keep
    each in bounds, or a quarter of the shuffle's partitions if there is work for them: a
    row goes to more cells the more there are.
    """
    per = sum(math.comb(width, k) for k in range(radius + 1))
    wanted = min(partitions(classes.sparkSession) / 4, n * per * TABLES / SORT_VARIANTS) / TABLES
    chosen = min(width // 2, max(math.ceil(math.log2(max(1, n * per / TABLE_CELL_VARIANTS))), math.floor(math.log2(max(1, wanted)))))
    flips = _masks(list(range(chosen)), radius).astype(np.int64).tolist()
    rest = [c for c in classes.columns if c != "fps"]
    one = classes.select(*rest, F.posexplode("fps").alias("t", "fp")).withColumn("flip", F.explode(F.lit(flips)))
    moved = one.select(*rest, "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("moved"), "flip")
    return moved.withColumn("cell", F.col("moved").bitwiseAND(F.lit((1 << chosen) - 1))), list(range(chosen, width))


def _numbers(cell: pa.Table, *columns: str) -> list[np.ndarray]:
    return [cell.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in columns]


def _ones(flip: np.ndarray) -> np.ndarray:
    return np.bitwise_count(flip).astype(np.int64)


def _pair_table(pairs: np.ndarray) -> pa.Table:
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _meetings(classes: DataFrame, n: int, width: int, radius: int) -> DataFrame:
    """Pairs a, b of classes that share a variant of one of their fingerprints.

    classes: cls and fps. Each class that meets any is paired with two of those that it
    meets in each part of the tables: the most popular and the rarest of all its cells. One
    with more meetings, which ``_other_meetings`` finds, comes as a pair with itself as
    well. So a crowd costs no more pairs than 2 * TABLE_PARTS times its size.
    """
    cells, free = _cells(classes.select("cls", "fps"), n, width, radius)

    def in_cell(cell: pa.Table) -> pa.Table:
        own, moved, flip = _numbers(cell, "cls", "moved", "flip")
        found = _to_few(_shared(own, moved, _ones(flip), free, radius))
        return found.append_column("part", pa.array(np.full(found.num_rows, cell.column("t")[0].as_py() % TABLE_PARTS), pa.int64()))

    met = cells.groupBy("t", "cell").applyInArrow(in_cell, f"{PARTNERS}, part long")
    few = met.groupBy("own", "part").agg(F.max_by("popular", F.struct("popularity", "popular")).alias("popular"), F.min_by("rare", F.struct("crowd", "rare")).alias("rare"), F.min(F.least("least", "greatest")).alias("least"), F.max(F.greatest("least", "greatest")).alias("greatest"))
    all_parts = few.groupBy("own").agg(F.flatten(F.collect_list(F.array("popular", "rare"))).alias("partners"), (F.min("least") != F.max("greatest")).alias("more"))
    partners = F.array_compact(F.concat("partners", F.array(F.when(F.col("more"), F.col("own")))))
    pairs = all_parts.select("own", F.explode(F.array_distinct(partners)).alias("partner"))
    return pairs.select(F.least("own", "partner").alias("a"), F.greatest("own", "partner").alias("b")).distinct()


def _other_meetings(classes: DataFrame, n: int, width: int, radius: int, similarity: float) -> DataFrame:
    """All pairs a < b of classes of different roots that meet and may be as similar.

    classes: cls, fps, size (of the shingle set), sketch and root. Pairs inside a group and
    pairs that their sizes or sketches rule out never leave their cell.
    """
    cells, free = _cells(classes, n, width, radius)

    def in_cell(cell: pa.Table) -> pa.Table:
        names, moved, flip, root = _numbers(cell, "cls", "moved", "flip", "root")
        if (root == root[0]).all():
            return _pair_table(np.empty((0, 2), np.int64))
        size = cell.column("size").to_numpy().astype(np.int64)
        parts = _shared(np.arange(len(names), dtype=np.uint64), moved, _ones(flip), free, radius)
        return _pair_table(_to_all(parts, names, moved ^ flip, root, size, Sketches(cell.column("sketch")), similarity, 2 * radius).view(np.int64))

    return cells.groupBy("t", "cell").applyInArrow(in_cell, "a long, b long").distinct()


def _by_pair(pairs: DataFrame, n: int, one: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``pairs`` with the columns of ``one`` (cls and others) for a and for b, named _a and _b."""
    for c in ("a", "b"):
        often = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("copies"))
        side = often.join(one.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
        pairs = join_hot(pairs, side, c, F.col("copies"), n).drop("copies")
    return pairs


def _may_be_similar(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sizes and sketches don't rule out that they are as similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.concatenate([b.column(f"size_{c}").to_numpy().astype(np.int64) for c in ("a", "b")])
            here = np.arange(b.num_rows)
            keep = Sketches(pa.chunked_array([b.column("sketch_a"), b.column("sketch_b")])).may_reach(here, here + b.num_rows, size, similarity)
            yield b.select(["a", "b"]).take(pa.array(keep))

    sizes = (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")) & (F.col("a") != F.col("b"))
    return _by_pair(pairs, pairs.count(), classes, ["size", "sketch"]).where(sizes).select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(near, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, classes: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs a, b (a stored table) whose whole shingle sets are as similar.

    A class's set comes from the text of one row, and only those of classes in a pair are made.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(text.as_py(), shingle_words) for text in b.column("text")]
            names = [class_of(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["cls", "shingles"])

    named = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = named.join(classes, "cls").select("row_key").distinct()
    whole = stored(texts.join(wanted, "row_key").select("text").mapInArrow(sets, "cls long, shingles array<long>").dropDuplicates(["cls"]), "similar-sets")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return _by_pair(pairs, pairs.count(), whole, ["shingles"]).where(both >= similarity * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b")


def similar_rows(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SIMILAR_WORDS, tables: int = TABLES, radius: int = 2) -> DataFrame:
    """doc_id, row_key, component_id and leads of every row of ``docs`` (doc_id, text).

    Texts with equal shingle sets are a class. Classes whose fingerprints of one table
    are within 2 * radius bits meet and are linked if the Jaccard similarity of their whole
    shingle sets reaches ``similarity``; component_id is the smallest doc_id reachable
    over links. Each is first held against the most popular and the rarest that it meets, then against all that it meets in other groups than its own, so that
    no meeting that could join two groups is left. What their sizes or sketches rule out
    isn't compared further; every link is exact. The fingerprints get a bit longer each
    time the rows double, so the pairs that meet by chance grow as the rows; there are
    ``tables`` of them, and as many more as the longer ones need for RECALL of the pairs
    just at ``similarity`` to meet.

    Null and wordless texts are one class. Repeated rows and rows that share a doc_id or
    have none are rows of their own; null doc_ids name no component that has others.
    leads is true for one row of a component, and for its exact repetitions. Other
    columns are ignored; an empty table gives an empty result.
    """
    n = docs.count()
    width = min(60, max(32, math.ceil(math.log2(max(2, n))) + 22))
    tables = tables_for(width, radius, similarity, tables)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, fps, size, sketch = [], [], [], []
            for text in b.column("text"):
                shingles = shingle_set(text.as_py(), shingle_words)
                cls.append(class_of(shingles))
                fps.append(short_fingerprints(shingles, tables, width) if len(shingles) else None)
                size.append(len(shingles))
                sketch.append(odd_sketch(shingles))
            made = [pa.array(cls, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *made], ["doc_id", "row_key", "cls", "fps", "size", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.mapInArrow(classed, "doc_id long, row_key long, cls long, fps array<long>, size long, sketch binary"), "similar-rows")
    classes = stored(rows.where("fps is not null").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("row_key", "fps", "size", "sketch")]), "similar-classes")
    met = stored(_meetings(classes, n, width, radius), "similar-met")
    near = stored(_may_be_similar(met.where("a <> b"), classes, similarity), "similar-near")
    links = stored(_similar(near, texts, classes, shingle_words, similarity), "similar-links")
    # What those few partners leave: the meetings between different groups.
    roots = components(links)
    more = met.where("a = b").select(F.col("a").alias("cls")).join(classes, "cls").join(roots, F.col("cls") == F.col("node"), "left")
    more = stored(more.select("cls", "fps", "size", "sketch", F.coalesce("root", "cls").alias("root")), "similar-more")
    others = _other_meetings(more, more.count(), width, radius, similarity)
    others = stored(others.join(near, ["a", "b"], "left_anti"), "similar-others")
    roots = components(links.union(_similar(others, texts, classes, shingle_words, similarity)))
    return _named(rows.select("doc_id", "row_key", "cls"), "cls", roots).drop("cls")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SIMILAR_WORDS, tables: int = TABLES, radius: int = 2) -> DataFrame:
    """doc_id and component_id of every row of ``docs``, as ``similar_rows`` finds them."""
    return similar_rows(docs, similarity, shingle_words, tables, radius).select("doc_id", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component in ``groups``; all columns stay.

    groups: row_key and leads of every row of ``docs``, from ``near_duplicates`` or
    ``similar_rows``. Of exact repetitions of a row's doc_id and text one stays. Rows are
    told apart by both, so none goes for sharing a doc_id, or having none.
    """
    key, other = fresh(docs, "row_key"), fresh(docs, "row_check")
    kept = stored(groups.where("leads").groupBy(F.col("row_key").alias(key)).agg(F.count(F.lit(1)).alias("times")), "kept-keys")
    keyed = docs.withColumn(key, row_key())
    once = keyed.join(kept.where("times = 1").select(key), key, "left_semi")
    # A second hash tells different rows apart that share the first.
    check = F.xxhash64(F.lit(SEED), F.col("text").cast("string"), F.col("doc_id").cast("long"))
    again = keyed.join(kept.where("times > 1").select(key), key, "left_semi").withColumn(other, check).dropDuplicates([key, other]).drop(other)
    return once.union(again).select(docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
