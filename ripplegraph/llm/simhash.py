"""SimHash near-duplicates: fingerprints compared exactly, tile by tile."""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import broadcast_if_small, checkpointed, free_names, joined_by_key, slices, text_of, written
from ripplegraph.llm.components import connected_components

#: Fingerprints in a tile at most, by expectation, and in a block of the comparison.
TILE, BLOCK = 1 << 15, 256
#: Texts in a group of the similarity check at most, and bytes of their shingles, by expectation.
TEXTS, SET_BYTES = 512, 4 << 20


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of words, A-Z lower-cased; of a shorter text the whole, of none nothing."""
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    return [line[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of what h is a hash of; for k = 0 h itself."""
    if not k:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, words: int, parts: int = 1) -> np.ndarray:
    """64 bits for each part: one is set if over half of the shingles' hashes have it; zero without words."""
    found = shingles(text, words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), dtype=np.uint64, count=len(found))
    out = np.zeros(parts, dtype=np.uint64)
    for k in range(parts if len(hashes) else 0):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(_mixed(hashes[at : at + (1 << 15)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int, parts: int = 1) -> DataFrame:
    """doc_id, ``_hash`` of the text, ``_fp`` (64 bits as a signed long) and ``_more`` (the other parts).

    Whole texts; null texts count as empty.
    """

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, words, parts) for t in b.column(2).to_pylist()], dtype=np.uint64).reshape(-1, parts)
            first, more = pa.array(fps[:, 0].view(np.int64)), pa.array([x.tobytes() for x in fps[:, 1:]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), first, more], names=["doc_id", "_hash", "_fp", "_more"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()), text_of().cast("binary"))
    return rows.mapInArrow(run, "doc_id long, _hash long, _fp long, _more binary")


def _ordered(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the bit counts of parts and bytes, and each block's least and most of the bytes'."""
    counts = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8)).reshape(-1, 8)
    halves = counts[:, 0::2] + counts[:, 1::2]
    order = np.lexsort((*counts.T, *halves.T))
    counts, starts = counts[order].astype(np.int16), np.arange(0, len(fps), BLOCK)
    return order, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The linked pairs' spanning forest: as many components, an edge less than nodes in each."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, within: int | None = None, names: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs within the radius of a tile and another (or itself), thinned to a spanning forest.

    A tile has a row of parts for each fingerprint; the radius is for the first part, and
    ``within`` for all parts together. Fingerprints go by their names, or else by their first
    parts. Blocks whose bit counts, byte by byte, differ by more
    than the radius in sum can't hold a pair and are skipped; all others are compared in full.
    """
    (order_a, low_a, high_a), (order_b, low_b, high_b) = _ordered(a[:, 0]), _ordered(b[:, 0])
    na, nb = names or (a[:, 0], b[:, 0])
    a, b, na, nb, found = a[order_a], b[order_b], na[order_a], nb[order_b], []
    fa, fb = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(b[:, 0])
    for i in range(len(low_a)):
        gap = np.maximum(low_a[i] - high_b, low_b - high_a[i]).clip(0).sum(axis=1)
        left = fa[i * BLOCK : (i + 1) * BLOCK]
        for j in np.flatnonzero(gap <= radius):
            right = fb[j * BLOCK : (j + 1) * BLOCK]
            x, y = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            x, y = i * BLOCK + x, j * BLOCK + y
            near = na[x] != nb[y]
            if within is not None and near.any():
                near &= np.bitwise_count(a[x] ^ b[y]).sum(axis=1) <= within
            if near.any():
                found += _forest(na[x[near]], nb[y[near]])
        if len(found) > 1 << 18:
            found = _forest(*np.array(found, dtype=np.uint64).T)
    return _forest(*np.array(found, dtype=np.uint64).T) if found else []


def _tile_of(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """A row of parts for each fingerprint, and the fingerprints' names."""
    first, names = (np.asarray(rows.field(k)).view(np.uint64) for k in (0, 2))
    more = np.frombuffer(b"".join(rows.field(1).to_pylist()), dtype=np.uint64).reshape(len(first), -1)
    return np.column_stack([first, more]), names


def near_links(fps: DataFrame, radius: int, within: int | None = None, tile: int = TILE) -> DataFrame:
    """u, v: edges that connect just the keys of fingerprints that links of the radius connect.

    ``fps`` has distinct ``_key``, and ``_fp`` and ``_more``. A tile holds fingerprints of one bit count, and
    meets only tiles whose bit count is the radius away at most. How many tiles a bit count
    needs comes from a table of 65 counts. Each pair of tiles is one row of a join of packed
    tiles. Exact comparison grows with the square of the distinct fingerprints, over the
    number of cores.
    """
    sizes = {r["_bits"]: r["n"] for r in fps.groupBy(F.bit_count("_fp").alias("_bits")).agg(F.count("*").alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for bits in range(65) for x in (bits, max(1, -(-sizes.get(bits, 0) // tile)))])
    tiles = (
        fps.select("_key", "_fp", "_more", F.bit_count("_fp").alias("_bits"))
        .withColumn("_part", F.pmod(F.xxhash64("_fp"), parts[F.col("_bits")]).cast("int"))
        .groupBy("_bits", "_part")
        .agg(F.collect_list(F.struct("_fp", "_more", "_key")).alias("_tile"))
    )
    left = (
        tiles.select(F.col("_tile").alias("_a"), F.col("_bits").alias("_ab"), F.col("_part").alias("_ap"))
        .withColumn("_bits", F.explode(F.sequence(F.col("_ab"), F.least(F.col("_ab") + radius, F.lit(64)))))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts[F.col("_bits")] - 1)))
        .where((F.col("_bits") > F.col("_ab")) | (F.col("_part") >= F.col("_ap")))
        .select("_a", "_bits", "_part")
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (a, na), (b, nb) = (_tile_of(batch.column(c)[k].values) for c in (0, 1))
                found = tile_links(a, b, radius, within, (na, nb))
                edges = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    return left.join(tiles, ["_bits", "_part"]).select("_a", "_tile").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """The rows of ``fingerprints`` with component_id."""
    rows = written(fingerprints(docs, words))
    nodes = written(rows.groupBy("_fp").agg(F.min("doc_id").alias("_least"), F.min("_more").alias("_more"), F.count("*").alias("_rows")))
    roots = connected_components(near_links(nodes.withColumn("_key", F.col("_fp")), radius))
    named = nodes.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_fp"))
    return _with_ids(rows, named, "_fp")


def _with_ids(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``rows`` and the component_id of their key; rows of a very common key don't meet in one task."""
    ids = _ids(named, key).withColumnRenamed(key, "_key")
    total = named.agg(F.sum("_rows")).first()[0] or 0
    return joined_by_key(rows, ids, F.col(key) == F.col("_key"), "_rows", total).drop("_key")


def _ids(named: DataFrame, key: str) -> DataFrame:
    """key, component_id, and the key's number of rows: the smallest id of each root's nodes, handed back to its nodes."""
    least = checkpointed(named.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("component_id"), F.count("*").alias("_n")))
    total = least.agg(F.sum("_n")).first()[0] or 0
    return joined_by_key(named.select(key, "_root", "_rows"), least, F.col("_root") == F.col("_r"), "_n", total).select(key, "component_id", "_rows")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own included; it is null
    only where every id there is null. Texts without words have fingerprint zero and are linked
    like any other. Repeated rows share their component, other columns are ignored, and no
    rows give none. Equal fingerprints are one node, so that copies are never paired.
    """
    digits = F.lpad(F.lower(F.hex("_fp")), 16, "0")
    return classes(docs, words, radius).select("doc_id", digits.alias("fingerprint"), "component_id")


#: For five-word shingles of which four fifths are shared, texts' 256 bits differ in 39 on
#: average and in 52 at most, but for one pair in a hundred; a first part in 18.
PARTS, FIRST_RADIUS, WITHIN = 4, 18, 52
#: Shared shingles of all shingles of two texts, as a fraction: from here on they are near-duplicates.
SHARED, OF = 4, 5


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words), repeat(42)), dtype=np.uint64))


class SharedCounts:
    """How many of a set's shingles each of some other sets has, by one look-up in all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        self.keys, self.owners = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, mine: np.ndarray) -> np.ndarray:
        """Which sets share four fifths of what they or this one have; sets without anything do."""
        lo, hi = (np.searchsorted(self.keys, mine, side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.sizes))
        return OF * shared >= SHARED * (len(mine) + self.sizes - shared)


def similar_links(a: pa.StructArray, b: pa.StructArray | None = None) -> list[tuple[int, int]]:
    """Of the texts of a group, and another if given, a spanning forest of the similar pairs.

    Every pair whose fingerprints are near is checked by its shingles; a text's with all
    others of the group at once.
    """
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    one = b is None
    sets = [[np.frombuffer(x, dtype=np.uint64) for x in rows.field(3).to_pylist()] for rows in ([a] if one else [a, b])]
    (fa, na), (fb, nb) = _tile_of(a), _tile_of(a if one else b)
    kept, left, right, others = [], na.view(np.int64).tolist(), nb.view(np.int64).tolist(), SharedCounts(sets[-1])
    for i, x in enumerate(left):
        bits = np.bitwise_count(fb ^ fa[i])
        near = (bits[:, 0] <= FIRST_RADIUS) & (bits.sum(axis=1) <= WITHIN)
        near[i if one else len(near) :] = False
        if not near.any():
            continue
        for j in np.flatnonzero(near & others.similar(sets[0][i])).tolist():
            if (p := top(x)) != (q := top(right[j])):
                up[p] = q
                kept.append((x, right[j]))
    return kept


def checked_links(docs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """u, v: edges that connect just the texts' hashes that similar pairs connect.

    ``texts`` has distinct ``_hash``, and ``_fp`` and ``_more``. Near fingerprints only say
    which texts are compared: those of a component of them, in groups dealt out by hash, each
    group with itself and each other one of its component. Work and rows grow with the square
    of a component's groups, and with the pairs that are near without being similar.
    """
    keyed = texts.withColumn("_key", F.xxhash64("_fp", "_more"))
    roots = connected_components(near_links(keyed.select("_key", "_fp", "_more").distinct(), FIRST_RADIUS, WITHIN))
    keyed = keyed.join(roots, F.col("_key") == F.col("node"), "left").select("_hash", "_fp", "_more", F.coalesce("root", "_key").alias("_root"))
    several = checkpointed(keyed.groupBy("_root").agg(F.count("*").alias("_n")).where("_n > 1"))
    several = broadcast_if_small(several, several.count(), 16)
    asked = checkpointed(keyed.join(several.select("_root"), "_root"))

    def run(batches):
        for b in slices(batches):
            found = pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["_text", "_set"])

    bodies = docs.select(F.xxhash64(text_of()).alias("_text"), text_of().cast("binary").alias("_body"))
    asked_for = broadcast_if_small(asked.select("_hash"), asked.count(), 8)
    bodies = bodies.join(asked_for, F.col("_text") == F.col("_hash"), "left_semi")
    sets = bodies.mapInArrow(run, "_text long, _set binary").groupBy("_text").agg(F.first("_set").alias("_set"))
    full = written(asked.join(sets, F.col("_hash") == F.col("_text")).select("_root", "_hash", "_fp", "_more", "_set"))
    sizes = full.groupBy("_root").agg(F.ceil(F.greatest(F.count("*") / TEXTS, F.sum(F.octet_length("_set")) / SET_BYTES)).cast("int").alias("_groups"))
    sizes = checkpointed(sizes.withColumn("_groups", F.greatest("_groups", F.lit(1))))
    dealt = full.join(broadcast_if_small(sizes, sizes.count(), 12), "_root").withColumn("_group", F.pmod(F.xxhash64("_hash"), F.col("_groups")).cast("int"))
    groups = dealt.groupBy("_root", "_group").agg(F.first("_groups").alias("_groups"), F.collect_list(F.struct("_fp", "_more", F.col("_hash").alias("_key"), "_set")).alias("_tile"))
    groups = written(groups)

    def edges_of(found):
        edges = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    def alone(batches):
        for b in slices(batches, 16):
            for k in range(b.num_rows):
                yield edges_of(similar_links(b.column(0)[k].values))

    def across(batches):
        for b in slices(batches, 1):
            yield edges_of(similar_links(b.column(0)[0].values, b.column(1)[0].values))

    later = groups.where("_group + 1 < _groups").select("_root", F.col("_tile").alias("_a"), F.explode(F.expr("sequence(_group + 1, _groups - 1)")).alias("_group"))
    pairs = later.join(groups.select("_root", "_group", "_tile"), ["_root", "_group"]).select("_a", "_tile")
    own = groups.where(F.size("_tile") > 1).select("_tile")
    return own.mapInArrow(alone, "u long, v long").union(pairs.mapInArrow(across, "u long, v long"))


def representatives(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of a row with a smaller doc_id.

    Near-duplicates share four fifths of their shingles, or are connected by texts that do; pairs
    are found by 256-bit fingerprints and checked by their shingles. Texts without words are
    alike, and null texts are empty ones. Rows that share both the smallest id and the text of
    their group all stay, as does a group without any id. Other columns may have any names, and
    no rows give none.
    """
    rows = written(fingerprints(docs, words, PARTS))
    texts = written(rows.groupBy("_hash").agg(F.min("doc_id").alias("_least"), F.min("_fp").alias("_fp"), F.min("_more").alias("_more"), F.count("*").alias("_rows")))
    roots = connected_components(checked_links(docs, texts, words))
    named = texts.join(roots, F.col("_hash") == F.col("node"), "left").select("_hash", "_least", "_rows", F.coalesce("root", "_hash").alias("_root"))
    id_, text_ = free_names(docs, "id", "text")
    gone = _with_ids(rows, named, "_hash").where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = checkpointed(gone.select(F.col("doc_id").alias(id_), F.col("_hash").alias(text_)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text_of()) == F.col(text_))
    return docs.join(broadcast_if_small(gone, gone.count(), 48), same, "left_anti")
