"""SimHash near-duplicate detection with bit-sliced comparison.

A fingerprint bit is set where it is set in over half the shingle hashes. Fingerprints that differ in at most `radius` bits
link, and documents reach one another over links.

Candidates: rows meet in the buckets of their keys. A fingerprint that is cut into radius + 3 blocks has one key for every
choice of three of them; two fingerprints within the radius agree on three blocks at least, so no link is lost. A bucket over `tile`
rows is dealt out over pairs of tiles, each pair a unit of work of its own. Within a stretch of bucket-sorted rows the bit planes
are stored vertically, as integers with a bit for every row: a shift by s and an XOR compares all rows with those s further
on, carry-save counters that overflow beyond the radius add the planes up, and the shift is abandoned once no pair is left.

Null or empty texts have the fingerprint zero, linked like any other; a text with fewer words than a shingle is one
shingle. Equal fingerprints meet as one node, so a group of copies costs one comparison. Null ids take part, and count as
no id in the least id of a component. Empty input: empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, cut, likely, stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 with seed 42 of every run of `words` words, A-Z lower-cased, split at ASCII white space."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(b" ".join(s), 42) for s in runs]), dtype=">u8").astype(np.uint64)


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64 bits of the hashes; the 0-th are the hashes themselves."""
    if k == 0:
        return h
    z = h + np.uint64(int(GOLDEN) * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65_536):
        part = h[a : a + 65_536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: Column, words: int = 3) -> Column:
    """array<bigint> of one: 64 fingerprint bits of the shingles, repeats included."""

    @F.arrow_udf("array<bigint>")
    def prints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            rows = []
            for x in t.cast(pa.binary()).to_pylist():
                h = shingle_hashes(x, words)
                rows.append([int(np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view("<i8")[0])])
            yield pa.array(rows, pa.list_(pa.int64()))

    return prints(text)


def probes(counts: np.ndarray, n: int, bands: int, width: int) -> np.ndarray:
    """Keys of `bands` bands of `width` bits: each band's bits, and those with its two least sure bits turned over.

    A bit that a few shingles decide is the one that a near copy has otherwise, so a band meets far more near copies by its four
    keys than by one.
    """
    at = (np.arange(bands) * 7 % (len(counts) // 16) * 16)[:, None] + np.arange(width)
    margin, bits = np.abs(2 * counts[at] - n), (2 * counts[at] > n).astype(np.int64)
    unsure = np.argpartition(margin, 1, axis=1)[:, :2]
    value, (one, two) = (bits << np.arange(width)).sum(axis=1), (1 << unsure).T
    keys = np.stack([value, value ^ one, value ^ two, value ^ one ^ two], axis=1)
    return (keys + (np.arange(bands) << 32)[:, None]).ravel()


def sketch(text: Column, words: int, lanes: int, bands: int, width: int, few: int = 16) -> Column:
    """struct<node, fp, keys>: a hash of the set of shingles, lanes * 64 fingerprint bits of it, and the keys of its buckets.

    The bits of a set of `few` shingles or fewer say little, so it has as further keys the hashes of the set itself and of the set
    without each one of its shingles: sets that differ in one of them, by insertion or exchange, meet for certain.
    """

    @F.arrow_udf("struct<node:bigint,fp:array<bigint>,keys:array<bigint>>")
    def sketches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            node, fps, keys = [], [], []
            for x in t.cast(pa.binary()).to_pylist():
                h = np.unique(shingle_hashes(x, words))
                node.append(xxhash.xxh64_intdigest(h.tobytes(), 3) - (1 << 63))
                if not len(h):
                    fps.append([0] * lanes)
                    keys.append([])
                    continue
                counts = np.concatenate([bit_counts(remixed(h, k)) for k in range(lanes)])
                fps.append(np.packbits(2 * counts > len(h), bitorder="little").view("<i8"))
                found = probes(counts, len(h), bands, width)
                if len(h) <= few:
                    each = remixed(h, lanes)
                    found = np.concatenate((found, np.append(each.sum(dtype=np.uint64) - each, each.sum(dtype=np.uint64)).view(np.int64)))
                keys.append(found)
            lists = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(fps, lists), pa.array(keys, lists)], ["node", "fp", "keys"])

    return sketches(text)


def planes_of(fps: np.ndarray) -> list[int]:
    """The bit planes of (n, lanes) fingerprints: integers whose bit r is the bit of row r."""
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in np.packbits(bits.T, axis=1, bitorder="little")]


def rows_of(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little"))


def within(alive: int, n: int, radius: int, differ: Iterator[int]) -> int:
    """Of the n places that `alive` marks, those at which at most `radius` of the given planes have a one.

    Two planes at a time go into carry-save counters that overflow beyond the radius; no plane is read once no place is left.
    """
    digits_n, ones = max(1, radius.bit_length()), (1 << n) - 1
    start = (1 << digits_n) - 1 - radius
    digits = [ones if start >> d & 1 else 0 for d in range(digits_n)]
    for a, b in zip(differ, differ, strict=True):
        u, low = a ^ b, digits[0]
        digits[0] = u ^ low
        carry = (a & b | u & low) & alive
        for d in range(1, digits_n):
            if not carry:
                break
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        alive &= ~carry
        if not alive:
            break
    return alive


def mask_of(rows: np.ndarray) -> int:
    return int.from_bytes(np.packbits(rows, bitorder="little").tobytes(), "little")


def close_pairs(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of equal group, group-sorted, whose fingerprints differ in at most `radius` bits."""
    n, planes, found = len(group), planes_of(fps), [(np.zeros(0, dtype=np.int64),) * 2]
    for s in range(1, n):
        same = group[:-s] == group[s:]
        if not same.any():
            break
        alive = within(mask_of(same), n, radius, (p ^ p >> s for p in planes))
        found.append((i := rows_of(alive, n), i + s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def connected_rows(group: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For each row the least row that it reaches over pairs of equal group, group-sorted, within the radius.

    Pairs that are connected already aren't compared. Shifts compare rows with those s further on; once fewer rows are outside their
    group's largest component than shifts are to come, each of these rows is compared with all others instead. So a group of near
    copies costs a few shifts, however many pairs it has, and a turn for each stranger in it.
    """
    n, planes, label = len(group), planes_of(fps), np.arange(len(group))
    _, number, sizes = np.unique(group, return_inverse=True, return_counts=True)
    number = number.ravel()

    def join(i: np.ndarray, j: np.ndarray) -> None:
        new = stars(n, *np.unique(np.stack([label[i], label[j]]), axis=1))
        label[:] = new[label]

    for s in range(1, int(sizes.max(initial=0))):
        if s & (s - 1) == 0:
            count = np.bincount(label, minlength=n)[label]
            largest = np.zeros(len(sizes), dtype=np.int64)
            np.maximum.at(largest, number, count * n + label)  # the larger count, then the larger label
            outside = np.flatnonzero(label != largest[number] % n)
            if len(outside) <= sizes.max() - s:
                break
        alive = mask_of((group[:-s] == group[s:]) & (label[:-s] != label[s:]))
        i = rows_of(within(alive, n, radius, (p ^ p >> s for p in planes)), n) if alive else label[:0]
        if len(i):
            join(i, i + s)
    else:
        return label
    ones = (1 << n) - 1
    for r in outside.tolist():
        alive = mask_of((group == group[r]) & (label != label[r]))
        i = rows_of(within(alive, n, radius, (p ^ ones if p >> r & 1 else p for p in planes)), n) if alive else label[:0]
        if len(i):
            join(i, np.full(len(i), r))
    return label


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the pairs."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def dealt(prints: DataFrame, tile: int) -> DataFrame:
    """(key, i, j, node, fp) of prints (node, fp, keys), sorted into units: a bucket's pair of tiles."""
    rows = prints.select("node", "fp", F.explode("keys").alias("key"))
    # Few keys pass the size of a tile, so the planner can broadcast them by their stored size; where there are many it joins.
    hot = stored(rows.groupBy("key").count().where(F.col("count") > tile), "buckets")
    rows = rows.join(hot, "key", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "fp")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def compared(rows: DataFrame, found: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What found(group, node, fps) returns for stretches of whole units of dealt()'s rows."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(unit: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return found(np.unique(unit, axis=0, return_inverse=True)[1].ravel() if len(unit) else unit[:, 0], node, fps)

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            node = batch.column(3).to_numpy(zero_copy_only=False)
            fps = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            if rest:
                unit, node, fps = (np.concatenate(x) for x in zip(rest, (unit, node, fps), strict=True))
            last = np.flatnonzero((unit != unit[-1]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0
            rest = unit[end:], node[end:], fps[end:]
            for part in slices(unit[:end]):
                yield of(unit[part], node[part], fps[part])
        if rest:
            yield of(*rest)

    return rows.mapInArrow(compare, schema)


def links(prints: DataFrame, radius: int, tile: int = 1024) -> DataFrame:
    """Edges (a, b) that connect the rows of prints (node, fp, keys) as all links within `radius` bits would."""

    def connected(group: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        label = connected_rows(group, fps, radius)
        moved = np.flatnonzero(node != node[label])
        return pa.RecordBatch.from_arrays([pa.array(node[moved], pa.int64()), pa.array(node[label[moved]], pa.int64())], ["a", "b"])

    return compared(dealt(prints, tile), connected, "a long, b long").distinct()


def shingle_set(text: Column, words: int) -> Column:
    """array<int>: the distinct shingle hashes, of 32 bits each, which move a similarity by less than a hundred-thousandth."""

    @F.arrow_udf("array<int>")
    def sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array([np.unique(shingle_hashes(x, words).astype(np.uint32)).view(np.int32) for x in t.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))

    return sets(text)


def similar(flat: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray:
    """Labels of the sets flat[ends[k]:ends[k + 1]], none empty: equal where links of Jaccard similarity `least` or more connect them.

    A set is compared with all sets of other labels at once. Sets of the largest label need no turn of their own, as each of
    the others is compared with them; so a group whose members soon meet costs a few turns and not one for each pair.
    """
    n, size = len(ends) - 1, np.diff(ends)
    codes = np.unique(flat, return_inverse=True)[1].ravel()
    mark = np.zeros(codes.max() + 1, dtype=bool)
    label, seen = np.arange(n), np.zeros(n, dtype=bool)
    while True:
        turn = np.flatnonzero(~seen & (label != np.bincount(label, minlength=n).argmax()))
        if not len(turn):
            return label
        p = turn[0]
        seen[p] = mark[codes[ends[p] : ends[p + 1]]] = True
        shared = np.add.reduceat(mark[codes], ends[:-1], dtype=np.int64)
        mark[codes[ends[p] : ends[p + 1]]] = False
        near = (shared + 1e-9 >= least * (size + size[p] - shared)) & (label != label[p])
        if near.any():
            label[np.isin(label, label[near])] = label[p]


def verified(sets: DataFrame, least: float, tile: int = 1024, tile_items: int = 1_000_000) -> DataFrame:
    """Edges (a, b, whole) that connect the rows of sets (root, node, set) of equal root as all their links of `least` or more would.

    All members of a root are compared, none of them skipped: a root with more than `tile` members, or with long sets, is dealt out
    over pairs of tiles. What leaves a unit is one edge for each member that has a link, however many links it has. Where a root is one
    unit, `whole`, all members of a group have the edge to the same one.
    """
    size = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.size("set")) / tile_items)).cast("int").alias("tiles")).where("tiles > 1")
    rows = sets.join(stored(size, "roots"), "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "set", (F.col("tiles") == 1).alias("whole"))
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: pa.Table) -> pa.RecordBatch:
            node, lists = part.column("node").to_numpy(), part.column("set").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            unit = np.column_stack([part.column(c).to_numpy().astype(np.int64) for c in ("root", "i", "j")])
            at = np.concatenate(([0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, [len(unit)]))
            a, b = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                label = similar(flat[ends[s] : ends[e]], ends[s : e + 1] - ends[s], least)
                a.append(node[s:e])
                b.append(node[s:e][label])
            a, b, whole = np.concatenate(a), np.concatenate(b), part.column("whole").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64()), pa.array(whole[a != b])], ["a", "b", "whole"])

        rest = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            got = pa.concat_tables([rest, got]) if rest is not None else got
            unit = np.column_stack([got.column(c).to_numpy().astype(np.int64) for c in ("root", "i", "j")])
            last = np.flatnonzero((unit != unit[-1:]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield edges(got.slice(0, end))
            rest = got.slice(end)
        if rest is not None and rest.num_rows:
            yield edges(rest)

    return rows.mapInArrow(compare, "a long, b long, whole boolean").distinct()


def slices(unit: np.ndarray, most: int = 8192) -> Iterator[slice]:
    """Stretches of about `most` rows that end where a unit does."""
    ends = np.append(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, len(unit)) if len(unit) else []
    start = 0
    for e in ends:
        if e - start >= most or e == len(unit):
            yield slice(start, e)
            start = e


def block_keys(fp: Column, radius: int) -> Column:
    """The keys of a 64-bit fingerprint: every choice of three of its radius + 3 blocks, hashed with the choice."""
    at = [64 * k // (radius + 3) for k in range(radius + 4)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]
    masks = [x | y | z for x, y, z in combinations(block, 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(m)), F.lit(k)) for k, m in enumerate(signed)])


def grouped(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component): the least id of the nodes that have the same root in roots (node, root), for each row of nodes (node, least)."""
    joined = nodes.join(roots, "node", "left")
    joined = joined.select("node", "least", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    return joined.join(least, "root").select("node", "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) for each row of docs: 64-bit fingerprints linked exactly at `radius` bits."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")).select("id", F.col("fp")[0].alias("node")))
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("least")))
    keyed = nodes.select("node", F.array("node").alias("fp"), block_keys(F.col("node"), radius).alias("keys"))
    groups = grouped(nodes, components(links(keyed, radius)))
    return prints.join(groups, "node", "left").select("id", F.col("node").alias("fp"), "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, lanes: int = 8, radius: int = 128, bands: int = 10, width: int = 16) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the least id (nulls last), then the least text hash.

    A document is its set of shingles, equal sets being one node. Nodes that share a bucket and differ in `radius` of the lanes * 64
    fingerprint bits at most are candidates, and candidates that reach one another form a cluster. Within a cluster all members
    are compared by the Jaccard similarity of their sets, and those that links of `least` or more connect are one group: no
    link between members of a cluster is lost, and none is below the limit. Shingle sets of similarity 0.8 differ in about 77
    bits with a deviation of 8, so the radius holds them all but for chance; ten bands of four keys miss about one pair in a
    hundred at exactly 0.8, and far fewer above. Buckets grow with the corpus: `width` may go up to 16 and `bands` to
    lanes * 4. Rows with equal id and text are one document. Null and empty texts are one node.
    """
    th = F.xxhash64(F.col(text_col)).alias("th")
    made = docs.select(F.col(id_col).alias("doc"), th, sketch(F.col(text_col), words, lanes, bands, width).alias("s"))
    key = F.struct(F.col("doc").isNull().alias("null"), F.col("doc").alias("doc"), F.col("th").alias("th"))
    prints = stored(made.select(key.alias("id"), "s.node", "s.fp", "s.keys"), "sketches")
    nodes = stored(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    clusters = components(links(nodes.select("node", "fp", "keys"), radius))
    # The texts of the clusters alone: one for each node, found by the hashes of its least id and text.
    met = cut(clusters.join(nodes.select("node", "least"), "node").select("root", "node", F.xxhash64("least.doc").alias("d"), F.col("least.th").alias("th")))
    texts = likely(docs.select(F.xxhash64(id_col).alias("__d"), F.xxhash64(F.col(text_col)).alias("__th"), F.col(text_col).alias("__text")), met.select("d", "th")).where("__hit")
    texts = texts.join(met, (F.col("__d") == F.col("d")) & (F.col("__th") == F.col("th"))).select("root", "node", shingle_set(F.col("__text"), words).alias("set"))
    sets = stored(texts.dropDuplicates(["node"]), "shingles")
    edges = cut(verified(sets, least))
    roots = edges.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(components(edges.where("NOT whole")))
    kept = grouped(nodes.select("node", "least"), roots).select(F.col("component.doc").alias("__doc"), F.col("component.th").alias("__th")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), th.alias("__h"))
    rows = rows.join(kept, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__th")), "left_semi")
    return rows.groupBy("__id", "__h").agg(F.first("__row").alias("__row")).select("__row.*")
