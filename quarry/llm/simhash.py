"""SimHash near duplicates by tiled exact comparison.

Points (distinct fingerprints, or distinct texts with theirs) are sorted and cut
into tiles, each a file in the shared folder.  Two tiles are compared, by
exclusive-or and bit counts, unless their population counts differ beyond the
radius: two fingerprints differ in at least as many bits as the counts of their
parts (the quarters of one word, or the words of several) do in sum.  Inside a
pair of tiles the same test skips stretches of ``STRETCH``.  A pair of tiles
gives back a spanning forest of its links, never all links.

Given a similarity, candidates within the radius are verified by their exact
Jaccard similarity on sets of word shingles.  Then the number of shingles skips
tiles too, and a mark leaves out pairs that can't be similar: a bit of a mark is
the parity of the shingles that fall on it, so marks differ in no more bits than
the sets do in shingles.

The comparison is quadratic in the number of points, though over whole tiles;
there are at most ``MAX_TILES``, so what the driver plans is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TaskFile, drop_written, hinted, merge_blocks, open_fs, remove, scratch, text_bytes, written
from .components import connected_components

STRETCH = 512
LEAST_TILE, FULL_TILE, MAX_TILES = 1024, 1 << 16, 2000
#: Tiles that one row of the plan compares with another.
STRIP = 8
#: Words and similarity of verified copies.  Fingerprints of four words; pairs of
#: similarity 0.8 differ in 39 bits of 256 on average (standard deviation 6; 48 for sets
#: of 4 and 5 shingles), unlike ones in 128 (8).  Of the first word: 10 to 12 (3), and 32 (4).
WIDTH, SIMILARITY, WORDS, RADIUS, FIRST_RADIUS = 5, 0.8, 4, 76, 24
#: Bits of a mark.
MARK = 1024


def text_key(text: Column) -> Column:
    """Identity of a text; of a null that of an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of runs of ``width`` words in their order, ASCII-lowered, repeats included; fewer words are one run, none gives none."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of hash bits that each hash gives; the first is itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of ``words`` 64-bit words; a bit is set if over half the hashes set it, and of none zero."""
    total = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 255 << 8):
        part = hashes[at : at + (255 << 8)]
        for k in range(words):
            bits = np.unpackbits(_mixed(part, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) - len(bits) % 255
            total[k] += bits[whole:].sum(0, dtype=np.uint8)
            if whole:  # sums of 255 bits fit a byte
                total[k] += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits of a whole text, by all its shingles; of no words zero."""
    return int(majority(shingles(text, width, seed))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed 64-bit number; of a null text that of an empty one, zero."""

    def run(batches):
        for batch in merge_blocks(batches, limit=4 << 20):
            fp = np.array([fingerprint(t, width) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def mark(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own % np.uint64(MARK)).astype(np.int64), minlength=MARK) & 1 == 1).tobytes()


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """``(key, n, fp, mark)`` of each distinct text of ``(text_key, text)``: by its set of shingles, their number, and both."""

    def run(batches):
        for batch in merge_blocks(batches, limit=4 << 20):
            keys, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            own = [np.unique(shingles(t, width)) for t in text_bytes(batch.column(1).take(pa.array(at)))]
            fps = [majority(x, WORDS).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(x) for x in own], pa.int64()), pa.array(fps, pa.binary()), pa.array([mark(x) for x in own], pa.binary())], names=["key", "n", "fp", "mark"])

    return texts.mapInArrow(run, "key bigint, n bigint, fp binary, mark binary").dropDuplicates(["key"])


class Points:
    """The points of a tile: keys, fingerprints (a row of words each), and for verified copies sizes, marks and groups."""

    def __init__(self, batch):
        column = {n: batch.column(n) for n in batch.schema.names}
        flat = lambda n: column[n].to_numpy(zero_copy_only=False) if n in column else None
        rows = lambda n: np.frombuffer(b"".join(column[n].to_pylist()), "<u8").reshape(batch.num_rows, -1)
        self.key, self.n, self.group = flat("key"), flat("n"), flat("group")
        self.fp = rows("fp") if "fp" in column else self.key.view(np.uint64).reshape(-1, 1)
        self.mark = rows("mark") if "mark" in column else None
        self.first = np.ascontiguousarray(self.fp[:, 0])
        self.box = self._counts()

    def _counts(self) -> np.ndarray:
        """Rows: population counts of the parts, of the whole, and the number of shingles."""
        if self.fp.shape[1] == 1:
            parts = [np.bitwise_count((self.first >> np.uint64(16 * q)) & np.uint64(0xFFFF)) for q in range(4)]
        else:
            parts = [np.bitwise_count(w) for w in self.fp.T]
        parts = [p.astype(np.int64) for p in parts]
        return np.stack([*parts, sum(parts), self.n if self.n is not None else np.zeros_like(parts[0])])

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, and least and largest counts, of stretches of STRETCH points."""
        at = np.arange(0, len(self.key), STRETCH)
        return at, np.minimum.reduceat(self.box, at, 1), np.maximum.reduceat(self.box, at, 1)


def _near(lo1, hi1, lo2, hi2, radius: int, similarity: float | None) -> np.ndarray:
    """Whether points within two boxes of counts may link."""
    gap = np.maximum(0, np.maximum(lo2 - hi1, lo1 - hi2))
    near = np.maximum(gap[:-2].sum(0), gap[-2]) <= radius
    return near if similarity is None else near & (hi2[-1] >= similarity * lo1[-1]) & (hi1[-1] >= similarity * lo2[-1])


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by edges u-v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def _candidates(a: Points, b: Points, within: bool, radius: int, similarity: float | None):
    """``(x, y)``: places in a and b of points whose (first) words differ in few enough bits, by pairs of stretches that may link."""
    first = radius if similarity is None else FIRST_RADIUS
    at1, lo1, hi1 = a.stretches()
    at2, lo2, hi2 = b.stretches()
    for i, s in enumerate(at1):
        near = np.flatnonzero(_near(lo1[:, i, None], hi1[:, i, None], lo2, hi2, radius, similarity))
        for j in near[near >= i] if within else near:
            x, y = np.nonzero(np.bitwise_count(a.first[s : s + STRETCH, None] ^ b.first[None, at2[j] : at2[j] + STRETCH]) <= first)
            if within and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x + s, y + at2[j]


def link_tiles(a: Points, b: Points | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of two tiles (or within one) at most ``radius`` bits apart."""
    keys = a.key if b is None else np.concatenate([a.key, b.key])
    shift = 0 if b is None else len(a.key)
    u, v, held = [], [], 0

    def spanned():
        r = roots(len(keys), np.concatenate(u), np.concatenate(v)) if u else np.arange(len(keys))
        moved = np.flatnonzero(r != np.arange(len(r)))
        return moved, r[moved]

    for x, y in _candidates(a, b or a, b is None, radius, None):
        u.append(x)
        v.append(y + shift)
        held += len(x)
        if held > 2_000_000:
            moved, root = spanned()
            u, v, held = [moved], [root], len(moved)
    moved, root = spanned()
    return keys[moved], keys[root]


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    root = parent[x]
    while not np.array_equal(root, up := parent[root]):
        root = up
    parent[x] = root
    return root


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of edges in order of preference, those of a spanning forest: each component takes its first edge to another, again and again."""
    taken, left = [], np.arange(len(u))
    while True:
        a, b = _find(parent, u[left]), _find(parent, v[left])
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return np.array(taken, np.int64)
        _, at = np.unique(np.column_stack([a, b]).ravel(), return_index=True)  # the first edge of each
        for k in np.unique(at // 2):
            x, y = int(a[k]), int(b[k])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                taken.append(left[k])


def copy_tiles(a: Points, b: Points | None, radius: int, similarity: float, all_pairs: bool):
    """Pairs of texts of two tiles (or within one) that may be similar and are of different groups, some at a time: a spanning forest, or all."""
    shift = 0 if b is None else len(a.key)
    within, b = b is None, b or a
    parent = np.arange(shift + len(b.key))
    for x, y in _candidates(a, b, within, radius, similarity):
        ok = a.group[x] != b.group[y] if all_pairs else _find(parent, x) != _find(parent, y + shift)
        x, y = x[ok], y[ok]
        ok = (np.minimum(a.n[x], b.n[y]) >= similarity * np.maximum(a.n[x], b.n[y]) - 1e-9) & (np.bitwise_count(a.fp[x] ^ b.fp[y]).sum(1, dtype=np.int64) <= radius)
        x, y = x[ok], y[ok]
        unlike = np.bitwise_count(a.mark[x] ^ b.mark[y]).sum(1, dtype=np.int64) / (a.n[x] + b.n[y]).clip(1)
        ok = np.flatnonzero(unlike <= (1 - similarity) / (1 + similarity) + 1e-9)
        if not all_pairs and len(ok):
            ok = ok[np.argsort(unlike[ok], kind="stable")]
            ok = ok[_forest(parent, x[ok], y[ok] + shift)]
        if len(ok):
            yield a.key[x[ok]], b.key[y[ok]]


def _compared(points: DataFrame, order: list[Column], radius: int, similarity: float | None = None, all_pairs: bool = False) -> DataFrame:
    """``(a, b)``: what the pairs of tiles that may link give back, written."""
    spark, n = points.sparkSession, points.count()
    size = max(min(FULL_TILE, max(LEAST_TILE, -(-n // 24))), -(-n // MAX_TILES))
    dealt = points.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    folder = scratch(spark, "tiles")

    def pack(batches):
        from pyspark import TaskContext

        part, no, held = TaskContext.get().partitionId(), 0, []

        def tile(batch):
            name = (part << 20) + no
            box = Points(batch).box
            file = TaskFile(folder, f"{name}.arrow")
            with pa.ipc.new_stream(file.out, batch.schema) as out:
                out.write_batch(batch)
            file.close()
            return pa.RecordBatch.from_pydict({"tile": [name], "lo": [box.min(1).tolist()], "hi": [box.max(1).tolist()]})

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= size:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                at = 0
                while whole.num_rows - at >= size:
                    yield tile(whole.slice(at, size))
                    no, at = no + 1, at + size
                held = [whole.slice(at)]
        if sum(x.num_rows for x in held):
            yield tile(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    boxes = sorted((r["tile"], r["lo"], r["hi"]) for r in dealt.mapInArrow(pack, "tile bigint, lo array<bigint>, hi array<bigint>").collect())  # some MAX_TILES rows
    plan = []
    if boxes:
        ids, lo, hi = [x[0] for x in boxes], np.array([x[1] for x in boxes]).T, np.array([x[2] for x in boxes]).T
        for i in range(len(ids)):
            near = [int(j) for j in np.flatnonzero(_near(lo[:, i, None], hi[:, i, None], lo, hi, radius, similarity)) if j >= i]
            plan += [(ids[i], [ids[j] for j in near[k : k + STRIP]]) for k in range(0, len(near), STRIP)]
    strips = spark.createDataFrame(plan, "i bigint, js array<bigint>").repartition(max(12, min(len(plan), 10_000)))

    def compare(batches):
        fs, root = open_fs(folder)

        def tile(name):
            with fs.open_input_file(f"{root}/{name}.arrow") as f:
                return Points(pa.ipc.open_stream(f.read()).read_next_batch())

        for batch in batches:
            for i, js in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tile(i)
                for j in js:
                    other = None if j == i else tile(j)
                    found = [link_tiles(own, other, radius)] if similarity is None else copy_tiles(own, other, radius, similarity, all_pairs)
                    for a, b in found:
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    out = written(strips.mapInArrow(compare, "a bigint, b bigint"), "links")
    remove(spark, folder)
    return out


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: links that join the distinct fingerprints (column ``fp``) as all links at most ``radius`` bits long do."""
    quarters = [F.bit_count(F.shiftrightunsigned("key", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    return _compared(distinct.select(F.col("fp").alias("key")), [F.bit_count("key"), *quarters, F.col("key")], radius)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable by links of fingerprints at most ``radius`` bits apart.

    A row per document; texts without words (and nulls) have fingerprint zero and
    link like any other; equal fingerprints link; a null id joins in but never
    names a component that has another id; no documents give no rows.
    """
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fps")
    joined = connected_components(links(distinct, radius))
    classes = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(a, b, similar)`` of distinct pairs of text keys, by exact similarity of their sets of shingles; written."""
    keys = written(pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct(), "keys")
    some = texts.join(hinted(keys), "text_key", "left_semi")
    some = written(some.groupBy("text_key").agg(F.first("text").alias("text")), "candidate_texts")

    def compare(batches):
        key, held = None, None
        for batch in batches:
            similar = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if key != a:  # rows of one text follow one another
                    key, held = a, np.unique(shingles(x.as_py() or b"", width))
                other = np.unique(shingles(y.as_py() or b"", width))
                both = len(np.intersect1d(held, other, assume_unique=True))
                similar.append(both >= similarity * (len(held) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.bool_())], names=["a", "b", "similar"])

    side = lambda x: some.select(F.col("text_key").alias(x), F.col("text").alias(f"text_{x}"))
    out = written(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint, similar boolean"), "verified")
    drop_written(keys)
    drop_written(some)
    return out


def similar_texts(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """``(text_key, component)`` of the distinct texts that links of ``similarity`` or more on shingles of ``width`` words join to others; written.

    Texts are told apart by ``text_key``, a 64-bit hash.  Texts without words
    (and nulls) have no shingles and are all alike.  Candidates are the pairs of
    texts whose 256-bit fingerprints differ in at most ``radius`` bits; a pair
    that is just similar is missed about once in ten thousand times, closer ones
    hardly ever, and nothing below the similarity links.

    First a spanning forest of the candidates is verified.  Where one of its
    pairs fails, all pairs of that tree whose ends are not linked yet are.
    """
    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    points = written(signatures(texts, width), "signatures")
    order = [F.col("n"), F.col("key")]
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    forest = written(_compared(points, order, radius, similarity).select(*pair).distinct(), "forest")
    checked = _verified(forest, texts, width, similarity)
    linked = checked.filter("similar").select("a", "b")
    failed = checked.filter("NOT similar").select(F.col("a").alias("node"))
    if not failed.isEmpty():
        trees = written(connected_components(forest), "trees")
        doubtful = trees.join(trees.join(failed, "node", "left_semi").select("component").distinct(), "component", "left_semi")
        grouped = connected_components(linked).withColumnRenamed("component", "group")
        some = doubtful.select(F.col("node").alias("key")).join(grouped.withColumnRenamed("node", "key"), "key", "left")
        some = written(points.join(some, "key").withColumn("group", F.coalesce("group", "key")), "doubtful")
        rest = _compared(some, order, radius, similarity, all_pairs=True).select(*pair).distinct().join(checked, ["a", "b"], "left_anti")
        linked = linked.unionByName(_verified(written(rest, "rest"), texts, width, similarity).filter("similar").select("a", "b"))
    return connected_components(linked).withColumnsRenamed({"node": "text_key"})
