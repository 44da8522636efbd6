"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits the vectors of a label again and again by random directions, at
the median; vectors near a cut go to both sides.  A label's medians come from a
sample of about ``SAMPLE`` of its distinct vectors, taken in one task a label,
which writes the trees to the shared folder; every vector is routed.  Vectors
that share a leaf are compared exactly, in double precision, and linked from the
threshold on.  Vectors of one direction (to ``DIRECTION``), so copies and scaled
copies, are one unit with a multiplicity; else they would tie at every cut.

A pair may meet in several leaves: it counts in the least leaf both are in, so
links are counted without ever shuffling pairs; for components a leaf gives
back a spanning forest of its links.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TaskFile, hinted, open_fs, scratch, written
from .components import connected_components

TREES, LEAF, SPILL, SAMPLE = 5, 256, 0.08, 20_000
#: Steps of a component of a vector of length 1.
DIRECTION = 10**12
#: Rows compared with others at once inside a leaf.
TILE = 1024


def usable(vector: str, label: str):
    """Whether a vector can link: label not null; at least one component, all finite, not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def plant(x: np.ndarray, count: int, trees: int, leaf: int, spill: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For ``count`` vectors of which x are a sample: directions [tree, level, dim], and both ends of the overlap [tree, node] in heap order."""
    depth = int(np.ceil(np.log2(max(1, count / leaf))))
    depth = min(depth, int(np.log2(max(1, len(x) / 16))))
    if depth < 1:
        return None
    directions = np.random.default_rng(seed).standard_normal((trees, depth, x.shape[1]))
    low, high = np.zeros((trees, 2**depth - 1)), np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        inside = {0: np.arange(len(x))}
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = inside.pop(node)
                p = x[own] @ directions[t, level]
                low[t, node], high[t, node] = np.quantile(p, [0.5 - spill, 0.5 + spill]) if len(p) else (0, 0)
                inside[2 * node + 1], inside[2 * node + 2] = own[p <= high[t, node]], own[p >= low[t, node]]
    return directions, low, high


def route(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they are in."""
    directions, low, high = tree
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(directions.shape[1]):
        p = (x @ directions[t, level])[rows]
        left, right = p <= high[t, node], p >= low[t, node]
        rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return rows, node


def compare(x: np.ndarray, group: np.ndarray, leaves: list[np.ndarray], leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v), each in both orders, in one leaf: of one group, cosine from the threshold on; and counted here or not."""
    norm = np.sqrt((x * x).sum(1))
    width = max(map(len, leaves))
    table = np.full((len(x), width), -1, np.int64)
    for i, own in enumerate(leaves):
        table[i, : len(own)] = own
    us, vs = [], []
    unit = x / norm[:, None]
    for i in range(0, len(x), TILE):
        for j in range(0, len(x), TILE):
            u, v = np.nonzero(unit[i : i + TILE] @ unit[j : j + TILE].T >= threshold - 1e-9)
            u, v = u + i, v + j
            other = (u != v) & (group[u] == group[v])
            u, v = u[other], v[other]
            for k in range(0, len(u), 1 << 16):
                a, b = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
                sure = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= threshold
                us.append(a[sure])
                vs.append(b[sure])
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
    here = np.zeros(len(u), bool)
    for k in range(0, len(u), 1 << 14):
        a, b = table[u[k : k + (1 << 14)]], table[v[k : k + (1 << 14)]]
        common = (a[:, :, None] == b[:, None, :]).any(2) & (a >= 0)
        here[k : k + (1 << 14)] = np.where(common, a, np.iinfo(np.int64).max).min(1) == leaf
    return np.stack([u, v]), here


def similar(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per vector.

    Only vectors of equal label and length are compared.  Vectors that are null,
    empty, zero or hold a null or non-finite component, or whose label is null,
    link with nothing.  Copies link with each other; repeated rows are copies.
    Cosines of a unit are those of its least vector, so right to about 1e-11.
    A component's id is the smallest id in it, null ids aside.
    """
    from .simhash import roots

    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    double = F.transform("v", lambda x: x.cast("double"))
    rows = rows.withColumn("usable", usable("v", "label"))
    rows = rows.select("vec_id", "usable", F.when(F.col("usable"), F.concat_ws("/", F.col("label").cast("string"), F.size("v"))).alias("group"), F.when(F.col("usable"), double).alias("v"))
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))  # so that no square overflows or vanishes
    scaled = F.zip_with("v", F.array_repeat(largest, F.size("v")), lambda x, m: x / m)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    direction = F.zip_with("scaled", F.array_repeat(norm, F.size("scaled")), lambda x, n: F.round(x / n * DIRECTION).cast("bigint"))
    rows = rows.withColumn("scaled", F.when(F.col("usable"), scaled)).withColumn("direction", F.when(F.col("usable"), direction)).drop("scaled")
    rows = written(rows.withColumn("uid", F.when(F.col("usable"), F.xxhash64("group", "direction"))), "vectors")
    good = rows.filter("usable")

    def packed(batches):
        for b in batches:
            v = pa.array([np.array(x, "<f8").tobytes() for x in b.column("v").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("group"), v, b.column("mult"), b.column("first_id")], names=["uid", "group", "v", "mult", "first_id"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    units = good.groupBy("uid", "group", "direction").agg(F.min("v").alias("v"), F.count("*").alias("mult"), F.min("vec_id").alias("first_id"))
    units = written(units.select("uid", "group", "v", "mult", "first_id").mapInArrow(packed, f"uid bigint, group string, v binary, mult bigint, first_id {kind}"), "units")
    # labels that need no tree are left out
    large = written(units.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > leaf), "large_labels")
    taken = F.least(F.lit(1.0), sample / F.col("n")) * float(1 << 30)
    chosen = units.join(hinted(large), "group").filter(F.pmod("uid", F.lit(1 << 30)) < taken)
    folder = scratch(spark, "trees")

    def planted(table: pa.Table) -> pa.Table:
        group, n = table["group"][0].as_py(), table["n"][0].as_py()
        x = np.stack([np.frombuffer(x, "<f8") for x in table["v"].to_pylist()])
        tree = plant(x / np.sqrt((x * x).sum(1))[:, None], n, trees, leaf, spill, seed)
        names = []
        if tree is not None:
            file, data = TaskFile(folder, f"{zlib.crc32(group.encode()):08x}-{group.encode().hex()[:64]}.npz"), io.BytesIO()
            np.savez(data, *tree)
            file.write(data.getvalue())
            file.close()
            names.append(file.uri)
        return pa.table({"group": [group] * len(names), "tree": names}, schema=pa.schema([("group", pa.string()), ("tree", pa.string())]))

    planted_in = written(chosen.select("group", "n", "v").groupBy("group").applyInArrow(planted, "group string, tree string"), "planted")

    def loaded(uri: str):
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as found:
            return tuple(found[k] for k in found.files)

    def deal(batches):
        held: dict[str, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            uris = dict(zip(batch.column("group").to_pylist(), batch.column("tree").to_pylist()))
            names, vs = np.array(batch.column("group").to_pylist(), object), batch.column("v").to_pylist()
            out_rows, out_leaf = [], []
            for g in set(names):
                own = np.flatnonzero(names == g)
                code = int.from_bytes(g.encode()[-24:].rjust(24, b"\0"), "little") % ((1 << 31) - 1)
                if uris[g] is None:
                    out_rows.append(own)
                    out_leaf.append(np.full(len(own), code << 32))
                    continue
                if uris[g] not in held and len(held) >= 100:
                    held.clear()
                tree = held.setdefault(uris[g], held.get(uris[g]) or loaded(uris[g]))
                x = np.stack([np.frombuffer(vs[i], "<f8") for i in own])
                x = x / np.sqrt((x * x).sum(1))[:, None]
                for t in range(tree[0].shape[0]):
                    r, node = route(x, tree, t)
                    out_rows.append(own[r])
                    out_leaf.append((code << 32) + t * tree[1].shape[1] * 3 + node)
            r, lf = np.concatenate(out_rows), np.concatenate(out_leaf)
            order = np.argsort(r, kind="stable")
            r, lf = r[order], lf[order]
            ends = np.cumsum(np.bincount(r, minlength=batch.num_rows))
            lists = [np.sort(part).astype("<i8").tobytes() for part in np.split(lf, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(lf, pa.int64()), *(batch.column(c).take(pa.array(r)) for c in ("uid", "group", "v", "mult")), pa.array([lists[i] for i in r], pa.binary())], names=["leaf", "uid", "group", "v", "mult", "leaves"])

    def within(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        uid, mult = table["uid"].to_numpy(), table["mult"].to_numpy()
        names = table["group"].to_pylist()
        number: dict[str, int] = {}
        group = np.array([number.setdefault(g, len(number)) for g in names])
        count, root = np.zeros(len(uid), np.int64), np.arange(len(uid))
        leaf_id = int(table["leaf"][0].as_py())
        raw, leaves = table["v"].to_pylist(), [np.frombuffer(x, "<i8") for x in table["leaves"].to_pylist()]
        for length in set(map(len, raw)):  # vectors of other lengths meet only by a clash of codes
            own = np.array([i for i, x in enumerate(raw) if len(x) == length])
            (u, v), here = compare(np.stack([np.frombuffer(raw[i], "<f8") for i in own]), group[own], [leaves[i] for i in own], leaf_id, threshold)
            np.add.at(count, own[u[here]], mult[own[v[here]]])
            root[own] = own[roots(len(own), u, v)]
        some = np.flatnonzero((count > 0) | (root != np.arange(len(uid))))
        return pa.table({"uid": uid[some], "n": count[some], "peer": uid[root[some]]}, schema=pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("peer", pa.int64())]))

    dealt = units.join(hinted(planted_in), "group", "left").select("uid", "group", "v", "mult", "tree").mapInArrow(deal, "leaf bigint, uid bigint, group string, v binary, mult bigint, leaves binary")
    found = written(dealt.groupBy("leaf").applyInArrow(within, "uid bigint, n bigint, peer bigint"), "links")
    joined = connected_components(found.select(F.col("uid").alias("a"), F.col("peer").alias("b")))
    linked = found.groupBy("uid").agg(F.sum("n").alias("n"))
    named = units.select("uid", "mult", "first_id").join(linked, "uid", "left").join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("component", "uid"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("uid", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "uid").join(named, "uid", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
