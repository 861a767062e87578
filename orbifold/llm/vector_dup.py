"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, exact cosine reranking.

Vectors are compared only under equal labels. A rotation of the principal components is learnt so that signs
lose least (iterative quantisation), and each bit is cut at the sample's median, so codes are balanced. Every vector
is indexed in several tables, each keyed by a stretch of a code. Pairs at the threshold are made of sampled vectors,
and tables, from as many rotations as that needs, are added until the share :data:`RECALL` of these pairs has met in
one; they are as wide as costs least. The radius in which the Hamming distances of nearly all made pairs
(:data:`WITHIN`) lie is taken for the search. With ``exact`` every label is compared whole, which misses nothing.

Tables hold ids and codes of 8 bytes. Buckets are cut into blocks; a task searches two of them for codes within
the radius, and only vectors that have such a neighbour are sent to the bucket, once for each, and
reranked there by cosine in double precision. A pair that meets in several tables counts in the first only, so no
pair leaves a task: counts per vector and the links that join components do. A label that is compared whole for less
has one table with one key and no radius, which misses no link.

Exact copies are one vector with a count. Null labels, null, empty or zero vectors and vectors with null or
non-finite components link with nothing and are their own component. Null ids are left out of links, with null
component. Rows that repeat an id count as vectors of their own. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, in_task, stored
from .components import components

COSINE = 0.93
#: Vectors that the rotations are fitted on at most; all are indexed.
FIT_ROWS = 10_000
ROUNDS = 30
#: Share of the made pairs at the threshold, of each kind, that have to meet in a table, and how many are made.
RECALL, PROBES = 0.985, 2_000
#: Share of the made pairs of each kind whose codes are within the radius.
WITHIN = 0.998
#: Comparisons that take as long as moving a vector to a bucket.
MOVE = 2_000
#: Vectors of a bucket that a task compares with as many others, and those of them at a time.
BLOCK, TOGETHER = 4_096, 256


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, projection): principal components turned so that their signs approximate them best, and where each of
    these is cut in two equal halves."""
    mean = x.mean(axis=0)
    y = x - mean
    _, _, axes = np.linalg.svd(y.T @ y)
    y = y @ axes[:bits].T
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
        r = (u @ v).T
    projection = axes[:bits].T @ r
    return np.median(x @ projection, axis=0), projection


def made_pairs(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample and others at ``cosine`` from them: half in any direction, half where the sample varies."""
    rng = np.random.default_rng(11)
    a = x[rng.integers(len(x), size=2 * PROBES)]
    away = x[rng.integers(len(x), size=PROBES)] - x[rng.integers(len(x), size=PROBES)]
    u = np.concatenate([rng.normal(size=away.shape), away])
    u -= (u * a).sum(axis=1, keepdims=True) * a
    norm = np.sqrt((u * u).sum(axis=1, keepdims=True))
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 1e-9)
    y = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * u
    return a, np.where(norm > 1e-9, y, a)


def share_met(met: np.ndarray) -> float:
    """The share of made pairs that met, of the kind that meets less."""
    return min(met[:PROBES].mean(), met[PROBES:].mean())


def signs(rotation: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    cuts, projection = rotation
    return (x @ projection >= cuts).astype(np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """The first 64 bits of each code as one number."""
    bits = bits[:, :64].astype(np.uint64)
    return bits @ (np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64))


def stretches(bits: np.ndarray, width: int) -> np.ndarray:
    """The keys of codes in the tables of ``width``."""
    starts = range(0, bits.shape[1] - width + 1, width)
    return np.stack([bits[:, i : i + width] @ (1 << np.arange(width, dtype=np.int64)) for i in starts], axis=1)


def tables_needed(equal: np.ndarray, width: int) -> float:
    """Tables until the share :data:`RECALL` of pairs met, from the share of equal bits of each."""
    once, low, high = equal**width, 0, 1
    while high < 1 << 20 and share_met(1 - (1 - once) ** high) < RECALL:
        low, high = high, 2 * high
    if high >= 1 << 20:
        return math.inf
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if share_met(1 - (1 - once) ** middle) >= RECALL else (middle, high)
    return high


def least_width(codes: np.ndarray, labels: np.ndarray, equal: np.ndarray, most: int) -> int:
    """The width of keys that costs least for a label of ``most`` vectors; 0 compares the whole label."""
    _, of, counts = np.unique(labels, return_inverse=True, return_counts=True)
    pairs = max(1, int((counts * (counts - 1)).sum()))
    best, least = 0, MOVE * math.ceil(most / BLOCK) + most
    for width in range(1, min(codes.shape[1], math.ceil(math.log2(max(2, most)))) + 1):
        keys = stretches(codes, width)
        met = [np.unique(of * (1 << width) + keys[:, t], return_counts=True)[1] for t in range(keys.shape[1])]
        bucket = most * float(np.mean([(n * (n - 1)).sum() for n in met])) / pairs
        cost = tables_needed(equal, width) * (MOVE * max(1.0, bucket / BLOCK) + bucket)
        if cost < least:
            best, least = width, cost
    return best


class Tables:
    """The keys of a vector in each table."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, most: int, cosine: float, exact: bool = False) -> None:
        bits = x.shape[1]
        a, y = made_pairs(x, cosine)
        self.maps = [learn_rotation(x, bits, 0)]
        self.width = 0 if exact else least_width(signs(self.maps[0], x), labels, (signs(self.maps[0], a) == signs(self.maps[0], y)).mean(axis=1), most)
        apart = (signs(self.maps[0], a)[:, :64] != signs(self.maps[0], y)[:, :64]).sum(axis=1)
        self.radius = int(max(np.quantile(part, WITHIN, method="higher") for part in (apart[:PROBES], apart[PROBES:])))
        self.number, met = 0, np.zeros(len(a), bool)
        while self.width:
            before = share_met(met)
            own, other = (stretches(signs(self.maps[-1], v), self.width) for v in (a, y))
            for t in range(own.shape[1]):
                met |= own[:, t] == other[:, t]
                self.number += 1
                if share_met(met) >= RECALL:
                    return
            # rotations that end in the same optimum add nothing: then any rotation is taken
            self.maps.append(learn_rotation(x, bits, len(self.maps), ROUNDS if share_met(met) > before else 0))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return packed(signs(self.maps[0], x))

    def keys(self, x: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros((len(x), 1), np.int64)
        return np.concatenate([stretches(signs(m, x), self.width) for m in self.maps], axis=1)[:, : self.number]


def units(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("usable", usable).withColumns({f"h{k}": F.xxhash64(F.lit(k), F.col("label").cast("string"), "v") for k in (0, 1)})
    groups = rows.where("usable").groupBy("h0", "h1").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = stored(groups.withColumn("dim", F.size("v")).withColumn("id", F.monotonically_increasing_id()), "vectors")  # as ids of vectors may repeat

    found = []
    for r in groups.groupBy("dim").count().collect():  # vectors of different lengths do not link
        same = groups.where(F.col("dim") == r.dim)
        most = same.groupBy("label").count().agg(F.max("count").alias("m")).first().m
        sample = same.orderBy(F.xxhash64(F.lit(5), "vec_id", "v"), "vec_id").limit(FIT_ROWS).select("v", F.col("label").cast("string").alias("label")).toArrow()
        x, labels = units(sample["v"].to_pylist()), np.array(sample["label"].to_pylist())
        tables = in_task(rows.sparkSession, lambda x=x, labels=labels, most=most: Tables(x, labels, most, cosine, exact))
        found.append(_compared(same, tables, cosine))
    if not found:
        counts, pairs = None, None
    else:
        out = found[0]
        for df in found[1:]:
            out = out.union(df)
        out = stored(out, "links")
        counts = out.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
        pairs = components(out.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))

    base = rows.select("vec_id", "usable", "h0", "h1")
    if counts is None:
        out = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        ids = groups.select("id", "vec_id")
        least = stored(pairs.join(ids, "id").groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
        pairs = pairs.join(least, "component").select("id", "component_id")
        told = groups.select("h0", "h1", "id", "vec_id", "copies").join(counts, "id", "left").join(pairs, "id", "left")
        told = told.select("h0", "h1", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        told = stored(told, "told")
        out = base.where("usable").join(told, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
        out = out.union(base.where("NOT usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _compared(groups: DataFrame, tables: Tables, cosine: float) -> DataFrame:
    """(id, n, other): linked vectors counted at ``id``, or a link that joins components."""

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(2).to_pylist())
                keys = tables.keys(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables.codes(x).view(np.int64)), lists], ["id", "label", "code", "keys"])

    def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side = group["side"].to_numpy()
        return (np.arange(len(side)),) * 2 if group["own"][0].as_py() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def near(code: np.ndarray, some: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.bitwise_count(code[some][:, None] ^ code[right][None, :]) <= tables.radius

    def search(group: pa.Table) -> pa.Table:
        left, right = sides(group)
        code, found = group["code"].to_numpy().view(np.uint64), np.zeros(group.num_rows, bool)
        for at in range(0, len(left), TOGETHER):
            some = left[at : at + TOGETHER]
            close = near(code, some, right) & (some[:, None] != right[None, :])
            found[some] |= close.any(axis=1)
            found[right] |= close.any(axis=0)
        return group.select(["id", "label", "table", "key"]).take(pa.array(np.flatnonzero(found)))

    def compare(group: pa.Table) -> pa.Table:
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        own, table = group["own"][0].as_py(), group["table"][0].as_py()
        left, right = sides(group)
        x, keys, code = units(group["v"].to_pylist()), np.array(group["keys"].to_pylist(), np.int64), group["code"].to_numpy().view(np.uint64)
        n, part, joins = np.zeros(len(ids)), np.arange(len(ids)), []
        for at in range(0, len(left), TOGETHER):
            some = left[at : at + TOGETHER]
            linked = x[some] @ x[right].T >= cosine
            if tables.width:
                linked &= near(code, some, right)
            i, j = np.nonzero(linked)
            i, j = some[i], right[j]
            first = i < j if own else np.ones(len(i), bool)
            for t in range(table):  # a pair that met in an earlier table was counted there
                first &= keys[i, t] != keys[j, t]
            i, j = i[first], j[first]
            n += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            ends = np.flatnonzero(np.append(i[1:] != i[:-1], True)) + 1 if len(i) else []
            for start, end in zip([0, *ends[:-1]], ends, strict=False):  # the links of one vector
                parts, where = np.unique(part[j[start:end]], return_index=True)
                for p, w in zip(parts, where, strict=True):
                    if p != part[i[start]]:
                        joins.append((i[start], j[start + w]))
                        part[part == p] = part[i[start]]
        at = np.flatnonzero(n)
        a, b = np.array(joins, np.int64).reshape(-1, 2).T
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[at], ids[a]])),
                "n": pa.array(np.concatenate([n[at].astype(np.int64), np.zeros(len(a), np.int64)])),
                "other": pa.array([None] * len(at) + ids[b].tolist(), pa.int64()),
            }
        )

    label = dict(groups.dtypes)["label"]

    def in_blocks(rows: DataFrame) -> DataFrame:
        """The rows of buckets of several once for each block of their bucket."""
        sizes = rows.groupBy("label", "table", "key").agg(F.count("*").alias("m")).where("m > 1")
        rows = rows.join(sizes, ["label", "table", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumns(
            {"lo": F.least("block", "against"), "hi": F.greatest("block", "against"), "side": (F.col("block") > F.col("against")).cast("int"), "own": F.col("block") == F.col("against")}
        ).drop("m", "blocks", "block", "against")

    keys = ["label", "table", "key", "lo", "hi"]
    coded = Stored(groups.select("id", "label", "v").mapInArrow(keyed, f"id long, label {label}, code long, keys array<long>"), "codes")
    live = coded.df.select("id", "label", "code", F.posexplode("keys").alias("table", "key"))
    if tables.width:
        found = in_blocks(live).groupBy(*keys).applyInArrow(search, f"id long, label {label}, table int, key long")
        live = Stored(found.distinct(), "near").df
    whole = groups.select("id", "copies", "v").join(coded.df.select("id", "code", "keys"), "id")
    out = in_blocks(live.select("id", "label", "table", "key")).join(whole, "id")
    return stored(out.groupBy(*keys).applyInArrow(compare, "id long, n long, other long"), "links")
