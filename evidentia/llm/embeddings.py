"""Near-duplicate vectors by product quantisation.

A coarse quantiser of about sqrt(n) centroids and residual subspace codebooks are fitted on
a sample of about SAMPLE vectors, taken by the hash of the id. Every vector is indexed:
it lies in the inverted list of its nearest centroid, as codes of its residual. A vector asks
its own list and every list across whose border a linked vector could lie, so no link is
lost; where vectors lie far apart in many dimensions these are nearly all lists, and the work
grows with the square of n. Asymmetric distances from lookup tables discard members that cannot
be within reach given their own quantisation error (which is kept, so nothing within reach is
discarded), and the exact cosine in double precision decides the rest.

Lists are put on shelves of about a chunk of members, and a vector goes once to each shelf, of its own and
those after it, with a list it asks. Larger lists, and those who ask a shelf, are split into chunks, and a
task holds one chunk against one other; it returns counts of links and the edges of a
spanning forest, never the pairs. Each pair counts once: within a shelf from its smaller id, between shelves from
the one before. Chunks grow with the vectors (see chunk_rows), so a vector is sent to at most about SPLIT tasks a side until they
reach LARGEST.

Defined results: vectors that are null, zero, hold nulls or non-finite values link with
nothing. Vectors of different lengths do not link; each length has an index of its own. Rows with one id are one vector,
the one whose hash is smallest. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.components import components
from evidentia.llm.storage import prepare, written

SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
#: Rows of a chunk: the fewest, the most, and how many chunks there are in between.
CHUNK, LARGEST, SPLIT = 4096, 65_536, 24
#: Members and askers compared at once, whose products stay in a core's cache.
MEMBERS, ASKERS = 512, 256
#: Rounding that distances may carry: of double precision at a border, of single precision in the tables.
_BORDER, _TABLES = 1e-9, 1e-4
_EDGE = "kind int, a long, b long"


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


class Index:
    def __init__(self, sample: np.ndarray, lists: int, reach: float):
        rng = np.random.default_rng(7)
        self.reach = reach
        self.centers = kmeans(sample, lists, 8, rng)
        residual = sample - self.centers[_nearest(sample, self.centers)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], CODES, 8, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def own(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centers)

    def asks(self, x: np.ndarray) -> np.ndarray:
        """Whether each vector asks each list: its own, and those whose border is within reach."""
        size = (self.centers**2).sum(1)
        d = size - 2 * x @ self.centers.T
        own = d.argmin(axis=1)
        rows = np.arange(len(x))
        gap = np.sqrt(np.maximum(size[own][:, None] + size - 2 * self.centers[own] @ self.centers.T, 0) + _BORDER)
        out = d - d[rows, own][:, None] <= 2 * gap * self.reach + _BORDER
        out[rows, own] = True
        return out

    def codes(self, x: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes of the members of a list, and the length of what they leave out."""
        residual = x - center
        codes, left = np.empty((len(x), len(self.books)), np.int64), np.zeros(len(x))
        for s, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:])):
            codes[:, s] = _nearest(residual[:, a:b], book)
            left += ((residual[:, a:b] - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def rebuilt(self, codes: np.ndarray, centers: np.ndarray) -> np.ndarray:
        """The points that the codes of members of these centroids' lists stand for."""
        return centers + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)

    def tables(self, query: np.ndarray) -> list[np.ndarray]:
        """By subspace, the product of every book entry with every query."""
        return [(book @ query[:, a:b].T).astype(np.float32) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:])]

    def within(
        self, query: np.ndarray, lists: np.ndarray, own: np.ndarray, point: np.ndarray, codes: np.ndarray, left: np.ndarray
    ) -> np.ndarray:
        """Which members (rows) can be within reach of which queries, by table lookups; a member's list is lists[own].

        The squared distance of a query q to a member's point c + b is |q|^2 + |c + b|^2 - 2 q.c - 2 q.b, and
        q.c and q.b are looked up.
        """
        least = ((point**2).sum(1) - (self.reach + left + _BORDER) ** 2 - _TABLES) / 2
        return self.reached(self.centers[lists] @ query.T, self.tables(query), (query**2).sum(1) / 2, own, codes, least)

    def reached(
        self, coarse: np.ndarray, tables: list[np.ndarray], half: np.ndarray, own: np.ndarray, codes: np.ndarray, least: np.ndarray
    ) -> np.ndarray:
        """within(), by what queries and members bring: products with centroids, tables, half the squares; lists, codes, least products."""
        product = coarse.astype(np.float32)[own]
        part = np.empty_like(product)
        for s, table in enumerate(tables):
            product += np.take(table, codes[:, s], axis=0, out=part, mode="clip")
        return product >= (least[:, None] + half).astype(np.float32)


def _vectors(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors at length 1; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) for the graph of these links."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def chunk_rows(n: int) -> int:
    """Rows of a chunk of n vectors."""
    return max(CHUNK, min(LARGEST, -(-n // SPLIT)))


def shelves(members: np.ndarray, chunk: int) -> np.ndarray:
    """The shelf of every list, by its number of members: consecutive lists of a chunk at most, or one larger list."""
    out, shelf, held = np.zeros(len(members), np.int64), 0, 0
    for i, n in enumerate(members.tolist()):
        if held and held + n > chunk:
            shelf, held = shelf + 1, 0
        out[i], held = shelf, held + n
    return out


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of df.

    Vectors with a cosine of at least `threshold` are linked; n_links counts a vector's
    links, component_id is the smallest id that links lead to.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"  # half as much to send
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists(
        "v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    ) & F.exists("v", lambda e: e != 0)
    good = rows.where(sound).groupBy("id").agg(F.min_by("v", F.xxhash64(F.col("v").cast("array<double>"))).alias("v"))
    good = written(good, "vectors")
    sizes = good.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()  # a row per length
    ids = rows.select("id")
    if not sizes:
        return ids.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    found = reduce(DataFrame.union, [_found(good.where(F.size("v") == r["d"]), r["count"], threshold) for r in sizes])
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n_links")).withColumnRenamed("a", "id")
    groups = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("id", "of")
    out = ids.join(links, "id", "left").join(groups, F.col("id") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def _found(good: DataFrame, n: int, threshold: float) -> DataFrame:
    """Counts of links (kind 0: id, links) and edges of components (kind 1) of n vectors (id, v) of one length."""
    spark = good.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    share = int((1 << 30) * min(1.0, SAMPLE / n))
    sample = good.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < share).select("v").toArrow()
    if not sample.num_rows:
        sample = good.limit(SAMPLE).select("v").toArrow()
    index = spark.sparkContext.broadcast(Index(unit(_vectors(sample["v"].combine_chunks())), int(np.clip(np.sqrt(n), 1, 4096)), reach))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                lists = index.value.own(unit(_vectors(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32())], names=["id", "v", "list"])

    kind, chunk = dict(good.dtypes)["v"], chunk_rows(n)
    placed = written(good.select("id", "v").mapInArrow(assign, f"id long, v {kind}, list int"), "lists")
    held = np.zeros(len(index.value.centers), np.int64)
    for r in placed.groupBy("list").count().collect():  # a row per centroid, 4096 at most
        held[r["list"]] = r["count"]
    shelf = spark.sparkContext.broadcast((held, shelves(held, chunk)))

    def ask(batches):
        held, of = shelf.value
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for batch in batches:
            if batch.num_rows:
                asked = np.logical_or.reduceat(index.value.asks(unit(_vectors(batch.column(1)))) & (held > 0), first, axis=1)
                own = of[batch.column(2).to_numpy()]
                asked &= np.arange(len(first)) >= own[:, None]  # those before ask this one's shelf
                ends = np.concatenate([[0], np.cumsum(asked.sum(axis=1))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(asked)[1], pa.int32()))
                columns = [*batch.columns[:2], pa.array(own, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "own", "shelves"])

    asking = written(placed.select("id", "v", "list").mapInArrow(ask, f"id long, v {kind}, own int, shelves array<int>"), "shelves")
    members = np.bincount(shelf.value[1], held).astype(np.int64)
    chunks = lambda n: max(1, -(-int(n) // chunk))
    load = [
        (r["shelf"], chunks(members[r["shelf"]]), chunks(r["count"])) for r in asking.select(
            F.explode("shelves").alias("shelf")
        ).groupBy("shelf").count().collect()
    ]
    load = F.broadcast(spark.createDataFrame(load, "shelf int, members int, askers int"))
    lists = F.broadcast(spark.createDataFrame(list(enumerate(shelf.value[1].tolist())), "list int, shelf int"))
    part = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c)).cast("int")
    members = placed.join(lists, "list").join(load, "shelf").select(
        "shelf", part("members", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("q"), "id", "v", "list"
    )
    askers = asking.select("id", "v", "own", F.explode("shelves").alias("shelf")).join(load, "shelf").select(
        "shelf", F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("m"), part("askers", "q").alias("q"),
        F.col("id").alias("asker"), F.col("v").alias("w"), (F.col("own") == F.col("shelf")).alias("same")
    )

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        it = index.value
        left, right = left.sort_by("id"), right.sort_by([("same", "ascending"), ("asker", "ascending")])
        member, asker = (unit(_vectors(c.combine_chunks())) for c in (left["v"], right["w"]))
        mid, qid, same = left["id"].to_numpy(), right["asker"].to_numpy(), right["same"].to_numpy()
        lists, own = np.unique(left["list"].to_numpy(), return_inverse=True)
        codes, lost = it.codes(member, it.centers[lists[own]])
        least = ((it.rebuilt(codes, it.centers[lists[own]]) ** 2).sum(1) - (it.reach + lost + _BORDER) ** 2 - _TABLES) / 2
        counts, pairs = [], []
        turn = int(np.searchsorted(same, True))  # askers of this shelf come last
        for at in (*range(0, turn, ASKERS), *range(turn, len(asker), ASKERS)):
            end = min(at + ASKERS, turn if at < turn else len(asker))
            q, i = asker[at:end], qid[at:end]
            coarse, tables, half = it.centers[lists] @ q.T, it.tables(q), (q**2).sum(1) / 2
            begin = 0 if at < turn else int(np.searchsorted(mid, i[0], side="right"))  # those of a larger id than one of these
            found = []
            for lo in range(begin, len(mid), MEMBERS):
                part = slice(lo, lo + MEMBERS)
                near = it.reached(coarse, tables, half, own[part], codes[part], least[part])
                if at >= turn:
                    near &= i[None] < mid[part, None]
                y, x = np.divmod(np.flatnonzero(near), len(q))
                if len(x) * 32 > near.size:
                    y, x = np.nonzero(near & (member[part] @ q.T >= threshold))
                elif len(x):
                    ok = np.einsum("ij,ij->i", q[x], member[lo + y]) >= threshold
                    x, y = x[ok], y[ok]
                if len(x):
                    found.append((i[x], mid[lo + y]))
            if found:
                x, y = (np.concatenate(c) for c in zip(*found))
                counts += [np.stack(np.unique(np.concatenate([x, y]), return_counts=True))]
                pairs.append(np.stack(_forest(x, y)))
        if not counts:
            return empty
        told, n_links = np.concatenate(counts, axis=1)
        ids, back = np.unique(told, return_inverse=True)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, back, n_links)
        a, b = np.concatenate(pairs, axis=1)
        a, b = _forest(a, b)
        return pa.table(
            {
                "kind": pa.array([0] * len(ids) + [1] * len(a), pa.int32()), "a": pa.array(np.concatenate([ids, a]), pa.int64()),
                "b": pa.array(np.concatenate([links, b]), pa.int64())
            }
        )

    keys = ["shelf", "m", "q"]
    return written(members.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInArrow(compare, _EDGE), "found")
