"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation.

Every document becomes its set of distinct word shingles. Equal sets collapse to one
representative first. SAMPLES MinHash values of a representative make BANDS band keys. For
verification, one-permutation MinHash takes the smallest shingle hash of each of BINS ranges, and
these samples are folded into an odd sketch: each flips one bit of a BITS-bit parity bitmap.
The population count of the XOR of two sketches tells how many samples differ, to within a
few for similar sets. Representatives that share a band key and whose sketches
allow the similarity (SIGMAS standard deviations of sampling and of the sketch) are
candidates; their full sets are compared before they are linked.

No pairs within a band are listed. Each member is first held against the smallest
member of its bands. Only bands that then still hold several components are looked at
again, in cells of CELL by CELL members, each pair of different components in its first
common band. A cell carries the full sets of its members of at most CARRIED shingles, compares
them on the spot and gives only the links that join components there. Pairs with a
larger set are compared outside: first the CLOSEST of each member by their sketches, then
all that are still apart. At a similarity of 0.8 the bands miss a link with probability
(1 - 0.8**5)**30 < 1e-5.

Defined results: null and blank texts have the empty set, n_shingles 0, and no links.
A text with fewer words than a shingle has has its whole sequence as its one
shingle. Rows with one id are one document; a null id has no links, component_id
null and kept true. Extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import kernel as K
from evidentia.llm.components import components
from evidentia.llm.storage import partitions, prepare, release_memory, trimmed, written

ROWS, BANDS = 5, 30
SAMPLES = ROWS * BANDS
BINS, BITS, SIGMAS = 1024, 2048, 6
CLOSEST = 4
CELL = 512
CARRIED = 4096
#: A band's members are spread over so many shares before they are joined to what is known of the band.
SHARES = 64
_SIGNATURE = "id long, n_shingles long, k1 long, k2 long, keys array<long>, n_bins int, sketch array<long>"


@functools.lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = K.mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:SAMPLES].astype(np.uint32), seeds[SAMPLES:].astype(np.uint32) | np.uint32(1)


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out = []
    for w in K.words(column, K.BLANK_LOWER):
        grams = K.windows(w.hash, width)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:  # the whole sequence, apart from any full shingle
                whole = K.windows(w.hash[a:b], b - a)
                out.append(K.mix64(whole + np.uint64(0x2545F4914F6CDD1D) * np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a non-empty set."""
    flip, factor = _family()
    low = shingles.astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[at : at + 1024, None] ^ flip) * factor).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = K.mix64(key * np.uint64(0xA0761D6478BD642F) + column + np.uint64(1))
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of samples of a sorted set, and the parity of the bits they flip."""
    bins = shingles >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    place = K.mix64(shingles[first] ^ np.uint64(0xBB67AE8584CAA73B)) % np.uint64(BITS)
    parity = np.bincount(place.astype(np.int64), minlength=BITS) & 1
    return int(first.sum()), np.packbits(parity.astype(np.uint8)).view(np.int64)


def _signatures(width: int):
    def run(batches):
        for batch in trimmed(batches):
            sets = shingle_sets(batch.column(1), width)
            keys = [band_keys(samples(s)) if len(s) else None for s in sets]
            sketches = [odd_sketch(s) if len(s) else (0, None) for s in sets]
            one = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            two = [int(K.mix64(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()), pa.array(keys, longs), pa.array([n for n, _ in sketches], pa.int32()),
                    pa.array([x for _, x in sketches], longs)
                ],
                names=["id", "n_shingles", "k1", "k2", "keys", "n_bins", "sketch"]
            )
        release_memory()

    return run


def _linked(width: int, percent: int):
    def run(batches):
        for batch in trimmed(batches):
            left, right = shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)
            keep = []
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"]
            )

    return run


def _agreeing(n_x: np.ndarray, n_y: np.ndarray, j: float) -> tuple[np.ndarray, np.ndarray]:
    """For sets of these sizes and similarity j, the share s of the samples n of both that agree,
    and the variance of (agreeing samples - s n).

    Ranges fill as by Poisson numbers of shared and of own shingles; the variance is that
    of independent ranges less what the known sizes explain: a variance over ranges is
    lowered by mean * (effect of one more shingle)**2 for each kind of shingle.
    """
    union = (n_x + n_y) / (1 + j)
    a = union / BINS
    own_x, own_y = np.maximum(n_x / BINS - j * a, 0.0), np.maximum(n_y / BINS - j * a, 0.0)
    bare, bare_x, bare_y = np.exp(-a), np.exp(-n_x / BINS), np.exp(-n_y / BINS)
    agree, filled = j * (1 - bare), 2 - bare_x - bare_y
    share = agree / filled
    square = agree * (1 - 4 * share) + share**2 * (filled + 2 * (1 - bare_x - bare_y + bare))
    least = -np.expm1(-a) / a  # how often one more shingle is its range's smallest
    lost = j * (least - bare)
    shared = least - lost - share * (bare_x + bare_y)
    explained = j * a * shared**2 + own_x * (lost + share * bare_x) ** 2 + own_y * (lost + share * bare_y) ** 2
    return share, BINS * np.maximum(square - explained, 0.0)


def allowed(x: tuple, y: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether two odd sketches allow the similarity, and in how many bits they differ; x and y are (n_shingles, n_bins, sketch).

    Of n_x + n_y samples at J = percent / 100 a known share agrees, so about that many
    differ; the XOR's population count is held against the count expected for that many and its
    deviation: that of the agreeing samples, given the filled ranges of both, and that of the sketch.
    """
    j = percent / 100
    differ = np.bitwise_count((x[2] ^ y[2]).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    share, spread = _agreeing(x[0], y[0], j)
    d = np.maximum((x[1] + y[1]) * (1 - 2 * share), 0.0)
    sampled = 4 * spread
    decay = np.exp(-4 * d / BITS)
    folded = (BITS / 4 * (1 - decay) - d * decay) / decay + 4
    most = d + SIGMAS * np.sqrt(sampled + folded)
    sizes = 100 * np.minimum(x[0], y[0]) >= percent * np.maximum(x[0], y[0])
    return sizes & (differ <= BITS / 2 * -np.expm1(-2 * most / BITS)), differ


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _sketches(table, suffix: str = "") -> tuple:
    one = lambda c: np.asarray(table.column(c + suffix)).astype(np.int64)
    return one("n_shingles"), one("n_bins"), _flat(table.column("sketch" + suffix))


def _plausible(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(allowed(_sketches(batch), _sketches(batch, "2"), percent)[0])
                yield batch.select(["a", "b"]).filter(keep)

    return run


def _carried(width: int):
    def run(batches):
        for batch in trimmed(batches):
            sets = [s.view(np.int64) if len(s) <= CARRIED else None for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


class _Sets:
    """The sorted shingle hashes of a cell's members."""

    def __init__(self, column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.first = np.asarray(column.offsets).astype(np.int64)
        self.values = np.asarray(column.values).view(np.uint64)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles x shares with each of others."""
        mine = self.values[self.first[x] : self.first[x + 1]]
        size = self.first[others + 1] - self.first[others]
        ends = np.cumsum(size)
        flat = self.values[np.arange(ends[-1]) + np.repeat(self.first[others] - (ends - size), size)]
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        return np.add.reduceat((mine[at] == flat).astype(np.int64), ends - size)


def _joining(x: np.ndarray, y: np.ndarray, root: np.ndarray, sets: _Sets, n: np.ndarray, percent: int):
    """Of candidate pairs sorted by x, links that join different roots; root is changed."""
    cuts = np.flatnonzero(np.diff(x, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)]):
        one, others = int(x[lo]), y[lo:hi]
        others = others[root[others] != root[one]]
        if not len(others):
            continue
        both = sets.common(one, others)
        others = others[(both > 0) & (100 * both >= percent * (n[one] + n[others] - both))]
        for other in others.tolist():
            if root[other] != root[one]:
                root[root == root[other]] = root[one]
                yield one, other


def _cells(percent: int, closest: int = 0):
    """Pairs from different components within every cell of a band, each in its first common band.

    Where the cells carry sets, links of carried members that join components are sure; pairs with a
    larger set are not, and only the closest few of each member by their sketches, if so asked.
    """

    def pairs(t: pa.Table, key: int, square: bool):
        sketch, ids, of, keys = _sketches(t), t["id"].to_numpy(), t["component"].to_numpy(), _flat(t["keys"])
        side, n, root = t["side"].to_numpy(), sketch[0], of.copy()
        small, sets = n <= CARRIED, None
        if "shingles" in t.column_names:
            sets = _Sets(t["shingles"])
            n = np.diff(sets.first)
            small &= n > 0
        left = np.arange(len(ids)) if square else np.flatnonzero(side == side.min())
        right = left if square else np.flatnonzero(side != side.min())
        if not len(right):
            return
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            near = of[rows][:, None] < of[right][None] if square else of[rows][:, None] != of[right][None]
            x, y = np.nonzero(near)
            x, y = rows[x], right[y]
            keep, differ = allowed(tuple(v[x] for v in sketch), tuple(v[y] for v in sketch), percent)
            x, y, differ = x[keep], y[keep], differ[keep]
            if not len(x):
                continue
            first = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == key
            carried = small[x] & small[y]
            found = []
            if sets:
                found = list(_joining(x[carried & first], y[carried & first], root, sets, n, percent))
            sure = len(found)
            x, y, differ, first = (v[~carried] for v in (x, y, differ, first))
            if closest and len(x):
                order = np.lexsort((differ, x))
                x, y, first = x[order], y[order], first[order]
                start = np.flatnonzero(np.diff(x, prepend=-1))
                keep = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x)))) < closest
                x, y, first = x[keep], y[keep], first[keep]
            x = ids[np.concatenate([np.array([p for p, _ in found], np.int64), x[first]])]
            y = ids[np.concatenate([np.array([p for _, p in found], np.int64), y[first]])]
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.arange(len(x)) < sure)], names=["a", "b", "sure"]
                )

    def run(batches):
        held, current = [], None

        def done():
            return pairs(pa.Table.from_batches(held).combine_chunks(), current[0], current[1] == current[2])

        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            if not len(cells):
                continue
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                cell = tuple(cells[lo].tolist())
                if current is not None and cell != current:
                    yield from done()
                    held = []
                current = cell
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return run


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, component) of the bands that hold several components of these links."""
    rows = written(
        members.join(components(links), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed"
    )
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return written(rows.join(mixed, "key", "left_semi"), "mixed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Documents with 100 * |common shingles| >= percent * |all shingles| are linked;
    component_id is the smallest id that links lead to, kept marks that document.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_signatures(width), _SIGNATURE), "signatures")
    sets = signed.where("n_shingles > 0 and id is not null")
    classes = sets.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"))
    reps = written(
        sets.join(classes, ["k1", "k2", "n_shingles"]).where("id = rep").dropDuplicates(["id", "k1", "k2"]).select(
            "id", "n_shingles", "keys", "n_bins", "sketch"
        ),
        "representatives"
    )

    keyed = reps.select("id", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail").drop("tail")
    members = written(keyed.join(heads, "key"), "members")
    sketches = reps.select("id", "n_shingles", "n_bins", "sketch")
    wanted = members.select("id").distinct()
    sources = written(texts.join(wanted, "id", "left_semi"), "candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sources.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        full = left.join(sources.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        return full.mapInArrow(_linked(width, percent), "a long, b long").distinct()

    def plausible(pairs: DataFrame) -> DataFrame:
        second = sketches.select(F.col("id").alias("b"), *[F.col(c).alias(c + "2") for c in sketches.columns[1:]])
        full = pairs.join(sketches.withColumnRenamed("id", "a"), "a").join(second, "b")
        return full.mapInArrow(_plausible(percent), "a long, b long")

    stars = plausible(members.where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    links = written(confirmed(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "links")
    placed = _placed(members.select("key", "id"), links)

    def across(placed: DataFrame, carried: DataFrame | None = None, closest: int = 0) -> DataFrame:
        # Only bands of several cells are looked up, by shares of their members, so that no task gets a whole band.
        share = F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("share")
        counts = placed.groupBy("key", share).agg(F.count("*").alias("m")).groupBy("key").agg(
            F.ceil(F.sum("m") / CELL).cast("int").alias("n")
        )
        large = counts.where("n > 1").select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
        n = F.coalesce("n", F.lit(1))
        part = F.pmod(F.xxhash64("id", F.lit("cell")), n).cast("int")
        dealt = placed.withColumn("share", share).join(large, ["key", "share"], "left").select(
            "key", "id", "component", part.alias("side"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
        )
        dealt = dealt.select(
            "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "component"
        ).join(carried or reps, "id")
        dealt = dealt.repartition(partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        return written(dealt.mapInArrow(_cells(percent, closest), "a long, b long, sure boolean"), "across")

    def joined(pairs: DataFrame) -> DataFrame:
        return pairs.where("sure").select("a", "b").union(written(confirmed(pairs.where("not sure").select("a", "b").distinct()), "links"))

    shingles = sources.join(placed.select("id").distinct(), "id", "left_semi").mapInArrow(_carried(width), "id long, shingles array<long>")
    links = links.union(joined(across(placed, reps.join(shingles, "id"), CLOSEST)))
    large = reps.where(F.col("n_shingles") * 100 >= percent * CARRIED).select("id")
    links = links.union(joined(across(_placed(members.select("key", "id").join(large, "id", "left_semi"), links))))
    found = components(links)

    of_class = classes.join(found, classes.rep == found.id, "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    out = signed.select("id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
