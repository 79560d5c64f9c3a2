"""Near-duplicates by MinHash: universal hash minima, banding, signature and exact verification, components.

A text's set holds the distinct runs of ``size`` words (A-Z lower-cased; a text
with fewer words has its whole sequence as the only one; without words the set
is empty and linked with nothing). Texts of equal sets form a class, represented
by its smallest id, and only representatives are compared.

Representatives with an equal band of minima share a bucket. First each is
compared with the smallest members of its buckets, ``STARS`` different ones at
most, which joins most groups. Then, round by round, members outside the largest
component of their bucket are compared with ``STARS`` members of such components,
drawn anew, as long as a round joins a fair share of what it compares. A round is
linear in the members, whatever the buckets hold, and later rounds look only at
buckets that are still mixed. Pairs that are
across components even then are compared one by one if they share three bands (a
pair of similarity 0.8 misses that with a probability of 2.6e-5) in buckets
where they are at most ``PAIRS_PER_MEMBER`` for each member. The members of other
buckets are compared by their rarest shingles (``rare_pairs``), which misses no
link: a group of texts that have much in common, but less than a link needs, has
none of these in common. Pairs pass if the share of equal minima allows the
similarity, and are links only if 100 * intersection >= 100 * similarity * union
holds on the full sets.

With 200 minima in 40 bands of 5, a pair of similarity 0.8 has no common band
with a probability of 1.2e-7.

Null ids have no class of their own: their rows keep null components. Rows that
share an id are separate texts with one name; links join the names.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.texts import LOWER, SPACE, list_array, mixed, run_hashes, slices, stored, text_bytes, within, word_bounds, word_hashes

BANDS, ROWS = 40, 5
MINIMA = BANDS * ROWS
#: The rounds end before ``STAR_ROUNDS`` if fewer than ``FRUITFUL`` of the compared pairs are links. What they leave is compared pair by pair.
STARS, STAR_ROUNDS, FRUITFUL = 4, 5, 0.05
PAIRS_PER_MEMBER = 32
#: Shingles are ordered by counters of how many sets hold them; each counter serves all shingles of a remainder.
COUNTERS = 1 << 18
#: Classes of set sizes, the smallest size of each: partners are sought class by class, as their size tells how much must be shared.
SIZE_CLASSES = np.unique(np.ceil(1.1 ** np.arange(300)).astype(np.int64))
#: Signature pairs pass if the share of equal minima is not this much below the similarity: five standard errors.
MARGIN = 0.15
_random = np.random.RandomState(20240229)
FACTORS = _random.randint(0, 1 << 31, MINIMA, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.randint(0, 1 << 32, MINIMA, np.int64).astype(np.uint32)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the texts (repeated ones too), and each text's offset in them."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, firsts = word_bounds(~SPACE[data], offsets)
    words = word_hashes(data, starts, ends)
    inside = within(firsts, size)
    runs = np.zeros(len(words), np.uint64)
    whole = run_hashes(words, size)
    runs[: len(whole)] = whole
    counts = np.diff(firsts)
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        # A sequence of its own length: the length is hashed too.
        a, b = firsts[i], firsts[i + 1]
        total = np.uint64(b - a)
        for w in words[a:b]:
            total = mixed(np.array([total ^ w]))[0]
        runs[a] = total
        inside[a] = True
    at = np.flatnonzero(inside)
    return runs[at], np.searchsorted(at, firsts)


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    values, bounds = shingles(column, size)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signature(values: list[np.ndarray]) -> np.ndarray:
    """The minima of each non-empty set under all hash functions, as 32-bit values."""
    out = np.empty((len(values), MINIMA), np.uint32)
    at = 0
    while at < len(values):
        to, n = at, 0
        while to < len(values) and (to == at or n + len(values[to]) <= 1 << 15):
            n += len(values[to])
            to += 1
        x = (np.concatenate(values[at:to]) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum([0, *(len(v) for v in values[at : to - 1])])
        for j in range(MINIMA):
            out[at:to, j] = np.minimum.reduceat(x * FACTORS[j] + SHIFTS[j], begin)
        at = to
    return out


def bands_of(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, its number mixed in."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    parts = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        total = mixed(total ^ parts[:, :, j])
    return total


def sketches(df: DataFrame, size: int) -> DataFrame:
    """``id, tk, n, key`` (a digest of the set), the bands, and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                sets = sets_of(part.column("source"), size)
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                minima = signature(full)
                key = [f"{int(mixed(s).sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(mixed(s * np.uint64(3)))):016x}{len(s)}" for s in full]
                place = np.cumsum(n > 0) - 1
                bands = bands_of(minima).view(np.int64)
                bounds = np.concatenate([[0], np.cumsum(n > 0)]) * BANDS
                marks = minima.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("tk"), pa.array(n, pa.int64()), pa.array([key[p] if k else None for p, k in zip(place, n, strict=True)], pa.string()),
                        list_array(bands.ravel(), bounds, pa.int64()), pa.array([marks[p].tobytes() if k else None for p, k in zip(place, n, strict=True)], pa.binary()),
                    ],
                    ["id", "tk", "n", "key", "bands", "marks"],
                )

    return df.mapInArrow(run, "id long, tk long, n long, key string, bands array<long>, marks binary")


def full_sets(df: DataFrame, size: int) -> DataFrame:
    """``node, items``: the whole set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                values = sets_of(part.column("source"), size)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([v.tobytes() for v in values], pa.binary())], ["node", "items"])

    return df.mapInArrow(run, "node long, items binary")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sizes and signatures allow the similarity."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("m_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("m_b"))
    least = similarity - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("m_a", "m_b"))
            good = (left == right).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    joined = pairs.join(two, "b").join(one, "a").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    return joined.select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sources: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are links on their full sets; only texts in a pair are looked at."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(full_sets(sources.join(needed, "node").select("node", "source"), size), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def few_each(stars: DataFrame, rank: Callable[[Column], Column]) -> DataFrame:
    """``a, b``: each ``node`` with the first ``STARS`` of its distinct ``centre`` by ``rank``; a node has one centre a band, so lists are short."""
    ranked = F.array_sort(F.transform(F.collect_set("centre"), lambda c: F.struct(rank(c).alias("rank"), c.alias("centre"))))
    pairs = stars.groupBy("node").agg(F.slice(ranked, 1, STARS).alias("drawn")).select("node", F.explode("drawn.centre").alias("centre"))
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def labelled(links: DataFrame) -> DataFrame:
    """``node, c``: the component of every node with a link."""
    return stored(components(links), "labels").withColumnRenamed("component", "c")


def mixed_buckets(multi: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: ``band, node, component``, the largest component ``top``, the members and the pairs across components."""
    members = multi.join(labelled(links), "node", "left").select("band", "node", F.coalesce("c", "node").alias("component"))
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("members"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("kinds")
    )
    buckets = buckets.where("kinds > 1").select("band", "top", "members", ((F.col("members") * F.col("members") - F.col("same")) / 2).alias("pairs"))
    return stored(members.join(stored(buckets, "buckets"), "band"), "members")


def pairs_across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different components in a bucket that share three bands at least; a pair counts only in the first two that it shares."""
    bands = nodes.select("node", "bands")
    rows = members.join(bands, "node")
    few = rows.where("component <> top").select(F.col("band").alias("band_a"), F.col("node").alias("a"), F.col("component").alias("c_a"), F.col("bands").alias("bands_a"))
    all_of = rows.select(F.col("band").alias("band_b"), F.col("node").alias("b"), F.col("component").alias("c_b"), F.col("bands").alias("bands_b"), (F.col("component") == F.col("top")).alias("in_top"))
    different = (F.col("c_a") != F.col("c_b")) & (F.col("in_top") | (F.col("a") < F.col("b")))
    shared = F.array_intersect("bands_a", "bands_b")
    first = F.array_position(F.slice(F.array_sort(shared), 1, 2), F.col("band_a")) > 0
    joined = few.join(all_of, (F.col("band_a") == F.col("band_b")) & different & (F.size(shared) >= 3) & first)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def shingle_counters(sets: DataFrame) -> np.ndarray:
    """How many sets hold shingles of each remainder; tasks add up batches, and the driver gets ``COUNTERS`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "items")):
            values = np.frombuffer(b"".join(part.column("items").to_pylist()), np.uint64) % np.uint64(COUNTERS)
            place, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64))], ["place", "n"])

    found = sets.select("items").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(COUNTERS, np.int64)
    counters[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return counters


def prefixes(sets: DataFrame, counters: np.ndarray, percent: int) -> DataFrame:
    """``band, node, n, at, kind``: the rarest shingles of each set, as many as a partner of a size class calls for.

    Two sets are linked only if they share ``percent * (n_a + n_b) / (100 + percent)``
    shingles. So the first that both hold, in whatever order, is among the first
    ``n - shared + 1`` of either. A counter of one tells that no other set holds a shingle.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            for node, items in zip(batch.column("node").to_pylist(), batch.column("items").to_pylist(), strict=True):
                items = np.frombuffer(items, np.uint64)
                n, seen = len(items), counters[(items % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((items, seen))
                items, alone = items[order], int((seen == 1).sum())
                least, most = -(-percent * n // 100), 100 * n // percent
                own, low, high = np.searchsorted(SIZE_CLASSES, [n, least, most], "right") - 1
                keys, ats, kinds = [], [], []
                for kind in range(low, high + 1):
                    need = -(-percent * (n + max(int(SIZE_CLASSES[kind]), least)) // (100 + percent))
                    at = np.arange(alone, n - need + 1)
                    keys.append(mixed(mixed(items[at]) ^ np.uint64(min(own, kind) << 16 | max(own, kind))))
                    ats.append(at)
                    kinds.append(np.full(len(at), np.sign(kind - own)))
                keys, ats, kinds = (np.concatenate(x) for x in (keys, ats, kinds))
                full = np.ones(len(keys), np.int64)
                columns = (keys.view(np.int64), full * node, full * n, ats.astype(np.int64), kinds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "node", "n", "at", "kind"])

    return sets.select("node", "items").mapInArrow(run, "band long, node long, n long, at long, kind int")


def rare_rows(members: DataFrame, sources: DataFrame, size: int, percent: int) -> DataFrame:
    """The prefixes of all ``members`` (``node``): two of them are linked only if they share a ``band`` of these."""
    sets = stored(full_sets(sources.join(members, "node").select("node", "source"), size), "sets")
    return stored(prefixes(sets, shingle_counters(sets), percent), "prefixes")


def with_tops(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of bands that hold several components, with their ``component`` and the band's largest, ``top``."""
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("c", "node")).drop("c")
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").select("band", "top")
    return stored(rows.join(stored(tops, "tops"), "band"), "members")


def rare_stars(rows: DataFrame) -> DataFrame:
    """Each node outside a band's largest component with the member of it that has the fewest shingles which are rarer: one pair a row."""
    centre = rows.where("component = top").groupBy("band").agg(F.min_by("node", F.struct("at", "node")).alias("centre"))
    star = rows.where("component <> top").join(centre, "band")
    return star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that share one of the shingles that a link of their sizes shares."""
    few, all_of = (rows.select("band", "top", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "n", "at", "kind"))) for side in "ab")
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent) - 1e-9)
    reached = (F.col("at_a") <= F.col("n_a") - need) & (F.col("at_b") <= F.col("n_b") - need)
    # Below a key of two size classes, partners are of different ones.
    facing = (F.col("component_a") != F.col("component_b")) & (F.col("kind_a") == -F.col("kind_b"))
    once = (F.col("component_b") == F.col("top")) | (F.col("node_a") < F.col("node_b"))
    joined = few.where("component_a <> top").join(all_of.drop("top"), "band").where(facing & once & reached)
    return joined.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, tk, n, component`` of every row: the smallest id that links of at least ``similarity`` reach; ``tk`` is a hash of the text."""
    percent = round(100 * similarity)
    rows = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tk"), F.col(text).alias("source"))
    found = stored(sketches(rows, size), "sketches")
    first = stored(found.where(F.col("id").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("first")), "first")
    # The first id of a set represents it. Where one id names several sets, each is a node of its own until the end.
    nodes = found.join(first.withColumnRenamed("first", "id"), ["key", "id"]).dropDuplicates(["key", "id"])
    nodes = stored(nodes.select(F.xxhash64("key").alias("node"), "id", "tk", "n", "bands", "marks"), "nodes")
    sources = rows.join(nodes.select("id", "tk", "node"), ["id", "tk"]).dropDuplicates(["node"])
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    centres = stored(buckets.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("band", "a"), "centres")
    multi = stored(buckets.join(centres, "band"), "multi")
    tried = stored(few_each(multi.where("node > a").select("node", F.col("a").alias("centre")), lambda c: c), "tried")
    links = stored(verified(stored(likely(tried, nodes, similarity), "pairs"), sources, size, percent), "verified")
    # A bucket within one component stays so: each round goes on with the members of mixed buckets.
    members = mixed_buckets(multi.select("band", "node"), links)
    for turn in range(STAR_ROUNDS):
        centre = stored(members.where("component = top").groupBy("band").agg(F.min_by("node", F.xxhash64("node", "band", F.lit(turn))).alias("centre")), "centres")
        star = members.where("component <> top").join(centre, "band").select("node", "centre", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        fresh = stored(few_each(star.join(tried, ["a", "b"], "left_anti"), lambda c, turn=turn: F.xxhash64(c, F.col("node"), F.lit(turn))), "tried")
        compared = fresh.count()
        if not compared:
            break
        more = stored(verified(stored(likely(fresh, nodes, similarity), "pairs"), sources, size, percent), "verified")
        joined = more.count()
        tried, links = tried.union(fresh), links.union(more)
        if joined:
            members = mixed_buckets(members.select("band", "node"), links)
        if joined < FRUITFUL * compared:
            break
    # All pairs that are still across components: by bands where they are in proportion to the bucket, else by the rarest shingles.
    light = members.where(F.col("pairs") <= PAIRS_PER_MEMBER * F.col("members"))
    heavy = stored(members.where(F.col("pairs") > PAIRS_PER_MEMBER * F.col("members")).select("node").distinct(), "heavy")
    rest = pairs_across(light.select("band", "node", "component", "top"), nodes)
    if not heavy.isEmpty():
        rare = rare_rows(heavy, sources, size, percent)
        # A text that is close to its group's core is linked to what has least besides the core.
        fresh = stored(rare_stars(with_tops(rare, labelled(links))).join(tried, ["a", "b"], "left_anti"), "tried")
        links = links.union(stored(verified(stored(likely(fresh, nodes, similarity), "pairs"), sources, size, percent), "verified"))
        tried = tried.union(fresh)
        rest = rest.union(rare_pairs(with_tops(rare, labelled(links)), percent))
    rest = stored(likely(rest.distinct().join(tried, ["a", "b"], "left_anti"), nodes, similarity), "pairs")
    if not rest.isEmpty():
        links = stored(links.union(verified(rest, sources, size, percent)), "verified")
    # Links between nodes as links between names; an id that names several sets joins them.
    name = nodes.select("node", "id")
    named = links.join(name.select(F.col("node").alias("a"), F.col("id").alias("i")), "a").join(name.select(F.col("node").alias("b"), F.col("id").alias("j")), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    own = stored(found.select("id", "tk", "n", "key").join(first, "key", "left").select("id", "tk", "n", "first"), "classes")
    same = own.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    reached = components(named.union(same))
    result = own.select("id", "tk", "n").join(reached.select(F.col("node").alias("id"), "component"), "id", "left")
    return result.select("id", "tk", "n", F.coalesce("component", "id").alias("component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row the key, ``n_shingles``, ``component_id`` and ``kept``, whether the row has its component's smallest id."""
    made = classes(df, key, text, size=size, similarity=similarity)
    return made.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows whose key is the smallest of its component; rows without a key stay."""
    made = classes(df, key, text, size=size, similarity=similarity)
    gone = made.where("id <> component").select(F.col("id").alias("_id")).distinct()
    return df.join(gone, F.col(key).cast("long") == F.col("_id"), "left_anti")
