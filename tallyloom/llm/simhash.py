"""SimHash near-duplicates over pigeonhole blocks.

Words are runs of non-spaces with A-Z lower-cased; shingles are ``width`` consecutive words with repeats, or
the whole sequence where it is shorter. A bit of the 64-bit fingerprint is 1 if more than half of the
shingles' XXH64 (seed 42) have it. Fingerprints link at ``radius`` or fewer differing bits.

Links are between distinct fingerprints. The 64 bits are split into ``blocks`` blocks; of two fingerprints
within the radius at least ``blocks - radius`` blocks are equal, so a join on every choice of that many blocks
meets each pair. Candidates are verified by their Hamming distance. A bucket with more than ``BUCKET``
fingerprints isn't paired up: each of its fingerprints is written under all fingerprints within half the radius
(the balls), and those that meet in a ball are linked to the smallest there - for radius 2, two fingerprints
are within 2 bits if and only if balls of radius 1 meet, so this loses and adds nothing, at 65 rows each.

Edge cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other;
every row counts, ids that repeat share the smallest component; null ids get a component only where another
document has the same fingerprint group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, dropped, held, modest_batches, table, text_of, words, written
from tallyloom.llm.components import components

WIDTH = 3
RADIUS = 2
BLOCKS = 4
BUCKET = 32


def with_shingles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, hashes)``: the signed XXH64 of the words from each place on, ``width`` at most.

    These are the shingles and then ``width - 1`` tails; a text shorter than ``width`` has itself first.
    """
    rows = held(docs.select("doc_id", text_of().alias("text")), "w", words(ascii_lower(F.col("text"))))
    hashes = F.transform("w", lambda x, i: F.xxhash64(F.array_join(F.slice("w", i + 1, width), " ")))
    return held(rows.select("doc_id", "w"), "hashes", hashes).select("doc_id", "hashes")


#: For each byte, a 64-bit word with its bits in eight counters of eight bits.
_SPREAD = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """The signed 64-bit majority of the bits of ``h``."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    octets = np.ascontiguousarray(h, dtype="<i8").view(np.uint8).reshape(n, 8)
    starts = np.arange(0, n, 255)  # a counter of eight bits holds 255
    for k in range(8):
        packed = np.add.reduceat(_SPREAD[octets[:, k]], starts)
        counts[8 * k : 8 * k + 8] = packed.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(h[: max(1, len(h) - width + 1)]) for h in hashes], dtype="int64")

    return F.pandas_udf(run, "long")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``docs``."""
    modest_batches(docs.sparkSession)
    return with_shingles(docs, width).select("doc_id", _fingerprints(width)("hashes").alias("fp"))


def _block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Every choice of ``blocks - radius`` blocks: its number and the bits of the fingerprint there."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` links between the distinct fingerprints ``fp``, enough for their components."""
    keyed = written(distinct.select("fp", F.explode(_block_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.n", "k.bits"), "sim-blocks")
    sizes = keyed.groupBy("n", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    small = sizes.where(F.col("size") <= bucket).select("n", "bits")
    members = keyed.join(small, ["n", "bits"]).groupBy("n", "bits").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = members.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowded = keyed.join(sizes.where(F.col("size") > bucket).select("n", "bits"), ["n", "bits"]).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)]]
    balls = crowded.select("fp", F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("ball"))
    least = balls.groupBy("ball").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("ball", "a")
    met = balls.join(least, "ball").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row for each document: doc_id, fp, component_id (the smallest doc_id reachable by links)."""
    if radius != 2:
        raise ValueError("crowded buckets are linked by balls of radius 1, which is exact for a radius of 2")
    prints = written(fingerprints(docs, width), "sim-prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "sim-classes")
    roots = components(links(classes.select("fp"), radius, blocks))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Similar documents: words in a shingle, the least similarity, bands that propose pairs and minima in each, words
#: of 64 bits to verify with.
SIMILAR_WIDTH, LEAST = 5, 0.8
BANDS, MINIMA, VERIFY_WORDS = 40, 8, 24
#: Members on each side of a tile of comparisons.
TILE = 256


def allowed_bits(similarity: float, bits: int) -> int:
    """Differing bits expected of two sets of that Jaccard similarity (equal sizes), and two deviations more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(round(bits * p + 2 * np.sqrt(bits * p * (1 - p))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_sets(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, begin): the distinct shingles of each text one after the other; a shorter text is one shingle."""
    out = []
    for w in texts:
        k = min(width, len(w))
        names = np.full(len(w) - k + 1 if k else 0, k, dtype=np.uint64)
        for j in range(k):
            names = _mixed(names * np.uint64(3) + w[j : len(w) - k + 1 + j])
        out.append(np.unique(names))
    begin = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), begin


def wide_bits(names: np.ndarray, begin: np.ndarray, words_: int, salt: int) -> np.ndarray:
    """SimHash of ``64 * words_`` bits for each text: (texts, 64 * words_) of 0 and 1."""
    texts = len(begin) - 1
    sizes = np.diff(begin)
    bits = np.zeros((texts, 64 * words_), dtype=np.uint8)
    if not len(names):
        return bits
    # Cuts of at most 255 names (a counter has eight bits) that never cross a text.
    full = np.nonzero(sizes)[0]
    cuts = np.concatenate([np.arange(begin[i], begin[i + 1], 255) for i in full])
    owner = np.searchsorted(begin, cuts, side="right") - 1
    first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    for r in range(words_):
        octets = _mixed(names + np.uint64((salt + r) * 0x9E3779B97F4A7C15 % 2**64)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            packed = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts = np.add.reduceat(packed, first, axis=0)
            bits[owner[first], 64 * r + 8 * k : 64 * r + 8 * k + 8] = 2 * counts > sizes[owner[first], None]
    return bits


#: Odd factors that reorder the shingle names, one for each minimum.
_FACTORS = _mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bands(names: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, BANDS): each band mixes the minima of a text's shingles in ``MINIMA`` orders; 0 without shingles.

    Two texts have equal minima in one order with the probability of their Jaccard similarity ``j``, wherever they
    differ, and so share a band with 1 - (1 - j ** MINIMA) ** BANDS: 0.9993 at 0.8.
    """
    full = np.nonzero(np.diff(begin))[0]
    out = np.zeros((len(begin) - 1, BANDS), dtype=np.uint64)
    order = np.empty_like(names)
    for n, factor in enumerate(_FACTORS if len(full) else ()):
        least = np.minimum.reduceat(np.multiply(names, factor, out=order), begin[full])  # names are random already
        out[full, n // MINIMA] = _mixed(out[full, n // MINIMA] * np.uint64(3) + least)
    return out.view(np.int64)


def _wide(names: pd.Series) -> pd.DataFrame:
    sets = _shingle_sets([np.asarray(x, dtype=np.int64).view(np.uint64) for x in names], SIMILAR_WIDTH)
    verify = np.packbits(wide_bits(*sets, VERIFY_WORDS, 1000), axis=1, bitorder="little").view("<i8")
    return pd.DataFrame({"blocks": list(bands(*sets)), "fp": list(verify)})


def _close(tiles: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(a, b)`` of every tile: members of the left and the right side with different roots and near fingerprints."""
    limit, step = allowed_bits(LEAST, 64 * VERIFY_WORDS), 64
    for batch in tiles:
        out = [np.empty((0, 2), dtype=np.int64)]
        for left, right in zip(batch["l"], batch["r"]):
            (ids, roots, prints), (ids_, roots_, prints_) = ([np.stack([x[c] for x in side]) for c in ("id", "root", "fp")] for side in (left, right))
            prints, prints_ = prints.view(np.uint64), prints_.view(np.uint64)  # bits are counted without a sign
            for at in range(0, len(ids), step):
                rows = slice(at, at + step)
                differ = sum(np.bitwise_count(prints[rows, None, c] ^ prints_[None, :, c]).astype(np.int32) for c in range(prints.shape[1]))
                i, j = np.nonzero((differ <= limit) & (roots[rows, None] != roots_[None, :]))
                out.append(np.sort(np.stack([ids[rows][i], ids_[j]], axis=1), axis=1))
        yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def _tiled(live: DataFrame, prints: DataFrame, tile: int) -> DataFrame:
    """Links between all members of a bucket ``(n, bits)`` with different roots, whatever the bucket's size.

    Of two members with different roots one at least is outside the bucket's most frequent root, so the outsiders
    are compared with all members, in tiles of about ``tile`` by ``tile``. A bucket with one root has no tiles.
    """
    key = ["n", "bits"]
    tops = live.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("c")).groupBy(*key).agg(
        F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("top")
    ).where(F.col("size") > F.col("top.c"))
    pieces = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    tops = tops.select(*key, F.col("top.root").alias("main"), pieces(F.col("size") - F.col("top.c")).alias("rows"), pieces(F.col("size")).alias("cols"))
    members = live.join(tops, key).join(prints, "id")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = F.struct("id", "root", "fp").alias("m")
    left = members.where("root <> main").select(*key, place("rows").alias("i"), every("cols").alias("j"), F.lit(True).alias("outside"), member)
    right = members.select(*key, every("rows").alias("i"), place("cols").alias("j"), F.lit(False).alias("outside"), member)
    tiles = left.unionByName(right).groupBy(*key, "i", "j").agg(
        F.collect_list(F.when(F.col("outside"), F.col("m"))).alias("l"), F.collect_list(F.when(~F.col("outside"), F.col("m"))).alias("r")
    ).where((F.size("l") > 0) & (F.size("r") > 0))
    return tiles.select("l", "r").mapInPandas(_close, "a long, b long").distinct()


def similar_documents(docs: DataFrame, bucket: int = BUCKET, leaders: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id): groups of documents whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more, by wide SimHash fingerprints.

    A pair at 0.8 differs in 15 % of the bits, too many for pigeonholes. So minima of the shingles in ``BANDS`` bands
    of ``MINIMA`` propose the pairs: one at 0.8 shares a band with a probability of 0.9993, whatever the edit. Pairs
    that share a band are verified by the Hamming distance of a wide fingerprint of the same shingles. Equal word
    sequences are one document from the start. First all members of a bucket are compared with its smallest id, or
    with up to ``leaders`` (smallest, largest and a hashed id) if it has more than ``bucket`` documents; this only
    saves work. Then all members of every bucket that this hasn't joined are compared with each other, in tiles.
    Texts without words are alike; null ids are never linked. The result is a work table of two numbers a document;
    the tables of fingerprints and bands are deleted once it is written.
    """
    modest_batches(docs.sparkSession)
    rows = held(docs.select("doc_id", text_of().alias("text")), "w", words(ascii_lower(F.col("text")))).select("doc_id", "w")
    rows = held(rows.select("doc_id", "w", F.md5(F.array_join("w", " ").cast("binary")).alias("name")), "names", F.transform("w", lambda x: F.xxhash64(x)))
    made = rows.select("doc_id", "name", F.pandas_udf(_wide, "blocks array<long>, fp array<long>")("names").alias("f"))
    prints = written(made.where("doc_id is not null").select("doc_id", "name", "f.blocks", "f.fp"), "wide-prints")
    classes = written(prints.groupBy("name").agg(F.min_by(F.struct("doc_id", "blocks", "fp"), "doc_id").alias("r")).select("name", F.col("r.doc_id").alias("id"), "r.blocks", "r.fp"), "wide-classes")
    keyed = written(classes.select("id", F.posexplode("blocks").alias("n", "bits")), "wide-blocks")
    sizes = keyed.groupBy("n", "bits").agg(
        F.count(F.lit(1)).alias("size"), F.array_distinct(F.array(F.min("id"), F.max("id"), F.min_by("id", F.xxhash64("id")))).alias("leaders")
    ).where("size > 1")
    crowded = F.col("size") > bucket
    first_of = F.when(crowded, F.slice("leaders", 1, leaders)).otherwise(F.slice("leaders", 1, 1))
    stars = keyed.join(sizes.select("n", "bits", first_of.alias("leaders")), ["n", "bits"])
    stars = stars.select(F.col("id").alias("b"), F.explode("leaders").alias("a")).where("a <> b")
    side = lambda c: classes.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}"))

    def verified(near: DataFrame) -> DataFrame:
        pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        distance = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return pairs.join(side("a"), "a").join(side("b"), "b").where(distance <= allowed_bits(LEAST, 64 * VERIFY_WORDS)).select("a", "b")

    star_links = written(verified(stars), "wide-links")
    stars_rooted = components(star_links)
    joined = written(stars_rooted, "wide-joined")
    live = keyed.join(sizes.where("size > 2").select("n", "bits"), ["n", "bits"]).join(joined.withColumnRenamed("node", "id"), "id", "left")
    live = live.select("n", "bits", "id", F.coalesce("root", "id").alias("root"))
    links_ = star_links.unionByName(_tiled(live, classes.select("id", "fp"), tile))
    roots = components(links_)
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("name", F.coalesce("root", "id").alias("component_id"))
    found = written(prints.select("doc_id", "name").join(named, "name").select("doc_id", "component_id"), "wide-found")
    dropped(prints, classes, keyed, star_links, stars_rooted, joined, roots)
    return found


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
