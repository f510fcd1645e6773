"""Near copies: word n-gram Jaccard similarity join by parity sketches.

A document's set holds the hashes of its distinct word n-grams.  Hash every element to a bit of a long sketch and
flip it: a bit is the parity of the elements there, so two sketches differ in at most as many bits as the sets have
elements of their own (the Hamming distance bounds the symmetric difference from below).  Sets of a and b elements
that reach a similarity of num / 100 differ in at most d(a + b) = (100 - num)(a + b) / (100 + num) elements.

- Size bands.  A pair belongs to the band of its smaller set.  A band's sketch is cut into one piece more than its
  largest pair may differ in and some to spare, so some piece agrees wholly (pigeonhole).  A document gives all its
  non-empty pieces in its own band and in the bands below where a partner can be; empty pieces, which unrelated
  documents have in common, only where it has too few others.  A piece is carried as the XOR of 64-bit hashes of its
  elements: a linear digest of its parity bits over 2**64 places.
- Rarest first.  All documents order their pieces alike: those that nobody shares, then by how many rows have them,
  empty ones last.  If two linked documents differ in at most d pieces, the first common one in that order is among
  the first d + 1 of both.  So a document shows those alone, and pieces without a partner, which come first, are
  shown to nobody: a document that shares a passage and nothing else has too many of them and shows nothing at all.
- Equal sets are one class before any search: classes come from partial aggregates, and a task shows the pieces of a
  class once.  So a group of copies makes no more pieces than there are tasks.
- Documents that show the same piece form a bucket.  All are compared with the bucket's hub (a star): the document
  whose pieces are the most widespread, which is the middle of a cluster of copies.  Then whatever else still lies in
  different components inside a bucket is compared pair by pair, with sizes and short sketches as conditions of that
  join, so that only likely links leave it; pairs of one component need no comparison, since only reachability is
  asked for.  No link between different texts is lost.
- A pair is verified on the exact sets only if sizes and the distance of folded sketches allow the link.  These have
  at least as many bits as the set has elements, so they tell long sets apart too; the longer of two is folded again.

Memory: a worker holds a slice of texts, or one hub's set and one partner's.  The rows of a piece meet in one task as
a stream of (key, node): nothing is held but a count for each key and the keys that have partners.  Texts of pairs
alone go on to verification, and a hub with many partners is dealt out by a salt.  What is left of a bucket after its
star is compared within its task, without rows for pairs that can't be links.

Edge cases.  A null or empty text, or one without words, has an empty set and is linked with nothing.  Fewer than n
words: the whole sequence is the one element.  Rows with a null doc_id keep a null component.  Rows that repeat a
doc_id are one node: it has the links of all its rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .bytescan import U64, Texts, grams, mix
from .graph import components

BAND_GROWTH = 1.4
FOLD_BITS = 1024
#: Partners of a hub that are verified in one salted group, on average.
GROUP = 256
#: Rows of (doc_id, hub, salt, role), 28 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_PAIRS = 200_000
#: Longs of the short sketch that is a condition of the join within buckets.
SHORT = 8


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (A-Z lower-cased; ASCII white space separates words)."""
    scan = Texts.of(texts).lowered()
    starts, ends, docs = scan.words()
    hashes = scan.hashes(starts, ends)
    values, places = grams(hashes, docs, n)
    cuts = np.searchsorted(docs[places], np.arange(len(scan) + 1))
    words = np.searchsorted(docs, np.arange(len(scan) + 1))
    out = []
    for i in range(len(scan)):
        own = values[cuts[i] : cuts[i + 1]]
        if not len(own) and words[i + 1] > words[i]:
            own = hashes[words[i] : words[i] + 1] + U64(words[i + 1] - words[i])
            for h in hashes[words[i] + 1 : words[i + 1]]:
                own = mix(own * U64(0xC2B2AE3D27D4EB4F) ^ h)
        out.append(np.unique(own))
    return out


class Bands:
    """Which pieces a set of a given size shows."""

    def __init__(self, num: int):
        self.num = num
        self.lows = [1]
        self.plans: dict[int, list[tuple[int, int, int]]] = {}

    def budget(self, total: int) -> int:
        return (100 - self.num) * total // (100 + self.num)

    def plan(self, size: int) -> list[tuple[int, int, int]]:
        """(band, pieces of its sketch, most elements a pair there may differ in); empty where a link needs equal sets."""
        if size not in self.plans:
            while self.lows[-1] <= size:
                self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND_GROWTH)))
            out = []
            own = next(k for k in range(len(self.lows) - 2, -1, -1) if self.lows[k] <= size)
            for band in range(own, -1, -1):
                top = self.lows[band + 1] - 1
                if 100 * top < self.num * size and band != own:
                    break
                most = self.budget(top + 100 * top // self.num)
                pieces = most + most // 16 + 4  # to spare: about as many as are empty at the top of a band
                need = self.budget(size + (100 * size // self.num if band == own else top))
                if need:
                    out.append((band, pieces, need))
            self.plans[size] = out
        return self.plans[size]


def piece_keys(values: np.ndarray, bands: Bands) -> list[tuple[int, int, np.ndarray]]:
    """For each band of a set: (band, how many more pieces it may show than it has non-empty ones, keys of its pieces).

    The lowest bit of a key is set for an empty piece, the three above hold the band modulo 8.
    """
    out = []
    mixed = mix(values ^ U64(0x5851F42D4C957F2D))
    high = values >> U64(32)
    for band, pieces, need in bands.plan(len(values)):
        piece = ((high * U64(pieces)) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        parity, empty = np.zeros(pieces, U64), np.ones(pieces, bool)
        parity[piece[first]], empty[piece[first]] = np.bitwise_xor.reduceat(mixed, first), False
        given = piece[first] if len(first) > need else np.arange(pieces)
        place = given.astype(np.uint64) + U64(band << 32)
        keys = mix(parity[given] ^ mix(place + U64(0x1234567)))
        out.append((band, need - len(first), (keys & ~U64(15)) | U64((band & 7) << 1) | empty[given].astype(U64)))
    return out


def folded(values: np.ndarray) -> np.ndarray:
    """The parity sketch as longs; its bits are a power of two, FOLD_BITS and the set's size at least."""
    size = max(FOLD_BITS, 1 << (len(values) - 1).bit_length())
    bits = np.bincount((mix(values ^ U64(0x5851F42D4C957F2D)) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SKETCH_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, fold array<long>, band int, rooms array<long>, pieces array<long>"


def sketches(docs: DataFrame, n: int, num: int) -> DataFrame:
    """Per document: its set's size, signature (s1, s2), folded sketch and, once a task and signature, its pieces.

    ``rooms`` has an entry for ``band``, the document's own, and for each band below that it takes part in.
    """

    def run(batches):
        bands, shown = Bands(num), set()
        for batch in batches:
            texts = store.filled(batch.column(1))
            for a, b in store.text_slices(texts):
                sizes, s1, s2, folds, own, rooms, pieces = [], [], [], [], [], [], []
                for values in shingle_sets(texts.slice(a, b - a), n):
                    one, two = mix(values + U64(11)), mix(values + U64(29))
                    sign = int(one.sum(dtype=U64).astype(np.int64)), int(np.bitwise_xor.reduce(two).astype(np.int64)) if len(two) else 0
                    sizes.append(len(values)), s1.append(sign[0]), s2.append(sign[1])
                    new = len(values) > 0 and sign not in shown
                    shown.add(sign)
                    folds.append(folded(values) if len(values) else np.zeros(0, np.int64))
                    plan = bands.plan(len(values)) if len(values) else []
                    given = piece_keys(values, bands) if new else []
                    own.append(plan[0][0] if plan else 0)
                    rooms.append(np.array([x[1] for x in given], np.int64))
                    pieces.append(np.concatenate([x[2] for x in given]).view(np.int64) if given and new else np.zeros(0, np.int64))
                columns = [pa.array(x, pa.int64()) for x in (sizes, s1, s2)] + [_lists(folds), pa.array(own, pa.int32()), _lists(rooms), _lists(pieces)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_shingles", "s1", "s2", "fold", "band", "rooms", "pieces"])

    return docs.mapInArrow(run, SKETCH_SCHEMA)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def _shorter(fold: str, other: str):
    """``fold``, its parts laid over each other until it is as short as ``other``."""
    part = F.least(F.size(fold), F.size(other))
    at = lambda i: F.aggregate(F.sequence(i, F.size(fold) - 1, part), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(fold, j)))
    return F.when(F.size(fold) > F.size(other), F.transform(F.sequence(F.lit(0), part - 1), at)).otherwise(F.col(fold))


def _sizes_fit(num: int, a: str, b: str):
    return 100 * F.least(a, b) >= num * F.greatest(a, b)


def _few(pairs: DataFrame) -> DataFrame:
    """``pairs`` saved, and sent to all executors if they are few: the texts of all others then stay where they are."""
    pairs = store.saved(pairs, "items")
    return F.broadcast(pairs) if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else pairs


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int) -> DataFrame:
    """Edges (u, v) between class representatives for those pairs (a, b) of signatures that are links."""
    side = lambda x: classes.select(F.col("s1").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("fold").alias(f"fold_{x}"))
    apart = F.aggregate(F.zip_with(_shorter("fold_a", "fold_b"), _shorter("fold_b", "fold_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    close = both.where(_sizes_fit(num, "n_a", "n_b") & (apart * (100 + num) <= (100 - num) * (F.col("n_a") + F.col("n_b"))))
    close = store.saved(close.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).where("u != v").distinct(), "pairs")
    salts = close.groupBy("u").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    dealt = close.join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).alias("salt"))
    partners = dealt.select(F.col("v").alias("doc_id"), F.col("u").alias("hub"), "salt", F.lit(1).alias("role"))
    hubs = dealt.select(F.col("u").alias("doc_id"), F.col("u").alias("hub"), "salt", F.lit(0).alias("role")).distinct()
    items = _few(partners.union(hubs)).join(docs, "doc_id").select("hub", "salt", "role", "doc_id", "text")

    def run(batches):
        at, held = None, []
        for batch in batches:
            hub, salt, role, doc = (batch.column(i).to_pylist() for i in range(4))
            texts = store.filled(batch.column(4))
            for a, b in store.text_slices(texts):
                found = []
                for i, values in enumerate(shingle_sets(texts.slice(a, b - a), n), a):
                    if at != (hub[i], salt[i]):
                        at, held = (hub[i], salt[i]), []
                    if role[i] == 0:
                        held.append(values)
                        continue
                    for other in held:
                        same = len(np.intersect1d(values, other, assume_unique=True))
                        if same and 100 * same >= num * (len(values) + len(other) - same):
                            found.append((hub[i], doc[i]))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    grouped = items.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "doc_id")
    return grouped.mapInArrow(run, "u long, v long")


def _buckets(table: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, hub) of all buckets of two nodes or more, rarest pieces first."""
    rows = table.select(F.explode("pieces").alias("key"), F.col("s1").alias("node")).repartition("key")
    # Both read the one exchange; a key's rows stream past, so that a frequent one takes no memory.
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
    rows = store.saved(rows.join(shared.hint("shuffle_hash"), "key").distinct(), "pieces")
    rooms = classes.select(F.col("s1").alias("node"), "band", "rooms").distinct()
    rows = rows.join(rooms, "node").select("key", "node", "n", "rooms", F.pmod(F.col("band") - F.shiftright("key", 1).bitwiseAND(7), F.lit(8)).cast("int").alias("slot"), F.col("key").bitwiseAND(1).alias("empty"))
    own = Window.partitionBy("node", "slot")
    rank = F.row_number().over(own.orderBy("empty", "n", "key"))
    rows = rows.select("key", "node", "slot", "rooms", rank.alias("rank"), F.sum(1 - F.col("empty")).over(own).alias("others"), F.sum("n").over(own).alias("weight"))
    rows = store.saved(rows.where("rank - 1 <= coalesce(get(rooms, slot), 0) + others").select("key", "node", "weight").distinct(), "shown")
    first = F.shiftleft(F.least("weight", F.lit((1 << 40) - 1)), 22) + F.col("node").bitwiseAND((1 << 22) - 1)
    hubs = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max_by("node", first).alias("hub")).where("low != high").select("key", "hub")
    return store.saved(rows.join(hubs, "key").select("key", "node", "hub"), "buckets")


def near_copies(docs: DataFrame, n: int = 5, num: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of the links at a similarity of num / 100."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = store.saved(sketches(docs, n, num), "sketches")
    sets = table.where("n_shingles > 0")
    classes = store.saved(sets.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    shapes = sets.where(F.size("pieces") > 0).select("s1", "s2", "n_shingles", "fold", "band", "rooms")
    buckets = _buckets(table, shapes)
    nodes = buckets.select(F.col("node").alias("s1")).distinct()
    known = shapes.join(nodes, "s1", "left_semi").dropDuplicates(["s1", "s2", "n_shingles"])
    known = known.join(classes.where(F.col("rep").isNotNull()), ["s1", "s2", "n_shingles"])
    short = F.transform(F.sequence(F.lit(0), F.lit(SHORT - 1)), lambda i: F.aggregate(F.sequence(i, F.size("fold") - 1, F.lit(SHORT)), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get("fold", j))))
    known = store.saved(known.withColumn("short", short), "known")
    named = docs.where(F.col("doc_id").isNotNull())
    stars = buckets.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = store.saved(_verified(stars, known, named, n, num), "links")
    joined = components(edges)
    # Buckets that still hold several components: every pair across them that no star has compared.
    label = known.select(F.col("s1").alias("node"), "rep", "n_shingles", "short").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    marked = buckets.where("node != hub").join(label.withColumn("component", F.coalesce("component", "rep")).drop("rep"), "node")
    apart = marked.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    open_ = store.saved(marked.join(apart, "key").select("key", "node", "component", "n_shingles", *[F.get("short", F.lit(i)).alias(f"x{i}") for i in range(SHORT)]), "open")
    x, y = (open_.select("key", F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in open_.columns[2:]]) for k in "ab")
    far = sum((F.bit_count(F.col(f"x{i}_a").bitwiseXOR(F.col(f"x{i}_b"))) for i in range(SHORT)), F.lit(0))
    likely = _sizes_fit(num, "n_shingles_a", "n_shingles_b") & (far * (100 + num) <= (100 - num) * (F.col("n_shingles_a") + F.col("n_shingles_b")))
    rest = x.join(y, (x["key"] == y["key"]) & F.expr("a < b and component_a != component_b") & likely).select("a", "b").distinct()
    more = store.saved(_verified(rest, known, named, n, num), "links")
    if not more.isEmpty():
        joined = components(edges.union(more))
    result = table.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    result = result.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"))
