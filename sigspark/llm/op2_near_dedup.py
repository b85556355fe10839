"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's k-mers are its five-word shingles, each labelled with its occurrence number, so labels are unique in a text. A
sketch takes the `tuple_size` labels of smallest hash and keeps them in text order; equal sketches make a candidate. Short
texts take a fifth of their labels instead, in every tuple size that a similar text might have. The
similarity of two texts is |LCS| / (n + m - |LCS|) over their labelled shingles: the shingles' Jaccard index, counting
only those in common order. As labels are unique, the longest common subsequence is a longest increasing run of matched
positions; positions further apart than a similar pair allows lie outside the band and are left out.

Candidates of a bucket are first compared with its smallest document. Buckets whose documents are then still in several
classes have the pairs across these classes compared, so no link of a bucket that could join two classes is lost, while
pairs inside a class, as in a large group of copies, are never made. Texts that share a long passage but little else meet
in such buckets by the thousands; a pair is made only where BITS one-bit minima of the two agree as often as a similar
pair's do. A pair at the threshold agrees in 0.9 of its bits on average and is missed where it lies MARGIN standard deviations
lower, about twice in 10,000, as rarely as the sketches miss it; no bucket is capped. With margin None every such pair is
made and aligned, so that only the sketches can miss one.

A vertex is a word sequence, not a doc_id: rows that repeat a doc_id with other texts are vertices of their own, joined
because they share the doc_id.

Defined results: null or empty texts, and other texts without a word, are each a class of their own; texts of under
five words have one shingle, all their words; equal word sequences are one class without alignment; rows of the same
doc_id share a class; a null doc_id is a class of its own; an empty table gives no rows; extra columns are ignored; texts
of any length are read whole.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, least_neighbour, small_batches, text_of, texts_as_bytes, written

SKETCHES, TUPLE, K = 48, 8, 5
#: One-bit minima of a text, 64 to a long, and the standard deviations that a pair may lie under the mean of its threshold.
BITS, MARGIN = 2048, 3.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _BASE
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Word hashes are kept from text to text; beyond `most` words the store starts anew."""

    def __init__(self, most: int = 200_000):
        self.words: dict[bytes, int] = {}
        self.most = most

    def words_of(self, text: bytes) -> np.ndarray:
        if len(self.words) > self.most:
            self.words.clear()
        words = text.lower().split()
        try:
            return np.array(list(map(self.words.__getitem__, words)), dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in self.words:
                    self.words[w] = xxhash.xxh3_64_intdigest(w)
            return np.array(list(map(self.words.__getitem__, words)), dtype=np.uint64)

    def labels(self, text: bytes, k: int) -> np.ndarray:
        """Labelled shingles in text order, as hashes that are unique in the text."""
        w = self.words_of(text)
        if not len(w):
            return w
        k = min(k, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = _scramble(h + w[j : len(w) - k + 1 + j])
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.flatnonzero(s[1:] == s[:-1])
        if len(same):
            first = np.concatenate(([True], s[1:] != s[:-1]))
            start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
            nth = np.empty(len(s), np.uint64)
            nth[order] = (np.arange(len(s)) - start).astype(np.uint64)
            h = np.where(nth > 0, _scramble(h + nth * _MIX), h)
        return h


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tuple_sizes(n: int, largest: int, least: float) -> range:
    """The tuple sizes a text of n labels is sketched in: those of all lengths that a similar text can have."""
    size = lambda x: min(largest, max(1, x // 5))
    return range(size(int(np.ceil(n * least))), size(int(n / least)) + 1)


#: Numbers that a kernel holds at once while it samples a text, whatever the text's length.
HELD = 1 << 20


def sketches(labels: np.ndarray, factors: np.ndarray, largest: int, least: float) -> np.ndarray:
    """For each tuple size and factor one hash: of the labels of smallest product, in text order."""
    sizes = tuple_sizes(len(labels), largest, least)
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    for part in np.array_split(factors, min(len(factors), 1 + len(factors) * len(labels) // HELD)):
        h = labels[None, :] * part[:, None]
        for own, size in zip(out, sizes, strict=True):
            if size < len(labels):
                rows = labels[np.sort(np.argpartition(h, size - 1, axis=1)[:, :size], axis=1)]
            else:
                rows = np.broadcast_to(labels, (len(part), len(labels)))
            key = part + np.uint64(size)
            for j in range(rows.shape[1]):
                key = _scramble(key + rows[:, j])
            own.append(key)
    return np.concatenate([key for own in out for key in own]).view(np.int64)


def one_bit_minima(labels: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor one bit of the smallest product, packed into longs. Two texts agree in (1 + Jaccard) / 2 of them."""
    least = [(labels[None, :] * part[:, None]).min(axis=1) for part in np.array_split(factors, min(len(factors), 64 + len(factors) * len(labels) // HELD))]
    return np.packbits((_scramble(np.concatenate(least)) >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def agreeing(least: float, margin: float) -> int:
    """Bits in which a pair agrees at least to be compared."""
    p = (1 + least) / 2
    return int(BITS * p - margin * (BITS * p * (1 - p)) ** 0.5)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """The similarity of two label sequences; 0 where it is provably under `least`."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    # similar means LCS >= least/(1+least)*(n+m), which leaves at most so many unmatched labels, the width of the band
    band = n + m - 2 * int(np.ceil(least / (1 + least) * (n + m) - 1e-9))
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    at[at == m] = 0
    j = order[at]
    i = np.flatnonzero((b[j] == a) & (np.abs(np.arange(n) - j) <= band))
    if len(i) < least / (1 + least) * (n + m) - 1e-9:
        return 0.0
    tails: list[int] = []
    for x in j[i].tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails) / (n + m - len(tails))


def _sketched(docs: DataFrame, k: int, n: int, size: int, least: float) -> DataFrame:
    """(doc_id, same: hash of the word sequence, n: shingles, keys)."""

    def kernel(batches):
        shingler, factors = Shingler(), multipliers(n)
        for batch in small_batches(batches):
            same, lengths, keys = [], [], []
            for text in texts_as_bytes(batch.column(1)):
                labels = shingler.labels(text, k)
                lengths.append(len(labels))
                same.append(_word_sequence(text))
                keys.append(sketches(labels, factors, size, least) if len(labels) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(lengths, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "n", "keys"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(kernel, "doc_id long, same binary, n long, keys array<long>")


def _word_sequence(text: bytes) -> bytes | None:
    words = text.lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _labelled(docs: DataFrame, k: int) -> DataFrame:
    """(id, labels, bits) of docs (doc_id, text, id, same): the rows whose text is the word sequence `same`, once each as
    rows of a doc_id follow one another."""

    def kernel(batches):
        shingler, factors, doc, seen = Shingler(), multipliers(SKETCHES + BITS)[SKETCHES:], None, set()
        for batch in small_batches(batches):
            ids, labels, bits = [], [], []
            for own, text, vertex, same in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != doc:
                    doc, seen = own, set()
                if vertex not in seen and _word_sequence(text) == same:
                    seen.add(vertex)
                    x = shingler.labels(text, k)
                    ids.append(vertex)
                    labels.append(x.tobytes())
                    bits.append(one_bit_minima(x, factors))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["id", "labels", "bits"])

    return docs.mapInArrow(kernel, "id long, labels binary, bits array<long>")


def _verified(pairs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar."""
    both = pairs.join(labels.select(F.col("id").alias("a"), F.col("labels").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("labels").alias("lb")), "b")

    def kernel(batches):
        for batch in small_batches(batches, 32):
            good = [aligned(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "la", "lb").mapInArrow(kernel, "a long, b long")


def near_classes(docs: DataFrame, least: float = 0.8, k: int = K, n_sketches: int = SKETCHES, tuple_size: int = TUPLE, margin: float | None = MARGIN) -> DataFrame:
    """doc_id, class_id (the largest doc_id of the class), class_size, kept for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", text_of().alias("text"))
    made = written(_sketched(docs, k, n_sketches, tuple_size, least), "sketches")
    # Equal word sequences are one vertex, numbered by its smallest doc_id; of several with one smallest doc_id the others
    # get a hash.
    first = made.where("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("same"))
    first = written(first.withColumn("id", F.when(nth == 1, F.col("doc")).otherwise(F.xxhash64("same", "doc"))), "vertices")
    keys = made.join(first.select(F.col("same").alias("s"), F.col("doc").alias("doc_id"), "id"), "doc_id").where("same = s").select("id", "n", F.explode("keys").alias("key")).distinct()
    keys = written(keys, "keys")
    heads = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("bucket"), F.col("head.id").alias("a"), F.col("head.n").alias("na"))
    rows = written(keys.join(heads, F.xxhash64("key") == F.xxhash64("bucket")).where("key = bucket").select("key", "id", "n", "a", "na"), "buckets")
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    # Only texts in buckets move, once; merge: the way that also holds when the ids are too many to broadcast.
    needed = first.join(rows.select("id").distinct(), "id", "left_semi").select(F.col("doc").alias("doc_id"), "id", "same")
    texts = docs.join(needed.hint("merge"), "doc_id").select("doc_id", "text", "id", "same")
    labelled = written(_labelled(texts, k), "labels")
    stars = written(rows.where(F.col("id") > F.col("a")).where(fits(F.col("n"), F.col("na"))).select("a", F.col("id").alias("b")).distinct(), "stars")
    # Rows of one doc_id share a class whatever their texts.
    shared = made.join(first.select("same", "id"), "same").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    shared = made.join(first.select("same", "id"), "same").join(shared, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    links = written(_verified(stars, labelled, least).union(shared), "links")
    labels = least_neighbour(links)
    # Second round: buckets that still hold several classes, and in these the pairs across classes.
    classed = rows.join(labels, "id", "left").select("key", "id", "n", "a", F.coalesce("label", "id").alias("label"))
    classed = written(classed, "classed")
    open_ = classed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("key").alias("bucket"))
    members = classed.join(open_, F.xxhash64("key") == F.xxhash64("bucket")).where("key = bucket").drop("bucket")
    words = range(BITS // 64)
    members = members.join(labelled.select("id", *[F.get("bits", F.lit(w)).alias(f"b{w}") for w in words]), "id")
    # A pair that shares several buckets is made in the one of the smallest key: no open bucket before it holds both.
    earlier = Window.partitionBy("id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    opened = written(members.withColumn("earlier", F.collect_list("key").over(earlier)), "open")
    members = opened
    heads = members.where("id = a").select(F.col("key").alias("hk"), F.col("label").alias("head_label"))
    members = members.join(heads, F.col("key") == F.col("hk"), "left").drop("hk")
    outer = members.where("label <> head_label").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("earlier").alias("earlier_x"), *[F.col(f"b{w}").alias(f"x{w}") for w in words])
    inner = members.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), F.col("label").eqNullSafe(F.col("head_label")).alias("headed"), F.col("earlier").alias("earlier_y"), *[F.col(f"b{w}").alias(f"y{w}") for w in words])
    differ = sum((F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in words), F.lit(0))
    across = outer.join(inner, "key").where("lx <> ly AND (headed OR x < y)").where(fits(F.col("nx"), F.col("ny")))
    if margin is not None:
        across = across.where(differ <= BITS - agreeing(least, margin))
    across = across.where(~F.arrays_overlap("earlier_x", "earlier_y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(stars, ["a", "b"], "left_anti")
    pairs = written(across, "across")
    more = written(_verified(pairs, labelled, least), "links")
    # Only classes are joined further, so the second search runs over them and their few links.
    one = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"class_{side}"))
    joined = more.join(one("a"), "a", "left").join(one("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    labels_of_classes = least_neighbour(joined).select(F.col("id").alias("first_label"), F.col("label").alias("last_label"))
    vertex = made.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(first.select("same", "id"), "same", "left")
    out = vertex.select("doc_id", "id").join(labels, "id", "left").withColumn("first_label", F.coalesce("label", "id"))
    out = out.join(labels_of_classes, "first_label", "left").withColumn("label", F.coalesce("last_label", "first_label"))
    out = written(out.select("doc_id", F.coalesce(F.col("label"), F.col("doc_id")).alias("vertex"), F.col("id").isNull().alias("alone")), "classes")
    dropped(made, first, keys, rows, labelled, stars, links, classed, opened, pairs, more)  # the classes have taken them in
    sums = out.where("NOT alone").groupBy("vertex").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    sums = sums.select(F.xxhash64(F.col("vertex")).alias("vk"), F.col("vertex").alias("v"), "top", "class_size")
    out = out.join(sums, (F.xxhash64(out["vertex"]) == sums["vk"]) & (out["vertex"] == sums["v"]) & ~out["alone"], "left")
    class_id = F.coalesce("top", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
