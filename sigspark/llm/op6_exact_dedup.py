"""Exact dedup by recipes of content-defined chunks.

A document's normalised text (A-Z lower-cased) is cut where a rolling hash of its last bytes hits a mask, so equal
stretches give equal chunks wherever they stand. One pass over the text makes the recipe: the ordered list of chunk
digests. From then on documents are compared by recipe; the text does not move again, except the chunks of documents
whose recipe occurs at least twice: these are shuffled once, keyed by digest, to verify that a digest stands for one content.
Digests with several contents get numbered identifiers, and the recipes that hold them are numbered anew before they are
compared.

Defined results: null counts as empty, and all empty texts are equal; ties cannot occur, as the largest doc_id stays (of
rows with the same doc_id and text, each row is answered and kept); a null doc_id is smaller than any; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_as_bytes, written

#: Bytes that decide a cut, and the largest chunk. A chunk of `mask + 1` bytes is the mean.
WIDTH, LARGEST = 32, 16384


def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)


def cuts(text: bytes, mask: int, gear: np.ndarray) -> list[int]:
    """Chunk ends. A cut follows each byte where the sum of the last WIDTH shifted table entries has zero mask bits."""
    n = len(text)
    if n <= WIDTH:
        return [n]
    g = gear[np.frombuffer(text, np.uint8)]
    h, step = g.copy(), 1
    while step < WIDTH:  # doubling: h(2k) = h(k) + 2^k * h(k), k bytes earlier
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    ends = (np.flatnonzero((h[WIDTH - 1 :] >> np.uint64(33)) & np.uint64(mask) == 0) + WIDTH).tolist()
    out, at = [], 0
    for end in [*ends, n]:
        while end - at > LARGEST:
            at += LARGEST
            out.append(at)
        if end > at:
            out.append(end)
            at = end
    return out


def recipes(docs: DataFrame, mask: int, digest_size: int) -> DataFrame:
    """(doc_id, text_sha256, recipe, recipe_key): one pass over the texts."""

    def kernel(batches):
        gear = _gear()
        for batch in batches:
            shas, lists, keys = [], [], []
            for text in texts_as_bytes(batch.column(1)):
                low = text.lower()
                shas.append(hashlib.sha256(low).hexdigest())
                at, own = 0, []
                for end in cuts(low, mask, gear):
                    own.append(hashlib.blake2b(low[at:end], digest_size=digest_size).digest())
                    at = end
                lists.append(own)
                keys.append(int.from_bytes(hashlib.blake2b(b"".join(own), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary())), pa.array(keys, pa.int64())], ["doc_id", "text_sha256", "recipe", "recipe_key"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(kernel, "doc_id long, text_sha256 string, recipe array<binary>, recipe_key long")


def chunks(docs: DataFrame, mask: int, digest_size: int) -> DataFrame:
    """(digest, chunk): chunks of the documents, each once per Arrow batch."""

    def kernel(batches):
        gear = _gear()
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for text in texts_as_bytes(batch.column(0)):
                low, at = text.lower(), 0
                for end in cuts(low, mask, gear):
                    seen[low[at:end]] = hashlib.blake2b(low[at:end], digest_size=digest_size).digest()
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.binary()), pa.array(seen.keys(), pa.binary())], ["digest", "chunk"])

    return docs.mapInArrow(kernel, "digest binary, chunk binary")


def dedup(docs: DataFrame, mask: int = 1023, digest_size: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    made = written(recipes(docs, mask, digest_size), "recipes")
    # Counted by text before anything is joined, so a recipe of very many copies is one row.
    by_text = written(made.groupBy("recipe_key", "text_sha256").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "texts")
    twice = by_text.groupBy("recipe_key").agg(F.sum("n").alias("n")).where("n > 1").select("recipe_key")
    # One document of each repeated text is enough to name its chunks: sha256 tells the contents apart that a digest confuses.
    named = by_text.join(twice, "recipe_key", "left_semi").select("doc_id").distinct()
    texts = docs.select("doc_id", text_of().alias("text")).join(named.hint("merge"), "doc_id", "left_semi").select("text")
    dictionary = chunks(texts, mask, digest_size).groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    unsure = written(dictionary.where("low <> high").select("digest"), "unsure")
    # Recipes with an unsure digest are told apart by their texts' own digests too: the digest's number is its content.
    parts = made.select("text_sha256", "recipe").distinct().select("text_sha256", F.explode("recipe").alias("digest"))
    split = parts.join(unsure, "digest", "left_semi").select(F.col("text_sha256").alias("apart")).distinct()
    ids = made.join(split, made["text_sha256"] == split["apart"], "left").select("doc_id", "text_sha256", "recipe", "recipe_key", F.coalesce("apart", F.lit("")).alias("apart"))
    groups = ids.groupBy("recipe_key", "recipe", "apart").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A key computed after the aggregate lets Spark split a hot group's rows in the join.
    group_key = F.xxhash64("recipe_key", "apart")
    groups = groups.where("group_size > 1").select(group_key.alias("gk"), F.col("recipe").alias("r"), F.col("apart").alias("a"), "keep_id", "group_size")
    out = ids.withColumn("k", group_key).join(groups, (F.col("k") == F.col("gk")) & (F.col("recipe") == F.col("r")) & (F.col("apart") == F.col("a")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
