"""A hierarchical Pitman-Yor language model, trained and applied in blocks.

Restaurants: one for each previous word, their parents one for each class of the previous word, these share the root, whose
base is uniform over the vocabulary and one unknown word. A class is a word's last byte (folded to 33 and one for the start
of a text, which is a restaurant of its own). Customers are the training tokens. Seating, its Gibbs sampler and the draw of
discounts and strengths are in pitman_yor.py; predictive probabilities are averaged over the sweeps after burn-in.

Data flow: a task cuts its documents into parts, and each part is kept as its words and its tokens, numbers of these. A part's
distinct (word, previous word) pairs and their training counts are made of it and go, packed, through one shuffle to the
words' blocks (ranges of the word's hash); they are in no table of their own, and made again to add up scores. Words are told
apart by their bytes, previous words by class and 58 bits of their hash. A sweep is one pass over blocks, whose state is
written after it. What no later step reads is deleted: tables after their last reader, shuffle files by a collection of the
driver's garbage. A previous word's restaurant has dishes in many blocks: after each sweep the blocks send its tables
to its owner (a range of the previous word's hash), which sends the totals back to the blocks that use it; blocks and owners
are bucketed tables, so only these numbers move. The totals of classes and root and the sums that discounts and strengths are
drawn from (some 1,300 numbers) pass the driver. Blocks send the pairs' log-probabilities back, and each part adds up its
documents. The number of blocks follows the input's size; scores don't depend on it, nor on partitions or session settings.
All pairs of one word are in one block.

Defined results: null or empty text is one end token; a doc_id's remainder decides training for each row, null doc_id
counts as the text 'null'; repeated rows train and score each; where no row trains, N and V are 0 and all words are
unknown; an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import atexit
import gc
import uuid
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _forget, delete_path, dropped, shared_folder, small_batches, text_of, texts_as_bytes, written
from .pitman_yor import CLASS_SHIFT, CLASSES, DISCOUNTS, START, STRENGTHS, Block, Totals, seating_fit

#: Tokens of a part, the unit of packed exchange; bounds a task's memory.
PART = 800_000
#: Bytes of input for one block of words.
BLOCK_BYTES = 6_000_000
#: Blocks of words for one owner of previous words.
OWNED = 16
#: The end of a text as a word: no other is empty.
END = b""


def held_out(doc_id) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def restaurants(vocab: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """The restaurants of what follows each word: its class, then its hash."""
    joined = np.frombuffer(b" ".join(vocab) + b" ", np.uint8)
    last = joined[np.flatnonzero(joined == 32) - 1].astype(np.uint64)
    last[last == 32] = 33  # the empty word
    return np.where(last >= 128, np.uint64(32), last & np.uint64(31)) << np.uint64(CLASS_SHIFT) | hashes >> np.uint64(64 - CLASS_SHIFT)


BEGIN = (CLASSES - 1) << CLASS_SHIFT


def _dealt(codes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of restaurants by owner, and the start of each owner's, and the end."""
    mine = (codes & np.uint64((1 << CLASS_SHIFT) - 1)) >> np.uint64(CLASS_SHIFT - 32)
    owner = (mine.astype(np.int64) * owners) >> 32
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(owners + 1))


def _zipped(x: bytes) -> bytes:
    """Packed by zstd below the length, which comes first."""
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(x, asbytes=True)


def _unzipped(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def _narrow(x: np.ndarray) -> bytes:
    """Integers in as few bytes as they need, zipped; the first byte says how many."""
    top = int(np.abs(x).max(initial=0))
    kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k - 1))
    return _zipped(bytes([kind]) + x.astype(f"<i{kind}").tobytes())


def _wide(x: bytes) -> np.ndarray:
    x = _unzipped(x)
    return np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 as all their lowest bytes, then all the next, as many as they need; the first byte says how many."""
    width = next(k for k in (1, 2, 3, 4) if int(x.max(initial=0)) < 1 << 8 * k)
    return bytes([width]) + x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : x[0]] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


def freed(spark) -> None:
    """Shuffle files that nothing refers to any more go when the driver's garbage is collected, which may else take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, name: str, buckets: int, key: str, *partition_by: str) -> DataFrame:
    """Written once like written(), in buckets of key, so that what is grouped by key later doesn't move."""
    spark = df.sparkSession
    path, table = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}", f"lm_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", path)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    atexit.register(_forget, spark, path)
    out = spark.table(table)
    out.written_path, out.table_name = path, table
    return out


def gone(table: DataFrame) -> None:
    """Deletes a table of bucketed() whose last reader has run."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")
    dropped(table)


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Start of each run of given lengths, and the end."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))


#: Words (joined) and tokens (numbers of words), and by document its doc_id, whether it is held out, and its tokens.
PARTS = "part long, vocab binary, tokens binary, lengths binary, doc_id array<long>, held array<boolean>"
#: What a part sends to a block of the block's words: the words, and by word how many pairs it has; by pair its context's
#: restaurant and its training count.
PACKED = "slot int, part long, data binary, own binary, context binary, counts binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def numbering() -> defaultdict:
    """A number for each word asked for, in the order of asking."""
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def tokenised(docs: DataFrame, part_tokens: int) -> DataFrame:
    types = [pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def kernel(batches):
        task, parts = TaskContext.get().partitionId(), count()

        def flush():
            row = task << 24 | next(parts), _zipped(b" ".join(numbers)), _zipped(_planes(np.concatenate(lists))), _narrow(np.array([len(x) for x in lists])), ids, held
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], _names(PARTS))

        ids, lists, held, numbers, n = [], [], [], numbering(), 0
        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                words = text.lower().split()
                words.append(END)
                lists.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                held.append(held_out(doc))
                n += len(words)
                if n >= part_tokens:
                    yield flush()
                    ids, lists, held, numbers, n = [], [], [], numbering(), 0
        if ids:
            yield flush()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(kernel, PARTS)


class Part:
    """The pairs of a part, by the word's hash and the context's restaurant, and the number of each token's pair."""

    def __init__(self, row: dict):
        self.vocab, self.lengths = _unzipped(row["vocab"]).split(b" "), _wide(row["lengths"])
        tokens, at = _unplaned(_unzipped(row["tokens"])), _starts(self.lengths)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab), np.uint64, len(self.vocab))
        self.by_hash = np.argsort(self.hashes, kind="stable")
        rank = np.empty(len(self.vocab), np.int64)
        rank[self.by_hash] = np.arange(len(self.vocab))
        rooms, follow = np.unique(np.append(restaurants(self.vocab, self.hashes), np.uint64(BEGIN)), return_inverse=True)
        code = rank[tokens] * len(rooms)
        begin = code[at[:-1]] + follow[-1]
        code[1:] += follow[tokens[:-1]]
        code[at[:-1]] = begin
        pairs, self.number = np.unique(code, return_inverse=True)
        self.word, self.context = pairs // len(rooms), rooms[pairs % len(rooms)]

    def packed(self, part: int, held: list[bool], blocks: int):
        """One row for each block. A block is a range of hashes, so its pairs are a stretch of the part's."""
        train = np.repeat(~np.array(held, bool), self.lengths)
        counts = np.bincount(self.number[train], minlength=len(self.word))
        own = np.bincount(self.word, minlength=len(self.vocab))
        slot = (self.hashes[self.by_hash] >> np.uint64(32)).astype(np.int64) * blocks >> 32
        bounds, first = np.searchsorted(slot, np.arange(blocks + 1)), _starts(own)
        for b in np.unique(slot):
            w, p = slice(bounds[b], bounds[b + 1]), slice(first[bounds[b]], first[bounds[b + 1]])
            words = b" ".join([self.vocab[i] for i in self.by_hash[w].tolist()])
            yield int(b), part, _zipped(words), _narrow(own[w]), _zipped(self.context[p].tobytes()), _narrow(counts[p])


def packed(parts: DataFrame, blocks: int) -> DataFrame:
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(PACKED))

    def kernel(batches):
        for row in _rows(batches):
            rows, size = [], 0
            for x in Part(row).packed(row["part"], row["held"], blocks):
                rows.append(x)
                size += sum(map(len, x[2:]))
                if size > 1 << 22:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return parts.select("part", "vocab", "tokens", "lengths", "held").mapInArrow(kernel, PACKED)


#: A block's row (kind 0, part null): hashes of its words, contexts a word, codes of its contexts' restaurants, and by pair the
#: context's number among these and the count. An index row (kind 1): which of the block's pairs a part holds (differences of their
#: numbers) and the part's own contexts a word.
GATHERED = "kind int, slot int, part long, hashes binary, own binary, codes binary, context binary, counts binary, index binary"


def gathered(packed: DataFrame, blocks: int) -> DataFrame:
    """The blocks, each with an index row for every part that has words in it."""

    def kernel(key, table):
        parts = table.column("part").to_pylist()
        lists = [_unzipped(x).split(b" ") for x in table.column("data").to_pylist()]
        own_raw = table.column("own").to_pylist()
        own = [_wide(x) for x in own_raw]
        context = [np.frombuffer(_unzipped(x), np.uint64) for x in table.column("context").to_pylist()]
        counts = np.concatenate([_wide(x) for x in table.column("counts").to_pylist()])
        numbers = numbering()
        word = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in lists]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = [len(c) for c in context]
        codes, local = np.unique(np.concatenate(context), return_inverse=True)
        local += np.repeat(rank[np.concatenate(word)], np.concatenate(own)) * len(codes)
        pairs, number = np.unique(local, return_inverse=True)
        total = np.bincount(number, weights=counts, minlength=len(pairs)).astype(np.int64)
        index = [_narrow(np.diff(x, prepend=0)) for x in np.split(number, np.cumsum(lengths)[:-1])]
        of_word = np.bincount(pairs // len(codes), minlength=len(order))
        n, slot = len(parts), key[0].as_py()
        nulls = [None] * n
        columns = [
            [0, *[1] * n], [slot] * (n + 1), [None, *parts], [hashes[order].tobytes(), *nulls], [_narrow(of_word), *own_raw],
            [codes.tobytes(), *nulls], [_narrow(pairs % len(codes)), *nulls], [_narrow(total), *nulls], [None, *index],
        ]
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(GATHERED))

    return packed.repartition(blocks, "slot").groupBy("slot").applyInArrow(kernel, GATHERED)


#: What doesn't change of a block in a sweep.
FIXED = ["slot", "hashes", "own", "codes", "context", "counts"]
#: A block's seating after a sweep, its restaurants' customers in the whole corpus (null before the first), the sum of
#: predictive probabilities so far, its own tables of each context's restaurant in the order of _dealt with the owners'
#: bounds, and its share of the totals.
STATE = "slot int, customers binary, tables2 binary, tables1 binary, tables0 binary, mean binary, sums binary, bounds binary, totals binary"


def _block(row: dict) -> Block:
    tables = None if row.get("tables2") is None else [_wide(row[c]) for c in ("tables2", "tables1", "tables0")]
    return Block(np.frombuffer(row["hashes"], np.uint64), _wide(row["own"]), _wide(row["context"]), _wide(row["counts"]), tables, np.frombuffer(row["codes"], np.uint64))


def _state(row: dict, block: Block, customers: bytes | None, mean: bytes | None, dealt: tuple[np.ndarray, np.ndarray], fitted: bool) -> list[pa.Array]:
    sums = np.bincount(block.context, weights=block.t2, minlength=len(block.codes)).astype(np.int64)
    values = [row["slot"], customers, *map(_narrow, (block.t2, block.t1, block.t0)), mean, _narrow(sums[dealt[0]]), _narrow(dealt[1]), block.totals(fitted).packed().tobytes()]
    return [pa.array([x], t) for x, t in zip(values, [pa.int32(), *[pa.binary()] * 8], strict=True)]


def _rows(batches):
    for batch in small_batches(batches, 1):
        yield from batch.to_pylist()


def seated_once(blocks: DataFrame, owners: int) -> DataFrame:
    """States in which every dish of a restaurant has one table."""

    def kernel(batches):
        for row in _rows(batches):
            block = _block(row)
            yield pa.RecordBatch.from_arrays(_state(row, block, None, None, _dealt(block.codes, owners), False), _names(STATE))

    return blocks.select(*FIXED).mapInArrow(kernel, STATE)


def _told(state: pa.Table, reply: pa.Table, owners: int, totals: np.ndarray):
    """A block's row, the block, its order of restaurants by owner, their customers, and the totals as it needs them."""
    row = state.to_pylist()[0]
    block = _block(row)
    dealt = _dealt(block.codes, owners)
    by_owner = sorted(reply.to_pylist(), key=lambda r: r["owner"])

    def told(column: str) -> np.ndarray:
        out = np.empty(len(block.codes), np.int64)
        out[dealt[0]] = np.concatenate([_wide(r[column]) for r in by_owner])
        return out

    customers = _wide(row["customers"]) if row["customers"] is not None else told("customers")
    return row, block, dealt, customers, Totals.unpacked(totals).local(customers.astype(float), told("tables").astype(float))


def _added_up(row: dict, block: Block, g: Totals, hyper) -> np.ndarray:
    p = block.predictive(g, hyper)
    return (p if row["mean"] is None else np.frombuffer(row["mean"], np.float32) + p).astype(np.float32)


def _seen(blocks: DataFrame, states: DataFrame, rooms: DataFrame):
    rows = blocks.select(*FIXED).join(states.drop("sums", "bounds", "totals").hint("merge"), "slot")
    return rows.groupBy("slot").cogroup(rooms.where("slot IS NOT NULL").select("slot", "owner", "customers", "tables").groupBy("slot"))


def swept(blocks: DataFrame, states: DataFrame, rooms: DataFrame, totals: np.ndarray, hyper, number: int, keep: bool, owners: int) -> DataFrame:
    """States after sweep `number` (0: the start in expectation), and with `keep` the predictive probabilities before it added.
    rooms: the restaurants' totals from their owners."""

    def kernel(key, state, reply):
        if not state.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 8)], names=_names(STATE))
        row, block, dealt, customers, g = _told(state, reply, owners, totals)
        mean = _added_up(row, block, g, hyper).tobytes() if keep else row["mean"]
        block.sweep(g, hyper, number) if number else block.start(g, hyper)
        return pa.table(_state(row, block, row["customers"] or _narrow(customers), mean, dealt, number > 0), names=_names(STATE))

    return _seen(blocks, states, rooms).applyInArrow(kernel, STATE)


#: By word its pairs and its training count, and by pair its averaged log10 probability (float32).
LAST = "slot int, own binary, known binary, logp binary"


def averaged(blocks: DataFrame, states: DataFrame, rooms: DataFrame, totals: np.ndarray, hyper, kept: int, owners: int) -> DataFrame:
    """The last sweep: its predictive probabilities are added; nothing reads the seating that it would draw."""

    def kernel(key, state, reply):
        if not state.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 3)], names=_names(LAST))
        row, block, _, _, g = _told(state, reply, owners, totals)
        logp = np.log10(np.maximum(_added_up(row, block, g, hyper) / np.float32(kept), np.float32(1e-37))).astype(np.float32)
        values = row["slot"], row["own"], _narrow(block.known), logp.tobytes()
        return pa.table([pa.array([x], t) for x, t in zip(values, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=_names(LAST))

    return _seen(blocks, states, rooms).applyInArrow(kernel, LAST)


#: An owner's restaurants in one block (differences of their numbers), and with slot null the customers of all of them.
OWNER = "owner int, slot int, index binary, customers binary"


def owned(blocks: DataFrame, owners: int) -> DataFrame:
    def sent(batches):
        for row in _rows(batches):
            codes = np.frombuffer(row["codes"], np.uint64)
            customers = np.bincount(_wide(row["context"]), weights=_wide(row["counts"]), minlength=len(codes)).astype(np.int64)
            order, at = _dealt(codes, owners)
            held = [(o, order[at[o] : at[o + 1]]) for o in range(owners) if at[o] < at[o + 1]]
            columns = [[o for o, _ in held], [row["slot"]] * len(held), [codes[x].tobytes() for _, x in held], [_narrow(customers[x]) for _, x in held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["owner", "slot", "codes", "customers"])

    def kernel(key, table):
        codes = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
        all_codes, number = np.unique(np.concatenate(codes), return_inverse=True)
        customers = np.bincount(number, weights=np.concatenate([_wide(x) for x in table.column("customers").to_pylist()]), minlength=len(all_codes)).astype(np.int64)
        index = [_narrow(np.diff(x, prepend=0)) for x in np.split(number, np.cumsum([len(c) for c in codes])[:-1])]
        columns = [[key[0].as_py()] * (len(codes) + 1), [None, *table.column("slot").to_pylist()], [None, *index], [_narrow(customers), *[None] * len(codes)]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=_names(OWNER))

    rows = blocks.select("slot", "codes", "context", "counts").mapInArrow(sent, "owner int, slot int, codes binary, customers binary")
    return rows.repartition(owners, "owner").groupBy("owner").applyInArrow(kernel, OWNER)


#: What an owner tells a block of the block's restaurants, in the order of _dealt; with slot null its seating_fit.
ROOMS = "slot int, owner int, customers binary, tables binary, fit binary"


def restaurant_totals(states: DataFrame, held: DataFrame, owners: int, first: bool) -> DataFrame:
    """Tables, and at `first` customers, of each restaurant over all blocks, for every block that uses it."""

    def sent(batches):
        for row in _rows(batches):
            sums, at = _wide(row["sums"]), _wide(row["bounds"])
            own = [o for o in range(owners) if at[o] < at[o + 1]]
            columns = [own, [row["slot"]] * len(own), [_narrow(sums[at[o] : at[o + 1]]) for o in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["owner", "slot", "sums"])

    def kernel(key, mine, sums):
        by_slot = dict(zip(sums.column("slot").to_pylist(), sums.column("sums").to_pylist(), strict=True))
        customers, slots, index = None, [], []
        for slot, raw, c in zip(*(mine.column(x).to_pylist() for x in ("slot", "index", "customers")), strict=True):
            if slot is None:
                customers = _wide(c)
            else:
                slots.append(slot)
                index.append(raw)
        if customers is None:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 3)], names=_names(ROOMS))
        tables = np.zeros(len(customers), np.int64)
        for slot, raw in zip(slots, index, strict=True):
            tables[np.cumsum(_wide(raw))] += _wide(by_slot[slot])  # a block names a restaurant once
        told = [np.cumsum(_wide(raw)) for raw in index]
        n = len(slots)
        columns = [
            [*slots, None], [key[0].as_py()] * (n + 1), [*([_narrow(customers[x]) for x in told] if first else [None] * n), None],
            [*[_narrow(tables[x]) for x in told], None], [*[None] * n, seating_fit(customers, tables).tobytes()],
        ]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=_names(ROOMS))

    rows = states.select("slot", "sums", "bounds").mapInArrow(sent, "owner int, slot int, sums binary")
    return held.groupBy("owner").cogroup(rows.groupBy("owner")).applyInArrow(kernel, ROOMS)


def summed_fit(rooms: DataFrame) -> np.ndarray:
    """Over all restaurants of previous words; a row an owner."""
    shape = len(DISCOUNTS), len(STRENGTHS)
    return sum((np.frombuffer(r["fit"], np.float64).reshape(shape) for r in rooms.where("slot IS NULL").select("fit").collect()), np.zeros(shape))


def summed_totals(states: DataFrame) -> np.ndarray:
    """The restaurants' totals over all blocks: summed in up to 64 groups, whose sums the driver adds."""

    def kernel(key, table):
        total = np.sum([np.frombuffer(x.as_py(), np.float64) for x in table.column("totals")], axis=0)
        return pa.table({"totals": pa.array([total.tobytes()], pa.binary())})

    rows = states.select((F.col("slot") % 64).alias("group"), "totals").groupBy("group").applyInArrow(kernel, "totals binary").collect()
    return np.sum([np.frombuffer(r["totals"], np.float64) for r in rows], axis=0) if rows else np.zeros(Totals.LENGTH)


REPLY = "part long, slot int, own binary, logp binary, known binary"


def replies(last: DataFrame, index: DataFrame) -> DataFrame:
    """For each part its pairs' averaged log10 probabilities (float32) and its words' training counts."""

    def kernel(key, state, index):
        if not state.num_rows or not index.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), *[pa.binary()] * 3)], names=_names(REPLY))
        row = state.to_pylist()[0]
        own, known, logp = _wide(row["own"]), _wide(row["known"]), np.frombuffer(row["logp"], np.float32)
        word = np.repeat(np.arange(len(own)), own)
        parts, owns = index.column("part"), index.column("mine").to_pylist()
        out_logp, out_known = [], []
        for raw, mine in zip(index.column("index").to_pylist(), owns, strict=True):
            at = np.cumsum(_wide(raw))
            out_logp.append(logp[at].tobytes())
            out_known.append(_narrow(known[word[at[_starts(_wide(mine))[:-1]]]]))
        slots = pa.array([row["slot"]] * len(owns), pa.int32())
        return pa.table([parts, slots, pa.array(owns, pa.binary()), pa.array(out_logp, pa.binary()), pa.array(out_known, pa.binary())], names=_names(REPLY))

    return last.groupBy("slot").cogroup(index.groupBy("block")).applyInArrow(kernel, REPLY)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _added(parts: DataFrame, answer: DataFrame, n_train: int, n_types: int) -> DataFrame:
    def kernel(key, part, reply):
        order = np.argsort(reply.column("slot").to_numpy())
        own, logp, known = (reply.column(c).to_pylist() for c in ("own", "logp", "known"))
        logp = np.concatenate([np.frombuffer(logp[i], np.float32) for i in order])
        known = np.concatenate([np.repeat(_wide(known[i]), _wide(own[i])) for i in order])
        row = part.to_pylist()[0]
        pairs = Part(row)
        number, at = pairs.number, _starts(pairs.lengths)
        base, seen, logp = np.log10((known + 0.1) / (n_train + 0.1 * (n_types + 1)))[number], (known > 0)[number], logp[number]
        columns = [[] for _ in range(7)]
        for doc, held, a, b in zip(row["doc_id"], row["held"], at[:-1], at[1:], strict=True):
            for c, x in zip(columns, (doc, held, b - a, int(seen[a:b].sum()), n_train, float(base[a:b].sum()), float(logp[a:b].sum(dtype=np.float64))), strict=True):
                c.append(x)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(SCORES))

    return parts.groupBy("part").cogroup(answer.groupBy("part")).applyInArrow(kernel, SCORES)


def blocks_for(docs: DataFrame) -> int:
    """From the input's size, by Spark's estimate, or by a scan where it has none; nothing depends on it but how much a
    task holds."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    return 1 + min(1 << 20, size // BLOCK_BYTES)


def model_scores(docs: DataFrame, blocks: int | None = None, sweeps: int = 6, burn_in: int = 3, part_tokens: int = PART, seed: int = 0) -> DataFrame:
    """Scores of every row of docs (doc_id, text) under the model trained on the rows that are not held out."""
    spark, blocks = docs.sparkSession, blocks or blocks_for(docs)
    parts = written(tokenised(docs, part_tokens), "parts")
    table = bucketed(gathered(packed(parts, blocks), blocks), "blocks", blocks, "slot", "kind")
    freed(spark)
    owners = 1 + blocks // OWNED
    fixed = table.where("kind = 0")
    states = bucketed(seated_once(fixed, owners), "states", blocks, "slot")
    held = bucketed(owned(fixed, owners), "owners", owners, "owner")
    totals, hyper = summed_totals(states), START
    for number in range(sweeps + 1):
        rooms = written(restaurant_totals(states, held, owners, not number), "rooms", codec="zstd")
        if number > 1:
            hyper = Totals.unpacked(totals).hyper(seed + number - 1, summed_fit(rooms))
        if number == sweeps:
            new = bucketed(averaged(fixed, states, rooms, totals, hyper, max(1, sweeps - burn_in), owners), "last", blocks, "slot")
        else:
            new = bucketed(swept(fixed, states, rooms, totals, hyper, number, number > burn_in, owners), "states", blocks, "slot")
            totals = summed_totals(new)
        gone(states)
        dropped(rooms)
        states = new
        freed(spark)
    gone(held)
    delete_path(spark, f"{table.written_path}/kind=0")
    index = table.where("kind = 1").selectExpr("slot AS block", "part", "own AS mine", "index")
    total = Totals.unpacked(totals)
    return _added(parts, replies(states, index), int(total.c[2].sum()), int(total.types))


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity): 10 to the minus mean log10 probability of a token."""
    sums = scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.sum("score").alias("s"))
    return sums.select("held_out", "tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("tokens")).alias("perplexity"))
