"""Token files: canonical, length-limited Huffman codes of token ids, decoded from tables in independent blocks.

``encoded_ids`` encodes every text once, ``count_ids`` gathers the counts of all ids of the corpus, ``codebook`` turns
them into a canonical code whose longest word has ``limit`` bits, ``write_ids`` writes the ids of all documents in
ascending ``doc_id`` order and ``read_ids`` decodes them.

File format.  A folder with the Parquet tables ``codes`` (id, n_bits: all that a canonical code needs), ``shards``
(shard, n_docs, n_ids, first: ids in all earlier shards) and ``blocks``.  A row of ``blocks`` is one independent block
of whole documents: shard, before (ids of the shard's earlier blocks), doc_ids, n_ids (of each document), bits (big-endian bit stream) and checkpoints: the
bit offset of every ``LANE``-th id.  A reader starts at any checkpoint; the decoder runs all lanes of a block side by
side.  Blocks hold about ``BLOCK_IDS`` ids; only a document that is longer by itself makes a longer block.

Edge cases.  A null text is an empty one: it has the end id alone.  A null doc_id sorts first; rows with the same
doc_id keep all their copies, in the order of their lengths and CRCs.  An empty table gives an empty folder of blocks.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .bytescan import LOWER, Texts, same_spans

LANE = 256
BLOCK_IDS = 1 << 16
#: Bytes of the distinct words whose ids a worker keeps; when as many are held, it starts anew.
KNOWN_BYTES = 8 << 20
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
END_ID = 1
#: Words that are encoded in one text.
JOINED = 2048


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII punctuation but the apostrophe, which begins contractions.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


class WordEncoder:
    """Encodes whole texts by their words, each distinct word once.

    The tokenizer's pre-tokenizer must never join text across ASCII white space, as that of ``word_bpe_49k.json``,
    which drops white space; then the ids of a text are those of its words in a row.  Where the tokenizer also lowers
    case and takes letters apart from other characters, so do the words here: marks that end a word after a letter are
    a word of their own.  That is left out for slices in which the string of a special token occurs.

    Words are looked up by a hash, but ids are used only where the very bytes agree: if two words of a slice, or one
    of it and a known one, share a hash, the texts of the slice go through the tokenizer as they are.
    """

    def __init__(self, spec: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads would hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        rules = json.loads(spec)
        self.special = [t["content"].encode() for t in rules.get("added_tokens", [])]
        self.apart = '"Lowercase"' in json.dumps(rules.get("normalizer")) and "[\\\\p{L}]+|" in json.dumps(rules.get("pre_tokenizer"))
        # Tokens that end a word, where the model marks them: words of letters alone can then be encoded in one text.
        suffix = rules["model"].get("end_of_word_suffix") if self.apart else None
        self.closing = None
        if suffix:
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.bytes, self.starts, self.ends = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        begin, size, flat = self.encoded([w.decode() for w in words])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.slot = np.insert(self.known, at, hashes[order]), np.insert(self.slot, at, len(self.size) + order)
        self.begin = np.concatenate([self.begin, len(self.ids) + begin])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, flat])
        ends = len(self.bytes) + np.cumsum([len(w) for w in words])
        self.starts = np.concatenate([self.starts, [len(self.bytes)], ends[:-1]]) if len(words) else self.starts
        self.ends, self.bytes = np.concatenate([self.ends, ends]), np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin, how many they are, and the ids.

        Words of small letters are one pre-token each, so that the ids of many in one text are told apart by the ids
        that end a word; if these are not as many as the words, and for all other words, each is encoded by itself.
        """
        size = np.zeros(len(words), np.int64)
        order: list[int] = []
        flats: list[np.ndarray] = []
        alone: list[int] = list(range(len(words)))
        if self.closing is not None:
            letters = [i for i, w in enumerate(words) if w.isalpha() and w.islower()]
            left = set(alone).difference(letters)
            for k in range(0, len(letters), JOINED):
                part = letters[k : k + JOINED]
                flat = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.closing[flat])
                if len(ends) != len(part) or ends[-1] != len(flat) - 1:
                    left.update(part)
                    continue
                size[part] = np.diff(ends, prepend=-1)
                order += part
                flats.append(flat)
            alone = sorted(left)
        got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
        size[alone] = [len(x) for x in got]
        order += alone
        flats.append(np.fromiter(chain.from_iterable(got), np.uint32, int(size[alone].sum())))
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return begin, size, np.concatenate(flats)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of words by their hashes, -1 for new ones."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.slot[at], -1)

    def words(self, texts: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as they are hashed, and the starts, ends and texts of their words."""
        scan = Texts.of(texts)
        starts, ends, docs = scan.words()
        data = scan.data
        if not self.apart or not len(starts) or any(s in data.tobytes() for s in self.special):
            return scan, starts, ends, docs
        # Marks at the end of each word: step back from its last byte to one that is no mark.
        last = ends - 1
        live = np.flatnonzero(_MARK[data[last]])
        while len(live):
            last[live] -= 1
            live = live[last[live] >= starts[live]]
            live = live[_MARK[data[last[live]]]]
        before = np.maximum(last, 0)
        letter = _LETTER[data[before]]
        latin = (data[before - 1] == 0xC3) & (data[before] != 0x97) & (data[before] != 0xB7) & (before > starts)
        cut = np.flatnonzero((last >= starts) & (last < ends - 1) & (letter | latin))
        where = cut + 1
        starts_, ends_ = np.insert(starts, where, last[cut] + 1), ends.copy()
        ends_[cut] = last[cut] + 1
        return Texts(LOWER[data], scan.offsets), starts_, np.insert(ends_, where, ends[cut]), np.insert(docs, where, docs[cut])

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
        """(number of each word's distinct word, slots of those, text of each word, number of texts); None where two words share a hash."""
        scan, starts, ends, docs = self.words(texts)
        code, distinct = pd.factorize(scan.hashes(starts, ends))
        if len(self.bytes) > KNOWN_BYTES:
            self.clear()
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        from_, to = starts[first], ends[first]
        place = self.find(distinct)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        if not same_spans(scan.data, starts, ends, scan.data, from_[code], to[code]) or not same_spans(scan.data, from_[old], to[old], self.bytes, self.starts[place[old]], self.ends[place[old]]):
            return None
        if len(new):
            raw = scan.data.tobytes()
            self.learn(distinct[new], [raw[a:b] for a, b in zip(from_[new].tolist(), to[new].tolist(), strict=True)])
            place[new] = np.arange(len(self.size) - len(new), len(self.size))
        return code, place, docs, len(scan)

    def plain(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """What ``encode`` returns, without words."""
        end = [] if end_id is None else [end_id]
        got = [e.ids + end for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts in a row, and the number of ids of each text (with ``end_id`` at its end)."""
        found = self.look_up(texts)
        if found is None:
            return self.plain(texts, end_id)
        code, place, docs, n = found
        begin, size = self.begin[place], self.size[place]
        ids = self.ids
        if end_id is not None:  # one more word, at the end of each text
            ids = np.append(ids, np.uint32(end_id))
            begin, size = np.append(begin, len(ids) - 1), np.append(size, 1)
            code = np.insert(code, np.searchsorted(docs, np.arange(n), "right"), len(size) - 1)
            docs = np.insert(docs, np.searchsorted(docs, np.arange(n), "right"), np.arange(n))
        sizes = size[code]
        n_ids = np.bincount(docs, weights=sizes, minlength=n).astype(np.int64)
        total = int(n_ids.sum())
        from_ = begin[code] - np.cumsum(sizes) + sizes
        return ids[np.repeat(from_, sizes) + np.arange(total)], n_ids

    def counts(self, texts: pa.Array, end_id: int | None = END_ID) -> np.ndarray:
        """How often each id occurs, from the counts of the distinct words."""
        found = self.look_up(texts)
        if found is None:
            return np.bincount(self.plain(texts, end_id)[0], minlength=(end_id or 0) + 1).astype(np.int64)
        code, place, _, n = found
        times, size = np.bincount(code, minlength=len(place)), self.size[place]
        from_ = self.begin[place] - np.cumsum(size) + size
        ids = self.ids[np.repeat(from_, size) + np.arange(int(size.sum()))]
        out = np.bincount(ids, weights=np.repeat(times, size), minlength=(end_id or 0) + 1).astype(np.int64)
        if end_id is not None:
            out[end_id] += n
        return out


def encoder(spec: str) -> WordEncoder:
    """One encoder in each worker process."""
    return store.held_once(("encoder", spec), lambda: WordEncoder(spec))


IDS_SCHEMA = "shard int, before long, doc_ids array<long>, n_ids array<long>, ids binary"


def _packed(ids: np.ndarray) -> bytes:
    """Little-endian ids of two bytes, or of four where one needs more than two."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def encoded_ids(ordered: DataFrame, spec, end_id: int = END_ID) -> DataFrame:
    """The ids of ``ordered`` (doc_id, text), whose partitions are the shards: a row for each group of whole documents."""

    def run(batches):
        from pyspark import TaskContext

        shard, before, enc = TaskContext.get().partitionId(), 0, encoder(spec.value)
        held: tuple[list, list, list] = ([], [], [])
        held_ids = 0

        def row(docs: list, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            made = [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([_packed(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(made, ["shard", "before", "doc_ids", "n_ids", "ids"])

        for batch in batches:
            texts, keys = store.filled(batch.column(1)), batch.column(0).to_pylist()
            for a, b in store.text_slices(texts, SLICE):
                ids, n_ids = enc.encode(texts.slice(a, b - a), end_id)
                parts = np.split(ids, np.cumsum(n_ids)[:-1])
                held[0].extend(keys[a:b]), held[1].extend(n_ids.tolist()), held[2].extend(parts)
                held_ids += len(ids)
                if held_ids < 4 * BLOCK_IDS:
                    continue
                *full, rest = _blocks(*held)
                for x in full:
                    yield row(*x)
                    before += len(x[2])
                held = (list(rest[0]), rest[1].tolist(), np.split(rest[2], np.cumsum(rest[1])[:-1]))
                held_ids = len(rest[2])
        for x in _blocks(*held):
            yield row(*x)
            before += len(x[2])
        store.release()

    return ordered.mapInArrow(run, IDS_SCHEMA)


def _ids_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Every row of ``IDS_SCHEMA`` with its ids."""
    for i in range(batch.num_rows):
        own = batch.slice(i, 1)
        n = int(np.asarray(own.column("n_ids")[0].values).sum())
        yield own, _unpacked(own.column("ids")[0].as_py(), n)


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all rows of ``encoded_ids``.  At most one row an id leaves each task."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, own in _ids_of(batch):
                got = np.bincount(own)
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return encoded.select("n_ids", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge: the code lengths of least total size under ``limit`` for positive ``counts``."""
    n = len(counts)
    if n <= 2:
        return np.ones(n, np.int64)
    if 1 << limit < n:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    # Each level is the sorted merge of the leaves and the pairs of the level below; only the kinds are kept.
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weight = np.concatenate([leaf, packages])
        at = np.argsort(weight, kind="stable")
        levels.append(at < n)
        weight = weight[at]
        packages = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: ids in ascending order of (n_bits, id) get ascending code words."""

    def __init__(self, ids, n_bits):
        ids, n_bits = np.asarray(ids, np.int64), np.asarray(n_bits, np.int64)
        order = np.lexsort((ids, n_bits))
        self.ids, self.n_bits = ids[order], n_bits[order]
        self.limit = int(n_bits.max()) if len(ids) else 1
        step = np.left_shift(1, self.limit - self.n_bits)
        first = np.cumsum(step) - step
        words = first >> (self.limit - self.n_bits)
        top = int(ids.max()) + 1 if len(ids) else 1
        self.word, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.word[self.ids], self.length[self.ids] = words.astype(np.uint64), self.n_bits
        self._table = None

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of the next ``limit`` bits: the id and the bits that it takes."""
        if self._table is None:
            step = np.left_shift(1, self.limit - self.n_bits)
            ids = np.repeat(self.ids, step)
            pad = (1 << self.limit) - len(ids)
            self._table = np.pad(ids, (0, pad)).astype(np.uint32), np.pad(np.repeat(self.n_bits, step), (0, pad), constant_values=1)
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream of ``ids`` and its checkpoints."""
        size = self.length[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        at = np.cumsum(size) - size
        n = int(size.sum())
        n_words = n // 32 + 2
        value = self.word[ids] << (64 - (at & 31) - size).astype(np.uint64)
        place = at >> 5
        high, low = (value >> np.uint64(32)).astype(np.float64), (value & np.uint64(0xFFFFFFFF)).astype(np.float64)
        # Codes don't overlap, so that adding is joining; sums stay below 2**32 and are exact.
        words = np.bincount(place, high, n_words + 1) + np.bincount(place + 1, low, n_words + 1)
        return words.astype(">u4").tobytes()[: (n + 7) // 8], at[::LANE].astype(np.int64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All ``n`` ids of a block; one step decodes an id in every lane."""
        ids, lengths = self.table
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        # The four bytes from each byte on, so that any 25 bits are one look-up away.
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        if self.limit > 25:
            raise ValueError("codes of more than 25 bits need wider windows")
        at = np.array(checkpoints, np.int64)
        lanes = len(at)
        out = np.empty((LANE, lanes), np.uint32)
        shift, mask = np.uint32(32 - self.limit), np.uint32((1 << self.limit) - 1)
        last = n - LANE * (lanes - 1)
        for k in range(LANE if lanes > 1 else max(last, 0)):
            if k == last:  # the last lane has ended
                at[-1] = 0
            key = (window[at >> 3] >> (shift - (at & 7).astype(np.uint32))) & mask
            out[k] = ids[key]
            at += lengths[key]
        return out.T.reshape(-1)[:n]


def codebook(counts: DataFrame, limit: int = 16) -> DataFrame:
    """(id, n_bits) of the best code of at most ``limit`` bits (more where so many ids need it).

    The counts have one row an id, so that the vocabulary bounds what the driver holds.
    """
    rows = counts.toPandas().sort_values("id")
    limit = max(limit, int(np.ceil(np.log2(max(len(rows), 2)))))
    lengths = code_lengths(rows["n"].to_numpy(), limit)
    spark = counts.sparkSession
    return spark.createDataFrame(pa.table({"id": pa.array(rows["id"].to_numpy(), pa.int64()), "n_bits": pa.array(lengths, pa.int64())}))


def _blocks(docs: list, sizes: list, ids: list) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Whole documents in groups of about BLOCK_IDS ids."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > BLOCK_IDS:
            yield docs[begin:i], np.array(sizes[begin:i], np.int64), np.concatenate(ids[begin:i])
            begin, total = i, 0
        total += n
    if begin < len(docs):
        yield docs[begin:], np.array(sizes[begin:], np.int64), np.concatenate(ids[begin:])


BLOCK_SCHEMA = "shard int, before long, doc_ids array<long>, n_ids array<long>, bits binary, checkpoints array<long>"


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, limit: int = 16, shards: int | None = None) -> None:
    """Write the ids of every whole text of ``docs`` to ``path`` in ascending order of ``doc_id``.

    Texts are encoded once.  Their ids, two bytes each, lie in the shared folder until their counts have given the code.
    The order comes from a range partitioning: its partitions are the shards.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json)  # a tokenizer's size doesn't depend on the corpus
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.length("text").asc(), F.crc32(F.col("text").cast("binary")).asc(), F.col("text").asc()]
    ordered = docs.repartitionByRange(shards, *order[:3]).sortWithinPartitions(*order)
    encoded = store.saved(encoded_ids(ordered, spec, end_id), "token-ids")
    codebook(count_ids(encoded), limit).coalesce(1).write.parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast(_read_book(spark, path))

    def run(batches):
        for batch in batches:
            for own, ids in _ids_of(batch):
                bits, checkpoints = book.value.encode(ids)
                made = [*own.columns[:4], pa.array([bits], pa.binary()), pa.array([checkpoints.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["shard", "before", "doc_ids", "n_ids", "bits", "checkpoints"])

    encoded.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    store.drop(encoded)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row a shard: the number of shards is a setting, not a size of the corpus.
    totals = blocks.groupBy("shard").agg(F.sum(F.size("doc_ids")).cast("long").alias("n_docs"), F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_ids")).orderBy("shard").toPandas()
    first = totals["n_ids"].cumsum() - totals["n_ids"]
    table = pa.table({"shard": pa.array(totals["shard"].astype("int32")), "n_docs": pa.array(totals["n_docs"].astype("int64")), "n_ids": pa.array(totals["n_ids"].astype("int64")), "first": pa.array(first.astype("int64"))})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/shards")
    spec.unpersist()


def _read_book(spark: SparkSession, path: str) -> Codebook:
    rows = spark.read.parquet(f"{path}/codes").toPandas()
    return Codebook(rows["id"].to_numpy(), rows["n_bits"].to_numpy())


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document, decoded from the files: doc_id, start, n_tokens, ids_crc32 (and ids, if asked for).

    Blocks are independent: a block knows its place in its shard, the table of shards has each shard's place.
    """
    book = spark.sparkContext.broadcast(_read_book(spark, path))
    first = dict(spark.read.parquet(f"{path}/shards").select("shard", "first").toPandas().itertuples(index=False))
    firsts = spark.sparkContext.broadcast(first)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("shard", "before", "bits")}
                keys = batch.column("doc_ids")[i].values
                sizes, checkpoints = (np.asarray(batch.column(k)[i].values) for k in ("n_ids", "checkpoints"))
                ids = book.value.decode(row["bits"].as_py(), checkpoints, int(sizes.sum()))
                start = firsts.value[row["shard"].as_py()] + row["before"].as_py() + np.cumsum(sizes) - sizes
                parts = np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])
                out = [keys, pa.array(start), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
                if with_ids:
                    out.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, READ_SCHEMA + (", ids array<long>" if with_ids else ""))
