"""Token-id files: concatenated id arrays with Elias-Fano document boundaries.

Documents are range-sorted by id; a range is a shard, a shard is a run of blocks, and a block is one row of the file:
the ids of its documents end to end, and two Elias-Fano lists, of the documents' ends and of their ids. A reader gets a
document's offsets by select on those lists, which take about two bits and log2(mean length) a document; no table of
64-bit offsets is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from hearthmark.llm.bpe import gather, numbered, text_blocks
from hearthmark.llm.common import new_path, partitions

END, BLOCK_BYTES, SELECT_EVERY = 0, 8_000_000, 64
KEPT = 500_000  # pre-tokens whose ids a worker keeps before it starts anew


class EliasFano:
    """A non-decreasing list of integers from 0: low bits packed, high parts in unary, and a select sample."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, sample: bytes):
        self.n, self.bits, self.low, self.high, self.sample = n, bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        at = (values >> bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SELECT_EVERY].astype("<u4").tobytes())

    def select(self, first: int, stop: int) -> np.ndarray:
        """The values of places first to stop - 1: of both parts only the bytes between their select samples are read."""
        if first >= stop:
            return np.zeros(0, np.int64)
        sample = np.frombuffer(self.sample, "<u4")
        own, last = first // SELECT_EVERY, (stop - 1) // SELECT_EVERY + 1
        start = int(sample[own])
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[start // 8 : int(sample[last]) // 8 + 1 if last < len(sample) else None], bitorder="little")
        bits[: start % 8] = 0
        skip = first - own * SELECT_EVERY
        at = 8 * (start // 8) + np.flatnonzero(bits)[skip : skip + stop - first]
        begin = first * self.bits
        low = np.unpackbits(np.frombuffer(self.low, np.uint8)[begin // 8 : (stop * self.bits + 7) // 8], bitorder="little")
        low = low[begin % 8 : begin % 8 + (stop - first) * self.bits].reshape(stop - first, self.bits).astype(np.int64)
        return ((at - np.arange(first, stop)) << self.bits) + (low << np.arange(self.bits)).sum(axis=1)


LIST = "struct<n: int, bits: int, low: binary, high: binary, sample: binary>"
FILE = f"shard int, block int, start long, total long, width int, ids binary, no_id int, first long, ends {LIST}, keys {LIST}"
_LIST = pa.struct([("n", pa.int32()), ("bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("sample", pa.binary())])
FIELDS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("total", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("no_id", pa.int32()), ("first", pa.int64()), ("ends", _LIST), ("keys", _LIST)])


class TextIds:
    """Ids of texts as the tokenizers library gives them: distinct pre-tokens of a block meet the library's model, and what
    it says of a pre-token, which does not depend on its neighbours, is kept.

    Texts that hold an added token's string go through the library whole, as does every text if the file normalizes text,
    or splits it in another way than at a byte-level pattern.
    """

    def __init__(self, file: str):
        self.library, how = Tokenizer.from_str(file), json.loads(file)
        kind = how.get("pre_tokenizer") or {}
        self.plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not how.get("normalizer")
        self.added = [t["content"] for t in how.get("added_tokens", [])]
        self.kind = "<u2" if self.library.get_vocab_size() <= 0x10000 else "<u4"
        self.known: dict[str, bytes] = {}
        # fixed values: a byte-level vocabulary writes a byte as its Latin-1 character where that is printable, the others as U+0100 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip([*seen, *(b for b in range(256) if b not in seen)], [*seen, *range(256, 324)], strict=True))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        known, tokenize, out = self.known, self.library.model.tokenize, []
        if len(known) > KEPT:
            known.clear()
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = np.array([t.id for t in tokenize(w.encode().decode("latin-1").translate(self.letters))], self.kind).tobytes()
            out.append(ids)
        return out

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, the end id after each, and the place after each end id."""
        special = np.full(len(texts), not self.plain)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(special)
        words, order, counts = numbered(pc.if_else(pa.array(special), "", texts) if len(apart) else texts)
        found = [*self.words(words.to_pylist()), *(self.whole(texts[i].as_py()) for i in apart.tolist()), np.array([end], self.kind).tobytes()]
        # a text apart has no words of its own: what the library gave stands in their place, before its end id
        rows = np.concatenate([apart, np.arange(len(texts))])
        more = np.concatenate([len(words) + np.arange(len(apart)), np.full(len(texts), len(found) - 1)])
        by = np.argsort(rows, kind="stable")
        order = np.insert(order, np.cumsum(counts)[rows[by]], more[by])
        counts[apart] += 1
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        return gather(np.frombuffer(b"".join(found), self.kind), lengths, order), np.cumsum(lengths[order])[np.cumsum(counts + 1) - 1]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, block_bytes: int = BLOCK_BYTES) -> None:
    """Encodes every whole text, ends each document with the end id, and writes the file in ascending id order.

    Documents without an id come first; those of equal id follow each other in order of their text's hash, so that a
    range may begin among them. A null text counts as empty and holds the end id alone. A block holds whole documents of
    about block_bytes bytes; one longer document makes a block of its own.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # the file of a fixed vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextIds(model.value)
        shard, start = TaskContext.get().partitionId(), 0
        for block, (keys, texts) in enumerate(text_blocks(batches, block_bytes)):
            ids, ends = encoder(texts, end)
            own = keys.drop_null().to_numpy()
            lists = [vars(EliasFano.of(v)) for v in (ends, own - own[0] if len(own) else own)]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "start": start, "total": len(ids), "width": ids.itemsize, "ids": ids.tobytes(), "no_id": keys.null_count, "first": int(own[0]) if len(own) else 0, "ends": lists[0], "keys": lists[1]}], FIELDS)
            start += len(ids)
            pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("hash").asc()]
    ordered = slim.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "text")
    ordered.mapInArrow(blocks, FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, *, id_col: str = "doc_id", step: int = 2048) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a file; ids are little-endian unsigned 32-bit integers.

    Offsets and ids of documents are selected step documents at a time.
    """
    files = spark.read.parquet(path)
    totals = sorted(files.groupBy("shard").agg(F.sum("total").alias("n")).collect(), key=lambda r: r["shard"])  # one row a shard
    bases = dict(zip([r["shard"] for r in totals], np.cumsum([0] + [r["n"] for r in totals[:-1]]).tolist(), strict=True)) if totals else {}

    def docs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ends, keys = EliasFano(**r.ends), EliasFano(**r.keys)
                raw, at = np.frombuffer(r.ids, f"<u{r.width}"), 0
                for i in range(0, ends.n, step):
                    stop = min(i + step, ends.n)
                    b = ends.select(i, stop)
                    a = np.concatenate([[at], b[:-1]])
                    own = keys.select(max(0, i - r.no_id), max(0, stop - r.no_id)) + r.first
                    part = raw[at : int(b[-1])].astype("<u4").tobytes()
                    cuts = zip((4 * (a - at)).tolist(), (4 * (b - at)).tolist(), strict=True)
                    yield pd.DataFrame({id_col: pd.array([None] * (stop - i - len(own)) + own.tolist(), "Int64"), "start": a + (bases[r.shard] + r.start), "n_tokens": b - a, "ids": [part[x:y] for x, y in cuts]})
                    at = int(b[-1])

    return files.select("shard", "start", "width", "ids", "no_id", "first", "ends", "keys").mapInPandas(docs, f"{id_col} long, start long, n_tokens long, ids binary")


def op5_token_ids(spark, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the file; null texts hold the end id alone."""
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
