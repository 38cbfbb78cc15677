"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens keep their positions as slots of a block's word list; each distinct word of the corpus is encoded once, its
ids go back to the blocks, and each document is put together again by position. Words and slots travel packed, so the
shuffles stay well below the size of the texts. Splitting, numbering, decoding and joining run on whole Arrow arrays.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.taskcontext import TaskContext
from tokenizers.pre_tokenizers import ByteLevel

from hearthmark.llm.common import partitions, stored

# fixed values: the general pattern, white space of Unicode, and the pattern's parts in the terms of Arrow's expressions
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
GENERAL = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUN = f"([{WHITE}]+)([{WHITE}][^{WHITE}])"
TOKEN = CONTRACTIONS + rf"| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}\x00]+|[{WHITE}]+"
APART = r"[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}\p{Co}]|\x00"  # the mark itself, and characters that Arrow's expressions do not know
LONG = 256  # bytes of a word beyond which the library's merging, quadratic in the word, gives way to a heap


def pre_tokens(texts: pa.Array, pattern: str = GENERAL) -> pa.Array:
    """The pre-tokens of texts without nulls as lists of strings, which may hold empty strings besides.

    The general pattern runs in Arrow: a mark goes between the last two characters of a run of white space before other
    text, then after every match. A text with a character that those expressions do not know is split by the library.
    """
    if pattern != GENERAL:
        split = regex.compile(pattern).findall
        return pa.array([split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    marked = pc.replace_substring_regex(pc.replace_substring_regex(texts, RUN, "\\1\0\\2"), TOKEN, "\\0\0")
    lists = pc.split_pattern(marked, "\0")
    apart = np.flatnonzero(pc.match_substring_regex(texts, APART).to_numpy(zero_copy_only=False)).tolist()
    if not apart:
        return lists
    split, parts, at = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, [], 0
    for i in apart:
        text = texts[i].as_py()
        parts += [lists.slice(at, i - at), pa.array([[text[a:b] for _, (a, b) in split(text)]], lists.type)]
        at = i + 1
    return pa.concat_arrays([*parts, lists.slice(at)])


def numbered(texts: pa.Array, pattern: str = GENERAL) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of texts, the number of the one at every position, and how many positions each text has."""
    lists = pre_tokens(texts, pattern)
    stops = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
    flat = lists.flatten().dictionary_encode()
    words, order = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    blank = words.index("").as_py()
    if blank >= 0:
        keep = order != blank
        stops = np.concatenate([[0], np.cumsum(keep)])[stops]
        order = order[keep]
        order -= order > blank
        words = pa.concat_arrays([words.slice(0, blank), words.slice(blank + 1)])
    return words, order, np.diff(stops, prepend=0)


def gather(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of flat, given by their lengths, in the order of at."""
    own = lengths[at]
    ends = np.cumsum(own, dtype=np.int64)
    shift = (np.cumsum(lengths, dtype=np.int64) - lengths)[at] - (ends - own)
    return flat[np.repeat(shift, own) + np.arange(ends[-1] if len(ends) else 0)]


def text_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null: empty) in runs of whole documents of about block_bytes; a longer document is a run of its own."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.Array, pa.Array]:
        ids = pa.concat_arrays([b.column(0) for b in held])
        return ids, pc.fill_null(pa.concat_arrays([b.column(1) for b in held]), "")

    for batch in batches:
        lengths = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)).astype(np.int64) + 1
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(int(np.searchsorted(ends, before + block_bytes - size, "right")), at if held else at + 1)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
            if stop < batch.num_rows:
                yield joined()
                held, size = [], 0
            at = stop
    if held:
        yield joined()


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of least rank joins first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            left[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (h := left[i]) >= 0 and (rank := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (rank, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def unpack_words(data: bytes, n: int) -> list[bytes]:
    raw = unpack(data)
    ends = 4 * n + np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, which compress better than whole integers."""
    return pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


BLOCKS = "block long, ids binary, nulls binary, counts binary, slots binary, shares binary, buckets array<struct<bucket: int, n: int, words: binary>>"
BLOCK_FIELDS = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "counts", "slots", "shares")), ("buckets", pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])))])


def block_rows(pattern: str, block_bytes: int, buckets: int):
    """Documents to blocks: their slots by position, and the block's distinct words by hash bucket."""

    def block(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words, order, counts = numbered(texts, pattern)
        often = np.argsort(-np.bincount(order, minlength=len(words)), kind="stable")  # frequent words get small slots
        slot_of = np.empty(len(words), np.int64)
        slot_of[often] = np.arange(len(words))
        names = words.to_numpy(zero_copy_only=False)[often]
        share = (pd.util.hash_array(names, categorize=False) % buckets).astype(np.int64) if len(names) else np.zeros(0, np.int64)
        by = np.argsort(share, kind="stable")
        dealt = words.take(pa.array(often[by])).cast(pa.binary())
        sizes = pc.binary_length(dealt).to_numpy().astype("<i4")
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        raw = b"".join(dealt.to_pylist())
        cuts = np.flatnonzero(np.diff(share[by], prepend=-1))
        lists = []
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(names)).tolist()[: len(cuts)], strict=True):
            lists.append({"bucket": int(share[by[a]]), "n": b - a, "words": pack(sizes[a:b].tobytes() + raw[at[a] : at[b]])})
        row = {"block": (TaskContext.get().partitionId() << 32) + number, "ids": pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes(), "nulls": ids.is_null().to_numpy(zero_copy_only=False).tobytes(), "counts": counts.astype("<i8").tobytes(), "slots": planes(slot_of[order]), "shares": planes(share), "buckets": lists}
        return pa.RecordBatch.from_pylist([row], BLOCK_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, texts) in enumerate(text_blocks(batches, block_bytes)):
            yield block(number, ids, texts)
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = GENERAL, block_bytes: int = 8_000_000, then: Callable[[pa.Table], pa.Table] | None = None, schema: str = "") -> DataFrame:
    """(doc_id, ids array<int>) of every document by the ranks, without special tokens; or what then makes of tables of
    those columns, with the given schema, in the task that puts the documents together.

    A null text counts as empty and gives no ids; repeated rows give repeated rows; a null id stays null; other columns
    are left out, whatever their names. A table without rows gives no rows. A block holds whole documents of about
    block_bytes bytes (one longer document makes a block of its own).
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # one entry per token of a fixed vocabulary
    n = partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(slim.mapInArrow(block_rows(pattern, block_bytes, n), BLOCKS), "blocks", bucket_by="block")

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a pre-token is matched as one piece again when it stands alone
        short = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        table, bucket, known = ranks.value, None, {}
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.bucket != bucket:
                    bucket, known = row.bucket, {}  # rows come sorted by bucket: each distinct word is encoded once
                words = unpack_words(row.words, row.n)
                for w in words:
                    if w not in known:
                        known[w] = np.array(short(w.decode()) if len(w) <= LONG else merge(w, table), "<u4").tobytes()
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                out.append((row.block, row.bucket, planes(sizes), planes(np.frombuffer(b"".join(found), "<u4"))))
            yield pd.DataFrame(out, columns=["block", "bucket", "sizes", "tokens"])

    lists = blocks.select("block", F.explode("buckets").alias("x")).select("block", "x.*")
    tokens = lists.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInPandas(encoded, "block long, bucket int, sizes binary, tokens binary")

    def rejoined(left: pa.Table, right: pa.Table) -> pa.Table:
        row, right = left.slice(0, 1).to_pylist()[0], right.sort_by("bucket")
        sizes = np.concatenate([from_planes(x) for x in right["sizes"].to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([from_planes(x) for x in right["tokens"].to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int32)
        place = np.empty(len(sizes), np.int64)
        place[np.argsort(from_planes(row["shares"]), kind="stable")] = np.arange(len(sizes))  # ids come bucket by bucket
        at = place[from_planes(row["slots"])]
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        cuts = ends[np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<i8"))])]
        keys = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool))
        out = pa.table({id_col: keys, "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(gather(flat, sizes, at)))})
        out = then(out) if then else out
        pa.default_memory_pool().release_unused()
        return out

    body = blocks.select("block", "ids", "nulls", "counts", "slots", "shares")
    return body.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(lambda a, b: rejoined(a, b), schema or f"{id_col} long, ids array<int>")


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table by id; ids that the file leaves out are null."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.binary())


def joined_bytes(ids: pa.Array, table: pa.Array, between: bytes) -> pa.Array:
    """For each list of ids the table's entries end to end. An id outside the table is an error."""
    taken = table.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id is not in the token-byte table")
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32)
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), taken), pa.scalar(between, table.type))
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, table.type)) if ids.null_count else out


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of each id list; the token-byte table is bounded by its vocabulary and joined map-side.

    Null ids stay null, an empty list gives no bytes, and an id outside the table fails the job.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rest = [c for c in encoded.columns if c != out_col]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(ranks.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, joined_bytes(part.column(ids_col), table, b"")], [*rest, out_col])

    schema = StructType([*(encoded.schema[c] for c in rest), StructField(out_col, BinaryType())])
    return encoded.select(rest).mapInArrow(joined, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, **how) -> DataFrame:
    """Encodes, decodes, and keeps counts and SHA-256 digests per document: of the decimal ids and of the decoded bytes. how goes to encode."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def digest(rows: pa.Table) -> pa.Table:
        table = token_table(ranks.value)
        decimal = pa.array([str(i).encode() for i in range(len(table))], pa.binary())
        ids, sha = rows["ids"].combine_chunks(), ([], [])
        for i in range(0, len(ids), 256):  # decoding joins the token-byte table; so do the ids their decimal digits
            for out, t, between in zip(sha, (decimal, table), (b" ", b""), strict=True):
                out.extend(hashlib.sha256(x.as_buffer()).hexdigest() for x in joined_bytes(ids.slice(i, 256), t, between))
        text = [pa.array(x, pa.string()) for x in sha]
        return pa.table([rows["doc_id"], pc.cast(pc.list_value_length(ids), pa.int64()), *text], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, ranks_path, pattern=pattern, then=digest, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **how)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and of the bytes decoded from them; null texts count as empty."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
