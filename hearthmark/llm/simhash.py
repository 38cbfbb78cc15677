"""SimHash near-duplicates: fingerprints linked by BK-trees at a small Hamming radius, then connected components.

Two fingerprints within RADIUS bits agree on at least one of RADIUS + 1 bands, so each band value is one shard with a
BK-tree of its own and no pair is missed. A shard of many fingerprints is dealt out once more by bands of its remaining
bits, which is as exact. The trees are not broadcast: fingerprints grow with the corpus, shards are what stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm.common import components, drop, groups, partitions, stored

RADIUS, LARGE, FOREST = 2, 20_000, 50_000
BITS = 64


def simhash(text: str | None) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half the XXH64 hashes (seed 42) of the 3-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()
    n = max(1, len(words) - 2)
    digest = xxhash.xxh64_intdigest
    last = min(3, len(words)) - 1
    hashes = np.fromiter((digest(joined[starts[i] : stops[i + last]], 42) for i in range(n)), np.uint64, n)
    sums = np.zeros(BITS, np.int64)
    for i in range(0, n, 65_536):
        sums += np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text column as a signed long; a null text counts as empty."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64), index=texts.index)

    return run(text)


class Forest:
    """BK-trees over shards: a child hangs on its parent by their Hamming distance. Items of a shard stand together."""

    def __init__(self, values: np.ndarray, roots: np.ndarray):
        """values: distinct uint64 within a shard; roots: for each item the index of its shard's first item."""
        self.values, self.roots = values, roots
        here = np.flatnonzero(roots != np.arange(len(values)))
        at = roots[here]
        keys, kids = [], []
        while len(here):  # one level a round
            key = at * (BITS + 1) + np.bitwise_count(values[here] ^ values[at]).astype(np.int64)
            edge, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = here[first]
            keys.append(edge)
            kids.append(child)
            at = child[inverse]
            here, at = here[at != here], at[at != here]
        edge, kid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(edge)
        self.edges, self.kids = edge[order], kid[order]

    def links(self, radius: int = RADIUS, chunk: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (item, item) within the radius, each twice at most; follows only edges within the radius of a distance."""
        for start in range(0, len(self.values), chunk):
            q = np.arange(start, min(start + chunk, len(self.values)))
            at = self.roots[q]
            while len(q):
                d = np.bitwise_count(self.values[q] ^ self.values[at]).astype(np.int64)
                near = (d <= radius) & (q != at)
                if near.any():
                    yield q[near], at[near]
                nq, na = [], []
                for step in range(-radius, radius + 1):
                    key = at * (BITS + 1) + d + step
                    ok = (d + step >= 0) & (d + step <= BITS)
                    i = np.searchsorted(self.edges, key)
                    ok &= i < len(self.edges)
                    ok[ok] = self.edges[i[ok]] == key[ok]
                    nq.append(q[ok])
                    na.append(self.kids[i[ok]])
                q, at = np.concatenate(nq), np.concatenate(na)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of linked items in place; a class is labelled by its smallest item."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _shard_links(radius: int):
    """Sorted (key, fp) rows to a spanning forest of the links within each shard."""

    def solve(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        forest = Forest(values.view(np.uint64), np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)))
        label = np.arange(len(keys))
        for a, b in forest.links(radius):
            unite(label, a, b)
        own = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": values[own], "b": values[label[own]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = [], []
        for frame in frames:
            keys.append(frame["key"].to_numpy())
            values.append(frame["fp"].to_numpy())
            if sum(map(len, keys)) >= FOREST:
                k, v = np.concatenate(keys), np.concatenate(values)
                cut = np.flatnonzero(k != k[-1])
                cut = cut[-1] + 1 if len(cut) else 0  # the last shard may go on in the next frame
                if cut:
                    yield solve(k[:cut], v[:cut])
                keys, values = [k[cut:]], [v[cut:]]
        if keys and len(k := np.concatenate(keys)):
            yield solve(k, np.concatenate(values))

    return run


def _bands(fp: Column, bits: list[int], radius: int) -> list[tuple[list[int], Column]]:
    """radius + 1 bands of the given bits with their values."""
    out = []
    for part in np.array_split(bits, radius + 1):
        mask = sum(1 << int(b) for b in part)
        out.append((part.tolist(), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return out


def near_links(nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(a, b): links between distinct fingerprints fp within the radius, as a spanning forest of each shard."""
    n = partitions(nodes.sparkSession)
    fp = F.col("fp")
    first = _bands(fp, list(range(BITS)), radius)
    shards = nodes.select("fp", F.posexplode(F.array(*(v for _, v in first))).alias("band", "value")).withColumn("key", F.xxhash64("band", "value"))
    hot = shards.groupBy("key").count().filter(F.col("count") > large).select("key", F.lit(True).alias("hot"))
    dealt = shards.join(hot, "key", "left")
    again = F.lit(None).cast("array<bigint>")
    for i, (own, _) in enumerate(first):
        rest = _bands(fp, [b for b in range(BITS) if b not in own], radius)
        again = F.when(F.col("band") == i, F.array(*(F.xxhash64("key", F.lit(j), v) for j, (_, v) in enumerate(rest)))).otherwise(again)
    dealt = dealt.select("fp", F.explode(F.when(F.col("hot"), again).otherwise(F.array("key"))).alias("key"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "fp").mapInPandas(_shard_links(radius), "a long, b long")


def cluster(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_key and the columns to keep) of every document.

    component_id is the smallest id reachable by links of at most radius differing bits, class_key a fingerprint of the component. Null and blank texts have
    fingerprint zero and link like any other. Rows without an id belong to their component but never name it; a component
    of such rows alone has a null component_id. Repeated rows stay; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, fingerprints(F.col(text_col)).alias("fp"))
    rows = stored(rows, "fingerprints") if not keep else rows
    ids = rows.select("doc_id", "fp")
    nodes = stored(ids.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.select("fp", "root").join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(named, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("root").alias("class_key"), *keep)


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, with the columns of documents: the one of smallest id, then of least text."""
    whole = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("doc"))  # no name can clash inside
    rows = cluster(whole, keep=("doc",), **how).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "doc")).alias("best"))
    return best.select("best.doc.*")


WIDTH, ALIKE = 5, 0.8  # the pipeline's settings: words a shingle, least Jaccard of the shingle sets
REACH, TABLES, ROWS = 20, 20, 5  # bits: 9.7 expected at ALIKE, deviation 2.9, beyond REACH once in 5,000; a pair at ALIKE misses all tables once in 2,900
KEYS = np.random.default_rng(8).integers(0, 2**63, (TABLES, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
NEAR = 3  # bits: fingerprints this near are looked for by BK-trees before any shard of least hashes
TURNS = 2  # rounds in which a shard's members meet one lead
ENOUGH = 62  # of the TABLES * ROWS least hashes: a pair at ALIKE agrees on 80, deviation 4, and falls short once in 100,000
FINER = np.random.default_rng(9).integers(0, 2**63, 1000, np.uint64) * np.uint64(2) + np.uint64(1)
MOST = 746  # of the least hashes in FINER orders: 800 expected at ALIKE, deviation 12.6, the same chance to fall short
BLOCK = 512  # members of a shard that meet another block of it in a task
SKETCH = "fp long, n int, shards array<long>, least binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the WIDTH-word shingles; a shorter text is one shingle, as is a text without words."""
    words = (text or "").encode().lower().split()
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n, width = max(1, len(h) - WIDTH + 1), min(WIDTH, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketch(text: str | None) -> tuple[int, int, list[int], bytes]:
    """SimHash of the shingle set, the set's size, a key a table: of its ROWS least hashes under as many orders, and a byte
    of each least hash."""
    s = shingle_set(text)
    sums, least = np.zeros(BITS, np.int64), np.full(KEYS.size, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048]
        sums += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (KEYS.reshape(-1, 1) * part).min(axis=1))
    keys = np.arange(TABLES, dtype=np.uint64)
    for column in least.reshape(TABLES, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    fp = np.packbits(2 * sums > len(s), bitorder="little").view("<u8")
    return int(fp.view(np.int64)[0]), len(s), keys.view(np.int64).tolist(), mixed(least).astype(np.uint8).tobytes()


def finer(text: str) -> Column:
    """A byte of each least hash of a text's shingles under the FINER orders."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for s in map(shingle_set, texts):
            least = np.full(FINER.size, 2**64 - 1, np.uint64)
            for i in range(0, len(s), 2048):
                least = np.minimum(least, (FINER.reshape(-1, 1) * s[i : i + 2048]).min(axis=1))
            out.append(mixed(least).astype(np.uint8).tobytes())
        return pd.Series(out, index=texts.index, dtype=object)

    return run(text)


def sketches(text: str) -> Column:
    @F.pandas_udf(SKETCH)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t) for t in texts], columns=["fp", "n", "shards", "least"])

    return run(text)


def jaccard(a: str, b: str) -> Column:
    """The Jaccard of two texts' shingle sets; a text that meets many others in a batch is cut once."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = lru_cache(256)(shingle_set)
        out = []
        for u, v in ((known(s), known(t)) for s, t in zip(x, y, strict=True)):
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both / (len(u) + len(v) - both))
        return pd.Series(out, index=x.index, dtype=float)

    return run(a, b)


def agreeing(a: str, b: str) -> Column:
    """How many least hashes of two texts agree."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1 if len(s) else 1) for s in (x, y))
        return pd.Series((u == v).sum(axis=1), index=x.index)

    return run(a, b)


def beside(pairs: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """The pairs (a, b) with a column of their texts as x and y."""
    left = pairs.join(table.select(F.col("tk").alias("a"), F.col(by).alias("x")), "a")
    return left.join(table.select(F.col("tk").alias("b"), F.col(by).alias("y")), "b")


def candidates(pairs: DataFrame, nodes: DataFrame, tested: DataFrame | None) -> DataFrame:
    """The pairs (a, b) not yet tested whose least hashes agree on ENOUGH places: only these move texts."""
    pairs = pairs.distinct()
    pairs = pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs
    return stored(beside(pairs, nodes, "least").filter(agreeing("x", "y") >= ENOUGH).select("a", "b"), "candidates")


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells of shards to the pairs (a, b) of different roots that may be ALIKE by fingerprint, size and finer sketch.

    A pair that shares several shards comes out of the first of them alone.
    """
    for (_, low, high), rows in groups(batches, ["key", "low", "high"]):
        if rows.num_rows < 2:
            continue
        tk = rows.column("tk").to_pylist()
        own, fp, n, tab, root = (rows.column(c).to_numpy() for c in ("own", "fp", "n", "tab", "root_key"))
        keys = np.stack(rows.column("shards").to_numpy())
        fine = np.stack([np.frombuffer(x, np.uint8) for x in rows.column("least").to_pylist()])
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        bits = fp.view(np.uint64)
        for start in range(0, len(left), 64):
            part = left[start : start + 64]
            may = (root[part][:, None] != root[right]) & (np.bitwise_count(bits[part][:, None] ^ bits[right]) <= REACH)
            may &= np.minimum(n[part][:, None], n[right]) >= ALIKE * np.maximum(n[part][:, None], n[right])
            if low == high:
                may &= np.arange(len(right)) > np.arange(start, start + len(part))[:, None]
            i, j = np.nonzero(may)
            for s in range(0, len(i), 8192):
                a, b = part[i[s : s + 8192]], right[j[s : s + 8192]]
                first = (keys[a] == keys[b]).argmax(axis=1) == tab[a]
                a, b = a[first], b[first]
                near = (fine[a] == fine[b]).sum(axis=1) >= MOST
                pairs = [sorted((tk[p], tk[q])) for p, q in zip(a[near].tolist(), b[near].tolist(), strict=True)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.binary()), pa.array([q for _, q in pairs], pa.binary())], ["a", "b"])


def near_in_shards(apart: DataFrame, fine: DataFrame) -> DataFrame:
    """All members of a shard meet inside tasks, in pairs of blocks of BLOCK; what leaves them are the pairs that finer sketches let through."""
    sizes = apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = apart.join(sizes, "key").join(fine, "tk").withColumn("own", F.pmod(F.xxhash64("tk", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "tk", "fp", "n", "tab", F.xxhash64("root").alias("root_key"), "shards", "least")
    cell = ["key", "low", "high"]
    return rows.repartition(partitions(apart.sparkSession), *cell).sortWithinPartitions(*cell).mapInArrow(_near_in_blocks, "a binary, b binary")


def alike(near: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose texts have a Jaccard of at least ALIKE, by their whole shingle sets."""
    need = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "tk")
    held = stored(texts.join(need, "tk", "left_semi"), "texts")
    return stored(beside(near, held, "text").withColumn("j", jaccard("x", "y")).filter(F.col("j") >= ALIKE).select("a", "b"), "alike")


def close(a, b) -> Column:
    """Whether two members (tk, fp, n) may be ALIKE by their fingerprints and sizes."""
    return (F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= REACH) & (F.least(a("n"), b("n")) >= ALIKE * F.greatest(a("n"), b("n")))


def near_by_fingerprint(nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts of one fingerprint, each with its least, and of fingerprints that BK-trees link within NEAR bits."""
    by = stored(nodes.groupBy("fp").agg(F.min("tk").alias("least_tk")), "fingerprints")
    same = nodes.join(by, "fp").filter("tk <> least_tk").select(F.col("least_tk").alias("a"), F.col("tk").alias("b"))
    links = near_links(by.select("fp"), NEAR)
    named = lambda c: by.select(F.col("fp").alias(c), F.col("least_tk").alias(f"{c}_tk"))
    near = links.join(named("a"), "a").join(named("b"), "b").select(F.least("a_tk", "b_tk").alias("a"), F.greatest("a_tk", "b_tk").alias("b"))
    return same.unionByName(near)


def still_apart(apart: DataFrame, roots: DataFrame) -> DataFrame:
    """The shards whose members are not all linked yet, with the roots of their members; the table before is dropped."""
    rooted = apart.drop("root").join(roots, "tk", "left").withColumn("root", F.coalesce("root", "tk"))
    split = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    out = stored(rooted.join(split, "key").select("key", "tab", "tk", "fp", "n", "root"), "apart")
    drop(apart)
    return out


def near_representatives(docs: DataFrame) -> DataFrame:
    """One document of each group of texts linked by a Jaccard of ALIKE, with the columns of documents: that of smallest id.

    First SimHash finds by itself what it can find exactly: BK-trees in shards by bands link fingerprints within NEAR bits. Two texts at ALIKE differ in some ten
    bits, where bands are of no use, as 21 bands of three bits would send every pair to some shard; so what BK-trees leave apart meets, within REACH bits, in
    shards of fingerprints whose texts share their least shingles. Candidates are
    held against ALIKE in full before they link. In each of TURNS rounds every member of a shard meets one lead, drawn anew, unless
    both are linked already; then the members that this left apart meet inside tasks, by finer sketches, and the few pairs these
    let through are held against ALIKE. What is alike costs a few times its number; what is a little less alike than ALIKE costs comparisons of
    sketches, but no rows: nothing short of a comparison shows that it has no link. Exact copies are one text from the start, by 128 bits of its
    hash: the first aggregation leaves one a task, so that they meet in no task as a group."""

    def members(name: str):
        return lambda c: F.col(f"{name}.{c}")

    pair = lambda a, b: [F.least(a("tk"), b("tk")).alias("a"), F.greatest(a("tk"), b("tk")).alias("b")]
    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    one = keyed.groupBy("tk").agg(F.min(F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), "doc")).alias("k"))
    # the documents move once, by their text's key; what later needs texts or rows by that key finds them in place
    rows = stored(one.select("tk", "k.doc"), "rows", bucket_by="tk")
    texts = rows.select("tk", F.col("doc.text").alias("text"))
    nodes = stored(rows.select("tk", "doc.doc_id", sketches("doc.text").alias("s")).select("tk", "doc_id", "s.*"), "nodes")
    shards = nodes.select("tk", "fp", "n", F.posexplode("shards").alias("tab", "key"))
    many = shards.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1").select("key")
    apart = stored(shards.join(many, "key").select("key", "tab", "tk", "fp", "n", F.col("tk").alias("root")), "apart")
    x, y = members("x"), members("y")
    tested = candidates(near_by_fingerprint(nodes.select("tk", "fp")), nodes, None)
    links = alike(tested, texts)
    roots = components(links).withColumnRenamed("node", "tk")
    apart = still_apart(apart, roots)
    for turn in range(TURNS + 1):
        if turn < TURNS:
            lead = apart.groupBy("key").agg(F.min_by(F.struct("tk", "fp", "n", "root"), F.xxhash64("tk", F.lit(turn))).alias("y"))
            met = apart.alias("x").join(lead, "key").filter((x("root") != y("root")) & close(x, y))
            near = candidates(met.select(*pair(x, y)), nodes, tested)
        else:
            left = apart.select("tk").distinct()
            fine = stored(texts.join(left, "tk", "left_semi").select("tk", finer("text").alias("least")), "finer")
            fine = fine.join(nodes.select("tk", "shards"), "tk")
            near = stored(near_in_shards(apart, fine).join(tested, ["a", "b"], "left_anti"), "candidates")
        found = alike(near, texts)
        links, tested = links.unionByName(found), tested.unionByName(near)
        roots = components(links).withColumnRenamed("node", "tk")
        if turn < TURNS:
            apart = still_apart(apart, roots)
    named = nodes.select("doc_id", "tk").join(roots, "tk", "left").withColumn("root", F.coalesce("root", "tk"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tk"))).alias("k")).select("k.tk")
    kept = stored(kept, "kept")
    drop(nodes, apart, links, tested)
    return rows.join(kept, "tk").select("doc.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id of its component; null and blank texts have fingerprint zero."""
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
