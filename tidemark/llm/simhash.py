"""SimHash near-duplicates by multi-index hashing.

Each text gets one 64-bit fingerprint; equal ones are one node from then on, so a group of exact copies of any size
is one row. Two fingerprints within three bits differ by one bit at most in one of their two 32-bit segments. So each
segment is a table: a fingerprint goes to the key of its own segment and to the 32 keys one bit away, 66 rows in all,
and every link lies under some key. Under a key, complete distances are verified, and a search that takes away
what it has reached gives a spanning forest of the links, never all pairs. Components of those edges follow by
alternating stars, each round a table in the shared folder.

The members under a key are distinct fingerprints that share 31 bits of a segment, 8 bytes each; copies do not add any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mapped, written

RADIUS = 3
SEED = 42
BROADCAST_ROWS = 1_000_000
SKETCH = 256
#: Pairs of which a sketch says less than this from the similarity asked for (four deviations) are counted on their whole shingle sets.
NEAR = 0.1
#: Words of a shingle of the fingerprints.
SHINGLE = 3
#: MinHash bands of ROWS hashes each: at a similarity of 0.8 a pair shares a band with probability 0.9993.
BANDS, ROWS = 24, 6
#: Members of one side that a comparison of blocks of a bucket takes.
BLOCK = 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (the whole sequence if it is shorter), ASCII letters in lower case, words between ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(w) - words])]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included; zero without words."""
    return majority(shingle_hashes(text, words))


def _fingerprints(words: int, at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(got.view(np.int64))], names=[*(f"c{k}" for k in keep), "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns `keep`, all by default) with the fingerprint as a long; it is zero for null and wordless texts."""
    kept = [docs.columns.index(c) for c in (docs.columns if keep is None else keep)]
    (out,) = fresh(docs.select(*(docs.columns[k] for k in kept)), out)
    schema = ", ".join([*(f"c{k} {docs.schema.fields[k].dataType.simpleString()}" for k in kept), "fp long"])
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return mapped(rows, _fingerprints(words, docs.columns.index(text), kept), schema).toDF(*(docs.columns[k] for k in kept), out)


_FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(32, dtype=np.uint64)])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            low, high = fp & np.uint64(0xFFFFFFFF), (fp >> np.uint64(32))
            keys = np.concatenate([(low[:, None] ^ _FLIPS).ravel(), (high[:, None] ^ _FLIPS | np.uint64(1 << 32)).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(np.repeat(fp, 33), 2).view(np.int64))], names=["key", "fp"])


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links within `radius` among distinct fingerprints."""
    left, out = fps, []
    while len(left) > 1:
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            reached = []
            for x in wave:
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    reached.append(left[near])
                    out += [(int(x), int(y)) for y in left[near]]
                    left = left[~near]
                    if not len(left):
                        break
            wave = np.concatenate(reached) if reached else left[:0]
    return out


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            a, b = [fps[two]], [fps[two + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                if found := forest(fps[s : s + n], radius):
                    x = np.array(found, np.uint64)
                    a.append(x[:, 0])
                    b.append(x[:, 1])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(a):
                return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])
            return None

        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(keys) or keys[0] == keys[-1]:
                continue
            done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if found := edges(keys[:done], fps[:done]):
                yield found
            keys, fps = keys[done:], fps[done:]
        if len(keys) and (found := edges(keys, fps)):
            yield found

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u > v) that connect what is linked within `radius` bits (3 at most), from a table of distinct fingerprints."""
    if radius > 3:
        raise ValueError("two segments with one changed bit each find distances up to 3")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = mapped(distinct.select("fp"), _keys, "key long, fp long")
    return mapped(keys.repartition(n, "key").sortWithinPartitions("key"), _links(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u > v) reaches. Roots are rows too.

    Alternates large and small stars until every node is a root or has its root for only neighbour; edges that are such stars already
    take no round. Every round is written to the shared folder."""
    now = written(edges.select("u", "v"), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's shuffle is its own and a hub's many edges can be split
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        least = written(least.select("u", F.least("u", "m").alias("m"), ((F.col("m") > F.col("u")) | (F.col("m") == F.col("most"))).alias("star")), "least")
        nodes, other = least.agg(F.count("*"), F.count_if(~F.col("star"))).first()
        least = least.select("u", "m")
        if not other:
            return least.toDF("node", "root")
        large = both.filter("v > u").join(F.broadcast(least) if nodes <= BROADCAST_ROWS else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        now = written(small, "edges")


def near_groups(docs_fp: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for a table (doc_id, fp): the smallest doc_id that the links within `radius` bits reach.

    Null doc_ids count for no smallest one; a component of such rows alone has a null component_id."""
    distinct = written(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, radius))
    placed = roots.join(distinct.withColumnRenamed("fp", "node"), "node")
    smallest = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    moved = placed.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    return distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 3, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each component one row, that of the smallest `key` (null last, then by text).

    Repeated rows and keys count as copies: one row stays. All columns stay as they are."""
    copy, k, h = fresh(docs, "copy", "kept_key", "kept_hash")
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))
    marked = written(fingerprints(whole, words, "t", "fp", ["doc_id", "h"]), "marked")
    groups = near_groups(marked, radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    best = marked.groupBy("fp").agg(F.min(order).alias("s"))
    first = best.join(groups, "fp").groupBy("component_id").agg(F.min("s").alias("s")).select(F.col("s.doc_id").alias(k), F.col("s.h").alias(h))
    rows = docs.withColumn(copy, F.xxhash64(text))
    if not marked.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([key, copy])
    same = F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.col(copy) == F.col(h))
    return rows.join(first, same, "left_semi").select(*docs.columns)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash function over the first one's values."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_MULT, _MASK = (_mixed(np.arange(1 + BANDS * ROWS * i, 1 + BANDS * ROWS * (i + 1), dtype=np.uint64)).astype(np.uint32) for i in (0, 1))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set, each over ROWS MinHashes of its own; two sets share one with probability 1 - (1 - J ** ROWS) ** BANDS."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    h = (_mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 1024):
        least = np.minimum(least, ((h[i : i + 1024, None] ^ _MASK) * (_MULT | np.uint32(1))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ column)
    return key


def _marks(words: int):
    """Of each text its fingerprint, and its band keys over shingles of `words` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            fps = np.fromiter((fingerprint(t, SHINGLE) for t in texts), np.uint64, len(texts))
            keys = [band_keys(shingle_hashes(t, words)) for t in texts]
            flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype="i4") * BANDS)
            columns = [batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "keys"])

    return run


def _sketches(words: int):
    """Of each text the SKETCH smallest 32-bit hashes of its distinct shingles, ascending: all of them if there are no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique((_mixed(shingle_hashes(t.as_py(), words)) >> np.uint64(32)).astype(np.uint32).view(np.int32))[:SKETCH] for t in part.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype("i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["h", "s"])

    return run


def sized(table: DataFrame) -> DataFrame:
    """A written table of a few longs a row, sent to all tasks while it has at most BROADCAST_ROWS rows; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def sketched(texts: DataFrame, involved: DataFrame, words: int) -> DataFrame:
    """(h, s): the sketches of the texts (h, t) whose h is in `involved`."""
    each = mapped(texts.join(sized(involved), "h", "left_semi").select("h", "t"), _sketches(words), "h long, s array<int>")
    return written(each.groupBy("h").agg(F.first("s").alias("s")), "sketches")


def alike(sets: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """(u, v, sure): the edges between texts whose shingles have a Jaccard similarity of `similarity` or more, and those to be counted (not sure).

    It is read off the SKETCH smallest hashes of both texts' shingles together (sets: h, s): exact where those are all, else with a
    deviation of 0.025 at 0.8. Sketches cover whole texts, and an edge moves a kilobyte instead of all shingles."""
    u, v = sets.select(F.col("h").alias("u"), F.col("s").alias("su")), sets.select(F.col("h").alias("v"), F.col("s").alias("sv"))
    pairs = edges.join(u, "u").join(v, "v").withColumn("least", F.slice(F.array_sort(F.array_union("su", "sv")), 1, SKETCH))
    both, n = F.size(F.array_intersect(F.array_intersect("least", "su"), "sv")), F.size("least")
    sure = (n < SKETCH) | (F.abs(both - similarity * n) >= NEAR * n)
    return pairs.select("u", "v", sure.alias("sure"), ((n == 0) | (both >= similarity * n)).alias("like")).filter("like or not sure").select("u", "v", "sure")


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype("i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["h", "x"])

    return run


def counted(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of texts (h, t) with that similarity by their whole shingle sets."""
    involved = written(pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct(), "near")
    each = mapped(texts.join(sized(involved), "h", "left_semi").select("h", "t"), _whole_sets(words), "h long, x array<long>")
    sets = written(each.groupBy("h").agg(F.first("x").alias("x")), "whole-sets")
    u, v = sets.select(F.col("h").alias("u"), F.col("x").alias("xu")), sets.select(F.col("h").alias("v"), F.col("x").alias("xv"))
    got = pairs.join(u, "u").join(v, "v").withColumn("both", F.size(F.array_intersect("xu", "xv")))
    return got.filter(F.col("both") >= similarity * (F.size("xu") + F.size("xv") - F.col("both"))).select("u", "v")


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends are in two components by a written table (node, root) of all nodes, with root_u and root_v."""
    table = sized(roots)
    for c in ("u", "v"):
        pairs = pairs.join(table.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c)
    return pairs.filter("root_u <> root_v")


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The table roots (node, root) with the edges (u, v) added. Only edges between two of its components are followed, as edges between their roots."""
    top = components(rooted(edges, roots).select(F.greatest("root_u", "root_v").alias("u"), F.least("root_u", "root_v").alias("v")))
    if top.isEmpty():
        return roots
    moved = roots.join(sized(top).select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
    return written(moved.select("node", F.coalesce("now", "root").alias("root")), "roots")


def settled(edges: DataFrame, roots: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The table roots (node, root) with those edges (u, v, sure) added that hold. One that isn't sure is counted unless its ends are linked anyway."""
    roots = joined(roots, edges.filter("sure").select("u", "v"))
    rest = written(rooted(edges.filter("not sure").select("u", "v").distinct(), roots).select("u", "v"), "unsure")
    if rest.isEmpty():
        return roots
    return joined(roots, written(counted(texts, rest, words, similarity), "counted"))


def overlap(x: np.ndarray, many: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sketch x and each row of `many` (ascending int64, padded with the largest one): how many of the SKETCH smallest hashes of both are shared, and how many there are."""
    if not len(x):
        return np.zeros(len(many), np.int64), np.minimum(sizes, SKETCH)
    at = np.searchsorted(x, many)
    shared = (x[np.minimum(at, len(x) - 1)] == many) & (np.arange(many.shape[1]) < sizes[:, None])
    before = np.cumsum(shared, axis=1) - shared
    both = (shared & (np.arange(many.shape[1]) + at - before < SKETCH)).sum(axis=1)
    return both, np.minimum(SKETCH, sizes + len(x) - shared.sum(axis=1))


def _compared(similarity: float):
    """Of rows sorted by (b, i, j), each a member of one or both sides of a comparison, the pairs across both sides that are alike or to be counted."""

    def pairs(rows: list[dict]) -> list[tuple[int, int, bool]]:
        ours, out = [r for r in rows if r["stray"]], []
        many = np.full((len(rows), SKETCH), np.iinfo(np.int64).max)
        for k, r in enumerate(rows):
            many[k, : len(r["s"])] = r["s"]
        sizes = np.array([len(r["s"]) for r in rows])
        roots, hs = np.array([r["root"] for r in rows]), np.array([r["h"] for r in rows])
        at = {r["h"]: k for k, r in enumerate(rows)}
        for r in ours:
            other = np.flatnonzero(roots != roots[at[r["h"]]])
            if not len(other):
                continue
            both, least = overlap(np.array(r["s"], np.int64), many[other], sizes[other])
            sure = (least < SKETCH) | (np.abs(both - similarity * least) >= NEAR * least)
            hit = other[sure & ((least == 0) | (both >= similarity * least))]
            # of components that this links, which are one from now on, one verified pair each
            _, one = np.unique(roots[hit], return_index=True)
            out += [(max(r["h"], int(x)), min(r["h"], int(x)), k < len(one)) for k, x in enumerate(hs[np.r_[hit[one], other[~sure]]])]
            roots[np.isin(roots, roots[hit])] = roots[at[r["h"]]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows):
            if got := pairs(rows):
                u, v, sure = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sure)], names=["u", "v", "sure"])

        at, held = None, []
        for batch in batches:
            for r in (r for k in range(0, batch.num_rows, 512) for r in batch.slice(k, 512).to_pylist()):
                if (now := (r["b"], r["i"], r["j"])) != at:
                    if held:
                        yield from found(held)
                    at, held = now, []
                held.append(r)
        if held:
            yield from found(held)

    return run


def strays(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u > v, sure) still to be found in buckets (b, h) whose members are not all of one root.

    Every member outside its bucket's largest component is compared with every member of another component. Sides are dealt into blocks, so that
    no task holds a bucket, and pairs that are not alike never become rows."""
    placed = members.join(sized(roots).select(F.col("node").alias("h"), "root"), "h", "left").select("b", "h", F.coalesce("root", "h").alias("root"))
    counts = written(placed.groupBy("b", "root").agg(F.count("*").alias("n")), "bucket-roots")
    mixed = counts.groupBy("b").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).filter("kinds > 1")
    mixed = written(mixed.select("b", "n", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("k")), "mixed")
    ours, theirs = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("k", "n"))
    rows = written(placed.join(sized(mixed), "b").withColumn("i_n", ours).withColumn("j_n", theirs).withColumn("salt", F.xxhash64("h")), "mixed-members")
    left = rows.filter("root <> main").select("b", F.pmod("salt", "i_n").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"), "h", "root", F.lit(True).alias("stray"))
    right = rows.select("b", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), F.pmod("salt", "j_n").cast("int").alias("j"), "h", "root", F.lit(False).alias("stray"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a member of both sides is one row
    sides = left.union(right).groupBy("b", "i", "j", "h", "root").agg(F.max("stray").alias("stray")).join(sets, "h")
    dealt = sides.select("b", "i", "j", "h", "root", "stray", "s").repartition(n, "b", "i", "j").sortWithinPartitions("b", "i", "j")
    return mapped(dealt, _compared(similarity), "u long, v long, sure boolean").distinct()


def near_members(nodes: DataFrame) -> DataFrame:
    """(b, h, first): the texts of nodes (h, fp) in one bucket for each component of fingerprints within RADIUS bits that holds several; first is its smallest h."""
    texts = nodes.select(F.col("h").alias("doc_id"), "fp")
    placed = written(grouped(texts, near_groups(texts)), "placed")
    several = written(placed.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id"), "several")
    members = placed.join(sized(several), "component_id")
    return written(members.select(F.col("component_id").alias("b"), F.col("doc_id").alias("h"), F.col("component_id").alias("first")), "near-members")


def band_members(nodes: DataFrame) -> DataFrame:
    """(b, h, first): the texts of nodes (h, keys) in one bucket for each MinHash band that several share; first is its smallest h."""
    each = nodes.select(F.explode("keys").alias("b"), "h")
    buckets = written(each.groupBy("b").agg(F.min("h").alias("first"), F.count("*").alias("n")).filter("n > 1").select("b", "first"), "buckets")
    return written(each.join(sized(buckets), "b").select("b", "h", "first"), "members")


def verified(members: DataFrame, roots: DataFrame, sets: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The table roots (node, root) of all texts in buckets, with what members (b, h, first) of one bucket have alike added.

    Each text that isn't linked with its bucket's first text is verified against it; where that leaves a bucket in several
    components, all pairs across them are verified too (see strays), so every two texts of a bucket are linked or have been compared."""
    pairs = members.filter("h <> first").select(F.col("h").alias("u"), F.col("first").alias("v")).distinct()
    edges = written(rooted(pairs, roots).select("u", "v"), "candidates")
    roots = settled(written(alike(sets, edges, similarity), "linked"), roots, texts, words, similarity)
    more = written(strays(members.select("b", "h"), roots, sets, similarity), "strays")
    return settled(more, roots, texts, words, similarity)


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay when of texts alike (shingles of `words` words, Jaccard of `similarity`) one is kept: the smallest key's.

    Equal texts are one node. Components of fingerprints within RADIUS bits, by multi-index hashing, are the first buckets, and what is alike in them
    is linked. Alike texts may be more than RADIUS bits apart, so texts that share a MinHash band are in one bucket too, and its pairs not linked yet
    are verified in turn. All columns stay as they are; null keys come last; repeated rows count as copies."""
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))
    marked = written(mapped(whole, _marks(words), "doc_id long, h long, fp long, keys array<long>"), "marked")
    nodes = written(marked.groupBy("h").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    near, banded = near_members(nodes), band_members(nodes)
    texts = whole.select("h", "t")
    involved = written(near.select("h").union(banded.select("h")).distinct(), "involved")
    sets = sketched(texts, involved, words)
    roots = involved.select(F.col("h").alias("node"), F.col("h").alias("root"))
    for members in (near, banded):
        roots = verified(members, roots, sets, texts, words, similarity)
    order = F.struct(F.col("least").isNull(), "least", "h")
    copies = nodes.join(roots.withColumnRenamed("node", "h"), "h").select("root", "h", "least")
    best = written(copies.groupBy("root").agg(F.min(order).alias("s")).select("root", F.col("s.h").alias("best")), "best")
    gone = copies.join(best, "root").filter("h <> best").select(F.col("h").alias("gone"))
    rows = first_rows(docs, marked, nodes, gone, text, key)
    if not marked.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([key, *(c for c in rows.columns if c not in docs.columns)])
    return rows.select(*docs.columns)


def first_rows(docs: DataFrame, marked: DataFrame, nodes: DataFrame, gone: DataFrame, text: str, key: str) -> DataFrame:
    """Of each text (nodes: h, least) that isn't in `gone` the rows of the smallest key, and a column with the text's hash.

    The rows to leave out are found on a narrow table; they go by key and hash together, so copies spread."""
    copy, h, low = fresh(docs, "copy", "left_hash", "left_key")
    kept = nodes.join(gone, F.col("h") == F.col("gone"), "left_anti").select(F.col("h").alias("kept_h"), F.col("least"))
    same = (F.col("h") == F.col("kept_h")) & F.col("doc_id").eqNullSafe(F.col("least"))
    left = written(marked.select("doc_id", "h").distinct().join(kept, same, "left_anti").select(F.col("doc_id").alias(low), F.col("h").alias(h)), "left-out")
    this = F.col(key).cast("long").eqNullSafe(F.col(low)) & (F.col(copy) == F.col(h))
    return docs.withColumn(copy, F.xxhash64(text)).join(sized(left), this, "left_anti")


def grouped(marked: DataFrame, groups: DataFrame) -> DataFrame:
    """marked (doc_id, fp) with the component of its fingerprint, groups being (fp, component_id).

    Fingerprints that hold a thousandth of the rows or more, a thousand of them at most, are sent to all tasks; the rest is joined by shuffle, so no
    task gets more than a thousandth of the rows for one fingerprint."""
    counts = written(marked.groupBy("fp").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    groups = written(groups, "groups")
    hot = groups.join(counts.filter(F.col("n") * 1000 >= total), "fp", "left_semi").select("fp", F.struct("component_id").alias("hot"))
    placed = marked.join(F.broadcast(hot), "fp", "left")
    cold = placed.filter("hot IS NULL").drop("hot").join(groups, "fp")
    return placed.filter("hot IS NOT NULL").select(*marked.columns, "hot.component_id").unionByName(cold)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = written(fingerprints(docs, 3, keep=["doc_id"]), "marked")
    return grouped(marked, near_groups(marked)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
