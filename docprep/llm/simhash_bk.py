"""SimHash near-duplicates found with BK-trees.

1. ``fingerprints``: one 64-bit fingerprint per text (a bit is set if it is set
   in over half of the shingle hashes).
2. ``links``: distinct fingerprints are sharded by what two fingerprints within
   the radius must share. The 64 bits are cut into ``radius + 2`` blocks; two
   fingerprints at ``radius`` or fewer differing bits agree on at least two
   whole blocks, so every such pair meets in the shard of those two blocks.
   A shard with more members than ``tree_size`` is dealt into cells: member sets
   of bounded size, each a tree that is sent to every set of the same shard, so
   a hot shard is many bounded tasks and no pair is lost.
3. In a cell a BK-tree holds the tree set (children keyed by the integer Hamming
   distance to their parent); a search follows only edges within the radius of
   the distance to the node. A cell returns a spanning forest of its links, never
   all pairs.
4. Components of the forests join the documents through their fingerprint.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import materialise
from docprep.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
TREE_SIZE = 2048
_CHUNK = 65_536  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one UTF-8 text; 0 for null or a text without words.

    A-Z are lower-cased (``bytes.lower`` changes ASCII letters only); words are
    runs without ASCII white space (``bytes.split`` cuts at those six bytes only).
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        h = np.fromiter(
            (digest(line[a : b - 1], seed) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK])),
            dtype="<u8",
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= (1 << 63) else x


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint's bit pattern as a signed long. One row per input row."""

    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint(t, shingle, seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Keys are 64-bit integers; children are keyed by their distance to the parent."""

    def __init__(self):
        self.root = None

    def add(self, key: int) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ key).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (key, {})
                return
            node = child

    def within(self, key: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ key).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius + 1:
                todo.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
            else:
                todo.extend(children[e] for e in range(max(0, d - radius), d + radius + 1) if e in children)
        return found


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _cell_links(rows, radius: int):
    """rows: (fp, rep, in_tree, in_query) of one cell -> spanning forest as pairs of reps."""
    tree, rep, forest, out = BKTree(), {}, _Forest(), []
    for fp, r, in_tree, _ in rows:
        if in_tree:
            tree.add(fp)
            rep[fp] = r
    for fp, r, _, in_query in rows:
        if in_query:
            for other in tree.within(fp, radius):
                if other != fp and forest.join(r, rep[other]):
                    out.append((r, rep[other]))
    return out


def _block_keys(blocks: int, radius: int) -> list:
    """Column expressions of the shard keys: each keeps the bits of two (radius 1 or more) blocks."""
    width = -(-64 // blocks)
    masks = []
    for i in range(blocks):
        lo, hi = i * width, min(64, (i + 1) * width)
        masks.append(((1 << hi) - 1) ^ ((1 << lo) - 1))
    keep = blocks - radius
    return [F.col("fp").bitwiseAND(F.lit(_signed(sum(c)))) for c in combinations(masks, keep)]


def links(distinct_fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``distinct_fps(fp, rep)`` -> ``(u, v)``: forests of all pairs of reps within ``radius`` bits."""
    keys = _block_keys(radius + 2, radius)
    shards = F.array(*[F.struct(F.lit(i).alias("band"), k.alias("key")) for i, k in enumerate(keys)])
    members = distinct_fps.select("fp", "rep", F.explode(shards).alias("s")).select("fp", "rep", "s.band", "s.key")
    sizes = materialise(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    full = members.join(sizes, ["band", "key"]).withColumn("n", F.ceil(F.col("m") / F.lit(tree_size)).cast("int"))
    full = full.withColumn("own", F.expr("int(pmod(xxhash64(fp), n))"))
    # a member goes to the cells (own, j) for j >= own, whose tree holds it, and to (i, own) for i < own as a query
    cells = full.withColumn("other", F.explode(F.expr("sequence(0, n - 1)"))).select(
        "band",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "fp",
        "rep",
        (F.col("own") <= F.col("other")).alias("in_tree"),
        (F.col("own") >= F.col("other")).alias("in_query"),
    )

    def run(batches):
        key, rows = None, []
        for b in batches:
            for band, k, i, j, fp, rep, in_tree, in_query in zip(*(c.to_pylist() for c in b.columns)):
                if (band, k, i, j) != key:
                    found = _cell_links(rows, radius)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
                    key, rows = (band, k, i, j), []
                rows.append((fp & 0xFFFFFFFFFFFFFFFF, rep, in_tree, in_query))
        found = _cell_links(rows, radius)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

    cell = ["band", "key", "i", "j"]
    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    seed: int = SEED,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``radius`` or
    fewer differing bits, itself included. Null and word-less texts have
    fingerprint 0 and link like any other. Repeated rows give repeated result
    rows; a null doc_id keeps its fingerprint and has a null component. Extra
    columns are ignored. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, text_col, id_col, shingle, seed), "fingerprints")
    # a doc_id with several texts ties its fingerprints together through the id itself
    distinct = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    same_id = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    same_id = materialise(same_id.where("n > 1 and a <> b").select("doc_id"), "same_id")
    edges = links(distinct, radius, tree_size)
    tied = fps.join(same_id, "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comp = connected_components(edges.unionByName(tied))
    by_fp = distinct.join(comp, distinct.rep == comp.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    by_fp = materialise(by_fp, "by_fp")
    out = fps.join(by_fp, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` whose document is its group's smallest doc_id, all columns kept.

    Of repeated rows of one doc_id the one with the smallest text stays; rows without a doc_id all stay.
    """
    id_col = kw.get("id_col", "doc_id")
    found = near_duplicates(docs, **kw)
    gone = materialise(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    left = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    repeated = left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).count().where("count > 1")
    repeated = materialise(repeated.select("__id"), "repeated")
    if repeated.isEmpty():
        return left
    # only rows of repeated ids are compared, combined before the shuffle; those without an id never meet
    is_repeated = F.col(id_col).cast("long") == F.col("__id")
    text = F.col(kw.get("text_col", "text"))
    order = F.struct(text.isNotNull(), text, F.xxhash64(*left.columns))
    many = left.join(repeated, is_repeated, "left_semi").groupBy(F.col(id_col).cast("long").alias("__id"))
    one = many.agg(F.min_by(F.struct(*left.columns), order).alias("__row")).select("__row.*")
    return left.join(repeated, is_repeated, "left_anti").unionByName(one)
