"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard likeness of THRESHOLD or more.

MinHash banding finds candidates: bands and rows per band come from the recall wanted at the threshold. Texts with equal
shingle sets count as one class before anything else, so exact copies never meet each other. Classes that share a band
hash are put into clusters (the least class of a band passes along until nothing changes); only their members' shingles
are moved. Within a cluster, blocks of bounded size are verified pair by pair on the full sets, each first with itself,
then with the others. This gives link counts for each text and the links of a spanning forest, never all links: at most one for each
text within its block, and between two blocks one for each pair of parts that are not joined yet. So no pair is lost within
a cluster, pairs need no row of their own, and a cluster of any size is spread over many tasks.

Words are those of benchmark decontamination; a text of one to four words is one shingle. Results for odd rows: a text
without words (null, empty) is alone in its class with no links; rows with equal or null ids are apart from each other
like any others; columns besides the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .work import kept, quoted, row_of, small, table

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9995, 6
#: Bounds of a block of a cluster.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 2_000_000
#: Rows of two keys that one task may go through on its own when components are joined.
ONE_TASK = 1 << 16


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands with which a pair at the threshold shares one with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(5)
    return made.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), made.integers(0, 2**32, n, dtype=np.uint32)


def _shingled(step: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, shingles of each, words of each."""
    words, counts = T.words(*T.utf8(step.column("text")))
    codes, distinct = T.coded(words)
    hashed, n = T.shingles(T.hashes(distinct)[codes], counts, SHINGLE)
    return hashed, n, counts


def _sets(hashed: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(n)
    for end, k in zip(ends.tolist(), n.tolist()):
        yield np.unique(hashed[end - k : end])


def _digest(own: np.ndarray) -> bytes:
    """128 bits of a set of shingles: its class."""
    a = T.mix(own).sum(dtype=np.uint64)
    b = T.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Class digest and band hashes of each text; no bands for a text without words."""
    a, b = _family(bands * rows)
    for step in T.steps(batches, "text"):
        hashed, n, _ = _shingled(step)
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        low = (hashed >> np.uint64(32)).astype(np.uint32)
        keys = np.empty((bands, len(starts)), np.uint64)
        for band in range(bands if len(starts) else 0):
            key = np.full(len(starts), band + 1, np.uint64)
            for r in range(band * rows, band * rows + rows):
                key = T.mix(key ^ np.minimum.reduceat(low * a[r] + b[r], starts).astype(np.uint64))
            keys[band] = key
        digests = [_digest(s) if len(s) else None for s in _sets(hashed, n)]
        offsets = np.append(0, np.cumsum(np.where(full, bands, 0))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [step.column("id"), step.column("row"), pa.array(n), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.T.ravel().view(np.int64)))],
            names=["id", "row", "n_shingles", "class", "bands"],
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in T.steps(batches, "text"):
        hashed, n, _ = _shingled(step)
        sets = list(_sets(hashed, n))
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.large_binary())], names=["class", "shingles"])


_LINKS = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("texts", pa.int64()), ("p", pa.binary()), ("q", pa.binary())])
LINKS = "class binary, links bigint, texts bigint, p binary, q binary"


def _verified(pairs: pa.Table, threshold: float) -> pa.Table:
    """Links between the texts of two blocks, or of one with itself: counts for each text, and the links (p, q) of a spanning forest.

    Each text stands in the forest as its root: itself within a block, and what its block has joined it to between two.
    So a pair of blocks gives no more links than they have parts that are not joined yet.
    """
    side = pairs.column("side").to_numpy()
    names, roots, weights = pairs.column("class").to_pylist(), pairs.column("root").to_pylist(), pairs.column("copies").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in pairs.column("shingles").to_pylist()]
    # A class may have come in more than one row; the first of each side stands for all.
    first = list({(s, c): i for i, (s, c) in reversed([*enumerate(zip(side.tolist(), names))])}.values())
    # By size, so that texts of which one is far longer never meet.
    first.sort(key=lambda i: (len(sets[i]), names[i]))
    left = [i for i in first if side[i] < 2]
    right = [i for i in first if side[i] in (0, 2)]
    if not left or not right:
        # Blocks are dealt by a hash: one of the two may hold nothing.
        return _LINKS.empty_table()
    same = not (side == 2).any()
    flat, begin = np.concatenate([sets[i] for i in right]), np.cumsum([0] + [len(sets[i]) for i in right])
    universe, where = np.unique(flat, return_inverse=True)
    inside = np.zeros(len(universe) + 1, bool)
    sizes = np.diff(begin)
    parent = {roots[i]: roots[i] for i in first}

    def top(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links, texts, forest = dict.fromkeys(first, 0), dict.fromkeys(first, 0), []
    for k, i in enumerate(left):
        own = len(sets[i])
        lo, hi = np.searchsorted(sizes, [threshold * own - 1e-9, own / threshold + 1e-9])
        if same:
            lo = max(lo, k + 1)
        if lo >= hi:
            continue
        at = np.searchsorted(universe, sets[i])
        at = at[(at < len(universe)) & (universe[np.minimum(at, len(universe) - 1)] == sets[i])]
        inside[at] = True
        common = np.add.reduceat(inside[where[begin[lo] : begin[hi]]], begin[lo:hi] - begin[lo], dtype=np.int64)
        inside[at] = False
        for j in (lo + np.flatnonzero(common >= threshold * (sizes[lo:hi] + own - common) - 1e-9)).tolist():
            j = right[j]
            links[i] += int(weights[j])
            links[j] += int(weights[i])
            texts[i], texts[j] = texts[i] + 1, texts[j] + 1
            if (p := top(roots[i])) != (q := top(roots[j])):
                parent[max(p, q)] = min(p, q)
                forest.append((max(p, q), min(p, q)))
    rows = [(names[i], links[i], texts[i], None, None) for i in first if texts[i]] + [(None, None, None, p, q) for p, q in forest]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_LINKS)], schema=_LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(node, least node of its component) for the nodes of edges (p, q); each end passes on the least it knows.

    Labels are written and read again, as a checkpoint takes along the size that its plan is estimated at, the product of those
    of its joins, whose digits grow by a factor from round to round. Each round costs some stages. Where both directions of all edges are ONE_TASK rows at most, one task goes through them
    without a shuffle, as a round of small stages costs the driver far more than the rows do.
    """
    both = kept(edges.select("p", "q").union(edges.select(F.col("q"), F.col("p"))).where("p is not null").distinct(), "edges")
    few = both.count() <= ONE_TASK
    gathered = lambda rows: rows.coalesce(1) if few else rows
    both = gathered(both)
    labels = kept(both.groupBy("p").agg(F.least(F.min("q"), F.col("p")).alias("label")).withColumnRenamed("p", "node"), "labels")
    while True:
        labels = gathered(labels)
        heard = gathered(both.join(labels.hint("merge"), both["q"] == labels["node"]).groupBy("p").agg(F.min("label").alias("heard")))
        # The label's own label shortens long chains.
        far = labels.select(F.col("node").alias("of"), F.col("label").alias("beyond"))
        new = gathered(labels.join(heard.hint("merge"), labels["node"] == heard["p"]).select("node", "label", F.least("label", "heard").alias("near")))
        new = kept(new.join(far.hint("merge"), new["near"] == far["of"], "left").select("node", F.least("near", F.coalesce("beyond", "near")).alias("label"), (F.least("near", F.coalesce("beyond", "near")) < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def _clusters(classes: DataFrame) -> DataFrame:
    """(node, label): the classes that share a band hash with others, by connected component.

    Each class first joins the least one that it meets in any band, one link for a class; the parts that this makes are
    then joined by what links are left between them, which are few, as near copies meet in almost all of their bands.
    """
    banded = classes.select("class", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("least")).where("n > 1").select("band", "least")
    stars = kept(banded.join(shared, "band").where("class <> least").select("class", "least").distinct(), "stars")
    parts = kept(components(stars.groupBy(F.col("class").alias("p")).agg(F.min("least").alias("q"))), "parts")
    far = parts.select(F.col("node").alias("least"), F.col("label").alias("q"))
    # The least of a band may be in no part of its own: nothing it meets has it as the least of all.
    ends = stars.join(parts.select(F.col("node").alias("class"), F.col("label").alias("p")), "class").join(far, "least", "left")
    left = ends.select("p", F.coalesce("q", "least").alias("q")).where("p <> q").distinct()
    joined = kept(components(left), "joined")
    nodes = parts.union(left.join(parts.select("node"), left["q"] == parts["node"], "left_anti").select("q", "q")).distinct()
    return nodes.join(joined.withColumnRenamed("node", "part").withColumnRenamed("label", "far"), F.col("label") == F.col("part"), "left").select("node", F.coalesce("far", "label").alias("label"))


def row_key(id_column: str, text_column: str) -> Column:
    """128 bits that stand for the id and the text of a row."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(quoted(id_column)).cast("string"), F.lit("none")), F.when(F.col(quoted(text_column)).isNull(), " ").otherwise(":"), F.coalesce(F.col(quoted(text_column)), F.lit("")))))


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: id, row (row_key), head (that of the class), class_id, n_copies, n_links, n_linked_texts.

    class_id is the least id of all rows that links join, directly or over others, and head the key of the row that has it
    (of several, the least key; null ids come last); n_copies are the rows with the same shingle set, n_links the other
    rows linked to this one, n_linked_texts the different shingle sets linked to it.
    """
    bands = band_count(threshold, recall, rows)
    source = docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"), row_key(id_column, text_column).alias("row"), F.col(quoted(text_column)).alias("text"))
    signed = kept(source.mapInArrow(partial(_signed, bands=bands, rows=rows), "id bigint, row binary, n_shingles bigint, class binary, bands array<bigint>"), "signatures")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("one")
    classes = kept(signed.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), one, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    clusters = kept(_clusters(classes), "clusters")
    described = classes.select(F.col("class").alias("node"), "copies", "n_shingles", F.col("one.row").alias("row"))
    sizes = clusters.join(described, "node").groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    sizes = sizes.select("label", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    members = kept(clusters.join(sizes, "label").join(described, "node").select(F.col("node").alias("class"), "label", "n_blocks", "copies", "row"), "members")
    texts = source.join(small(members.select("row")), "row", "left_semi").select("text").mapInArrow(_members, "class binary, shingles binary")
    placed = texts.join(members.drop("row"), "class").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "class"), F.col("n_blocks")).cast("int"))
    placed = kept(placed, "placed")
    verify = lambda pairs: _verified(pairs, threshold)
    # Each block with itself.
    alone = placed.select("class", F.col("class").alias("root"), "copies", "shingles", F.lit(0).cast("bigint").alias("side"), "label", "block")
    within = kept(alone.groupBy("label", "block").applyInArrow(verify, LINKS), "links")
    # Block pairs (i, j) with i < j: side 1 in the lower and 2 in the higher block.
    many = placed.where("n_blocks > 1")
    roots = components(within.where("p is not null").select("p", "q"))
    partner = F.explode(F.filter(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: k != F.col("block"))).alias("other")
    met = many.join(roots.select(F.col("node").alias("class"), F.col("label").alias("root")), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "copies", "shingles", "label", "block", partner)
    met = met.select("class", "root", "copies", "shingles", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") < F.col("other"), 1).otherwise(2).cast("bigint").alias("side"))
    between = kept(met.groupBy("label", "i", "j").applyInArrow(verify, LINKS), "far-links")
    found = within.union(between)
    linked = found.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    joined = components(found.where("p is not null").select("p", "q"))
    groups = classes.select("class", "copies", "one").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    heads = groups.groupBy("label").agg(F.min("one").alias("head"))
    found_classes = groups.join(heads, "label").join(linked, "class", "left").select("class", "head", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    # Kept first, so that the last join has nothing else in its stage and Spark can split the rows of a class with many copies.
    found_classes = kept(found_classes, "found-classes")
    return signed.drop("bands", "n_shingles").join(found_classes, "class", "left").select(
        F.col("id").alias(id_column),
        "row",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("head.row", "row").alias("head"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_linked_texts"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each class, the one of the least id; rows without words all stay."""
    classes = kept(jaccard_classes(docs, id_column, text_column).where("row <> head or n_copies > 1").select("row", "head"), "not-alone")
    gone = kept(classes.where("row <> head").select("row").distinct(), "gone")
    repeated = kept(classes.where("row = head").groupBy("row").count().where("count > 1").select("row"), "repeated")
    held = docs.select(row_key(id_column, text_column).alias("key"), row_of(docs))
    single = held.join(small(gone.union(repeated).select(F.col("row").alias("other"))), F.col("key") == F.col("other"), "left_anti")
    # Rows with equal ids and texts come down to one where they are read, before they are sent.
    several = held.join(small(repeated.select(F.col("row").alias("other"))), F.col("key") == F.col("other"), "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return single.select("row.*").union(several.select("row.*"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("row", "head")
