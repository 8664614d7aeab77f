"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, arrow_batches, blocks, bounded_batches, discard, first_of_runs, materialize, mix64, record_batch, text_bytes
from tessera.llm.components import connected_components

#: Words of a shingle, and the similarity from which documents link, in hundredths.
SHINGLE, PERCENT = 5, 75
#: Shingles that more documents than this have are frequent: they only count in combinations.
RARE = 32
#: Frequent shingles that are told apart, the most frequent first: 8 MB at most go to the executors. All others
#: count as rare. This steers the work and never the result: groups of either kind are compared through hubs.
MAX_FREQUENT = 1_000_000
#: Shingles that one range of the counting holds on average.
RANGE_SHINGLES = 500_000
#: Hubs that a group gets in the second round; each further round has this many times more.
HUBS = 4


#: Bytes of text whose sets are held at once.
HELD_BYTES = 2 << 20


def shingle_sets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with their documents' sets of shingle hashes, sorted.

    A document with fewer words than a shingle has its whole sequence as the only element.
    """
    for batch in it:
        raw, offsets = text_bytes(batch.column("text"))
        for i, j in blocks(offsets, HELD_BYTES):
            yield batch.slice(i, j - i), _sets_of_texts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _sets_of_texts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for i, j in blocks(offsets):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        hashes, at = words.windows(SHINGLE)
        bounds = np.searchsorted(at, words.bounds)
        short = {}
        for size in range(1, SHINGLE):
            if (words.counts == size).any():
                whole, first = words.windows(size, seed=size)
                lone = words.counts[words.doc[first]] == size
                short |= dict(zip(words.doc[first[lone]].tolist(), whole[lone]))
        for k in range(j - i):
            sets.append(np.array([short[k]], np.uint64) if k in short else np.unique(hashes[bounds[k] : bounds[k + 1]]))
    return sets


def set_digest(s: np.ndarray) -> np.uint64:
    """A hash of the whole set: documents with equal sets are one node."""
    both = np.array([np.bitwise_xor.reduce(mix64(s)), s.sum(dtype=np.uint64)], np.uint64)
    return mix64(both[:1] + both[1:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))[0]


_COUNTS = pa.schema([("part", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])
_COUNTS_DDL = "part int, h binary, c binary"
_SIGS = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("r", pa.int32()), ("rank", pa.int32()), ("one", pa.bool_())])
_SIGS_DDL = "sig long, node long, n int, r int, rank int, one boolean"


def parities(s: np.ndarray) -> np.ndarray:
    """A bitmap of the set, 2 to 4 bits a shingle: how often, modulo 2, each value of the hash's low bits occurs.

    Two bitmaps differ in at most as many bits as the sets differ in shingles. The bitmap of half the size is the
    two halves of the larger one added up.
    """
    size = 64 << max(0, int(2 * len(s) - 1).bit_length() - 6)
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in shingle_sets(it):
        digests = np.array([set_digest(s) for s in sets], np.uint64).view(np.int64)
        bits = [parities(s) for s in sets]
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int32), np.concatenate(bits))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests), lists], names=["doc_id", "n", "node", "bits"])


def _distinct(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) for the different non-empty sets of a batch: copies count once."""
    seen = set()
    for s in sets:
        if len(s) and (d := int(set_digest(s).view(np.int64))) not in seen:
            seen.add(d)
            yield d, s


def _counted(parts: int):
    """Counts of the shingles of a portion of documents, packed by range of the hash: a row is (range, hashes, counts)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for _, sets in shingle_sets(it):
            own = [s for _, s in _distinct(sets)]
            if own:
                h, c = np.unique(np.concatenate(own), return_counts=True)
                c = c.astype(np.int64)
                ends = np.concatenate([[0], np.searchsorted(h, borders), [len(h)]])
                full = np.flatnonzero(np.diff(ends))
                yield record_batch(_COUNTS, full, *(pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary()) for x in (h, c)))

    return run


def _frequent_of_ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: adds up the counts of one range at a time and gives the frequent shingles."""
    part, h, c = None, [], []

    def added():
        both, where = np.unique(np.concatenate(h), return_inverse=True)
        return [both], [np.bincount(where, weights=np.concatenate(c)).astype(np.int64)]

    def frequent():
        (both,), (count,) = added()
        on = count > RARE
        return pa.RecordBatch.from_arrays([pa.array(both[on].view(np.int64)), pa.array(count[on])], names=["h", "c"])

    for batch in it:
        for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if k != part:
                if h:
                    yield frequent()
                part, h, c = k, [], []
            h.append(np.frombuffer(x, np.uint64))
            c.append(np.frombuffer(y, np.int64))
            if sum(map(len, h[1:])) > max(len(h[0]), 1 << 18):
                h, c = added()
    if h:
        yield frequent()


def classes_of_band(band: int) -> int:
    """Into how many classes the frequent shingles of documents of this size band fall: about 4 a class in a prefix."""
    return max(1, round((4 / 3) ** band / 16))


def bands_of(n: int) -> tuple[int, int]:
    """Two documents that can link differ by one size level at most, so they have one of these bands in common."""
    level = int(np.floor(np.log(n) / np.log(4 / 3) + 1e-9))
    return level, level + 1


def among(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which elements of ``s`` are in the sorted table."""
    return table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s if len(table) else np.zeros(len(s), bool)


def signatures(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's signatures: its rare prefix shingles, and hashes of pairs of its frequent prefix shingles.

    Prefixes follow one order over all shingles: rare ones before frequent ones, then by hash. Of n shingles at
    most n - ceil(0.75 n) can be missing in a partner. Frequent shingles fall into classes; a class of m of them
    still has two in common with the partner unless m - 1 are missing. So a prefix is long enough once (rare
    ones) + sum of (m - 1) over its classes exceeds what can be missing: then any partner shares a rare shingle
    of the prefix, or two of one class.
    """
    n = len(s)
    need = n - -(-PERCENT * n // 100) + 1
    common = among(frequent, s)
    rare, rest = s[~common], s[common]
    if len(rare) >= need:
        return rare[:need], np.empty(0, np.uint64)
    combos = []
    for band in bands_of(n):
        classes = np.uint64(classes_of_band(band))
        label = (mix64(rest) % classes).astype(np.int64)
        # a shingle adds to the cover unless it is the first of its class
        first = np.zeros(len(rest), bool)
        first[np.unique(label, return_index=True)[1]] = True
        cover = len(rare) + np.cumsum(~first)
        stop = int(np.searchsorted(cover, need)) + 1
        for c in np.unique(label[:stop]):
            members = rest[:stop][label[:stop] == c]
            i, j = np.triu_indices(len(members), 1)
            a, b = np.minimum(members[i], members[j]), np.maximum(members[i], members[j])
            combos.append(mix64(mix64(a) * np.uint64(3) + b + np.uint64(band)))
    return rare, np.concatenate(combos) if combos else np.empty(0, np.uint64)


def _signed(frequent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for _, sets in shingle_sets(it):
            parts = []
            for node, s in _distinct(sets):
                one, two = signatures(s, table)
                r = len(s) - int(among(table, s).sum()) if len(two) else len(s)
                parts.append((np.concatenate([one, two]), node, len(s), r, len(one), len(one) + len(two)))
                if len(parts) >= 2000:
                    yield _pack(parts)
                    parts = []
            if parts:
                yield _pack(parts)

    return run


def _pack(parts: list) -> pa.RecordBatch:
    """Signatures as rows. ``r`` is the number of rare shingles where combinations are among the signatures (all
    of them are signatures then), else the set's size; ``rank`` is low for sets of mostly frequent shingles."""
    total = [p[5] for p in parts]
    one = np.concatenate([np.arange(p[5]) < p[4] for p in parts])
    each = (np.repeat(np.array([f(p) for p in parts], np.int64), total) for f in (lambda p: p[1], lambda p: p[2], lambda p: p[3], lambda p: 1000 * p[3] // p[2]))
    return record_batch(_SIGS, np.concatenate([p[0] for p in parts]).view(np.int64), *each, one)


_GROUPS = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("r", pa.int32()), ("one", pa.bool_()), ("hub", pa.int64()), ("hub_n", pa.int32()), ("hub_r", pa.int32())])
_GROUPS_DDL = "sig long, node long, n int, r int, one boolean, hub long, hub_n int, hub_r int"


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, rank, node): the groups of two nodes or more, each row with its group's first node.

    Only that first row is carried from batch to batch, however large a group is.
    """
    head, last, told = None, None, False  # first row of the open group, its last node, whether the first row was given
    for batch in arrow_batches(it, ["sig", "node", "n", "r", "one"]):
        keep = first_of_runs(batch[0], batch[1])  # copies of one node come from different batches
        keep[0] &= head is None or (batch[0][0], batch[1][0]) != (head[0][0], last)
        rows = [x[keep] for x in batch]
        if head is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(head, rows)]
        sig, node, n, r, one = rows
        start = np.flatnonzero(first_of_runs(sig))
        size = np.diff(np.append(start, len(sig)))
        out = np.repeat(size > 1, size)
        if told:
            out[0] = False
        hub = np.repeat(start, size)
        yield record_batch(_GROUPS, *(x[out] for x in rows), node[hub][out], n[hub][out], r[hub][out])
        told = bool(size[-1] > 1) or told and len(start) == 1
        head, last = [x[start[-1] :][:1] for x in rows], node[-1]


def _may_link(n, r, m, q, one):
    """Whether sets of n and m shingles, r and q of them rare, can reach the similarity.

    Two sets that share a combination and no rare shingle have at most their frequent ones in common; if they
    share a rare one too, they also meet in that one's group.
    """
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return sizes & (one | (F.least(n - r, m - q) >= _least_overlap(n, m)))


_SETS_DDL = "node long, items array<long>"


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in shingle_sets(it):
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        items = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
        digests = pa.array(np.array([set_digest(s) for s in sets], np.uint64).view(np.int64))
        same = pa.compute.equal(digests, batch.column("node"))
        yield pa.RecordBatch.from_arrays([digests, items], names=["node", "items"]).filter(same)


def _frequent(texts: DataFrame, shingles: int) -> np.ndarray:
    """Sorted hashes of at most MAX_FREQUENT shingles with the highest counts over RARE; counts cover all texts."""
    parts = max(16, -(-shingles // RANGE_SHINGLES))
    counts = texts.mapInArrow(_counted(parts), _COUNTS_DDL).repartition("part").sortWithinPartitions("part")
    often = materialize(counts.mapInArrow(_frequent_of_ranges, "h long, c long"), "ngram-frequent")
    top = often.orderBy(F.desc("c"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    discard(often)
    return np.sort(top.column("h").to_numpy().view(np.uint64)) if top.num_rows else np.empty(0, np.uint64)


def _differing(x, y):
    """Bits in which two bitmaps differ, the larger one cut to the other's size."""

    def half(v):
        n = (F.size(v) / 2).cast("int")
        return F.zip_with(F.slice(v, 1, n), F.slice(v, n + 1, n), lambda p, q: p.bitwiseXOR(q))

    def same(v, w):
        return F.when(F.size(v) > F.size(w), half(v)).otherwise(v)

    each = F.zip_with(same(x, y), same(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(each, F.lit(0), lambda total, k: total + k)


def _least_overlap(n, m):
    return F.ceil(PERCENT * (n + m) / F.lit(100.0 + PERCENT) - 1e-9)


def _links(pairs: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is high enough.

    Bitmaps rule out pairs that differ in too many shingles; the whole sets of the others are compared, made
    from the texts of the documents that own the nodes.
    """
    for side in ("a", "b"):
        pairs = pairs.join(owners.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    n, m = F.col("n_a"), F.col("n_b")
    near = pairs.filter(_differing(F.col("bits_a"), F.col("bits_b")) <= n + m - 2 * _least_overlap(n, m))
    near = materialize(near.select("a", "b"), "ngram-near")
    needed = near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(owners.select("node", "owner"), "node")
    needed = materialize(needed, "ngram-needed")
    texts = docs.join(needed, docs["doc_id"].eqNullSafe(needed["owner"])).select("node", "text")
    sets = materialize(texts.mapInArrow(_sets, _SETS_DDL), "ngram-sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    link = F.col("common") * 100 >= PERCENT * (F.size("x") + F.size("y") - F.col("common"))
    out = materialize(both.filter(link).select("a", "b").distinct(), "ngram-links")
    discard(near, needed, sets)
    return out


def _unordered(a: str, b: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _components_of_groups(groups: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a link.

    Rounds of hubs: a group's hub is compared with the group's other nodes, nodes that turn out linked are one
    component from then on, and the hub leaves the group, as all its pairs are known. Pairs are only made between
    different components that can still reach the similarity. A group is done once it lies within one component.
    The first hub is the node whose shingles are the most frequent, the likely original of a family of copies;
    later ones are nodes of the smallest components.
    """
    first = groups.filter("node <> hub").filter(_may_link(F.col("n"), F.col("r"), F.col("hub_n"), F.col("hub_r"), F.col("one")))
    pairs = _unordered("hub", "node", first)
    links = new = _links(pairs, owners, docs)
    before = None  # labels and open rows of the round before
    # all groups of one hub are one group from here on: its pairs include theirs, and a family is there only once
    merged = groups.filter("node <> hub").select(F.xxhash64("hub", "one").alias("sig"), "node", "n", "r", "one").distinct()
    open_rows, hubs = materialize(merged, "ngram-merged"), HUBS
    while True:
        labels = connected_components(links)
        discard(new)
        sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
        placed = open_rows.join(labels.join(sizes, "root"), "node", "left")
        placed = placed.select("sig", "node", "n", "r", "one", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
        spans = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("sig")
        placed = materialize(placed.join(spans, "sig", "left_semi"), "ngram-open")
        discard(*(before or ()))
        if placed.isEmpty():
            return labels
        chosen = placed.withColumn("k", F.expr("row_number() over (partition by sig order by size, node)")).filter(F.col("k") <= hubs)
        chosen = materialize(chosen, "ngram-hubs")
        hub = chosen.select("sig", *(F.col(c).alias(f"hub_{c}") for c in ("node", "n", "r", "root")))
        met = placed.join(hub, "sig").filter((F.col("root") != F.col("hub_root")) & _may_link(F.col("n"), F.col("r"), F.col("hub_n"), F.col("hub_r"), F.col("one")))
        fresh = _unordered("hub_node", "node", met)
        new = _links(fresh, owners, docs)
        links = labels.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)
        open_rows = placed.join(chosen, ["sig", "node"], "left_anti").select("sig", "node", "n", "r", "one")
        before, hubs = (labels, placed, chosen), hubs * HUBS


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that are linked by a Jaccard similarity of their word 5-shingles of 0.75 or more.

    Documents with equal sets are one node, so copies are not compared with one another. Each node indexes its
    signatures (see ``signatures``): rare shingles of its prefix, combinations of two where shingles are
    frequent. Nodes that share a signature are a group; groups are compared through hubs (see
    ``_components_of_groups``) and every pair is verified on the whole sets, so no link between components is lost
    and a family of copies makes pairs in proportion to its members.

    Texts are lower-cased (A-Z), words are split at ASCII white space. Defined cases: null or blank text has an
    empty set, linked with nothing; with fewer than five words the whole sequence is the only element; repeated
    rows get one component; a null id is never a component's name unless all its ids are null; an empty table
    gives no rows; other columns are not read. Sets are of 64-bit hashes.

    Returns doc_id, n_shingles, component_id (smallest id reachable, itself included).
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    nodes = materialize(docs.mapInArrow(_nodes, "doc_id long, n int, node long, bits array<long>"), "ngram-nodes")
    owners = materialize(nodes.filter("n > 0").groupBy("node", "n", "bits").agg(F.min("doc_id").alias("owner")), "ngram-owners")

    texts = docs.select("text")
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = spark.sparkContext.broadcast(_frequent(texts, shingles))
    signed = texts.mapInArrow(_signed(frequent), _SIGS_DDL)
    groups = materialize(signed.repartition("sig").sortWithinPartitions("sig", "rank", "node").mapInArrow(_groups, _GROUPS_DDL), "ngram-groups")
    labels = _components_of_groups(groups, owners, docs)

    placed = nodes.join(labels, "node", "left").withColumn("part", F.coalesce("root", "node"))
    names = placed.filter("n > 0").groupBy("part").agg(F.min("doc_id").alias("name"))
    out = placed.join(names, "part", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), e AS (
  SELECT doc_id, unnest(g) AS t FROM s
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM c JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE 100 * k >= 75 * (len(p.g) + len(q.g) - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT s.doc_id, len(s.g) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = s.doc_id) AS component_id FROM s
"""
