"""N-gram Jaccard self-join by chosen paths, and the near-duplicate classes that its links make."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import text as tx
from factloom.llm.words import mix, slices, word_hashes

_U = np.uint64
#: Odd multipliers of the words of a shingle, by place.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


@dataclass(frozen=True)
class Paths:
    """Parameters of the join.

    A set chooses about ``branches`` of its tokens at each of ``levels`` levels of a run, the same ones as any other
    set that has them and is as large. Sets that chose the same tokens so far share a bucket; buckets of up to
    ``bucket`` sets are compared in full, larger ones are split by the next level, and what no level splits is
    compared in blocks of ``bucket``, so every bucket is compared in full.
    """

    similarity: float = 0.8
    recall: float = 0.9999
    branches: float = 2.5
    levels: int = 3
    bucket: int = 1024
    width: int = 5

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has met with probability ``recall``."""
        met = 1.0
        for _ in range(self.levels):  # a shared token is chosen by both with chance branches / larger set
            met = 1 - math.exp(-self.similarity * self.branches * met)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - met))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word windows of each text, lower-cased; a shorter text is one window.

    Words stand between ASCII white space. A null, empty or blank text has an empty set.
    """
    coded, bounds = word_hashes(texts)
    n = max(len(coded) - width + 1, 0)
    places = _PLACES if width <= len(_PLACES) else mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    windows = np.zeros(n, dtype=_U)
    for k in range(width):
        windows += coded[k : k + n] * places[k]
    windows = mix(windows)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(coded[a:b].tobytes())], dtype=_U))
        else:
            out.append(coded[:0])
    return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame, paths: Paths) -> DataFrame:
    """doc_id, row key, digest of the shingle set, its size, and the tokens that it chooses (slot = run * levels + level)."""
    slots = paths.runs * paths.levels
    seeds = mix(np.arange(1, slots + 1, dtype=_U) * _PLACES[0])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), paths.width)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                tokens = np.concatenate([*sets, np.empty(0, dtype=_U)])
                of = np.repeat(np.arange(len(sets)), size)
                share = np.minimum(paths.branches / np.maximum(size, 1), 1.0)[of]
                limit = (share * float(2**53)).astype(_U)
                rows, slot, token = [], [], []
                for s, seed in enumerate(seeds):
                    chosen = np.flatnonzero((mix(tokens ^ seed) >> _U(11)) < limit)
                    rows.append(of[chosen])
                    slot.append(np.full(len(chosen), s, dtype=np.int32))
                    token.append(tokens[chosen])
                rows, slot, token = np.concatenate(rows), np.concatenate(slot), np.concatenate(token)
                order = np.argsort(rows, kind="stable")
                cut = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sets)))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(slot[order]), pa.array(token[order].view(np.int64))], ["slot", "token"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(size), pa.ListArray.from_arrays(pa.array(cut), pairs)],
                    ["doc_id", "row", "digest", "size", "chosen"],
                )

    scratch.small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", tx.row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    return keyed.mapInArrow(sketch, "doc_id long, row binary, digest binary, size long, chosen array<struct<slot:int,token:long>>")


def _buckets(classes: DataFrame, paths: Paths) -> DataFrame:
    """digest, bucket, members: the sets of each bucket that has to be compared; every two buckets differ.

    Hot buckets are counted with partial sums, and rows meet those counts in joins that Spark can split.
    """
    chosen = classes.select("digest", F.explode("chosen").alias("c")).select("digest", "c.slot", "c.token")
    level = chosen.where(F.col("slot") % paths.levels == 0).select("digest", F.floor(F.col("slot") / paths.levels).cast("int").alias("run"), F.xxhash64("slot", "token").alias("bucket"))
    final: list[DataFrame] = []
    for k in range(paths.levels):
        level = scratch.stored(level, f"paths-{k}")
        mark = F.xxhash64("digest")
        counts = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(F.shiftright(mark, 20)).alias("sum"), F.bit_xor(mark).alias("xor")).where("members > 1")
        counts = scratch.stored(counts, f"buckets-{k}")
        large = counts.where(F.col("members") > paths.bucket)
        if k + 1 == paths.levels or large.isEmpty():
            final.append(level.join(counts, "bucket").select("digest", "bucket", "members", "sum", "xor"))
            break
        final.append(level.join(counts.where(F.col("members") <= paths.bucket), "bucket").select("digest", "bucket", "members", "sum", "xor"))
        held = scratch.stored(level.join(large.select("bucket", "members"), "bucket"), f"large-{k}")
        later = chosen.where(F.col("slot") % paths.levels == k + 1).select("digest", F.floor(F.col("slot") / paths.levels).cast("int").alias("run"), "slot", "token")
        below = scratch.stored(held.join(later, ["digest", "run"]).select("digest", "run", F.col("bucket").alias("parent"), "members", F.xxhash64("bucket", "slot", "token").alias("bucket")), f"below-{k}")
        # a bucket of which one token keeps more than half is one group of like sets: no level would split it
        dense = below.groupBy("parent", "members", "bucket").agg(F.count(F.lit(1)).alias("n")).where("2 * n > members").select(F.col("parent").alias("bucket")).distinct()
        dense = scratch.stored(dense, f"dense-{k}")
        final.append(level.join(counts.join(dense, "bucket", "left_semi"), "bucket").select("digest", "bucket", "members", "sum", "xor"))
        level = below.join(dense.withColumnRenamed("bucket", "parent"), "parent", "left_anti").select("digest", "run", "bucket")
    rows = final[0]
    for x in final[1:]:
        rows = rows.unionByName(x)
    rows = scratch.stored(rows, "bucket-rows")
    once = rows.groupBy("members", "sum", "xor").agg(F.min("bucket").alias("bucket")).select("bucket")
    return scratch.stored(rows.select("digest", "bucket", "members").join(once, "bucket", "left_semi"), "bucket-members")


def _compare(bucket: int, left: list, right: list | None, similarity: float) -> Iterator[tuple[bytes, bytes, int, int]]:
    """digest, root, linked classes and linked documents of each set that has links within the group.

    ``left`` and ``right`` are blocks of (digest, copies, buckets, set); without ``right`` all pairs of ``left``. Two
    sets that share several buckets are compared in the least one only.
    """
    rows = left + (right or [])
    n, a = len(rows), len(left)
    size = np.array([len(r[3]) for r in rows], dtype=np.int64)
    if n <= 24:
        shared = np.zeros((n, n), dtype=np.int64)
        for i in range(a):
            for j in range(i + 1 if right is None else a, n):
                if 10 * min(size[i], size[j]) >= 10 * similarity * max(size[i], size[j]):
                    shared[i, j] = len(np.intersect1d(rows[i][3], rows[j][3], assume_unique=True))
    else:
        tokens, of = np.concatenate([r[3] for r in rows]), np.repeat(np.arange(n), size)
        _, column, often = np.unique(tokens, return_inverse=True, return_counts=True)
        keep = often[column] > 1
        names, column = np.unique(column[keep], return_inverse=True)
        of = of[keep]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        shared = np.zeros((n, n), dtype=np.float32)
        for c in range(0, len(names), 4096):
            lo, hi = np.searchsorted(column, [c, c + 4096])
            held = np.zeros((n, min(4096, len(names) - c)), dtype=np.float32)
            held[of[lo:hi], column[lo:hi] - c] = 1
            shared[:a] += held[:a] @ held.T
        shared = np.rint(shared).astype(np.int64)
    linked = shared * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
    linked &= shared > 0
    allowed = np.zeros((n, n), dtype=bool)
    if right is None:
        allowed[np.triu_indices(n, 1)] = True
    else:
        allowed[:a, a:] = True
    linked &= allowed
    if linked.any():
        members: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for b in r[2]:
                if b < bucket:
                    members.setdefault(b, []).append(i)
        for m in members.values():
            if len(m) > 1:
                linked[np.ix_(m, m)] = False
    if not linked.any():
        return
    copies = np.array([r[1] for r in rows], dtype=np.int64)
    both = linked | linked.T
    links, documents = both.sum(1), both @ copies
    root = np.full(n, -1)
    for start in np.flatnonzero(links):
        if root[start] < 0:
            reached = np.zeros(n, dtype=bool)
            front = reached.copy()
            front[start] = True
            while front.any():
                reached |= front
                front = both[front].any(0) & ~reached
            root[reached] = start
    for i in np.flatnonzero(links).tolist():
        yield rows[i][0], rows[root[i]][0], int(links[i]), int(documents[i])


def _places(members: DataFrame, paths: Paths) -> DataFrame:
    """digest, buckets (sorted) and places (bucket, blocks i and j, own block): the groups that each set is compared in."""
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", F.ceil(F.col("members") / paths.bucket).cast("int")).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    each = dealt.select("digest", "bucket", "block", other).select("digest", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return each.groupBy("digest").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"), F.collect_list(F.struct("bucket", "i", "j", "block")).alias("places"))


def _linked(sets: DataFrame, paths: Paths, partitions: int) -> DataFrame:
    """digest, root, links, documents from each group of ``sets(digest, copies, buckets, places, tokens)``."""
    each = sets.select("digest", "copies", "buckets", "tokens", F.explode("places").alias("p")).select("p.*", "digest", "copies", "buckets", "tokens")
    rows = each.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block")
    similarity = paths.similarity

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right, met = None, [], [], set()
        out: list = []

        def flush() -> None:
            if key is not None and len(left) + len(right) > 1:
                out.extend(_compare(key[0], left, None if key[1] == key[2] else right, similarity))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "root", "links", "documents"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "digest", "copies", "buckets", "tokens")]
            for bucket, i, j, at, digest, copies, buckets, tokens in zip(*columns, strict=True):
                if key != (bucket, i, j):
                    flush()
                    key, left, right = (bucket, i, j), [], []
                    met = set()
                if digest not in met:  # rows that repeat a doc_id and its text come twice
                    met.add(digest)
                    (left if at == i else right).append((digest, copies, buckets, np.frombuffer(tokens, dtype=_U)))
            if len(out) > 10_000:
                yield made()
        flush()
        yield made()

    columns = ("bucket", "i", "j", "block", "digest", "copies", "buckets", "tokens")
    return rows.select(*columns).mapInArrow(compare, "digest binary, root binary, links long, documents long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of ``edges(a, b)``; nothing is gathered on the driver.

    Each round hangs every node on the least of itself and its neighbours and contracts the edges, so edges shrink
    until none is left; then the rounds are read backwards.
    """
    both = edges.select("a", "b").where("a <> b")
    both = scratch.stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hung: list[DataFrame] = []
    while not both.isEmpty():
        parent = scratch.stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), "parents")
        hung.append(parent)
        one = both.join(parent, both["a"] == parent["node"]).select(F.col("up").alias("a"), "b")
        two = one.join(parent, one["b"] == parent["node"]).select("a", F.col("up").alias("b")).where("a <> b")
        both = scratch.stored(two.distinct(), "edges")
    if not hung:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = hung[-1].select("node", F.col("up").alias("component"))
    # a parent may hang itself in the same round, so the last round is closed by its own steps
    for parent in [hung[-1], *reversed(hung[:-1])]:
        upper = out.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        if parent is hung[-1]:
            closed = False
            while not closed:
                upper = out.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
                step = scratch.stored(out.join(upper, out["component"] == upper["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"), (F.coalesce("_c", "component") != F.col("component")).alias("moved")), "jump")
                closed = step.where("moved").isEmpty()
                out = step.select("node", "component")
            continue
        found = parent.join(upper, parent["up"] == upper["_n"], "left").select("node", F.coalesce("_c", "up").alias("component"))
        rest = upper.join(found.select(F.col("node").alias("_f")), F.col("_n") == F.col("_f"), "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("component"))
        out = scratch.stored(found.unionByName(rest), "labels")
    return out


def _classified(docs: DataFrame, paths: Paths | None) -> DataFrame:
    """Every row of ``docs`` with its row key, set, links, and the least row (id, then key; no id last) of its copies and of its class."""
    paths = paths or Paths()
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = scratch.stored(sketches(docs, paths), "sketches")
    some = drawn.where("size > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("lead")
    counted = scratch.stored(some.groupBy("digest").agg(lead, F.count(F.lit(1)).alias("copies")), "set-classes")
    first = some.join(counted.hint("shuffle_hash"), "digest").where(F.col("row") == F.col("lead.row")).select("digest", "chosen").dropDuplicates(["digest"])
    members = _buckets(scratch.stored(first, "set-paths"), paths)
    needed = _places(members, paths).join(counted, "digest")
    needed = scratch.stored(needed.select(F.col("lead.row").alias("key"), F.col("digest").alias("wanted"), "copies", "buckets", "places"), "wanted-sets")
    width = paths.width

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                same = pa.array([_digest(s) == w for s, w in zip(sets, part.column("wanted").to_pylist(), strict=True)], pa.bool_())
                made = pa.RecordBatch.from_arrays([part.column("wanted"), *(part.column(c) for c in ("copies", "buckets", "places")), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "copies", "buckets", "places", "tokens"])
                yield made.filter(same)

    texts = docs.select(tx.row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").join(needed.hint("shuffle_hash"), "key")
    schema = "digest binary, copies long, buckets array<long>, places array<struct<bucket:long,i:int,j:int,block:int>>, tokens binary"
    sets = texts.select("wanted", "copies", "buckets", "places", "text").mapInArrow(again, schema)
    found = scratch.stored(_linked(sets, paths, partitions), "links")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    groups = scratch.stored(components(found.select(F.col("digest").alias("a"), F.col("root").alias("b"))), "components")
    labelled = counted.join(groups.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = labelled.groupBy("component").agg(F.min("lead").alias("least"))
    classes = scratch.stored(labelled.join(least, "component").join(links, "digest", "left").select("digest", "least", "lead", "copies", "links", "documents"), "classes")
    return drawn.select("doc_id", "row", "size", "digest").join(classes, "digest", "left")


def jaccard_join(docs: DataFrame, paths: Paths | None = None) -> DataFrame:
    """Near-duplicate class and links of every row of ``docs(doc_id, text)``.

    doc_id; class_id, the least doc_id of all documents that links connect with it; copy_of, the least doc_id with
    the same shingle set; n_links, other documents whose shingle sets have Jaccard similarity 0.8 or more with its
    own (copies included); n_text_links, the same in different sets. Copies are joined as one set, so they are never
    paired. Documents without a word link with nothing and are their own class. Null ids are left out of class_id and
    copy_of unless nothing else is in the class. Repeated rows are copies. Other columns are ignored. Every link
    between documents that share a bucket is found; ``Paths.recall`` bounds the chance to share one at the threshold.
    """
    linked = F.when(F.col("size") > 0, F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).otherwise(F.lit(0))
    return _classified(docs, paths).select(
        "doc_id",
        F.coalesce("least.doc_id", "doc_id").alias("class_id"),
        F.coalesce("lead.doc_id", "doc_id").alias("copy_of"),
        linked.cast("long").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def one_of_each(docs: DataFrame, paths: Paths | None = None) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, the one with the least doc_id, with all its columns.

    A null id comes after all others, and of equal ids the row with the least key of id and text stays. Of rows that
    repeat both, any one stays. Rows without a word are classes of their own and all stay.
    """
    held = _classified(docs, paths).where("size > 0").groupBy("row").agg(F.max(F.col("row") == F.col("least.row")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = scratch.stored(held.where("NOT stays OR n > 1").select(F.col("row").alias("_row"), "stays"), "near-duplicates")
    keyed = docs.select(F.struct("*").alias("_all"), tx.row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    kept = keyed.join(marks.select("_row").hint("shuffle_hash"), "_row", "left_anti").select("_all")
    again = marks.where("stays").select("_row")
    if not again.isEmpty():  # rows that stand several times
        once = keyed.join(again.hint("shuffle_hash"), "_row", "left_semi").groupBy("_row").agg(F.first("_all").alias("_all"))
        kept = kept.unionByName(once.select("_all"))
    return kept.select("_all.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
c AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, count(*) AS copies, list(doc_id) AS docs FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT rep, len(s) AS n, copies, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM t a JOIN t b ON a.g = b.g AND a.rep <> b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 18 * count(*) >= 8 * (a.n + b.n)),
r(node, low) AS (SELECT rep, rep FROM c UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.node WHERE r.low < p.b),
k AS (SELECT node, min(low) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n, sum(copies) AS docs FROM p GROUP BY a),
m AS (SELECT unnest(docs) AS doc_id, rep, copies FROM c)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(m.rep, d.doc_id) AS copy_of,
       CAST(coalesce(m.copies - 1, 0) + coalesce(l.docs, 0) AS BIGINT) AS n_links, CAST(coalesce(l.n, 0) AS BIGINT) AS n_text_links
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k ON k.node = m.rep LEFT JOIN l ON l.a = m.rep"""
