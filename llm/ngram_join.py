"""Exact n-gram Jaccard join by vertical partitioning, as linked components.

Shingles are ordered by their hash; that global order is cut into fragments.

1. Document frequencies: each fragment gets the shingles of its range, one entry
   per shingle and slice of documents, and counts for every document how many of
   its shingles occur elsewhere.  A partner at similarity t must share t of a
   document's shingles, so documents with fewer are done.
2. The rest is collapsed to distinct sets (nodes) by fingerprints that step 1 made;
   tokens are read of one document of each.  Two sets within t differ in at most D shingles, so of m > D fragments of the order at least m - D agree whole.
   Fragment signatures give candidates: a signature's hub, the node with the
   fewest shingles of its own, is paired with each of its other nodes.
3. The sets of a pair are cut into fragments of the order.  Each fragment counts
   the overlap of its two parts by itself, as a row; the rows are summed per pair
   and pairs that reach the threshold are links.
4. A signature whose other nodes are now connected is done.  What is left are
   groups with nodes that missed the threshold.  Two sets within t share m - D
   signatures, empty fragments apart, so nodes with fewer open ones are done, and of
   the rest each node's rarest signatures name all that it may link with (the prefix
   lemma).  Groups of those are paired and counted as in 3, the largest are cut into
   tiles, where a row holds the overlaps of one fragment between all nodes of two
   tiles; the rows are summed per pair of tiles.
5. Components of the links are the result.

Signatures, pairs and tiles run in waves that send about as many bytes as all sets
have, and a wave's files go before the next: steps 3 and 4 send a set once per pair.

Copies never multiply: they are one node.  A common shingle is one entry per
slice.  No candidate is dropped.

Defined cases: null and empty texts have no shingles and link with nothing; a
text with fewer words than k has one shingle, the whole sequence; texts of any
length are read whole; a null doc_id is counted but linked with nothing, its
component is null; rows that share a doc_id are one document in links; of equal
hubs the smallest doc_id is taken; extra columns are ignored (``one_of_each``
keeps them), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import BROADCAST_ROWS, by_key, data_parts, discard, map_arrow, partitions, table, written
from llm.components import components
from llm.kernels import U64, distinct_sets, lower_ascii, mix, shingles, text_buffer

#: Bytes of text whose shingles are in memory at once.
SLICE_BYTES = 1 << 20
#: Fragments per shuffle partition when frequencies are counted.
FRAGMENTS = 4
#: Fragments that the sets of candidate pairs are cut into.
PAIR_FRAGMENTS = 8
#: Members of a hub that one join key holds; nodes of a group that is paired whole; nodes of a tile.
MEMBERS, SMALL, TILE = 512, 256, 256
#: Least bytes that a wave of signatures, pairs or tiles sends; bytes that a signature counts as.
WAVE_BYTES, SIG_BYTES = 256 << 20, 32
#: Columns of a dense block when overlaps of tiles are counted.
BLOCK = 2048
NULL_ID = np.iinfo(np.int64).min
PARTS = "fragment int, batch long, kind int, a binary, b binary, c binary"


def _ids(col: pa.Array) -> np.ndarray:
    return np.asarray(col.cast(pa.int64()).fill_null(NULL_ID))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, first row, last row, ids, bytes, offsets) of at most SLICE_BYTES, or one longer text."""
    for batch in batches:
        ids = _ids(batch.column(0))
        buf, off = text_buffer(batch.column(1))
        a = 0
        while a < len(ids):
            b = max(a + 1, min(a + 60_000, int(np.searchsorted(off, off[a] + SLICE_BYTES, side="right")) - 1))
            yield batch, a, b, ids[a:b], buf[off[a]:off[b]], off[a:b + 1] - off[a]
            a = b


def sets_of(buf: np.ndarray, off: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    h, d = shingles(lower_ascii(buf) if lower else buf, off, k)
    return distinct_sets(h, d, len(off) - 1)


def _batch(cols: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=names)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return _batch([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()),
                   *(pa.array(x, pa.binary()) for x in c[3:])], ["fragment", "batch", "kind", "a", "b", "c"])


def fingerprints(h: np.ndarray, o: np.ndarray) -> list[bytes]:
    """128-bit fingerprints of the sets that are not empty."""
    n = np.diff(o)
    some = np.flatnonzero(n)
    if not len(some):
        return []
    f1 = mix(np.add.reduceat(mix(h), o[some]) + n[some].astype(U64))
    f2 = mix(np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), o[some]) + U64(1))
    fp = np.stack([f1, f2], 1).astype(">u8").tobytes()
    return [fp[i: i + 16] for i in range(0, len(fp), 16)]


def shared_counts(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, shared, fp): the size of each document's set, how many of its
    shingles occur in another document too (never too few; a collision of 32 bits
    inside a fragment may count one too many), and the set's fingerprint (null: none)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    n_frag = data_parts(docs, FRAGMENTS * parts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for *_, ids, buf, off in sliced(batches):
            h, o = sets_of(buf, off, k)
            n = np.diff(o)
            fps = fingerprints(h, o)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            multi = same.copy()
            multi[:-1] |= same[1:]
            base = np.bincount(doc[multi], minlength=len(n)).astype(np.int32)
            frag = ((h >> U64(32)) * U64(n_frag)) >> U64(32)
            cut = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]])) if len(frag) else np.zeros(0, np.int64)
            key = (part << 32) | seq
            seq += 1
            rows = [(key % n_frag, key, 1, ids.tobytes(), n.astype(np.int32).tobytes(), base.tobytes() + b"".join(fps))]
            low = h.astype(np.uint32)
            once, head = ~multi, multi & ~same
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)]):
                rows.append((int(frag[a]), key, 0, low[a:b][once[a:b]].tobytes(), doc[a:b][once[a:b]].astype(np.uint16).tobytes(),
                             low[a:b][head[a:b]].tobytes()))
            yield _parts(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, rows in by_key(batches):  # one fragment at a time
            out = [(f, key, 1, a, b, c) for key, kind, a, b, c in rows if kind == 1]
            rows = [(key, np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint32)) for key, kind, a, b, c in rows if kind == 0]
            toks = np.concatenate([r[1] for r in rows] + [r[3] for r in rows]) if rows else np.zeros(0, np.uint32)
            order = np.argsort(toks, kind="stable")
            same = np.zeros(len(toks), bool)
            same[1:] = toks[order][1:] == toks[order][:-1]
            same[:-1] |= same[1:]
            shared = np.zeros(len(toks), bool)
            shared[order] = same
            at = 0
            for key, tok, doc, _ in rows:
                hit = doc[shared[at: at + len(tok)]]
                at += len(tok)
                if len(hit):
                    out.append((f, key, 2, np.bincount(hit).astype(np.int32).tobytes(), b"", b""))
            if out:
                yield _parts(out)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):  # one slice of documents at a time
            a, b, c = next(r[2:] for r in rows if r[1] == 1)
            ids, n = np.frombuffer(a, np.int64), np.frombuffer(b, np.int32)
            shared, fps = np.frombuffer(c, np.int32, len(ids)).astype(np.int64), iter(range(4 * len(ids), len(c), 16))
            fp = [c[(at := next(fps)): at + 16] if some else None for some in (n > 0).tolist()]
            for _, kind, x, *_ in rows:
                if kind == 2:
                    add = np.frombuffer(x, np.int32)
                    shared[: len(add)] += add
            yield _batch([pa.array(ids, mask=ids == NULL_ID), pa.array(n.astype(np.int64)), pa.array(shared), pa.array(fp, pa.binary())], ["doc_id", "n", "shared", "fp"])

    counted = map_arrow(map_arrow(docs, split, PARTS).repartition(parts, "fragment").sortWithinPartitions("fragment"), count, PARTS)
    return map_arrow(counted.repartition(parts, "batch").sortWithinPartitions("batch"), total, "doc_id long, n long, shared long, fp binary")


def node_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp, n, lone, tokens) of (doc_id, text, lone): fp is a 128-bit
    fingerprint of the set, lone the shingles that no other document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, ids, buf, off in sliced(batches):
            h, o = sets_of(buf, off, k)
            n = np.diff(o)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            yield _batch([pa.array(ids[some]), pa.array(fingerprints(h, o), pa.binary()),
                          pa.array(n[some]), batch.column(2).slice(lo, hi - lo).take(pa.array(some)),
                          pa.array([h[o[i]:o[i + 1]].tobytes() for i in some], pa.binary())],
                         ["doc_id", "fp", "n", "lone", "tokens"])

    return map_arrow(docs.select("doc_id", "text", "lone"), run, "doc_id long, fp binary, n long, lone long, tokens binary")


def named_sets(rows: DataFrame, names: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(node, fp, n, lone, tokens) of names (node, fp, lone): the tokens of one
    document of each distinct set alone; the other copies' are neither sent nor kept."""
    few = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = names.groupBy(F.col("node").alias("doc_id")).agg(F.min("lone").alias("lone"))
    found = node_sets(rows.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id"), k).withColumnRenamed("doc_id", "node")
    if stats.filter("n > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():  # rows that share a doc_id
        found = found.dropDuplicates(["node", "fp"]).join(names.select("node", "fp"), ["node", "fp"], "left_semi")
    return found


def size_classes(top: int, num: int, den: int) -> np.ndarray:
    """First sizes of the classes; sets within the threshold are in the same or
    neighbouring classes."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * den // num + 1)
    return np.array(out + [out[-1] * den // num + 1])


def signatures(n: np.ndarray, h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, unit) rows; h holds the sets' sorted hashes one after the other.

    unit is 2 * need + scheme of the set's two schemes: sets within the threshold share
    need signatures of one scheme at least, for the need of either."""
    first = size_classes(int(n.max(initial=1)) * 2, num, den)
    cls = np.searchsorted(first, n, side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    sigs, sets, units = [], [], []
    for up in (0, 1):
        scheme = cls + up
        most = first[scheme + 1] - 1
        d = (den - num) * 2 * most // (den + num)
        m = d + 1 + d // 4 + 1
        seg = (((h >> U64(32)) * m[owner].astype(U64)) >> U64(32)).astype(np.int64)
        head = np.ones(len(h), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(head)
        who, part = owner[at], seg[at]
        value = np.add.reduceat(mix(h), at) if len(at) else np.zeros(0, U64)
        tag = (scheme[who].astype(U64) << U64(40)) + part.astype(U64)
        ok = d[who] > 0
        filled = np.bincount(who, minlength=len(n))
        unit = 2 * np.maximum(1, filled - d) + up  # at most d fragments differ
        sigs.append(mix(value + mix(tag))[ok])
        sets.append(who[ok])
        units.append(unit[who[ok]])
        # sets that may agree with a partner in empty fragments only name those too
        for i in np.flatnonzero((d > 0) & (m - filled >= m - d)):
            empty = np.setdiff1d(np.arange(m[i]), part[who == i])
            sigs.append(mix(mix((U64(scheme[i]) << U64(40)) + empty.astype(U64)) ^ U64(0xABCDEF)))
            sets.append(np.full(len(empty), i))
            units.append(np.full(len(empty), unit[i]))
    return np.concatenate(sigs), np.concatenate(sets), np.concatenate(units)


def candidates_of(nodes: DataFrame, num: int, den: int) -> list[DataFrame]:
    """(sig, node, unit, hub), a table per wave of signatures: the nodes of every shared signature and the one of them
    with the fewest shingles of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                n = np.asarray(part.column(1))
                h = np.frombuffer(b"".join(part.column(3).to_pylist()), U64)
                sig, who, unit = signatures(n, h, num, den)
                yield _batch([pa.array(sig.view(np.int64)), part.column(0).take(pa.array(who)), part.column(2).take(pa.array(who)), pa.array(unit.astype(np.int32))],
                             ["sig", "node", "lone", "unit"])

    sigs = written(map_arrow(nodes.select("node", "n", "lone", "tokens"), run, "sig long, node long, lone long, unit int"), "signatures")
    n_waves, found = waves(nodes, SIG_BYTES * sigs.count()), []
    for i in range(max(1, n_waves)):
        some = sigs.filter(F.pmod(F.xxhash64("sig"), F.lit(n_waves)) == i) if n_waves > 1 else sigs
        hubs = (some.groupBy("sig").agg(F.min(F.struct("lone", "node")).alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi"))
                .filter("lo <> hi").select("sig", F.col("hub.node").alias("hub")))
        found.append(written(some.select("sig", "node", "unit").join(hubs, "sig"), "candidates"))
    discard(sigs)
    return found


def segments(rows: DataFrame, pieces: int = PAIR_FRAGMENTS) -> DataFrame:
    """rows (with tokens last) once per fragment of the order, with the tokens in it
    as part: array<long>; fragments without tokens give no row."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                piece = batch.slice(a, 200)
                raw = piece.column(piece.num_columns - 1).to_pylist()
                h = np.frombuffer(b"".join(raw), U64)
                owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                key = owner * pieces + (((h >> U64(32)) * U64(pieces)) >> U64(32)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                at = pa.array(key[cut] // pieces)
                part = pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield _batch([*(piece.column(i).take(at) for i in range(len(names))), pa.array((key[cut] % pieces).astype(np.int32)), part],
                             [*names, "fragment", "part"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return map_arrow(rows, run, f"{schema}, fragment int, part array<long>")


def waves(nodes: DataFrame, sent: int | None) -> int:
    """How many waves send so many bytes, each about as many as all sets have."""
    return -(-(sent or 0) // max(WAVE_BYTES, nodes.agg(F.sum(8 * F.col("n"))).first()[0] or 0))


def together(spark: SparkSession, tables: list[DataFrame], schema: str = "a long, b long") -> DataFrame:
    """The rows of all waves."""
    return spark.read.schema(schema).parquet(*[x._llm_path for x in tables]) if tables else spark.createDataFrame([], schema)


def verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold.

    Pairs whose sizes rule it out go first.  Each fragment of the order counts the
    overlap of its parts of both sets as one row; the rows are summed per pair.  A hot a
    is dealt to a key per MEMBERS pairs."""
    sizes = nodes.groupBy("node").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    for x in "ab":
        pairs = pairs.join(sizes.toDF(x, f"lo_{x}", f"hi_{x}"), x)
    pairs = written(pairs.filter(f"{den} * hi_a >= {num} * lo_b and {den} * hi_b >= {num} * lo_a").select("a", "b", F.col("hi_b").alias("n")), "sized-pairs")
    sized = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    all_ = written(pairs.join(sized, "a").select("a", "b", "n", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "dealt-pairs")
    discard(pairs)
    keys = ["a", "salt", "fragment"]
    n, found = waves(nodes, all_.agg(F.sum(16 * F.col("n"))).first()[0]), []

    def near(df: DataFrame, small: bool) -> DataFrame:
        return F.broadcast(df) if small else df.hint("merge")

    for i in range(n):
        dealt = all_.filter(F.pmod(F.xxhash64("a", "salt"), F.lit(n)) == i).drop("n")
        small = dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        left = nodes.join(near(dealt.select("a", "salt").distinct(), small), F.col("node") == F.col("a")).select("a", "salt", F.col("n").alias("na"), "tokens")
        right = nodes.join(near(dealt, small), F.col("node") == F.col("b")).select("a", "salt", "b", F.col("n").alias("nb"), "tokens")
        both = segments(right).hint("merge").join(segments(left).withColumnRenamed("part", "other"), keys)
        counts = both.select("a", "b", "na", "nb", F.size(F.array_intersect("part", "other")).cast("long").alias("overlap"))
        total = counts.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("overlap").alias("x"))
        found.append(written(total.filter(den * F.col("x") >= num * (F.col("na") + F.col("nb") - F.col("x"))).select("a", "b"), "linked-pairs"))
    discard(all_)
    return together(nodes.sparkSession, found)


def open_groups(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, unit, label) of the signatures of which nodes beside the hub are not
    yet connected: the hub was compared with all, they were not with each other."""
    seen = candidates.filter("node <> hub").join(labels.withColumnRenamed("id", "node"), "node", "left")
    seen = written(seen.select("sig", "node", "unit", F.coalesce("component", "node").alias("label")), "labelled")
    out = written(unconnected(seen), "open")
    discard(seen)
    return out


def unconnected(rows: DataFrame) -> DataFrame:
    """The rows of signatures with nodes of more than one label."""
    mixed = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig")
    return rows.join(mixed, "sig")


def narrowed(open_: DataFrame) -> DataFrame:
    """(sig, node, label) of open groups in which every two nodes that may still link
    meet: nodes with fewer open signatures than a link needs are left out, until that
    changes little, then all but the count - need + 1 signatures of each node that
    have the fewest nodes."""
    unit, need = ["node", "unit"], F.floor(F.col("unit") / 2)
    now, n = open_, open_.count()
    while n:
        full = now.groupBy(*unit).agg(F.count(F.lit(1)).alias("had")).filter(F.col("had") >= need)
        nxt = written(unconnected(now.join(full.select(*unit), unit)), "open")
        if now is not open_:
            discard(now)
        now, n, before = nxt, nxt.count(), n
        if n > 0.9 * before:
            break
    sizes = now.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    had = now.groupBy(*unit).agg(F.count(F.lit(1)).alias("had"))
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy("size", "sig"))
    first = now.join(sizes, "sig").join(had, unit).withColumn("rank", rank).filter(F.col("rank") <= F.col("had") - need + 1)
    out = written(unconnected(first.select("sig", "node", "label").distinct()), "narrowed")
    if now is not open_:
        discard(now)
    return out


def tile_overlaps(left: np.ndarray, right: np.ndarray, tok: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Shared tokens of each left with each right node: left and right name the nodes
    of tok (-1: none).  Counted by dense blocks of tokens that occur twice."""
    _, number, df = np.unique(tok, return_inverse=True, return_counts=True)
    common = df > 1
    keep = common[number]
    number = (np.cumsum(common) - 1)[number[keep]]
    left, right = left[keep], right[keep]
    order = np.argsort(number, kind="stable")
    number, left, right = number[order], left[order], right[order]
    out = np.zeros((n_left, n_right), np.float32)
    cuts = np.searchsorted(number, np.arange(0, int(common.sum()) + BLOCK, BLOCK))
    for f in range(len(cuts) - 1):
        a, b = cuts[f], cuts[f + 1]
        if a < b:
            col, i, j = number[a:b] - f * BLOCK, left[a:b], right[a:b]
            x, y = np.zeros((n_left, BLOCK), np.float32), np.zeros((n_right, BLOCK), np.float32)
            x[i[i >= 0], col[i >= 0]] = 1
            y[j[j >= 0], col[j >= 0]] = 1
            out += x @ y.T
    return out.astype(np.int32)


def spanning(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right nodes (which may be the same)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, x in enumerate(left.tolist()):
        for y in right[np.flatnonzero(link[i])].tolist():
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def links_in_tiles(members: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links that connect what the threshold connects in groups of any size;
    members: (node, family, size).

    A row of the first step is one fragment's overlaps between the nodes of two
    tiles, of the second the sum of such rows: no pair is a row."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    placed = members.withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = written(placed, "tiles")
    rows = nodes.join(placed, "node").withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "node", "family", "t", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "n", "tokens")
    # tokens, and the overlaps of half a tile in all fragments
    sent = placed.join(nodes.select("node", "n"), "node").agg(F.sum(F.col("tiles") * (8 * F.col("n") + 4 * PAIR_FRAGMENTS * TILE))).first()[0]
    n_waves, found = waves(nodes, sent), []

    def count(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        node, t, n = (tab[c].to_numpy() for c in ("node", "t", "n"))
        fam, i, j = tab["family"][0].as_py(), tab["i"][0].as_py(), tab["j"][0].as_py()
        part = tab["part"].combine_chunks()
        size = np.diff(part.offsets.to_numpy())
        tok = part.flatten().to_numpy()
        names = [np.sort(node[t == i]), np.sort(node[t == j])]
        places = [np.where(t == k, np.minimum(np.searchsorted(x, node), max(len(x) - 1, 0)), -1) for k, x in zip((i, j), names)]
        counts = tile_overlaps(np.repeat(places[0], size), np.repeat(places[1], size), tok, *map(len, names))
        sizes = [n[t == k][np.argsort(node[t == k])] for k in (i, j)]
        at = np.flatnonzero(counts)
        return pa.table({"family": pa.array([fam], pa.int64()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                         "left": [names[0].tobytes()], "right": [names[1].tobytes()], "nl": [sizes[0].astype(np.int64).tobytes()],
                         "nr": [sizes[1].astype(np.int64).tobytes()], "at": [at.astype(np.int32).tobytes()], "x": [counts.ravel()[at].tobytes()]})

    def total(tab: pa.Table) -> pa.Table:
        got = [tuple(np.frombuffer(tab[c][r].as_py(), np.int32 if c in ("at", "x") else np.int64) for c in ("left", "right", "nl", "nr", "at", "x"))
               for r in range(tab.num_rows)]
        left, right = (np.unique(np.concatenate([g[k] for g in got])) for k in (0, 1))
        x = np.zeros((len(left), len(right)), np.int64)
        nl, nr = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for gl, gr, sl, sr, at, c in got:  # nodes without tokens in a fragment are not in its rows
            pl, pr = np.searchsorted(left, gl), np.searchsorted(right, gr)
            nl[pl], nr[pr] = sl, sr
            if len(at):
                x[pl[at // len(gr)], pr[at % len(gr)]] += c
        link = (den * x >= num * (nl[:, None] + nr[None, :] - x)) & (left[:, None] != right[None, :])
        found = spanning(link, left, right)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    for k in range(n_waves):
        some = rows.filter(F.pmod(F.xxhash64("family", "i", "j"), F.lit(n_waves)) == k)
        counts = segments(some).groupBy("family", "i", "j", "fragment").applyInArrow(
            count, "family long, i int, j int, left binary, right binary, nl binary, nr binary, at binary, x binary")
        found.append(written(counts.groupBy("family", "i", "j").applyInArrow(total, "a long, b long"), "linked-tiles"))
    discard(placed)
    return together(nodes.sparkSession, found)


def missing_links(open_: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Links between nodes of (sig, node, unit, label) groups that connect what the
    threshold connects: groups by pairs, families of large groups by tiles."""
    groups = narrowed(open_)
    sizes = written(groups.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("a")), "sizes")
    small = groups.join(sizes.filter(F.col("size") <= SMALL).select("sig"), "sig")
    x, y = small.select("sig", F.col("node").alias("a"), F.col("label").alias("la")), small.select("sig", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = written(x.join(y, "sig").filter("a < b and la <> lb").select("a", "b").distinct(), "pairs")
    links = verified(pairs, nodes, num, den)
    discard(pairs)
    large = sizes.filter(F.col("size") > SMALL).select("sig", "a")
    if large.limit(1).count():
        families = components(groups.join(large, "sig").select("a", F.col("node").alias("b")))
        sized = families.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        placed = written(families.join(sized, "component").select(F.col("id").alias("node"), F.col("component").alias("family"), "size"), "families")
        links = links.unionByName(links_in_tiles(placed, nodes, num, den))
        discard(placed)
    discard(groups)
    discard(sizes)
    return links


def linked_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    stats = written(shared_counts(rows, k), "shared-counts")
    able = (F.col("n") > 0) & (F.col("shared") * den >= F.col("n") * num) & F.col("doc_id").isNotNull()
    sets = written(stats.filter(able).select("doc_id", "fp", (F.col("n") - F.col("shared")).alias("lone")), "sets")
    # a set's number is its smallest doc_id, so a component's is its smallest document's
    names = written(sets.groupBy("fp").agg(F.min("doc_id").alias("node"), F.min("lone").alias("lone")), "names")
    nodes = written(named_sets(rows, names, stats, k), "nodes")
    found = candidates_of(nodes, num, den)
    candidates = together(docs.sparkSession, found, "sig long, node long, unit int, hub long")
    pairs = candidates.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(pairs, nodes, num, den)
    links_of = components(links)
    left = open_groups(candidates, links_of)
    if left.limit(1).count():
        links_of = components(links.unionByName(missing_links(left, nodes, num, den)))
    links = links_of
    for x in [*found, nodes]:
        discard(x)
    node_of = names.select("fp", "node").join(links.withColumnRenamed("id", "node"), "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    found = (sets.select("doc_id", "fp").join(node_of, "fp").groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    return stats.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those linked to a document of smaller id; of rows
    that share a doc_id one stays.  Rows without doc_id stay."""
    found = linked_components(docs, k, num, den, key, text)
    gone = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    small = gone.limit(1_000_001).count() <= 1_000_000
    left = docs.join(F.broadcast(gone) if small else gone, key, "left_anti").select(docs.columns)
    again = written(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(key)).count().filter("count > 1").select(key), "again")
    if again.limit(1).count():
        single = left.join(again, key, "left_anti").select(docs.columns)
        left = single.unionByName(left.join(again, key, "left_semi").select(docs.columns).dropDuplicates([key]))
    return left


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
