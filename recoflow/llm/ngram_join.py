"""N-gram Jaccard join with PartEnum signatures: linked documents and their components, exactly.

A document's set holds the distinct SIZE-word shingles (A-Z lower-cased; fewer words: the whole sequence as one).
Two documents link when 100 * |A & B| >= PCT * |A | B|.

Method. Sets of nearby sizes share a band group j (sizes [L_j, L_{j+2})); every pair that can link shares one.
In a group the symmetric difference of a linked pair is at most k. The feature domain is hashed into n1 first-level
parts of n2 second-level parts each; a set gives one signature for every first-level part and subset of n2 - k2 of its
second-level parts. By the pigeonhole principle a linked pair has at least one part with at most k2 differences, hence
one equal signature. ``extra`` more parts than needed make sure that some equal signature is not that of an empty
subset, unless a set has more than ``extra`` parts with an empty subset; only such sets give empty signatures too.
Larger sets have three second-level parts, of which a signature covers two.

Scale. Equal sets act as one (set_id). A task replaces the sets that share a signature by links to the smallest of
them before the shuffle, so a hot signature reaches its partition once per flush; signatures travel packed by range. Instead of all pairs
within a signature, star links to the smallest set are verified first, and of these only pairs whose sizes and parity bits allow a link are
compared element by element. A signature of two sets, or whose sets end in one component, needs nothing more. Sets of a larger signature that
stay in different components are compared with each other where their rarest elements allow a link (an exact filter: it loses no link).

Cases: null, empty or blank text has an empty set, is linked with nothing and is its own component; a null doc_id is
the smallest; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import textkit as tk
from recoflow.llm.shared import NULL_ID, few, key_columns, keyed, shuffle_partitions, small_batches, spent, written

SIZE, PCT = 4, 85
FLUSH = 1_000_000
#: Signatures that a task holds before it packs them: its memory is some 100 bytes each.
HELD = 1 << 18
#: Texts, or pairs with both sets, in an Arrow batch.
BATCH = 1000
#: Words of 64 parity bits a set.
PARITY = 4
_BITS = [f"p{k}" for k in range(PARITY)]
_FACTS = ["n_shingles", "set_id", *_BITS, "sketch"]
_FACTS_SQL = f"n_shingles long, set_id long, {', '.join(f'{c} long' for c in _BITS)}, sketch binary"
#: Frequent elements that are known to all tasks, at most.
COMMON = 1 << 18
U = np.uint64
_WORD = tk.byte_class("space")


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    buf_all, off_all = tk.utf8(column)
    for i, j, buf, off in tk.pieces(buf_all, off_all):
        buf = tk.LOWER[buf]
        starts, ends, wo = tk.word_spans(buf, off, _WORD)
        words = tk.span_hashes(buf, starts, ends)
        g = tk.shingles(words, size)
        for k in range(j - i):
            a, b = int(wo[k]), int(wo[k + 1])
            if b - a >= size:
                yield np.unique(g[a: b - size + 1])
            elif b > a:
                yield tk.shingles(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """Identity of a set (0: empty)."""
    if not len(s):
        return 0
    total = np.add.reduce(tk.mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True) + tk.times(len(s), 0x9E3779B97F4A7C15)
    return int(tk.mix(total).view(np.int64)[0])


@cache
def _bands(pct: int) -> list[int]:
    """Lower ends of the size bands: sizes that can link lie in one band or in neighbours."""
    low = [1, 2]
    while low[-1] < 2**40:
        low.append(max(low[-1] + 1, 100 * (low[-1] - 1) // pct + 1))
    return low


@cache
def _scheme(group: int, pct: int) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """n1, n2, subsets (0/1 rows over the second-level parts), salts of the signatures, extra parts."""
    largest = _bands(pct)[group + 2] - 1
    k = 2 * largest * (100 - pct) // (100 + pct)  # differences of a linked pair of sizes up to ``largest``
    if k == 0:
        n1, n2, k2, extra = 1, 1, 0, 0
    elif k < 12:
        k2 = min(k, 2)
        extra = 1
        n1, n2 = -(-(k + 1) // (k2 + 1)) + extra, k2 + 2
    else:
        k2, n2 = 1, 3
        extra = 1 + k // 50
        n1 = k // 2 + 1 + extra
    subsets = np.zeros((len(list(itertools.combinations(range(n2), n2 - k2))), n2), dtype=np.uint64)
    for row, chosen in enumerate(itertools.combinations(range(n2), n2 - k2)):
        subsets[row, list(chosen)] = 1
    salts = tk.mix(np.arange(n1 * len(subsets), dtype=np.uint64) + tk.times(group + 1, 0x632BE59BD9B4E019))
    return n1, n2, subsets, salts, extra


def signatures(s: np.ndarray, pct: int) -> np.ndarray:
    """PartEnum signatures of a set, for both band groups that its size belongs to."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(_bands(pct), n, "right")) - 1
    out = []
    value = tk.mix(s + U(0x2545F4914F6CDD1D))
    for group in {max(band - 1, 0), band}:
        n1, n2, subsets, salts, extra = _scheme(group, pct)
        cell = ((s ^ (s >> U(32))) + tk.times(group, 0x9E3779B97F4A7C15)) % U(n1 * n2)
        order = np.argsort(cell, kind="stable")
        sums, counts = np.zeros(n1 * n2, np.uint64), np.bincount(cell.astype(np.int64), minlength=n1 * n2)
        full = np.flatnonzero(counts)
        sums[full] = np.add.reduceat(value[order], (np.cumsum(counts) - counts)[full])
        if n2 == 1:
            total, held = sums, counts
            hollow = held == 0
        else:
            total = (sums.reshape(n1, n2)[:, None, :] * subsets[None]).sum(axis=2, dtype=np.uint64).ravel()
            held = (counts.reshape(n1, n2) @ subsets.T.astype(np.int64)).ravel()
            hollow = (held.reshape(n1, -1) == 0).any(axis=1)
        sig = tk.mix(total + salts)
        out.append(sig if int(hollow.sum()) > extra else sig[held > 0])
    return np.concatenate(out)


def _sets_of(names: list[str], text_col: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, bits, sketches = [], [], np.zeros((b.num_rows, PARITY), np.int64), []
            for i, s in enumerate(shingle_sets(b.column(names.index(text_col)), size)):
                n.append(len(s))
                ids.append(set_id(s))
                sketches.append(sketch(s))
                bits[i] = parity(s, 64 * PARITY)
            keep = [c for c in names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in keep), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                                              *(pa.array(bits[:, k]) for k in range(PARITY)), pa.array(sketches, pa.binary())], names=[*keep, *_FACTS])
    return run


def _star(sig: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (signature, set): which are the first of their signature, and for the others that first set."""
    order = np.lexsort((sid, sig))
    sig, sid = sig[order], sid[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
    sig, sid = sig[keep], sid[keep]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    top = sid[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))] if len(sig) else sid
    return sig, sid, top


#: Packed rows: heads of a range of signatures, or links that a flush made.
_HEADS, _LINKS = 0, 1
_PACKED = "part int, kind int, body binary"


def _packed_heads(sig: np.ndarray, sid: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Signatures, sorted, by their range (part): a table of the sets and, for each signature, its place there."""
    part = ((sig >> U(40)) * U(parts)) >> U(24)
    for p, a, b in zip(*_runs(part)):
        sets, at = np.unique(sid[a:b], return_inverse=True)
        yield int(p), np.array([b - a, len(sets)]).tobytes() + sets.tobytes() + at.astype(np.uint32).tobytes() + sig[a:b].tobytes()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal numbers."""
    start = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[start], start, np.append(start[1:], len(x))[: len(start)]


def _unpacked_heads(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(body, np.int64, 2)
    sets, at = np.frombuffer(body, np.int64, m, 16), np.frombuffer(body, np.uint32, n, 16 + 8 * m)
    return np.frombuffer(body, U, n, 16 + 8 * m + 4 * n), sets[at]


def _signature_rows(size: int, pct: int, parts: int):
    """_PACKED rows of each flush: the smallest set of each signature stands for all, the others are links to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, sid, held = [], [], 0

        def flush():
            s, i, t = _star(np.concatenate(sig), np.concatenate(sid))
            head = i == t
            made = [(p, _HEADS, body) for p, body in _packed_heads(s[head], i[head], parts)]
            s, i, t = s[~head], i[~head], t[~head]
            made += [((a // 20_000) % parts, _LINKS, np.stack((s[a: a + 20_000].view(np.int64), i[a: a + 20_000], t[a: a + 20_000])).tobytes()) for a in range(0, len(s), 20_000)]
            for a in range(0, len(made), 100):
                p, k, body = zip(*made[a: a + 100])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(body, pa.binary())], names=["part", "kind", "body"])

        for b in batches:
            for s in shingle_sets(b.column(0), size):
                if len(s):
                    g = signatures(s, pct)
                    sig.append(g)
                    sid.append(np.full(len(g), set_id(s), dtype=np.int64))
                    held += len(g)
                    if held >= HELD:
                        yield from flush()
                        sig, sid, held = [], [], 0
        if held:
            yield from flush()
    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_PACKED rows sorted by part: links from each set to the smallest of its signature; a part is held at a time."""
    was, sig, sid = None, [], []

    def rows(s, i, t):
        for a in range(0, len(s), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a: a + 100_000]) for x in (s, i, t)], names=["sig", "sid", "top"])

    def met():
        s, i, t = _star(np.concatenate(sig), np.concatenate(sid))
        link = i != t
        yield from rows(s[link].view(np.int64), i[link], t[link])

    for b in batches:
        for part, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            body = body.as_buffer().to_pybytes()
            if kind == _LINKS:
                yield from rows(*np.frombuffer(body, np.int64).reshape(3, -1))
                continue
            if part != was and sig:
                yield from met()
                sig, sid = [], []
            was = part
            s, i = _unpacked_heads(body)
            sig.append(s)
            sid.append(i)
    if sig:
        yield from met()


def parity(s: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits (a power of two): each tells whether an odd number of elements hash to it.

    Two sets differ in at least as many elements as their bits differ. A half of the bits xor the other half is the parity of half the width.
    """
    odd = np.bincount((tk.mix(s + U(0x3C6EF372FE94F82B)) % U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(s: np.ndarray) -> bytes | None:
    """Parity of about as many bits as the set has elements; none where the narrow one does."""
    return parity(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > 64 * PARITY else None


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows of sketches differ, the wider ones folded."""
    while x.shape[1] != y.shape[1]:
        if x.shape[1] < y.shape[1]:
            x, y = y, x
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)


def _near_sketches(pct: int):
    """Pairs (a, b, shared, n_a, n_b, sketch_a, sketch_b): those whose sketches, if both have one, allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            sizes = [np.nan_to_num(pc.binary_length(b.column(k)).to_numpy(zero_copy_only=False)).astype(np.int64) for k in (5, 6)]
            total = b.column(3).to_numpy() + b.column(4).to_numpy()
            for wide_a, wide_b in sorted(set(zip(*(x.tolist() for x in sizes)))):
                if wide_a and wide_b:
                    at = np.flatnonzero((sizes[0] == wide_a) & (sizes[1] == wide_b))
                    x, y = (np.frombuffer(b"".join(b.column(k).take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for k in (5, 6))
                    ok[at] = (100 + pct) * _differing(x, y) <= (100 - pct) * total[at]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in range(3)], names=["a", "b", "shared"])
    return run


def _bodies(size: int):
    """Rows (text, comp): (sid, comp, body) of each set, once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            made = []
            for s, comp in zip(shingle_sets(b.column(0), size), b.column(1).to_pylist()):
                i = set_id(s)
                if i not in seen:
                    seen.add(i)
                    made.append((i, comp, s.tobytes()))
            for a in range(0, len(made), 256):
                ids, comps, bodies = zip(*made[a: a + 256])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(comps, pa.int64()), pa.array(bodies, pa.binary())], names=["sid", "comp", "body"])
    return run


def _verify(pct: int):
    """Pairs with both bodies: those that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= pct * max(len(x), len(y)):
                    both = np.sort(np.concatenate((x, y)), kind="stable")
                    inter = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * inter >= pct * (len(x) + len(y) - inter)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
    return run


def linked_pairs(pairs: DataFrame, bodies: DataFrame, pct: int) -> DataFrame:
    """A written table of the pairs (a, b) of set ids whose sets link. Only bodies of the pairs travel: the pairs' sets are written first, and sent to the bodies."""
    pairs = written(pairs.select("a", "b"), "candidates")
    rows = pairs.count()
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    bodies = bodies.join(few(ids, 2 * rows), "sid", "left_semi")
    with_b = pairs.join(bodies.select(F.col("sid").alias("b"), F.col("body").alias("body_b")), "b")
    both = with_b.join(bodies.select(F.col("sid").alias("a"), F.col("body").alias("body_a")), "a")
    out = written(both.select("a", "b", "body_a", "body_b").mapInArrow(_verify(pct), "a long, b long"), "edges")
    spent(pairs)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the edges (a, b).

    Alternating large-star and small-star steps on the edge table: every step links a node's neighbours to its smallest
    neighbour, until all edges are stars; about log(size) rounds. Tables only, nothing is collected.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    while not _only_stars(cur):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        was, cur = cur, written(small, "cc")
        spent(was)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (u, v), u > v, is either a centre or has one edge, to its centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")) \
        .where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` (node, comp) with the links of ``edges`` (a, b) added: only the components that they touch are worked on."""
    if edges.isEmpty():
        return comp
    over = components(_in_components(edges, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = over.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    kept = comp.join(moved, comp.comp == moved.was, "left").select("node", F.coalesce("now", "comp").alias("comp"))
    # components of one set have no row of their own yet
    new = over.join(comp, "node", "left_anti")
    return written(kept.unionByName(new), "comp")


def _in_components(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b, ca, cb): pairs with the component of either set."""
    ca, cb = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def _possible_pairs(pairs: DataFrame, facts: DataFrame, pct: int) -> DataFrame:
    """A written table of the pairs (a, b, shared) of which sizes, parity bits and sketches allow a link."""
    def of(side: str, columns: list[str]) -> DataFrame:
        return facts.select(F.col("set_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))

    both = pairs.join(of("a", ["n", *_BITS]), "a").join(of("b", ["n", *_BITS]), "b")
    near = 100 * F.least("n_a", "n_b") >= pct * F.greatest("n_a", "n_b")
    differ = reduce(add, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _BITS))
    alike = written(both.where(near & ((100 + pct) * differ <= (100 - pct) * (F.col("n_a") + F.col("n_b")))).select("a", "b", "shared", "n_a", "n_b"), "alike")
    sketched = alike.join(of("a", ["sketch"]), "a").join(of("b", ["sketch"]), "b").select("a", "b", "shared", "n_a", "n_b", "sketch_a", "sketch_b")
    out = written(sketched.mapInArrow(_near_sketches(pct), "a long, b long, shared long"), "pairs")
    spent(alike)
    return out


def set_components(docs: DataFrame, text_col: str, size: int, pct: int, sets: DataFrame) -> DataFrame:
    """(sid, comp_sid) of the sets that link with another; ``sets`` has (ord, tk, n_shingles, set_id, parity bits) of each row."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    raw = docs.select(text_col).mapInArrow(_signature_rows(size, pct, 8 * parts), _PACKED)
    # heads meet by range of signatures; links of a flush pass through: one pass over the texts
    dealt = raw.repartition(parts, "part").sortWithinPartitions("part")
    linked = written(dealt.mapInArrow(_links, "sig long, sid long, top long"), "signature-links")
    facts = written(sets.groupBy("set_id").agg(F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in (*_BITS, "sketch")), F.min(F.struct("ord", "tk")).alias("f")), "facts")
    pairs = _possible_pairs(linked.groupBy(F.col("sid").alias("a"), F.col("top").alias("b")).agg(F.count(F.lit(1)).alias("shared")), facts, pct)

    def bodies_of(ids: DataFrame) -> DataFrame:
        """(sid, comp, body) of the sets (sid, comp), from one text each."""
        first = written(facts.join(ids, facts.set_id == ids.sid).select("f.ord", "f.tk", "comp"), "first-rows")
        wanted = first.count()
        texts = keyed(docs, "doc_id", text_col).join(few(first, wanted), ["ord", "tk"]).select("text", "comp")
        made = written(texts.mapInArrow(_bodies(size), "sid long, comp long, body binary"), "bodies")
        # only repeated rows of one id give a set in several tasks
        return written(made.dropDuplicates(["sid"]), "bodies") if made.count() > wanted else made

    alone = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    bodies = bodies_of(alone.withColumn("comp", F.col("sid")))
    # 1: each set with the one it shares most signatures with
    best = written(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")), "best")
    edges = linked_pairs(best, bodies, pct)
    comp = components(edges)
    # 2: the other star links between sets that are still apart; 3: all sets of a signature that are still apart
    edges2 = linked_pairs(_apart(pairs.select("a", "b"), comp).join(best, ["a", "b"], "left_anti"), bodies, pct)
    comp = merged(comp, edges2)
    spent(bodies, edges, edges2, best)
    members = linked.select("sig", "sid").unionByName(linked.select("sig", F.col("top").alias("sid"))).distinct()
    placed = members.join(comp, members.sid == comp.node, "left").select("sig", "sid", F.coalesce("comp", "sid").alias("comp"))
    # two sets of a signature are its star link, which was looked at
    split = placed.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 != c1 and n > 2").select("sig")
    rest = written(placed.join(split, "sig", "left_semi").select("sid", "comp").distinct(), "rest")
    spent(linked)
    if rest.isEmpty():
        return comp.select(F.col("node").alias("sid"), F.col("comp").alias("comp_sid"))
    bodies = bodies_of(rest)
    cross = _possible(bodies, facts, pct).join(pairs, ["a", "b"], "left_anti")
    edges3 = linked_pairs(cross, bodies, pct)
    spent(bodies, pairs)
    return merged(comp, edges3).select(F.col("node").alias("sid"), F.col("comp").alias("comp_sid"))


def _seen_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the elements that a flush of sets holds more than once."""
    held, count = [], 0

    def flush():
        token, n = np.unique(np.concatenate(held), return_counts=True)
        many = n > 1
        return pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(n[many])], names=["token", "n"])

    for b in batches:
        for body in b.column(0):
            held.append(np.frombuffer(body.as_buffer(), np.int64))
            count += len(held[-1])
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def common_elements(bodies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements, at most COMMON, and how often flushes saw them. They only decide the order of elements, so what flushes leave out costs no link."""
    counts = written(bodies.select("body").mapInArrow(_seen_again, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "common")
    sizes = {r.e: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 64 rows
    bound, held = max(sizes, default=0) + 1, 0
    while bound and held + sizes.get(bound - 1, 0) <= COMMON:
        bound -= 1
        held += sizes.get(bound, 0)
    found = counts.where(F.col("n") >= 1 << bound).toPandas().sort_values("token")
    spent(counts)
    return found["token"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _prefixes(common, pct: int):
    """(token, sid, comp, n, pos): the rarest elements of each set, in an order that is the same for all sets: by frequency, then by value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, often = common.value
        for b in batches:
            for sid, comp, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = np.frombuffer(body.as_buffer(), np.int64)
                n = len(s)
                f = np.zeros(n, np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    f = np.where(tokens[at] == s, often[at], 0)
                first = np.lexsort((s, f))[: n + n * -pct // 100 + 1]
                for a in range(0, len(first), 100_000):
                    part = s[first[a: a + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), sid)), pa.array(np.full(len(part), comp)), pa.array(np.full(len(part), n)),
                                                      pa.array(np.arange(a + 1, a + 1 + len(part)))], names=["token", "sid", "comp", "n", "pos"])
    return run


def _possible(bodies: DataFrame, facts: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that can still link.

    Texts around a common passage share signatures without being similar, so pairs within such signatures are not listed. Linked sets
    share an element among the rarest (100 - pct) % of either, with enough elements after it for the overlap needed, and sizes, parity bits and
    sketches must allow the link.
    """
    common = bodies.sparkSession.sparkContext.broadcast(common_elements(bodies))
    prefix = written(bodies.mapInArrow(_prefixes(common, pct), "token long, sid long, comp long, n long, pos long"), "prefixes")
    other = prefix.select("token", F.col("sid").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    near = 100 * F.least("n", "n_b") >= pct * F.greatest("n", "n_b")
    enough = (100 + pct) * (1 + F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))) >= pct * (F.col("n") + F.col("n_b"))
    met = prefix.join(other, (prefix.token == other.token) & (F.col("sid") > F.col("b")) & (F.col("comp") != F.col("comp_b")) & near & enough)
    out = _possible_pairs(met.groupBy(F.col("sid").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared")), facts, pct).select("a", "b")
    spent(prefix)
    return out


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    return _in_components(pairs, comp).where("ca != cb").select("a", "b")


def _placed(docs: DataFrame, id_col: str, text_col: str, size: int, pct: int) -> DataFrame:
    """(ord, tk, n_shingles, group, component) of each row; group tells components apart, component is the smallest ord in it."""
    with small_batches(docs.sparkSession, BATCH):  # every Python step writes its table in here
        sets = written(keyed(docs, id_col, text_col).mapInArrow(_sets_of(["ord", "tk", "text"], "text", size), f"ord long, tk long, {_FACTS_SQL}"), "sets")
        some = sets.where("n_shingles > 0")
        linked = set_components(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", size, pct, some)
    first = some.groupBy("set_id").agg(F.min("ord").alias("first"))
    comp = first.join(linked, first.set_id == linked.sid, "left").select("set_id", "first", F.coalesce("comp_sid", "set_id").alias("group"))
    lowest = comp.groupBy("group").agg(F.min("first").alias("component"))
    by_set = comp.join(lowest, "group").select("set_id", "group", "component")
    return sets.join(by_set, "set_id", "left").select("ord", "tk", "n_shingles", "group", F.coalesce("component", "ord").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, pct: int = PCT) -> DataFrame:
    """(id, n_shingles, component_id) of each row."""
    unkeyed = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return _placed(docs, id_col, text_col, size, pct).select(unkeyed("ord").alias(id_col), "n_shingles", unkeyed("component").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, pct: int = PCT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays; texts without words all stay."""
    placed = written(_placed(docs, id_col, text_col, size, pct), "placed")
    first = placed.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct("ord", "tk")).alias("f")).select("f.ord", "f.tk")
    times = placed.where("n_shingles > 0").groupBy("ord", "tk").agg(F.count(F.lit(1)).alias("times"))
    wordless = placed.where("n_shingles = 0").select("ord", "tk").distinct().withColumn("times", F.lit(1).cast("long"))
    keys = ["ord", "tk"]
    stays = written(wordless.unionByName(times.join(first, keys, "left_semi")), "stays")
    stays = few(stays, stays.count())
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows = plain.select("*", *key_columns(names[docs.columns.index(id_col)], names[docs.columns.index(text_col)])).join(stays, keys)
    # repeated rows share their key with the one that stays: combined map-side
    once = rows.where("times = 1").unionByName(rows.where("times > 1").dropDuplicates(keys))
    return once.select(*names).toDF(*docs.columns)
