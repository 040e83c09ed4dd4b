"""N-gram Jaccard join by signature trees.

Each text becomes its set of distinct k-word shingles. Texts with equal sets are one
class, called a node. Nodes that share a block key, of which two linked sets always have
one in common, are dealt into bins, groups of one key whole; a group too large for a bin
is cut by size, and where that is not enough into chunks joined pair by pair. Over each
bin stands a signature tree: its nodes hold the OR of the token bitmaps below them and
the range of their sizes, and a dual traversal drops every pair of tree nodes whose
largest possible overlap cannot reach the threshold. A first traversal over bitmaps alone
joins what may be linked into clusters; a second one, over bins of whole clusters,
verifies every pair that sizes and bitmaps leave by the exact sets.

Nodes are told apart by 64-bit hashes of their sets, as shingles are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import give_back, sampled, written
from meridia.llm._words import U, mix, signed, words_of
from meridia.llm.components import connected_components, joined

#: Sets under a leaf, and children of an inner node: few, as the OR of many different sets has every bit.
LEAF, FAN = 4, 4
#: Nodes and bytes of a chunk. A bin holds about as much.
CHUNK, CHUNK_BYTES = 2048, 2 << 20
#: Rows that tell the frequent shingles, or so, and log2 of the slots they are kept in.
SAMPLE, SLOT_BITS = 8_000, 24
#: Words of bitmaps, and tokens, that are compared at once.
_WORDS = 1 << 18


def part_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of which any two unequal sets with Jaccard >= num/den share one: parts of the sets.

    A pair belongs to the size class of its larger set; there the sets differ by at most d
    tokens, and the tokens are dealt by hash into d + 1 + spare parts, of which 1 + spare
    agree. A set with no more than `spare` empty parts needs no key for those; the others,
    small sets, add the first tokens of the hash order.
    """
    n, found, low = len(tokens), [], 1
    last = n * den // num
    while low <= last:
        high = max(low + 1, -(-low * 3 // 2))
        d = (den - num) * 2 * (high - 1) // (den + num)
        if high > n and d:
            k = d + 1 + -(-d // 4)
            part = ((mix(tokens + U(0x9FB21C651E98DF25)) >> U(32)) * U(k)) >> U(32)
            order = np.argsort(part, kind="stable")
            p = part[order]
            heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            sums = np.add.reduceat(mix(tokens)[order], heads)
            found.append(mix(mix(sums + U(low)) + p[heads] * U(2)))
            if k - len(heads) >= k - d:
                found.append(mix(mix(tokens[: n - -(-num * n // den) + 1] + U(low)) + U(1)))
        low = high
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def prefix_keys(tokens: np.ndarray, num: int, den: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of which any two unequal sets with Jaccard >= num/den share one: the sets' first tokens.

    tokens is sorted; frequent, from frequent_slots or empty, tells the tokens that come
    last in the order of all tokens. A set's keys are the first n - ceil(n * num / den) + 1
    of it, in each size class (sizes from a power of 4 to below the next) that a set as
    large or larger can be in.
    """
    n = len(tokens)
    if (den - num) * n < num and (den - num) * n < den:  # no other set of any size reaches it
        return np.empty(0, np.uint64)
    if len(frequent):
        tokens = tokens[np.argsort(in_slots(frequent, tokens >> U(64 - SLOT_BITS)), kind="stable")]
    prefix = mix(tokens[: n - -(-num * n // den) + 1])
    return np.concatenate([mix(prefix + U(c)) for c in range((n.bit_length() + 1) // 2, ((n * den // num).bit_length() + 1) // 2 + 1)])


def in_parts(num: int, den: int) -> bool:
    """Whether parts hold six tokens or so, too many to agree by chance; else first tokens are better keys."""
    return (num + den) * 4 >= 6 * 2 * (den - num) * 5


def frequent_slots(docs: DataFrame, id_col: str, text_col: str, k: int, lower: bool, sample: int = SAMPLE, least: int = 3) -> np.ndarray:
    """A bitmap of the slots (leading SLOT_BITS bits of a shingle) whose shingles at least `least` of about `sample` rows have.

    The rows are chosen by a hash of id and text. The bitmap has one size for every table;
    it decides only the order of shingles, and any order loses no link.
    """
    rows = sampled(docs.select(F.xxhash64(id_col, text_col).alias("seed"), F.col(text_col).alias("text")), docs.count(), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(0), lower):
                tokens = np.concatenate([*w.shingle_sets(k), np.empty(0, np.uint64)])
                slot, n = np.unique(tokens >> U(64 - SLOT_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(slot)), pa.array(n.astype(np.int64))], ["slot", "n"])

    found = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return slot_bitmap(found)


def slot_blocks(slots: DataFrame) -> DataFrame:
    """(block, bits) of a bitmap of the rows' column `slot`, numbers of SLOT_BITS bits; it has one size at most for every table."""
    return slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))


def slot_bitmap(slots: DataFrame) -> np.ndarray:
    """That bitmap, as bytes."""
    bitmap = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for r in slot_blocks(slots).collect():
        bitmap[(r.block - 1) * len(r.bits) : r.block * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bitmap


def in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows whose column `slot` is in the bitmap; its blocks, 2 MB at most, are broadcast."""
    at = F.bitmap_bit_position(F.col("slot") + 1)
    byte = F.conv(F.hex(F.substr("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(blocks), F.bitmap_bucket_number(F.col("slot") + 1) == F.col("block"))
    return held.where(F.bit_get(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def in_slots(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """0 or 1 for each slot, an unsigned number."""
    return bitmap[slot >> U(3)] >> (slot & U(7)).astype(np.uint8) & 1


def signature(tokens: np.ndarray, num: int, den: int) -> bytes:
    """A bitmap of 4 to 8 bits a token: bit token mod its size, which is a power of 2.

    For thresholds from 4/5 only a quarter of all tokens is in bitmaps. The largest
    overlap of two sets counts the others as shared, which leaves it under the threshold
    wherever the quarter is not mostly shared.
    """
    few = 5 * num >= 4 * den
    bits = np.zeros(signature_bits(len(tokens), num, den), bool)
    kept = tokens[tokens >> U(62) == 0] if few else tokens
    bits[(kept & U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signature_bits(n: int, num: int, den: int) -> int:
    return 1 << min(17, max(8, (n // 4 if 5 * num >= 4 * den else n).bit_length() + 2))


def shingle_index(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, lower: bool) -> DataFrame:
    """(id, n_shingles, node, check, bitmap, keys) of each row: the set's size, two hashes of it, its signature and its block keys."""
    parts = in_parts(num, den)
    frequent = docs.sparkSession.sparkContext.broadcast(np.empty(0, np.uint8) if parts else frequent_slots(docs, id_col, text_col, k, lower))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(1), lower):
                sets = list(w.shingle_sets(k))
                keys = [part_keys(s, num, den) if parts else prefix_keys(s, num, den, frequent.value) for s in sets]
                cuts = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                ids = np.array([set_hashes(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.lo, w.hi - w.lo),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        pa.array(ids[:, 0]),
                        pa.array(ids[:, 1]),
                        pa.array([signature(s, num, den) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(np.concatenate(keys)))),
                    ],
                    ["id", "n_shingles", "node", "check", "bitmap", "keys"],
                )
        give_back()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, node long, check long, bitmap binary, keys array<long>")


def set_hashes(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        sums = np.array([mix(tokens).sum(dtype=np.uint64), mix(tokens ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return tuple(signed(sums).tolist())


class SignatureTree:
    """Bitmaps, sizes and chunks of sets, in the order given: LEAF of them under a leaf, FAN nodes under an inner node.

    A level is (OR of the bitmaps, least size, largest size, most slack, least chunk,
    largest chunk); the slack of a set is its tokens beyond its bits, as many of which can
    overlap without a bit of their own.
    """

    def __init__(self, size: np.ndarray, bitmap: np.ndarray, chunk: np.ndarray):
        self.size, self.bitmap = size, bitmap
        self.slack = size - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        self.levels = [self._fold(LEAF, bitmap, size, size, self.slack, chunk, chunk)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._fold(FAN, *self.levels[-1]))

    @staticmethod
    def _fold(fan: int, orb: np.ndarray, *bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        heads = np.arange(0, len(orb), fan)
        lo, hi, slack, first, last = bounds
        return (
            np.bitwise_or.reduceat(orb, heads, axis=0),
            np.minimum.reduceat(lo, heads),
            np.maximum.reduceat(hi, heads),
            np.maximum.reduceat(slack, heads),
            np.minimum.reduceat(first, heads),
            np.maximum.reduceat(last, heads),
        )

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int, cross: bool) -> np.ndarray:
        """Which pairs of nodes of a level can hold a link: by sizes and largest overlap, and, if cross, between two chunks."""
        orb, lo, hi, slack, first, last = self.levels[level]
        keep = den * np.minimum(hi[i], hi[j]) >= num * np.maximum(lo[i], lo[j])
        if cross:
            keep &= (first[i] != last[j]) | (last[i] != first[j])
        at = np.flatnonzero(keep & (i != j))
        need = -(-num * (lo[i] + lo[j]) // (num + den))
        for part in np.array_split(at, 1 + len(at) * orb.shape[1] // _WORDS):
            most = np.bitwise_count(orb[i[part]] & orb[j[part]]).sum(axis=1).astype(np.int64) + np.minimum(slack[i[part]], slack[j[part]])
            keep[part] = most >= need[part]
        return keep


def bitmaps_of(packed: list[bytes]) -> np.ndarray:
    """Signatures as rows of words, the larger ones folded to the smallest size among them."""
    width = min(map(len, packed))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(p, np.uint64).reshape(-1, width // 8), axis=0) for p in packed])


def tree_pairs(size: np.ndarray, packed: list[bytes], num: int, den: int, chunk: np.ndarray | None = None, group: np.ndarray | None = None, pruned: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (x, y) of rows that sizes and bitmaps leave possible, in parts, by a dual traversal of one tree.

    With chunks, only pairs of different chunks. Rows of one group stand side by side in
    the tree. To `pruned` go the counts of node pairs dropped at each level, leaves last.
    """
    cross = chunk is not None
    chunk = np.zeros(len(size), np.int64) if chunk is None else chunk
    bitmap = bitmaps_of(packed)
    order = np.lexsort((bitmap[:, 0], size, np.zeros(len(size)) if group is None else group, chunk))
    size, chunk = size[order], chunk[order]
    tree = SignatureTree(size, bitmap[order], chunk)
    i = j = np.zeros(1, np.int64)
    for level in range(len(tree.levels) - 1, -1, -1):
        keep = tree.possible(level, i, j, num, den, cross)
        if pruned is not None:
            pruned.append(int(len(keep) - keep.sum()))
        i, j = i[keep], j[keep]
        if level:
            i, j = _below(i, j, FAN, len(tree.levels[level - 1][0]), False)
    width = tree.bitmap.shape[1]
    for part in np.array_split(np.arange(len(i)), 1 + len(i) * LEAF * LEAF * width // _WORDS):
        x, y = _below(i[part], j[part], LEAF, len(size), True)
        fits = den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y])
        if cross:
            fits &= chunk[x] != chunk[y]
        x, y = x[fits], y[fits]
        most = np.bitwise_count(tree.bitmap[x] & tree.bitmap[y]).sum(axis=1).astype(np.int64) + np.minimum(tree.slack[x], tree.slack[y])
        fits = most * (num + den) >= num * (size[x] + size[y])
        yield order[x[fits]], order[y[fits]]


def _below(i: np.ndarray, j: np.ndarray, fan: int, n: int, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of node pairs, each pair once; n is the number of children in all."""
    step = np.arange(fan)
    x, y = np.broadcast_arrays((i[:, None] * fan + step)[:, :, None], (j[:, None] * fan + step)[:, None, :])
    x, y = x.ravel(), y.ravel()
    keep = (x < n) & (y < n) & ((x < y) if apart else (x <= y))
    return x[keep], y[keep]


def linked_pairs(xs: np.ndarray, ys: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact Jaccard is >= num/den. One set is marked at a time, and its partners' tokens are counted."""
    order = np.argsort(xs, kind="stable")
    xs, ys = xs[order], ys[order]
    size = np.array([len(v) for v in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    marked, linked = np.zeros(int(token.max()) + 1, bool), np.zeros(len(xs), bool)
    heads = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
    for a, b in zip(heads, np.append(heads[1:], len(xs)), strict=True):
        mine = token[start[xs[a]] : start[xs[a] + 1]]
        marked[mine] = True
        while a < b:  # as many partners at once as have a bounded number of tokens
            upto = a + max(1, int(np.searchsorted(np.cumsum(size[ys[a:b]]), _WORDS, side="right")))
            other = ys[a:upto]
            first = np.cumsum(size[other]) - size[other]
            at = np.arange(int(size[other].sum())) - np.repeat(first - start[other], size[other])
            shared = np.add.reduceat(marked[token[at]].astype(np.int64), first)
            linked[a:upto] = den * shared >= num * (len(mine) + size[other] - shared)
            a = upto
        marked[mine] = False
    return xs[linked], ys[linked]


def _same_width(size: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whether they have the smaller bitmaps) for each bitmap size with the next larger one: links span no more."""
    bits = np.array([signature_bits(int(n), num, den).bit_length() for n in size])
    for b in np.unique(bits):
        rows = np.flatnonzero((bits == b) | (bits == b + 1))
        yield rows, bits[rows] == b


def _pairs_of(rows: dict[str, np.ndarray], packed: list[bytes], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    chunk = rows["chunk"] if not rows["own"].all() else None
    for c, small in _same_width(rows["size"], num, den):
        for x, y in tree_pairs(rows["size"][c], [packed[i] for i in c], num, den, None if chunk is None else chunk[c], rows["group"][c]):
            here = small[x] | small[y]  # the others come with the next size of bitmaps
            yield c[x[here]], c[y[here]]


_PLACE = ("bin", "tree", "group", "range", "least", "chunk", "own")


def _trees(table: pa.Table) -> Iterator[tuple[dict[str, np.ndarray], list[bytes]]]:
    """The trees of a bin: columns of its rows, one row a node, and their values."""
    columns = {c: table.column(c).to_numpy() for c in ("tree", "group", "node", "size", "range", "least", "chunk", "own")}
    order = np.lexsort((columns["group"], columns["node"], columns["tree"]))
    columns = {c: v[order] for c, v in columns.items()}
    fresh = np.concatenate([[True], (columns["node"][1:] != columns["node"][:-1]) | (columns["tree"][1:] != columns["tree"][:-1])])
    order, columns = order[fresh], {c: v[fresh] for c, v in columns.items()}
    value = table.column("value").combine_chunks()
    cuts = np.flatnonzero(np.concatenate([[True], columns["tree"][1:] != columns["tree"][:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            yield {c: v[a:b] for c, v in columns.items()}, [value[int(i)].as_py() for i in order[a:b]]


def _links(*columns: tuple[np.ndarray | None, ...]) -> pa.Table:
    rows = [pa.table({c: pa.array(v if v is not None else [None] * len(part[0]), pa.int64()) for c, v in zip("abn", part, strict=True)}) for part in columns]
    return pa.concat_tables([pa.table({c: pa.array([], pa.int64()) for c in "abn"}), *rows])


def _star(node: np.ndarray, label: np.ndarray) -> tuple:
    other = np.flatnonzero(label != np.arange(len(label)))
    return node[other], node[label[other]], None


def _possible_links(num: int, den: int):
    """Links that connect the nodes of a bin whose sizes and bitmaps may be linked."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for rows, packed in _trees(table):
            label = np.arange(len(packed))
            for x, y in _pairs_of(rows, packed, num, den):
                label = joined(label, x, y)
            out.append(_star(rows["node"], label))
        return _links(*out)

    return run


def _verified_links(num: int, den: int, listed: bool):
    """Exact links of the trees of a bin.

    Rows with a and b alone connect what is linked. Rows with n count: a has n linked
    documents of other nodes in this bin, or, if listed, a and b are linked. A pair that
    stands in several trees counts in one: the first range that both are in, and the tree
    of their two chunks.
    """

    def run(table: pa.Table) -> pa.Table:
        out = []
        copies_of = dict(zip(table.column("node").to_pylist(), table.column("copies").to_pylist(), strict=True))
        for rows, values in _trees(table):
            sets = [np.frombuffer(v, np.uint64) for v in values]
            copies = np.array([copies_of[n] for n in rows["node"].tolist()], np.int64)
            label, linked = np.arange(len(sets)), np.zeros(len(sets), np.int64)
            for x, y in _pairs_of(rows, [signature(s, num, den) for s in sets], num, den):
                if not len(x):
                    continue
                x, y = linked_pairs(x, y, sets, num, den)
                label = joined(label, x, y)
                counted = rows["range"][x] == np.maximum(rows["least"][x], rows["least"][y])
                x, y = x[counted], y[counted]
                if listed:
                    out.append((rows["node"][x], rows["node"][y], np.ones(len(x), np.int64)))
                np.add.at(linked, x, copies[y])
                np.add.at(linked, y, copies[x])
            out.append(_star(rows["node"], label))
            if not listed:
                some = np.flatnonzero(linked)
                out.append((rows["node"][some], None, linked[some]))
        return _links(*out)

    return run


def _member_sets(k: int, lower: bool):
    """The shingle sets of (text, node, check, ..) rows; of rows that share an id only those with the node's own set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for w in words_of(batch.column(0), lower):
                sets = list(w.shingle_sets(k))
                mine = np.array([set_hashes(s) == (n, c) for s, n, c in zip(sets, node[w.lo : w.hi].tolist(), check[w.lo : w.hi].tolist(), strict=True)])
                rest = [batch.column(i).slice(w.lo, w.hi - w.lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([s.tobytes() for s in sets], pa.binary())], [*batch.schema.names[1:], "value"]).filter(pa.array(mine))
        give_back()

    return run


def candidate_groups(index: DataFrame) -> DataFrame:
    """(group, node) of the nodes that share a block key with another one.

    Keys are reduced to their least and largest node before any of their rows meet, and
    rows move only for keys that two nodes have. Keys of the same least and largest node
    are one group, mostly of the same near copies; groups only grow by it.
    """
    keyed = index.where("id IS NOT NULL").select("node", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    shared = written(ends.select("key", F.xxhash64("a", "b").alias("group")), "keys")
    return keyed.join(shared, "key").select("group", "node").distinct()


def deal(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, size, bin, tree, group, range, least, chunk, own) of (group, node, size, weight) rows: the trees a node stands in.

    Groups of up to a chunk go whole to a bin, where one tree holds all of them. Larger ones are cut into overlapping ranges of size, so wide that two sizes which
    allow a link share one, ranges into chunks, and every pair of chunks is a bin. least
    is a node's first range; own tells the tree of one chunk from those between two.
    """
    total = members.agg(F.sum("weight"), F.count("*")).first()
    bins = 1 + max((total[0] or 0) // CHUNK_BYTES, total[1] // CHUNK)
    sums = [F.count("*").alias("members"), F.sum("weight").alias("bytes")]
    counted = members.join(members.groupBy("group").agg(*sums).where("members > 1"), "group")
    whole = (F.col("members") <= CHUNK) & (F.col("bytes") <= CHUNK_BYTES)
    bin_ = F.pmod(F.xxhash64("group"), F.lit(bins)).cast("long")
    zero = F.lit(0)
    small = counted.where(whole).select("node", "size", bin_.alias("bin"), F.lit(0).cast("long").alias("tree"), "group", *[zero.alias(c) for c in ("range", "least", "chunk")], F.lit(True).alias("own"))
    step = F.log(F.lit(den / num)) + 1e-9
    at = F.floor(F.log("size") / step).cast("int")
    ranges = counted.where(~whole).select("group", "node", "size", "weight", F.explode(F.array(at - 1, at)).alias("range"), (at - 1).alias("least"))
    chunks = F.greatest(F.ceil(F.col("members") / F.lit(CHUNK)), F.ceil(F.col("bytes") / F.lit(CHUNK_BYTES))).cast("int")
    cut = ranges.join(ranges.groupBy("group", "range").agg(*sums), ["group", "range"]).withColumn("chunks", chunks)
    paired = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    tree = F.xxhash64("group", "range", F.least("chunk", "other"), F.greatest("chunk", "other"))
    large = paired.select("node", "size", tree.alias("bin"), tree.alias("tree"), "group", "range", "least", "chunk", (F.col("chunk") == F.col("other")).alias("own"))
    return small.unionByName(large)


def _joined(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: tuple[int, int], lower: bool, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, nodes, links): the shingle index, the nodes that have an id, and the rows of _verified_links."""
    num, den = threshold
    if not 0 < den <= 2 * num <= 2 * den:
        raise ValueError(f"a threshold from 1/2 to 1 is needed, not {num}/{den}")
    index = written(shingle_index(docs, id_col, text_col, k, num, den, lower), "shingles")
    firsts = [F.first(c).alias(c) for c in ("check", "n_shingles", "bitmap")]
    nodes = written(index.where("n_shingles > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *firsts), "nodes")
    sized = lambda weight: nodes.select("node", F.col("n_shingles").alias("size"), weight.alias("weight"))
    members = written(candidate_groups(index).join(sized(F.octet_length("bitmap") + 100), "node"), "members")
    dealt = deal(members, num, den).join(nodes.select("node", F.col("bitmap").alias("value")), "node")
    possible = dealt.groupBy("bin").applyInArrow(_possible_links(num, den), "a long, b long, n long")
    clusters = connected_components(possible).withColumnRenamed("component", "group")
    members = written(clusters.join(sized(8 * F.col("n_shingles") + 100), "node"), "members")
    places = deal(members, num, den).groupBy("node", "size").agg(F.collect_list(F.struct(*_PLACE)).alias("places"))
    placed = written(places.join(nodes.select("node", "check", "copies", F.col("id").alias("first_id")), "node"), "places")
    # Only texts whose id may be placed move: a bitmap of fixed size, which errs to the side of moving too many, tells.
    slot = F.shiftrightunsigned(F.xxhash64("first_id"), 64 - SLOT_BITS).alias("slot")
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("first_id")).select("text", slot, "first_id")
    texts = in_blocks(texts, slot_blocks(placed.select(slot))).join(placed, "first_id")
    carried = texts.select("text", "node", "check", "size", "copies", "places")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[1:])
    sets = carried.mapInArrow(_member_sets(k, lower), f"{schema}, value binary").select("node", "size", "copies", "value", F.inline("places"))
    return index, nodes, written(sets.groupBy("bin").applyInArrow(_verified_links(num, den, listed), "a long, b long, n long"), "links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links): the component of each text, and the number of other rows that it is linked with.

    Two rows with ids are linked if their shingle sets have Jaccard >= threshold, a
    fraction (numerator, denominator) from 1/2 to 1, compared in integers; equal sets are
    linked too. component_id is the smallest id reachable. Every pair that sizes and
    bitmaps leave is verified, and counted once. Null and empty texts, and texts without
    words, have 0 shingles and 0 links and stay alone. Rows of one id are rows of their
    own, whatever their texts. A row without an id keeps its n_shingles, has null n_links,
    counts for no other, and takes the component of the rows with ids that have its set,
    or null. Ties do not arise. Only the id and text columns are read, so other columns
    cannot clash. An empty table gives no rows.
    """
    index, nodes, links = _joined(docs, id_col, text_col, k, threshold, lower, False)
    counts = links.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    connected = connected_components(links.where("n IS NULL")).withColumnRenamed("component", "root")
    grouped = nodes.select("node", "id", "copies").join(connected, "node", "left").join(counts, "node", "left")
    rooted = grouped.select("node", F.col("id").alias("alone"), "copies", "n", "root")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("alone").alias("component"))
    found = rooted.join(least, "root", "left").select("node", F.coalesce("component", "alone").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    has = F.col("n_shingles") > 0
    n_links = F.when(F.col("id").isNotNull(), F.when(has, F.col("links")).otherwise(0).cast("long"))
    rows = index.select("id", "n_shingles", "node").join(found, "node", "left")
    return rows.select(F.col("id").alias(id_col), "n_shingles", F.when(has, F.col("component")).otherwise(F.col("id")).alias("component_id"), n_links.alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """(id, n_shingles, component_id): jaccard_join without its count of links."""
    return jaccard_join(docs, id_col, text_col, k, threshold, lower).drop("n_links")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """(a, b, a_copies, b_copies), a < b: the linked pairs of classes of equal sets, each by its smallest id and its number of rows.

    All links of rows are these times the copies, and the pairs within each class. Its
    rows are as many as the links, which can grow with the square of a group of near copies.
    """
    _, nodes, links = _joined(docs, id_col, text_col, k, threshold, lower, True)
    end = lambda c: nodes.select(F.col("node").alias(c), F.struct("id", "copies").alias(f"{c}_end"))
    pairs = links.where("n IS NOT NULL").join(end("a"), "a").join(end("b"), "b")
    pairs = pairs.select(F.least("a_end", "b_end").alias("x"), F.greatest("a_end", "b_end").alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.copies").alias("a_copies"), F.col("y.copies").alias("b_copies"))
