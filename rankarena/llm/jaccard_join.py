"""N-gram Jaccard join: which documents share nearly all of their word shingles, and the groups this makes.

The links are entries of a sparse product: the document by shingle incidence matrix times its transpose. It is worked
out in blocks, and only blocks that can hold a link are formed.

1. Documents with equal sets are one class; from here on each class counts once.
2. Sizes bound the difference of two linked sets (3/37 of both sizes together, at a similarity of 0.85). The shingles
   are dealt into segments. As each shingle that differs spoils one segment, a set with more filled segments than may
   differ agrees with any set it is linked with on a filled one, whatever that other set is like. Each class has a
   signature for each filled segment, for sizes like its own and for the next larger ones. Common shingles are left
   out, so a line or passage that many documents share makes no common segment. Classes that have too few filled
   segments then also take smaller segments, next the common shingles too, and at last the empty segments; each step
   is one that the class itself sees the need for, and where neither of a linked pair does, the step before has tied
   them. So any set of shingles may be called common. Here it is those that are seen often within a task, the
   ``HOT_SHINGLES`` most frequent ones at most. Classes with a common signature are tied to the least of them, first
   within a task and then between tasks, so a signature that very many classes have is sent once a task. The components
   of these ties hold all links.
3. Each component is cut into blocks of bounded size, and each block's product is accumulated over blocks of columns;
   pairs that can't reach the overlap that their sizes ask for are discarded on the way. A component of several blocks
   first links within blocks. Its groups are then tied once more, with the shingles that several of its classes have as
   common ones, and what is still tied links between one class of each group found so far. Where several groups remain, the
   classes outside of the largest are multiplied with all classes of the component, block by block. So no link is lost,
   and no list of pairs is ever made: blocks give a spanning tree of their links.
4. The components of the links are the result.

Shingles, signatures and classes are 64-bit hashes. Defined results: letters A-Z are lower-cased; words are runs of
bytes other than space and 09-0D. A text of fewer words than a shingle has its whole sequence as one; one without
words, or null, has no shingles, is linked with nothing and is its own component. Rows with equal texts are linked, also
with the same identifier. A component's id is its smallest identifier; null identifiers are passed over there.
"""

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, lean_group, lower_ascii, mixed, pieces, span_hashes, text_bytes, word_spans
from rankarena.llm.components import components
from rankarena.sources.scratch import written

SHINGLE_WORDS = 4
#: Similarity that links, as a fraction.
SIMILARITY = Fraction(85, 100)
#: Classes and shingles in a block of a product; a longer document makes a block of its own.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 400_000
#: A shingle is common if some tasks see it so often each, and together so often; so many at most (8 bytes each).
HOT_IN_TASK = 3
HOT_COUNT = 48
HOT_SHINGLES = 1_000_000
#: Within components of several blocks, where all shingles are counted, one is common if it is there so often.
HOT_IN_LARGE = 8
#: Classes that may have links are sent to all tasks up to this many (50 bytes each); more meet the texts in a shuffle.
BROADCAST_ROWS = 500_000
#: Columns of a product that are held at a time.
_COLUMNS = 2048
#: Shingles that a task counts at a time, and those whose counts it remembers.
_WAITING = 1 << 19
_REMEMBERED = 1 << 20
#: Bytes of text that are shingled at a time; some fifty times as many are held meanwhile.
_PIECE = 1 << 18
#: Signatures that a task holds before it sends them on, and that a group of them has about: some tens of megabytes while they are sorted.
_SIGNATURES = 1 << 19

# Fixed value: all bytes but the space and 09-0D belong to words.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[0x20] = WORD_BYTES[0x09:0x0E] = False


class Sizes:
    """Intervals of set sizes, such that linked sets are in the same or in neighbouring ones."""

    def __init__(self, similarity: Fraction) -> None:
        first, starts, differ = 1, [], []
        while first < 1 << 40:
            last = int(first / similarity)
            starts.append(first)
            # How many shingles two linked sets of up to ``last`` each may have apart: |a| + |b| - 2 |a & b|.
            differ.append(int(2 * last * (1 - similarity) / (1 + similarity)))
            first = last + 1
        self.starts, self.differ = np.array(starts), np.array(differ)

    def interval(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, size, side="right") - 1


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after another, and where each row starts."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, row = word_spans(data, offsets, WORD_BYTES)
    hashes = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        # Words beyond the text's end count as none, so a short text's first shingle is its whole sequence.
        ahead = np.zeros(len(hashes), np.uint64)
        ahead[: max(len(hashes) - k, 0)] = np.where(row[k:] == row[: len(row) - k], hashes[k:], 0) if k else hashes
        rolled = mixed(rolled + ahead * np.uint64(2 * k + 1))
    kept = np.maximum(count - words + 1, np.minimum(count, 1))
    sets = [np.unique(rolled[a : a + n]) for a, n in zip(first.tolist(), kept.tolist(), strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else rolled[:0]), np.concatenate(([0], np.cumsum(sizes)))


def classes_of(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(sets), dtype=np.uint64)))
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _segments(
    sets: np.ndarray, owner: np.ndarray, rows: np.ndarray, count: np.ndarray, tag: np.ndarray, empty_up_to: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the filled segments of ``rows``, the row of each, and how many each row has.

    ``count`` and ``tag`` are by row: the number of its segments, and what its signatures are for. Rows with no more
    filled segments than ``empty_up_to`` have signatures for empty segments, too.
    """
    count = np.where(rows, count, 0)
    inside = rows[owner]
    sets, owner = sets[inside], owner[inside]
    base = np.cumsum(count) - count
    at = base[owner] + ((sets >> np.uint64(16)) % count[owner].astype(np.uint64)).astype(np.int64)
    total = int(count.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, at, mixed(sets ^ np.uint64(0x5851F42D4C957F2D)))
    used = np.bincount(at, minlength=total) > 0
    of = np.repeat(np.arange(len(count)), count)
    filled = np.bincount(of[used], minlength=len(count))
    if empty_up_to is not None:
        used |= (filled <= empty_up_to)[of]
    key = mixed((tag[of] << 40 | (np.arange(total) - base[of])).astype(np.uint64))
    return mixed(sums + key)[used], of[used], filled


def signatures(sets: np.ndarray, offsets: np.ndarray, sizes: Sizes, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all rows that have shingles; ``hot`` has the common shingles, sorted."""
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    rare = np.ones(len(sets), bool)
    if len(hot):
        rare = hot[np.minimum(np.searchsorted(hot, sets), len(hot) - 1)] != sets
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        interval = sizes.interval(np.maximum(size, 1)) + up
        differ = sizes.differ[interval]
        few = size > 0
        for step, (values, of, count) in enumerate(
            ((sets[rare], owner[rare], 1 + differ + differ // 5), (sets[rare], owner[rare], 1 + 4 * differ), (sets, owner, 1 + differ + differ // 5))
        ):
            if few.any():
                key, row, filled = _segments(values, of, few, count, interval << 2 | step, differ if step == 2 else None)
                found.append(key)
                owners.append(row)
                few = few & (filled <= differ)
    return np.concatenate(found), np.concatenate(owners)


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, in order."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new], v[new]


def _ties(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its least node, and ties (node, least) of the other nodes of the key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    least = nodes[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else nodes
    other = nodes != least
    return keys[first], nodes[first], *_distinct(nodes[other], least[other])


def _rows(**columns: np.ndarray | list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


class _Seen:
    """How often shingles are seen; once there are too many, those seen least are forgotten."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        if sum(map(len, self.waiting)) > _WAITING:
            self.merge()

    def merge(self) -> None:
        new, counts = np.unique(np.concatenate([self.keys[:0], *self.waiting]), return_counts=True)
        self.waiting = []
        place = np.searchsorted(self.keys, new)
        known = np.zeros(len(new), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == new[inside]
        self.counts[place[known]] += counts[known]
        self.keys = np.insert(self.keys, place[~known], new[~known])
        self.counts = np.insert(self.counts, place[~known], counts[~known])
        least = 1
        while (counts_kept := int((self.counts >= least).sum())) > _REMEMBERED:
            least += 1
        if counts_kept < len(self.keys):
            kept = self.counts >= least
            self.keys, self.counts = self.keys[kept], self.counts[kept]

    def often(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Shingles that were seen often, and how often, some at a time."""
        self.merge()
        often = self.counts >= HOT_IN_TASK
        keys, counts = self.keys[often].view(np.int64), self.counts[often]
        for start in range(0, len(keys), 1 << 17):
            part = slice(start, start + (1 << 17))
            yield keys[part], counts[part]


def class_table(docs: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h, n, cls) for each row: a hash of its text, the size of its set and, if it has one, its class.

    Rows of a negative ``n`` are no documents: ``h`` is a shingle that a task has seen in -n of them.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    names = ["id", "h", "n", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                sets, offsets = shingle_sets(piece.column("text"), words)
                size = np.diff(offsets)
                seen.add(sets)
                classes = pa.array(classes_of(sets, offsets), mask=size == 0)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("h"), pa.array(size), classes], names)
        for keys, counts in seen.often():
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(keys), pa.array(-counts), none], names)

    return rows.mapInArrow(lean(run), "id bigint, h bigint, n bigint, cls bigint")


def hot_shingles(table: DataFrame, least: int = HOT_COUNT) -> np.ndarray:
    """The most frequent of the shingles that tasks have seen often; their number is bounded, so they can be sent around."""
    counts = table.where("n < 0").groupBy("h").agg(F.sum(-F.col("n")).alias("count")).where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "h").limit(HOT_SHINGLES).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def text_ties(docs: DataFrame, *, text_col: str, words: int, sizes: Sizes, hot: np.ndarray, weight: int) -> DataFrame:
    """Edges (u, v) between classes of texts; classes with a common signature are connected by them."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, None]]:
        for piece in pieces(batch, "text", _PIECE):
            sets, offsets = shingle_sets(piece.column("text"), words)
            cls = classes_of(sets, offsets)
            once = np.zeros(len(cls), bool)
            once[np.unique(cls, return_index=True)[1]] = True
            size = np.where(once, np.diff(offsets), 0)
            yield sets[np.repeat(once, np.diff(offsets))], np.concatenate(([0], np.cumsum(size))), cls, None

    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''")
    return _ties_of(texts, read, sizes=sizes, hot=hot, weight=weight)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with a ``body``, some at a time, with their sets and where each starts."""
    for piece in pieces(batch, "body", 4 * _PIECE):
        data, offsets = text_bytes(piece.column("body"))
        yield piece, data.view(np.uint64), offsets >> 3


def set_ties(bodies: DataFrame, *, sizes: Sizes, hot: np.ndarray, weight: int) -> DataFrame:
    """Edges (u, v) between groups (``root``) of the same component (``comp``), as for texts."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for piece, sets, offsets in _sets_of(batch):
            yield sets, offsets, piece.column("root").to_numpy(), piece.column("comp").to_numpy()

    return _ties_of(bodies.select("comp", "root", "body"), read, sizes=sizes, hot=hot, weight=weight)


def _ties_of(
    rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple]], *, sizes: Sizes, hot: np.ndarray, weight: int
) -> DataFrame:
    """``read`` gives sets, where each starts, their classes, and what has to be equal for a tie, if anything; ``weight`` is the
    number of shingles."""
    schema = "bucket bigint, a binary, b binary"
    hot_set = rows.sparkSession.sparkContext.broadcast(hot)
    buckets = 1 + int(weight * 0.5) // _SIGNATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            unique, least, u, v = _ties(np.concatenate(keys), np.concatenate(nodes))
            lowest = np.array([k * ((1 << 64) // buckets) for k in range(buckets)], np.uint64)
            cuts = np.append(np.searchsorted(unique, lowest), len(unique)).tolist()
            parts = [(k, unique[a:b].tobytes(), least[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            if len(u):
                parts.append((-1 - int(u[0] % buckets), u.tobytes(), v.tobytes()))
            for start in range(0, len(parts), 64):
                some = zip(*parts[start : start + 64])
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "a", "b"), map(list, some))))
            keys.clear()
            nodes.clear()

        for batch in batches:
            for sets, offsets, cls, within in read(batch):
                key, row = signatures(sets, offsets, sizes, hot_set.value)
                keys.append(key if within is None else mixed(key ^ within[row].view(np.uint64)))
                nodes.append(cls[row])
                if sum(map(len, keys)) >= _SIGNATURES:
                    yield from flush()
        if keys:
            yield from flush()

    def tie(table: pa.Table) -> pa.Table:
        a = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")])
        b = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("b")])
        if table.column("bucket")[0].as_py() < 0:
            u, v = _distinct(a.view(np.int64), b)
            return pa.Table.from_batches([_rows(u=u, v=v)])
        *_, u, v = _ties(a, b)
        return pa.Table.from_batches([_rows(u=u, v=v)])

    return rows.mapInArrow(lean(run), schema).groupBy("bucket").applyInArrow(lean_group(tie), "u bigint, v bigint")


def linked(sets: list[np.ndarray], similarity: Fraction, left: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets are linked, as a square matrix above its diagonal. Only pairs with one of ``left`` are asked for.

    Overlaps are accumulated over blocks of columns; pairs that can't reach what their sizes ask for are discarded.
    """
    size = np.array([len(s) for s in sets], np.int64)
    n, d = similarity.numerator, similarity.denominator
    # All squares hold 32 bits an entry, and few are held at a time: a component's part has two thousand classes and more.
    need = np.empty((len(sets), len(sets)), np.int32)
    for k in range(len(sets)):
        # d * overlap >= n * (both - overlap)
        need[k] = -(-n * (size[k] + size) // (n + d))
    rest = size.astype(np.int32)
    open_pairs = np.triu(np.minimum.outer(rest, rest) >= need, 1)
    if left is not None:
        open_pairs &= left[:, None] | left[None, :]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([True], values[1:] != values[:-1]))) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    del values, order, shared
    overlap = np.zeros(need.shape, np.int32)
    rest = np.bincount(owner, minlength=len(sets)).astype(np.int32)
    start = 0
    while True:
        reach = np.minimum.outer(rest, rest)
        reach += overlap
        open_pairs &= reach >= need
        del reach
        if start == len(column) or not open_pairs.any():
            return open_pairs & (overlap >= need)
        stop = int(np.searchsorted(column, column[start] + _COLUMNS))
        incidence = np.zeros((len(sets), int(column[stop - 1] - column[start]) + 1), np.float32)
        incidence[owner[start:stop], column[start:stop] - column[start]] = 1
        # Products are whole numbers of up to _COLUMNS, so nothing is lost.
        np.add(overlap, incidence @ incidence.T, out=overlap, casting="unsafe")
        rest -= np.bincount(owner[start:stop], minlength=len(sets)).astype(np.int32)
        start = stop


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    near, seen, edges = links | links.T, np.zeros(len(links), bool), []
    for root in range(len(links)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            new = near[front].any(axis=0) & ~seen
            seen |= new
            front = np.flatnonzero(new).tolist()
            edges += [(root, k) for k in front]
    return edges


def _block_links(rows: DataFrame, keys: list[str], similarity: Fraction) -> DataFrame:
    """Edges between the classes of each group; rows have ``comp``, ``cls``, ``body`` and ``asks`` besides the keys."""

    def run(table: pa.Table) -> pa.Table:
        comp, cls = table.column("comp").to_numpy(), table.column("cls").to_numpy()
        asks = table.column("asks").to_numpy()
        order = np.lexsort((~asks, cls, comp))
        # A class that came twice counts once, as one that asks if either does.
        new = np.concatenate(([True], (np.diff(comp[order]) != 0) | (np.diff(cls[order]) != 0)))
        order = order[new]
        edges: list[tuple[int, int]] = []
        bodies = table.column("body")
        for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(part) > 1:
                sets = [np.frombuffer(bodies[int(k)].as_buffer(), np.uint64) for k in part]
                found = linked(sets, similarity, asks[part])
                edges += [(cls[part[a]], cls[part[b]]) for a, b in spanning(found)]
        u, v = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.Table.from_batches([_rows(u=u, v=v)])

    return rows.groupBy(*keys).applyInArrow(lean_group(run), "u bigint, v bigint")


def jaccard_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
    similarity: Fraction = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: identifier, ``n_shingles`` and ``component_id``."""
    sizes = Sizes(similarity)
    table = written(class_table(docs, id_col=id_col, text_col=text_col, words=words), "classes")
    members = table.where("n >= 0")
    total = members.agg(F.sum("n")).first()[0] or 0
    ties = text_ties(docs, text_col=text_col, words=words, sizes=sizes, hot=hot_shingles(table), weight=total)
    ties = written(ties, "ties")
    near = written(components(ties).select(F.col("node").alias("cls"), F.col("root").alias("comp")), "near")

    # One row for each class that may have links, and how many blocks its component takes.
    one = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "h", "n")).alias("one"))
    chosen = near.join(one, "cls").select("comp", "cls", "one.*")
    chosen = written(chosen.join(_blocks(chosen), "comp"), "chosen")
    weight, classes = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = F.broadcast(chosen) if classes <= BROADCAST_ROWS else chosen
    bodies = written(_bodies(docs, wanted, id_col=id_col, text_col=text_col, words=words), "sets")

    # Small components share groups; a large one has groups of its own.
    large = F.col("blocks") > 1
    bins = 1 + int(weight // BLOCK_SHINGLES)
    own = F.when(large, F.col("comp")).otherwise(F.lit(0))
    slot = F.when(large, F.pmod(F.xxhash64("cls"), "blocks")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins)))
    dealt = bodies.select("comp", "cls", "body", F.lit(True).alias("asks"), own.alias("own"), slot.alias("slot"))
    links = written(_block_links(dealt, ["own", "slot"], similarity), "links")
    if not chosen.where(large).isEmpty():
        links = _across_blocks(_divided(bodies.where(large), links, sizes), links, similarity)
    roots = components(links).select(F.col("node").alias("cls"), "root")

    whole = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = whole.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    named = whole.join(least, "root", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _size_of_body() -> Column:
    return F.octet_length("body").cast("bigint") / 8


def _blocks(classes: DataFrame) -> DataFrame:
    """How many blocks each component takes, from its classes' sizes ``n``."""
    amount = F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)
    return classes.groupBy("comp").agg(F.ceil(amount).alias("blocks"))


def _shared(bodies: DataFrame, weight: int) -> DataFrame:
    """(h, n): the shingles that ``HOT_IN_LARGE`` sets or more have, and -n, their number; ``weight`` is that of all sets."""
    buckets = 1 + weight // _SIGNATURES
    lowest = np.array([k * ((1 << 64) // buckets) for k in range(buckets)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values = np.sort(np.concatenate(waiting))
            waiting.clear()
            cuts = np.append(np.searchsorted(values, lowest), len(values)).tolist()
            parts = [(k, values[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            for start in range(0, len(parts), 64):
                some = zip(*parts[start : start + 64])
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "a"), map(list, some))))

        for batch in batches:
            for _, sets, _ in _sets_of(batch):
                # Not a view: that would hold the whole batch.
                waiting.append(sets.copy())
                if sum(map(len, waiting)) >= _SIGNATURES:
                    yield from flush()
        if waiting:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")])
        values, counts = np.unique(values, return_counts=True)
        often = counts >= HOT_IN_LARGE
        return pa.Table.from_batches([_rows(h=values[often].view(np.int64), n=-counts[often])])

    dealt = bodies.select("body").mapInArrow(lean(deal), "bucket bigint, a binary")
    return dealt.groupBy("bucket").applyInArrow(lean_group(count), "h bigint, n bigint")


def _divided(bodies: DataFrame, links: DataFrame, sizes: Sizes) -> DataFrame:
    """Classes of components of several blocks, in the smaller components that they make when tied anew.

    The work on such a component grows with the square of its classes. Most often passages tie them that are in many texts, but in
    too few of those of one task to have been seen there often. So the shingles of these components are all counted, and those
    count as common now that are in several classes. Groups that ``links`` has are tied as one; those that aren't tied to any
    other are left out, as they have no more links.
    """
    weight = bodies.agg(F.coalesce(F.sum(_size_of_body()), F.lit(0))).first()[0]
    hot = hot_shingles(_shared(bodies, int(weight)), HOT_IN_LARGE)
    roots = written(_groups_so_far(bodies, links).select("cls", "root", _size_of_body().alias("n")), "roots")
    ties = written(set_ties(bodies.join(roots, "cls"), sizes=sizes, hot=hot, weight=int(weight)), "ties")
    near = components(ties).select(F.col("node").alias("root"), F.col("root").alias("comp"))
    tied = written(roots.join(near, "root").select("comp", "cls", "n"), "near")
    placed = tied.join(_blocks(tied), "comp").select("comp", "cls", "blocks")
    return written(bodies.select("cls", "body").join(placed, "cls").select("comp", "cls", "blocks", "body"), "sets")


def _bodies(docs: DataFrame, chosen: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """``comp, cls, blocks, body``: the sorted set of each chosen class, from one of its rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    wanted = chosen.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "comp", "cls", "blocks")
    met = rows.join(wanted, rows["id"].eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                sets, offsets = shingle_sets(piece.column("text"), words)
                bodies = [sets[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [piece.column("comp"), piece.column("cls"), piece.column("blocks"), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["comp", "cls", "blocks", "body"])

    return met.select("comp", "cls", "blocks", "text").mapInArrow(lean(run), "comp bigint, cls bigint, blocks bigint, body binary")


def _groups_so_far(bodies: DataFrame, links: DataFrame) -> DataFrame:
    """``bodies`` with ``root``, the group that the links put a class into."""
    roots = components(links).select(F.col("node").alias("cls"), "root")
    return bodies.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _across_blocks(bodies: DataFrame, links: DataFrame, similarity: Fraction) -> DataFrame:
    """The links of components of several blocks, added to those within blocks."""
    heads = _groups_so_far(bodies, links).where("root = cls").withColumn("n", _size_of_body())
    parts = _blocks(heads).withColumnRenamed("blocks", "parts")
    heads = heads.join(parts, "comp").select(
        "comp", "cls", "body", F.lit(True).alias("asks"), F.pmod(F.xxhash64("cls", F.lit("heads")), "parts").alias("slot")
    )
    links = written(links.unionByName(_block_links(heads, ["comp", "slot"], similarity)), "links")

    grouped = _groups_so_far(bodies, links).select("comp", "cls", "blocks", "root", _size_of_body().alias("n"))
    grouped = written(grouped, "groups")
    by_root = grouped.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    largest = by_root.groupBy("comp").agg(
        F.max(F.struct("size", "root", "n")).alias("largest"), F.sum("size").alias("all"), F.sum("n").alias("weight")
    )
    largest = largest.select(
        "comp", F.col("largest.root").alias("main"),
        (F.col("all") - F.col("largest.size")).alias("left"), (F.col("weight") - F.col("largest.n")).alias("left_weight"),
    )
    divided = grouped.join(largest.where("left > 0"), "comp").withColumn("asks", F.col("root") != F.col("main"))
    # Blocks of the classes that ask, by their number and weight; they may be larger than those they meet, as each is sent to all of these.
    parts = F.ceil(F.greatest(F.col("left") / BLOCK_CLASSES, F.col("left_weight") / (2 * BLOCK_SHINGLES), F.lit(1)))
    divided = divided.select(
        "comp", "cls", "asks", parts.alias("parts"), "blocks",
        F.pmod(F.xxhash64("cls", F.lit("asking")), parts).alias("row_part"),
        F.pmod(F.xxhash64("cls"), "blocks").alias("column_part"),
    )
    asking = divided.where("asks").select(
        "comp", "cls", "asks", "row_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("column_part")
    )
    asked = divided.select(
        "comp", "cls", F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("row_part"), "column_part"
    )
    rows = asking.unionByName(asked).join(bodies.select("cls", "body"), "cls")
    return written(links.unionByName(_block_links(rows, ["comp", "row_part", "column_part"], similarity)), "links")


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
    similarity: Fraction = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller identifier; rows that share one go together."""
    found = jaccard_groups(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    groups = written(found, "groups")
    gone = groups.where("component_id IS NOT NULL AND NOT component_id <=> " + f"`{id_col}`").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone")), "left_anti")
