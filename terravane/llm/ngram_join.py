"""Jaccard join of documents on word n-grams: a blocked sparse product of the document by n-gram incidence.

Documents with the same set are one row of the incidence, whatever their number. A pair that reaches the similarity has a
column in common among the first n - ceil(0.8 n) + 1 of each row (columns in order of rarity), so the product's entries that can
count are those of rows that meet there: a column of k rows gives each row with one centre and a few neighbours, not k squared.
Sizes and places discard what cannot reach the bound. The entries that are left are dealt to blocks of rows that belong together;
a block has its rows once, as sparse rows, and multiplies them column block by column block: overlaps accumulate by (row, row),
and after each column block those go that the sizes of what is left cannot bring to the bound any more. Only columns whose rows
did not all come together in one component are looked at in full, for the pairs of different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, Texts, batches, column, fresh, id_and_text, if_small, mark, prepare, release, trim
from terravane.llm.components import connected_components
from terravane.llm.words import MIX, Words

#: Bytes of words `[^\x20\x09-\x0D]`.
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Counters of the sketch that says which n-grams are frequent, and how many travel together.
BUCKETS, TOGETHER = 1 << 22, 1 << 16
SIZE = 5


def ngram_sets(data: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one after another, and their bounds; a shorter text is one n-gram."""
    words = Words(data, bounds, _WORD)
    n = np.diff(words.first)
    grams = words.shingles(size)
    row = np.searchsorted(words.first, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + size <= words.first[row + 1]
    grams, row = grams[inside], row[inside]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                has = n[few] > j
                own[has] += words.hash[words.first[few[has]] + j] * MIX[j]
            own = (own ^ (own >> np.uint64(32))) + n[few].astype(np.uint64)
        grams, row = np.concatenate([grams, own]), np.concatenate([row, few])
    by = np.lexsort((grams, row))
    grams, row = grams[by], row[by]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(bounds)))


def _bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _narrow(counts: np.ndarray) -> str:
    """The narrowest unsigned type that holds the counts."""
    most = int(counts.max())
    return next(t for t, end in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if most < end)


def column_levels(rows: DataFrame) -> np.ndarray:
    """How frequent the n-grams of each bucket are, over all documents, in steps of a quarter of a doubling.

    A task sums what it has read and sends its counters in parts; the parts are summed as they stream in, and a byte of each counter
    comes to the driver.
    """
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def count(it):
        total = np.zeros(BUCKETS, np.uint32)  # a task's documents are far fewer than 2^32
        some = False
        for batch in it:
            texts = Texts(batch.column(0))
            for i, j in texts.pieces(1 << 19):
                grams, _ = ngram_sets(texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i])
                np.add.at(total, _bucket(grams), 1)
                some = True
        if some:
            parts = total.reshape(-1, TOGETHER)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(_narrow(p)).tobytes() for p in parts], pa.binary())], schema=schema)
        del total
        trim()

    def total(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, f"<u{len(raw) // TOGETHER}").astype(np.int64)
                sums[part] = sums[part] + own if part in sums else own
        if sums:
            steps = [np.minimum(np.log2(x + 1.0) * 4, 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], schema=schema)

    spec = "part int, counts binary"
    reducers = min(BUCKETS // TOGETHER, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = rows.select("text").mapInArrow(count, spec).repartition(reducers, "part").mapInArrow(total, spec).collect()  # BUCKETS numbers
    out = np.zeros(BUCKETS, np.uint8)
    for r in summed:
        out[r["part"] * TOGETHER : (r["part"] + 1) * TOGETHER] = np.frombuffer(r["counts"], np.uint8)
    return out


def _signatures(rows: DataFrame, shared, numer: int, denom: int) -> DataFrame:
    """doc_id, n, two hashes of the whole set, and the necessary columns in order of rarity."""
    spec = [("doc_id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("columns", pa.list_(pa.int64()))]

    @batches(spec)
    def sign(batch):
        texts = Texts(batch.column(1))
        sizes, h1, h2, columns, counts = [], [], [], [], []
        for i, j in texts.pieces(1 << 19):
            grams, at = ngram_sets(texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i])
            n = np.diff(at)
            row = np.repeat(np.arange(j - i), n)
            total = np.zeros((2, j - i), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(2):
                    mixed = grams * MIX[2 * k + 1]
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX[2 * k + 2]
                    sums = np.r_[np.uint64(0), np.cumsum(mixed ^ (mixed >> np.uint64(27)))]
                    total[k] = sums[at[1:]] - sums[at[:-1]]
            key = (shared.value[_bucket(grams)].astype(np.uint64) << np.uint64(55)) | (grams >> np.uint64(9))
            key = key[np.lexsort((key, row))].astype(np.int64)
            keep = n - -(-n * numer // denom) + (n > 0)
            columns.append(key[np.arange(len(key)) - np.repeat(at[:-1], n) < np.repeat(keep, n)])
            sizes.append(n)
            counts.append(keep)
            h1.append(total[0].view(np.int64))
            h2.append(total[1].view(np.int64))
        offsets = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns)))
        return [batch.column(0), np.concatenate(sizes).astype(np.int32), np.concatenate(h1), np.concatenate(h2), lists]

    return rows.mapInArrow(sign, "doc_id long, n int, h1 long, h2 long, columns array<long>")


#: Rows of a column that a batch sends on to the other tasks, and how many rows before it each row is multiplied with.
SENT, BACK = 16, 3
_STAR = "column long, x long, xp long, c long, cp long, home long"
_STAR_SCHEMA = pa.schema([(n, pa.int64()) for n in ("column", "x", "xp", "c", "cp", "home")])


def _admissible(xp: np.ndarray, cp: np.ndarray, numer: int, denom: int) -> np.ndarray:
    """Whether sizes and places (size << 32 | place in the row's order) let two rows with this column reach the similarity."""
    nx, ny = xp >> 32, cp >> 32
    need = -(-numer * (nx + ny) // (numer + denom))
    place = (1 << 32) - 1
    return (denom * nx >= numer * ny) & (denom * ny >= numer * nx) & ((xp & place) <= nx - need) & ((cp & place) <= ny - need)


_ADMISSIBLE = """
    {denom} * (xp >> 32) >= {numer} * (cp >> 32) AND {denom} * (cp >> 32) >= {numer} * (xp >> 32)
    AND (xp & 4294967295) <= (xp >> 32) - ({numer} * ((xp >> 32) + (cp >> 32)) + {numer} + {denom} - 1) div ({numer} + {denom})
    AND (cp & 4294967295) <= (cp >> 32) - ({numer} * ((xp >> 32) + (cp >> 32)) + {numer} + {denom} - 1) div ({numer} + {denom})
"""


def _groups(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ordered by column: the place of each one's first row, and how many rows that column has."""
    first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    size = np.diff(np.r_[first, len(column)])
    return np.repeat(first, size), np.repeat(size, size)


def _neighbours(column, x, xp, centre, new, numer, denom) -> pa.RecordBatch | None:
    """Distinct admissible pairs of each new row with the BACK rows before it, without their columns; home is the column's centre."""
    found = []
    for d in range(1, BACK + 1):
        i = np.flatnonzero((column[d:] == column[:-d]) & new[d:]) + d
        i = i[_admissible(xp[i], xp[i - d], numer, denom) & (x[i] != x[i - d])]
        found.append(np.column_stack([x[i], x[i - d], xp[i], xp[i - d], centre[i]]))
    pairs = np.concatenate(found)
    if not len(pairs):
        return None
    by = np.lexsort((pairs[:, 4], pairs[:, 1], pairs[:, 0]))
    pairs = pairs[by]
    pairs = pairs[np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]]
    return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), *[pa.array(pairs[:, k]) for k in (0, 2, 1, 3, 4)]], schema=_STAR_SCHEMA)


def _stars(rows: DataFrame, numer: int, denom: int) -> DataFrame:
    """(null, x, its place, y, its place, c): admissible pairs of neighbours in a column's order by size; and for the rows of a column
    that has more rows than neighbours meet in: (column, x, its place, c, its place, c), c being one row of the column for all of it.
    """

    def within(it):
        """Stars among the rows of a batch; the first SENT rows of each column, with c null, go on to the other tasks."""
        for batch in (b.slice(k, 8192) for b in it for k in range(0, b.num_rows, 8192)):
            lists = batch.column(2)
            each = np.diff(lists.offsets.to_numpy())
            column = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            x, n = np.repeat(batch.column(0).to_numpy(), each), np.repeat(batch.column(1).to_numpy().astype(np.int64), each)
            xp = (n << 32) | (np.arange(len(column)) - np.repeat(np.cumsum(each) - each, each))
            by = np.lexsort((x, n, column))
            column, x, xp = column[by], x[by], xp[by]
            if not len(column):
                continue
            first, _ = _groups(column)
            nth = np.arange(len(column)) - first
            sent, kept = nth < SENT, nth >= SENT
            none = pa.nulls(int(sent.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(column[sent]), pa.array(x[sent]), pa.array(xp[sent]), none, none, none], schema=_STAR_SCHEMA)
            if kept.any():
                centre = x[first]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (column[kept], x[kept], xp[kept], centre[kept], xp[first[kept]], centre[kept])], schema=_STAR_SCHEMA)
                if (pairs := _neighbours(column, x, xp, centre, kept, numer, denom)) is not None:
                    yield pairs
        trim()

    def across(it):
        """Stars among the rows that were sent, ordered by column; what is done already passes through."""
        tail, centre = None, None
        for batch in it:
            done = batch.column(3).is_valid()
            if done.true_count:
                yield batch.filter(done)
            if done.true_count == batch.num_rows:
                continue
            column, x, xp = (c.to_numpy() for c in batch.filter(pc.invert(done)).columns[:3])
            carried = 0
            if tail is not None and tail[0][-1] == column[0]:
                same = tail[0] == column[0]
                carried = int(same.sum())
                column, x, xp = (np.r_[t[same], v] for t, v in zip(tail, (column, x, xp), strict=True))
            first, size = _groups(column)
            cx, cp = x[first], xp[first]
            if carried:
                own = first == 0
                cx, cp = np.where(own, centre[0], cx), np.where(own, centre[1], cp)
            new = np.arange(len(column)) >= carried
            # neighbours are all pairs of a column of BACK + 1 rows; one that goes on in other batches may have more
            star = new & (x != cx) & ((size > BACK + 1) | (column == column[-1]) | (column == column[0]))
            if star.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[star]) for v in (column, x, xp, cx, cp, cx)], schema=_STAR_SCHEMA)
            if (pairs := _neighbours(column, x, xp, cx, new, numer, denom)) is not None:
                yield pairs
            tail, centre = tuple(v[-BACK:].copy() for v in (column, x, xp)), (int(cx[-1]), int(cp[-1]))
        trim()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.select("x", "n", "columns").mapInArrow(within, _STAR)
    dealt = local.repartition(parts, F.when(F.col("c").isNull(), F.col("column")).otherwise(F.col("x")))  # what is done goes by its row
    return dealt.sortWithinPartitions("column", "xp", "x").mapInArrow(across, _STAR)


def _shuffled_neighbours(members: DataFrame, numer: int, denom: int) -> DataFrame:
    """Admissible pairs of different components among neighbours in a random order of each column, as _candidates gives them.

    One such pair can join two large components, whose rows then need not be multiplied one by one. Columns of very many rows are split.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = members.groupBy("column").agg(F.ceil(F.count("*") / 10_000).alias("splits"))
    dealt = members.join(size, "column").select("column", F.pmod(F.xxhash64("d"), "splits").alias("split"), "d", "p", "d_part", F.xxhash64("d", "column").alias("at"))
    dealt = dealt.repartition(parts, "column", "split").sortWithinPartitions("column", "split", "at")

    def near(it):
        for batch in it:
            column, split, d, p, part = (batch.column(k).to_numpy() for k in range(5))
            for back in range(1, 2 * BACK + 1):
                i = np.flatnonzero((column[back:] == column[:-back]) & (split[back:] == split[:-back]) & (part[back:] != part[:-back])) + back
                i = i[_admissible(p[i], p[i - back], numer, denom)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (column[i], d[i], p[i], d[i - back], p[i - back], column[i])], schema=_STAR_SCHEMA)

    return _candidates(dealt.mapInArrow(near, _STAR))


def _candidates(stars: DataFrame) -> DataFrame:
    """Distinct pairs u < v of rows, with their sizes and a home that pairs which belong together share."""
    first = F.col("x") < F.col("c")
    each = stars.where("x <> c").select(
        F.least("x", "c").alias("u"), F.greatest("x", "c").alias("v"), "home",
        F.shiftright(F.when(first, F.col("xp")).otherwise(F.col("cp")), 32).alias("nu"), F.shiftright(F.when(first, F.col("cp")).otherwise(F.col("xp")), 32).alias("nv"),
    )
    return each.groupBy("u", "v").agg(F.min("home").alias("home"), F.max("nu").alias("nu"), F.max("nv").alias("nv"))


#: N-grams of the sparse rows that a block may have, column blocks after which hopeless pairs go, and entries multiplied at once.
BLOCK, COLUMN_BLOCKS, ENTRIES = 1 << 20, 4, 1 << 18


def overlaps(values: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, numer: int, denom: int) -> np.ndarray:
    """Of the pairs (a, b) of sparse rows, whether their product reaches the bound of their sizes.

    values: the rows' column ids, ascending in each row, from 0; at: the rows' bounds. The product is taken column block by column
    block: overlaps accumulate by pair, and a pair goes as soon as all that is left of its shorter row would not do.
    """
    width = int(values.max(initial=0)) + 1
    n = np.diff(at)
    need = -(-numer * (n[a] + n[b]) // (numer + denom))
    total = np.zeros(len(a), np.int64)
    alive = np.flatnonzero(np.minimum(n[a], n[b]) >= need)
    ends = at[:-1]
    for k in range(COLUMN_BLOCKS):
        starts, edge = ends, -(-width * (k + 1) // COLUMN_BLOCKS)
        below = np.r_[0, np.cumsum(values < edge)]
        ends = at[:-1] + below[at[1:]] - below[at[:-1]]  # rows are sorted: what lies below the edge comes first
        each = np.cumsum((ends - starts)[a[alive]] + (ends - starts)[b[alive]])
        for own in np.split(alive, np.unique(np.searchsorted(each, np.arange(ENTRIES, int(each[-1]) if len(each) else 0, ENTRIES)))):
            x, pair_x = _spread(values, starts, ends, a[own], width)
            y, _ = _spread(values, starts, ends, b[own], width)
            if len(x) and len(y):
                hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                total[own] += np.bincount(pair_x[hit], minlength=len(own))
        left = np.minimum(at[1:][a[alive]] - ends[a[alive]], at[1:][b[alive]] - ends[b[alive]])
        alive = alive[total[alive] + left >= need[alive]]
    out = np.zeros(len(a), bool)
    out[alive] = (total[alive] >= need[alive]) & (n[a[alive]] > 0)
    return out


def _spread(values, starts, ends, rows, width) -> tuple[np.ndarray, np.ndarray]:
    """(pair, column) as one ascending number for the entries of a part of each pair's row, and the pair of each."""
    each = ends[rows] - starts[rows]
    pair = np.repeat(np.arange(len(rows)), each)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    return pair * width + values[np.repeat(starts[rows], each) + step], pair


def _multiplied(table: pa.Table, numer: int, denom: int) -> pa.RecordBatch:
    """The linked pairs of some whole blocks; table: block, doc, other (null for a sparse row), grams (null for a pair), by block and doc."""
    block, doc = table.column(0).to_numpy(), table.column(1).to_numpy()
    row = table.column(2).is_null().to_numpy()
    ordinal = np.cumsum(np.r_[False, block[1:] != block[:-1]])
    names = np.unique(doc[row])
    key = ordinal[row] * len(names) + np.searchsorted(names, doc[row])
    by = np.argsort(key, kind="stable")
    raw = table.column(3).filter(pa.array(row)).combine_chunks().take(pa.array(by))
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 8
    grams = np.frombuffer(data, np.uint64, count=int(at[-1]))[at[0] :]
    at = at - at[0]
    values = np.unique(grams, return_inverse=True)[1].reshape(-1)
    u, v = doc[~row], table.column(2).filter(pa.array(~row)).to_numpy()
    find = lambda d: np.searchsorted(key[by], ordinal[~row] * len(names) + np.searchsorted(names, d))
    keep = overlaps(values, at, find(u), find(v), numer, denom)
    return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], schema=_PAIR)


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _linked(pairs: DataFrame, rows: DataFrame, scratch: Scratch, numer: int, denom: int) -> DataFrame:
    """Those of the pairs whose whole rows overlap enough, written.

    Pairs of one home are a block; a home whose rows may have more than BLOCK n-grams is split by the rows that
    are not the home itself. A block gets each of its rows once, and a task reads blocks one after another.
    """
    large = pairs.groupBy("home").agg(F.ceil(F.sum(F.col("nu") + F.col("nv")) / BLOCK).alias("splits")).where("splits > 1")
    split = F.pmod(F.xxhash64(F.when(F.col("u") == F.col("home"), F.col("v")).otherwise(F.col("u"))), F.coalesce("splits", F.lit(1)))
    placed = scratch.written(pairs.join(if_small(large, 16), "home", "left").select(F.xxhash64("home", split).alias("block"), "u", "v"), "placed")
    wanted = placed.select("block", F.col("u").alias("doc_id")).union(placed.select("block", F.col("v").alias("doc_id"))).distinct()
    sets = _whole_sets(rows, wanted.select("doc_id").distinct())
    sparse = wanted.join(sets, "doc_id").select("block", "doc_id", F.lit(None).cast("long").alias("other"), "grams")
    fed = sparse.union(placed.select("block", "u", "v", F.lit(None).cast("binary")))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def multiply(it):
        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += batch.nbytes
            if size < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            block = table.column(0).to_numpy()
            whole = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
            if whole:
                yield _multiplied(table.slice(0, whole), numer, denom)
            held, size = table.slice(whole).to_batches(), table.slice(whole).nbytes
        if held:
            yield _multiplied(pa.Table.from_batches(held), numer, denom)
        trim()

    linked = scratch.written(fed.repartition(parts, "block").sortWithinPartitions("block", "doc_id").mapInArrow(multiply, "u long, v long"), "links")
    scratch.drop(placed)
    return linked


def _whole_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The whole sets of some documents, from their texts."""
    spec = [("doc_id", pa.int64()), ("grams", pa.binary())]

    @batches(spec)
    def whole(batch):
        texts, out = Texts(batch.column(1)), []
        for i, j in texts.pieces(1 << 19):
            grams, at = ngram_sets(texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i])
            raw = grams.tobytes()
            out += [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [batch.column(0), out]

    return rows.join(if_small(nodes, 16), "doc_id", "left_semi").mapInArrow(whole, "doc_id long, grams binary")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numer: int = 4, denom: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z), words are runs of other than white space, a set has the distinct
    five-word shingles, or the whole of a shorter text; null and empty texts have none and link with nothing. Two documents
    link if the Jaccard similarity of their sets is at least numer / denom; component_id is the smallest id that links reach.

    Rows of one id are one document; rows without an id take no part (component_id null). Shingles are compared as 64-bit
    hashes. Copies are represented by their smallest id, so a group of copies costs one row per task.
    """
    spark = prepare(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    with Scratch(spark, "ngrams") as scratch:
        levels = spark.sparkContext.broadcast(column_levels(rows))  # 4 MB, whatever the input
        signs = scratch.written(_signatures(rows, levels, numer, denom), "signatures", keep=True)
        levels.destroy()
        known = signs.where("n > 0 AND doc_id IS NOT NULL")
        several = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("x"), F.count("*").alias("copies")).where("copies > 1")
        several = scratch.written(several, "copies", keep=True)
        copies = known.select("doc_id", "h1", "h2").join(several, ["h1", "h2"]).where("doc_id <> x").select("doc_id").distinct()
        groups = known.join(if_small(copies, 16), "doc_id", "left_anti").select(F.col("doc_id").alias("x"), "n", "columns")
        stars = scratch.written(_stars(groups, numer, denom), "stars")
        admissible = _ADMISSIBLE.format(numer=numer, denom=denom)
        pairs = scratch.written(_candidates(stars.where(f"column IS NULL OR ({admissible})")), "pairs")
        links = _linked(pairs, rows, scratch, numer, denom)
        parts = connected_components(links, scratch)

        # columns whose rows are not all in one component by now
        whole = stars.where("column IS NOT NULL")
        apart = _of(_of(whole, "x", parts), "c", parts).where("x_part <> c_part").select("column").distinct()
        still = whole.join(apart, "column", "left_semi")
        members = still.select("column", F.col("x").alias("d"), F.col("xp").alias("p")).union(still.select("column", F.col("c").alias("d"), F.col("cp").alias("p"))).distinct()
        members = scratch.written(_of(members, "d", parts), "apart")
        again = scratch.written(_shuffled_neighbours(members, numer, denom).join(pairs, ["u", "v"], "left_anti"), "again")
        scratch.drop(stars)
        if not again.isEmpty():
            found = _linked(again, rows, scratch, numer, denom)
            pairs, links = pairs.union(again), links.union(found)
            parts = connected_components(links, scratch)
            members = _of(members.drop("d_part"), "d", parts)
            open_ = members.groupBy("column").agg((F.min("d_part") != F.max("d_part")).alias("open")).where("open").select("column")
            members = members.join(open_, "column", "left_semi")
        rest = scratch.written(_rest(members, signs, scratch, admissible).join(pairs, ["u", "v"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = links.union(_linked(rest, rows, scratch, numer, denom))
        parts = connected_components(links, scratch, keep=True)

    out = signs.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "h1", "h2").join(several.select("h1", "h2", "x"), ["h1", "h2"], "left")
    out = out.withColumn("x", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("x", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(parts.select(F.col("node").alias("x"), "component"), "x", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "x").alias("component_id"))


def _of(df: DataFrame, name: str, parts: DataFrame) -> DataFrame:
    """df with the component of a column's rows; a row without links is its own."""
    own = parts.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    return df.join(own, name, "left").withColumn(f"{name}_part", F.coalesce(f"{name}_part", name))


def _rest(members: DataFrame, signs: DataFrame, scratch: Scratch, admissible: str) -> DataFrame:
    """All admissible pairs of different components in the columns that are still open, but those within a column's commonest component.

    A pair is made in its first common column of all: elsewhere one of the columns just before is common too.
    """
    own = signs.join(if_small(members.select(F.col("d").alias("doc_id")).distinct(), 16), "doc_id", "left_semi")
    ordered = own.groupBy(F.col("doc_id").alias("d")).agg(F.any_value("columns").alias("columns"))
    place = F.expr("cast(p & 4294967295 as int)")
    members = members.join(ordered, "d").withColumn("earlier", F.slice("columns", F.greatest(place - 7, F.lit(1)), F.least(place, F.lit(8)))).drop("columns")
    members = scratch.written(members, "open")
    sizes = members.groupBy("column", "d_part").agg(F.count("*").alias("k"))
    members = members.join(sizes.groupBy("column").agg(F.max_by("d_part", F.struct("k", "d_part")).alias("main")), "column")
    a = members.where("d_part <> main").select("column", F.col("d").alias("x"), F.col("p").alias("xp"), F.col("d_part").alias("pu"), F.col("earlier").alias("eu"))
    b = members.select("column", F.col("d").alias("c"), F.col("p").alias("cp"), F.col("d_part").alias("pv"), F.col("earlier").alias("ev"), (F.col("d_part") == F.col("main")).alias("in_main"))
    met = a.join(b, "column").where(f"pu <> pv AND (in_main OR x < c) AND {admissible} AND NOT arrays_overlap(eu, ev)")
    return _candidates(met.withColumn("home", F.col("column")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numer: int = 4, denom: int = 5) -> DataFrame:
    """The rows of docs with the smallest id of their component, all columns as they are; rows without an id stay, repeated rows stay as often."""
    before = mark()
    with Scratch(docs.sparkSession, "one-of-each") as scratch:
        gone = fresh(docs, "gone")[0]
        found = ngram_components(docs, id_col, text_col, numer, denom).where("component_id <> doc_id")
        found = scratch.written(found.select(F.col("doc_id").alias(gone)).distinct(), "gone", keep=True)
        release(before)
    return docs.join(if_small(found, 16), column(id_col).cast("long") == F.col(gone), "left_anti")
