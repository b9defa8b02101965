"""Documents that stay similar under small edits: a T-occurrence search over inverted lists of word sequences."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.session import spread, written

WORD = re.compile(r"\w{2,}")
#: Counters of the frequency sketch; its size is the same for every corpus (4 MB).
COUNTERS = 1 << 20
#: Rows of the sketch that travel as one.
CHUNK = 1 << 14
#: Words of which the hash is kept by a worker.
KEPT_WORDS = 1_000_000
#: Groups of equal texts with at least 1/HOT of all rows (so at most HOT of them) are joined by broadcast.
HOT = 1000
#: Copies of one text that meet in one block.
CLASS = 2000
#: Bits of a hash that travel with a list: so many more than the corpus has sequences, that chance seldom joins two lists.
SPARE_BITS = 14


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_held = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct sequences of `width` words of each lower-cased text, ordered by row and hash."""
    found = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    words = np.fromiter(map(_held.__getitem__, itertools.chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(3) + words[k : len(words) - width + 1 + k])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parts = [np.unique(h[s : s + n - width + 1]) if n >= width else h[:0] for s, n in zip(starts, sizes)]
    return np.repeat(np.arange(len(texts)), [len(p) for p in parts]), np.concatenate(parts)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def _sets(width: int):
    """(id, hs): the sorted sequences of each text as bytes, so that texts are taken apart once and nothing handles them one by one."""

    def run(batches):
        for batch in batches:
            row, h = shingles(batch.column(1).to_pylist(), width)
            ends = 8 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            if ends[-1] >= 2**31:  # as long as an array of bytes may be: a text at a time
                for k in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([h[ends[k] // 8 : ends[k + 1] // 8].tobytes()])], ["id", "hs"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(h)])], ["id", "hs"])

    return run


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sequences of all rows, where each row's begin and end) of a column of _sets."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    h = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u8") if data is not None and len(ends) else np.zeros(0, np.uint64)
    return h, (ends - ends[0]).astype(np.int64) // 8


def _sketch(batches):
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(_slot(_sequences(batch.column(0))[0]), minlength=COUNTERS)
    parts = np.minimum(total, 2**32 - 1).astype("<u4").reshape(-1, CHUNK)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts])], ["chunk", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, "<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4")
    return pa.table({"chunk": [table["chunk"][0].as_py()], "counts": [total.tobytes()]})


def frequencies(sets: DataFrame) -> np.ndarray:
    """Upper bounds of the number of texts that hold a sequence, by slot of its hash; over all texts. What reaches the driver, and every task
    after it, is the sketch of 4 MB."""
    added = sets.select("hs").mapInArrow(_sketch, "chunk bigint, counts binary").groupBy("chunk").applyInArrow(_add, "chunk bigint, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for r in added.collect():
        out[r[0] * CHUNK : (r[0] + 1) * CHUNK] = np.frombuffer(bytes(r[1]), "<u4")
    return out


def _least(share: float, n: np.ndarray) -> np.ndarray:
    """The fewest common sequences with which a set of n can reach the share with any other."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _short_lists(share: float, counts, drop: int):
    """(hash, id, n) of the sequences of a text that come first in the order by frequency: of n, the n - T + 1 rarest,
    T being the fewest that must be common. Two texts with T in common share one of these."""

    def run(batches):
        for batch in batches:
            h, ends = _sequences(batch.column(1))
            if not len(h):
                continue
            # one number to order by: the frequency, then the hash
            key = np.minimum(counts.value[_slot(h)], 0xFFFF).astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
            n = np.diff(ends)
            first = n - _least(share, n) + 1
            keep = np.concatenate([s + np.argpartition(key[s : s + m], k - 1)[:k] for s, m, k in zip(ends, n, first) if m])
            kept = np.where(n > 0, first, 0)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array((h[keep] >> np.uint64(drop)).view(np.int64)), pa.array(np.repeat(ids, kept)), pa.array(np.repeat(n, kept).astype(np.int32))], ["h", "id", "n"])

    return run


#: Lists up to this length are paired many at a time, longer ones row by row; those of more than LONG rows go to blocks of their own.
SHORT, LONG = 16, 2000
MET = "a bigint, b bigint, na int, nb int, h bigint"


def _fits(na, nb, share: float):
    """Whether sets of these sizes can reach the share."""
    return np.minimum(na, nb) >= share * np.maximum(na, nb) - 1e-9


def _merged(share: float, longest: int = LONG):
    """Pairs of texts that one short list holds, list by list: rows come ordered by hash. The rows of a list of more than `longest` are passed on as they
    are (b null, h the list), so what is held and what a list costs here is bounded."""

    def pairs(starts: np.ndarray, sizes: np.ndarray):
        for m in np.unique(sizes[(sizes > 1) & (sizes <= SHORT)]):
            at = starts[sizes == m]
            i, j = np.triu_indices(m, 1)
            yield (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        for s, m in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            for k in range(1, m):  # one against those before it: at most the list's length at a time
                yield np.arange(s, s + k), np.full(k, s + k)

    def rows(a, b, na, nb, h):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), pa.array(h, pa.int64())], ["a", "b", "na", "nb", "h"])

    def whole_lists(h, ids, n):
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(h)]]))
        far = np.repeat(sizes > longest, sizes)
        if far.any():
            yield rows(ids[far], np.ma.masked_all(far.sum(), np.int64), n[far], np.ma.masked_all(far.sum(), np.int32), h[far])
        for i, j in pairs(starts[sizes <= longest], sizes[sizes <= longest]):
            fits = _fits(n[i], n[j], share) & (ids[i] != ids[j])
            i, j = i[fits], j[fits]
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                yield rows(ids[i], ids[j], n[i], n[j], np.ma.masked_all(len(i), np.int64))

    def run(batches):
        held: tuple = ()
        passing = None  # the long list that is being passed on
        for batch in batches:
            h, ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if passing is not None:
                on = int(np.searchsorted(h, passing, "right"))
                if on:
                    yield rows(ids[:on], np.ma.masked_all(on, np.int64), n[:on], np.ma.masked_all(on, np.int32), h[:on])
                h, ids, n = h[on:], ids[on:], n[on:]
                passing = passing if not len(h) else None
            if not len(h):
                continue
            if held:
                h, ids, n = (np.concatenate(x) for x in zip(held, (h, ids, n)))
            whole = int(np.searchsorted(h, h[-1]))  # the last list may go on in the next batch
            held = (h[whole:], ids[whole:], n[whole:])
            if whole:
                yield from whole_lists(h[:whole], ids[:whole], n[:whole])
            if len(held[0]) > longest:
                yield from whole_lists(*held)
                passing, held = held[0][0], ()
        if held:
            yield from whole_lists(*held)

    return run


def _long_lists(rest: DataFrame, share: float, longest: int) -> DataFrame:
    """a, b, na, nb, c of the lists that were passed on: each list is cut into blocks by hash of the id, and every two blocks meet under a key of their own."""
    lists = rest.groupBy("h").agg(F.count("*").alias("m")).select("h", F.ceil(F.col("m") / F.lit(longest)).cast("int").alias("blocks"))
    at = rest.join(lists, "h").withColumn("at", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    x = at.select("h", F.col("at").alias("i"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("j"), "a", "na")
    y = at.select("h", F.explode(F.expr("sequence(0, at)")).alias("i"), F.col("at").alias("j"), F.col("a").alias("b"), F.col("na").alias("nb"))
    fits = F.least("na", "nb") >= share * F.greatest("na", "nb") - 1e-9
    met = x.join(y, ["h", "i", "j"]).where(((F.col("i") < F.col("j")) & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b"))) & fits)
    swap = F.col("a") > F.col("b")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return met.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))


def _probed(share: float):
    """Candidates whose overlap reaches the threshold: the sequences of the smaller set are looked up in the larger,
    which is sorted, by binary search."""

    def run(batches):
        for batch in batches:
            (va, ea), (vb, eb) = _sequences(batch.column(2)), _sequences(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = va[ea[k] : ea[k + 1]], vb[eb[k] : eb[k + 1]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[k] = common >= share * (len(x) + len(y) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def similar_texts(docs: DataFrame, width: int = 5, share: float = 0.8, min_chars: int = 200, longest: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes(id, rep): every text of docs(id, body) of at least min_chars characters with the
    smallest id of its exact copies. links(a, b): a < b, the representatives of different texts whose sets of `width`
    words in a row have at least `share` of their union in common.

    Null ids, null and shorter texts take no part; texts of fewer than `width` words have copies but no links; an id given
    twice with different texts counts with each; other columns are ignored; empty tables give no rows.

    Exact copies are folded first, by an aggregate with map-side combine; texts are taken apart once and their sequences written. Lists are
    ordered by a frequency sketch of fixed size over all texts, so the short (rare) lists come first and the long ones never need merging: a
    pair that shares T sequences shares one among the n - T + 1 rarest of each. Pairs whose occurrences in the short lists, with all that the
    long ones could add, reach T are candidates; their other sequences are probed by binary search (DivideSkip with the T - 1 longest lists of each
    text left to the probe). No cap: where a text has nothing rarer than a long list, the list is met in blocks.
    """
    rows = spread(docs.where((F.length("body") >= min_chars) & F.col("id").isNotNull()).select("id", "body"), "id")
    keyed = rows.select("id", F.xxhash64("body").alias("k1"), F.crc32("body").alias("k2"), F.length("body").alias("k3"))
    folded = keyed.groupBy("k1", "k2", "k3").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    many = written(folded.where(F.col("size") > 1), "many")
    total = max(1, rows.count())
    hot, cold = many.where(F.col("size") * HOT >= total), many.where(F.col("size") * HOT < total)
    key = ["k1", "k2", "k3"]
    copies = written(keyed.join(F.broadcast(hot), key).union(keyed.join(cold, key)).select("id", "rep"), "copies")
    # tables of known size from here on: Spark broadcasts them while they are under its threshold, and shuffles beyond
    single = rows.join(copies.where(F.col("id") != F.col("rep")).select("id"), "id", "left_anti")
    sets = written(single.mapInArrow(_sets(width), "id bigint, hs binary"), "sets")
    slots = frequencies(sets)
    drop = max(0, 64 - max(40, SPARE_BITS + int(slots.sum(dtype=np.int64)).bit_length()))
    counts = docs.sparkSession.sparkContext.broadcast(slots)
    short = spread(sets, "id").mapInArrow(_short_lists(share, counts, drop), "h bigint, id bigint, n int")
    met = short.repartition("h").sortWithinPartitions("h").mapInArrow(_merged(share, longest), MET)
    counted = written(met.groupBy("a", "b", "na", "nb", "h").agg(F.count("*").alias("c")), "met")
    merged, rest = counted.where(F.col("b").isNotNull()).drop("h"), counted.where(F.col("b").isNull()).select("h", "a", "na")
    if rest.limit(1).count():
        merged = merged.union(_long_lists(rest, share, longest)).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    # common ones in the short lists, and at most all of the rest of one of the two
    others = F.greatest(F.ceil(share * F.col("na") - 1e-9), F.ceil(share * F.col("nb") - 1e-9)) - 1
    needed = F.ceil((F.col("na") + F.col("nb")) * share / (1 + share) - 1e-9)
    merged = written(merged.where(F.col("c") + others >= needed).select("a", "b"), "candidates")
    ids = written(merged.select(F.col("a").alias("id")).union(merged.select(F.col("b").alias("id"))).distinct(), "ids")
    own = sets.join(ids, "id", "left_semi")
    left, right = own.withColumnsRenamed({"id": "a", "hs": "x"}), own.withColumnsRenamed({"id": "b", "hs": "y"})
    links = written(merged.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_probed(share), "a bigint, b bigint"), "links")
    return copies, links


def classes(docs: DataFrame, width: int = 5, share: float = 0.8, min_chars: int = 200) -> DataFrame:
    """id, class_id, copies, links of every text that takes part in similar_texts: the smallest id of its exact copies, how many there are, and with
    how many different texts the class is linked. The form for collections with large classes: a row a document, whatever the number of pairs."""
    copies, links = similar_texts(docs, width, share, min_chars)
    rows = docs.where((F.length("body") >= min_chars) & F.col("id").isNotNull()).select("id").distinct()
    ends = links.select(F.col("a").alias("class_id")).union(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = copies.groupBy("rep").agg(F.countDistinct("id").alias("copies")).withColumnRenamed("rep", "class_id")
    own = rows.join(copies.groupBy("id").agg(F.min("rep").alias("rep")), "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    out = own.join(ends, "class_id", "left").join(sizes, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_pairs(docs: DataFrame, width: int, share: float, min_chars: int = 200) -> DataFrame:
    """id_a < id_b of every two documents of similar_texts, copies included: the classes' links with their members. A class of m copies gives all its
    pairs, as the pair form demands; classes() has one row a document. A large class is met in blocks of CLASS copies, so no task holds it whole."""
    copies, links = similar_texts(docs, width, share, min_chars)
    a = copies.select(F.col("rep").alias("a"), F.col("id").alias("id_a"))
    b = copies.select(F.col("rep").alias("b"), F.col("id").alias("id_b"))
    wide = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    heads = docs.join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")  # copies are one text: one of them is looked at
    worded = heads.where(F.size(F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))) >= width).select(F.col("id").alias("rep")).distinct()
    sizes = copies.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(CLASS)).cast("int").alias("blocks"))
    cut = copies.join(worded, "rep", "left_semi").join(sizes, "rep").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = cut.select("rep", F.col("at").alias("i"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("j"), F.col("id").alias("x"))
    y = cut.select("rep", F.explode(F.expr("sequence(0, at)")).alias("i"), F.col("at").alias("j"), F.col("id").alias("y"))
    within = x.join(y, ["rep", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("x", "y")
    return wide.union(within).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
