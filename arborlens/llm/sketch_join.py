"""Near-duplicate documents: an exact Jaccard join of word shingles by parity sketches.

A document's set of shingles is XOR-hashed into a bit sketch: every shingle toggles one bit. Each bit of
Hamming distance between two sketches needs at least one shingle that only one set has, so the distance
never exceeds the symmetric difference. Two sets of joint size S with Jaccard index >= t differ in at most
k(S) = floor(S * (1 - t) / (1 + t)) shingles. Documents are put in bands of similar size. In a band every set is cut
by hash ranges into P parts, each with a sketch of its own of 2 ** 64 bits, so sparse that it is held as the XOR of the
numbers of its bits. P is above the band's largest k, so a linked pair agrees in the sketches of at least P - k(S)
parts (pigeonhole), and equal parts are joined: they are the keys. A document also sends keys for the bands of
larger partners; a pair is met in the band of its larger one. Parts without a shingle say little and are left out where
enough others remain. Pairs with fewer common keys than a linked pair must have are no candidates; the others
are compared by their whole sketches, and what remains is verified on the sets.

Equal sets are linked by a star, without the join. A key of more than ``small_group`` documents is frequent: its documents
are compared with its first one, and its rows are noted. A document whose frequent keys in a band are few enough meets
each of its partners there by rare keys as well. Where both of a pair have more, the documents of a frequent key that
are in different components by then are compared by their whole sketches, in blocks of bounded size; so no link
between components is lost, and a group of near copies costs a star and not its pairs.

Shingles are compared by 64-bit hashes: two different shingles of a pair of documents of n shingles each agree by
chance with odds of n * n / 2 ** 64 (2e-11 for 20,000), and equal sets are told by 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.common import cut, forget
from arborlens.llm.components import connected_components



@dataclass(frozen=True)
class Limits:
    """How much is done at once; results don't depend on it."""

    #: Documents with a common key up to which all pairs are tried at once.
    small_group: int = 8
    #: Documents of one flush with a common key from which only the first goes to the shuffle.
    local_group: int = 64
    #: Bytes of text and number of documents that are hashed at once; a longer text is taken alone.
    flush_bytes: int = 2 << 20
    flush_docs: int = 16384
    #: Keys of a task that are grouped at once.
    slice_keys: int = 1 << 17
    #: Rows of one frequent key on either side of a block.
    block: int = 2048
    #: Rows of frequent keys with the same first document that one task compares.
    lead_rows: int = 2048


#: 64-bit words that a product of sketches holds.
PRODUCT_WORDS = 1 << 20
#: Whole sketches have two to four bits per shingle within these limits.
LEAST_BYTES, MOST_BYTES = 8, 1 << 13
#: Ids of documents to verify up to which they are broadcast (8 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Ratio of a band's sizes, and parts beyond its k + 1: a share of k, and a least number where k is small.
BAND, SPARE, LEAST_SPARE = 1.5, 0.25, 2


def max_difference(total, num: int, den: int):
    """Largest symmetric difference of two sets of joint size ``total`` with Jaccard index >= num / den."""
    return total * (den - num) // (den + num)


def bands(num: int, den: int, limit: int):
    """(first sizes of the bands up to ``limit`` and beyond, parts per band) as arrays."""
    import numpy as np

    edges = [1]
    while edges[-1] <= limit * den // num + 1:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    k = [max_difference(2 * (e - 1), num, den) for e in edges[1:]]
    return np.array(edges), np.array([x + 1 + (max(LEAST_SPARE, int(SPARE * x)) if x else 0) for x in k])


def sketch_bytes(n):
    """Bytes of the whole sketch of a set of ``n`` shingles (array): a power of two."""
    import numpy as np

    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 4.0)).astype(np.int64).clip(0), LEAST_BYTES, MOST_BYTES)


def folded(words, n: int):
    """Sketches of 64-bit words in the last axis, folded to ``n`` words. Bits are numbered by the low bits of the
    hash, so halves XOR to the smaller sketch."""
    import numpy as np

    return np.bitwise_xor.reduce(words.reshape(*words.shape[:-1], -1, n), axis=-2)


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches, the larger one folded to the size of the smaller."""
    import numpy as np

    a, b = (np.frombuffer(s, dtype=np.uint64) for s in (x, y))
    n = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, n) ^ folded(b, n)).sum())


class Sets:
    """The shingle sets of some documents: sorted distinct hashes, document after document."""

    def __init__(self, data, ends, width: int):
        import numpy as np

        from arborlens.llm.common import batch_shingles

        self.hashes, self.doc = batch_shingles(data, ends, width)
        self.n = np.bincount(self.doc, minlength=len(ends) - 1)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.mixed = None

    def digests(self):
        """Two 64-bit sums of mixed hashes per document."""
        import numpy as np

        from arborlens.llm.common import mix64

        self.mixed = mix64(self.hashes)
        out = np.zeros((2, len(self.n)), dtype=np.int64)
        full = np.flatnonzero(self.n)
        if len(full):
            for k, h in enumerate((self.mixed, mix64(self.hashes ^ np.uint64(0xA24BAED4963EE407)))):
                out[k, full] = np.add.reduceat(h, self.at[full]).view(np.int64)
        return out

    def sketches(self) -> list[bytes]:
        """XOR of one bit per shingle."""
        import numpy as np

        size = sketch_bytes(self.n)
        begin = np.concatenate(([0], np.cumsum(size)))
        bit = 8 * begin[self.doc] + (self.mixed & (8 * size[self.doc] - 1).astype(np.uint64)).astype(np.int64)
        flat = np.packbits((np.bincount(bit, minlength=8 * begin[-1]) & 1).astype(np.uint8)).tobytes()
        return [flat[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]

    def keys(self, docs, band, parts, smax, num: int, den: int):
        """Join keys of ``docs`` for a band each: (key, index into docs), and per document twice its empty parts, plus one if
        those are sent."""
        import numpy as np

        from arborlens.llm.common import mix64

        place = np.full(len(self.n), -1)
        place[docs] = np.arange(len(docs))
        own = place[self.doc]
        chosen = own >= 0
        h, own = self.hashes[chosen], own[chosen]
        part = ((h >> np.uint64(32)) * parts[own].astype(np.uint64)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (own[1:] != own[:-1]))))
        words = np.bitwise_xor.reduceat(self.mixed[chosen], starts)
        part, own = part[starts], own[starts]
        empty = parts - np.bincount(own, minlength=len(docs))
        least = parts - max_difference(smax, num, den)  # common parts of every linked pair
        sent = least - empty < np.maximum(1, (least + 1) // 2)
        if sent.any():
            lone = np.flatnonzero(sent)
            first = np.zeros(len(docs), dtype=np.int64)
            first[lone] = np.cumsum(parts[lone]) - parts[lone]
            row = np.repeat(lone, parts[lone])
            bare = np.ones(len(row), dtype=bool)
            there = sent[own]
            bare[first[own[there]] + part[there].astype(np.int64)] = False
            part = np.concatenate((part, (np.arange(len(row)) - first[row])[bare].astype(np.uint64)))
            own = np.concatenate((own, row[bare]))
            words = np.concatenate((words, np.zeros(bare.sum(), dtype=np.uint64)))
        return mix64(words ^ mix64(part + (band[own].astype(np.uint64) << np.uint64(40)) + np.uint64(1))), own, 2 * empty + sent


def common_keys(edges, parts, low, high, x, y, num: int, den: int):
    """Common keys that a linked pair of sizes ``low`` and ``high`` has to have to be a candidate: two thirds of those that it has
    at least. ``x`` and ``y`` hold twice the empty parts of either, plus one if they are sent."""
    import numpy as np

    have = parts[np.searchsorted(edges, high, "right") - 1] - max_difference(low + high, num, den)
    have = np.maximum(1, have - np.where((x & y & 1) == 1, 0, np.minimum(x, y).astype(np.int64) >> 1))
    return have - have // 3


def slack(edges, parts, n, empty, step, num: int, den: int):
    """Frequent keys that a document may have in a band while its rare ones still find every partner."""
    import numpy as np

    band = np.searchsorted(edges, n, "right") - 1 + step
    smax = n + np.minimum(edges[band + 1] - 1, n * den // num)
    return np.maximum(0, parts[band] - max_difference(smax, num, den) - (empty.astype(np.int64) >> 1)) // 3


def _chunks(batch, limits: Limits):
    """(first row, end, bytes, their offsets) of runs of rows whose texts have about ``flush_bytes``."""
    import numpy as np

    column = batch.column(1)
    kind = np.int64 if "large" in str(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = min(max(at + 1, int(np.searchsorted(ends, ends[at] + limits.flush_bytes, "right")) - 1), at + limits.flush_docs, len(column))
        yield at, end, data[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
        at = end


_ROW = "kind int, id long, n long, d1 long, d2 long, sketch binary"
#: Arrays of numbers as bytes: keys of one bucket, pairs or rows of frequent keys.
_BLOB = ", bucket int, keys binary, entry binary, hot binary, ids binary, sizes binary, empty binary, steps binary"
_OUT = _ROW + ", b long, key long"


def _arrow(ddl: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _batch(schema, rows: int, /, **columns):
    import pyarrow as pa

    cols = [columns.get(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, f.type) if c is None else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, cols, strict=True)], schema=schema)


def _packed(kind: int, owner, buckets: int, **columns):
    """Arrays cut up by a bucket of their owner, a row for each bucket."""
    import numpy as np

    from arborlens.llm.common import mix64

    bucket = (mix64(owner.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    columns = {c: np.split(v[order], starts[1:]) for c, v in columns.items()}
    if len(found):
        yield _batch(_arrow(_ROW + _BLOB), len(found), kind=np.full(len(found), kind, np.int32), bucket=found, **{c: [x.tobytes() for x in v] for c, v in columns.items()})


def _signatures(source: DataFrame, width: int, num: int, den: int, buckets: int, limits: Limits) -> DataFrame:
    """One pass over the texts. Kind 0: a row per document. Kind 1: keys of a flush by bucket, sorted, with the entries
    (document and band) they belong to. Kind 3: rows of keys that many documents of the flush share, and kind 2: pairs
    of those with the first. Rows without keys are dealt to the buckets in turn."""

    def run(batches):
        import numpy as np

        schema = _arrow(_ROW + _BLOB)
        dealt = 0

        def deal(n):
            nonlocal dealt
            dealt += n
            return (np.arange(dealt - n, dealt) % buckets).astype(np.int32)

        for batch in batches:
            every = np.array(batch.column(0).fill_null(0)), ~np.array(batch.column(0).is_null())
            for a, b, data, ends in _chunks(batch, limits):
                ids, known = every[0][a:b], every[1][a:b]
                sets = Sets(data, ends, width)
                n, (d1, d2) = sets.n, sets.digests()
                yield _batch(schema, b - a, kind=np.zeros(b - a, np.int32), id=batch.column(0).slice(a, b - a), n=n, d1=d1, d2=d2, sketch=sets.sketches(), bucket=deal(b - a))
                edges, parts = bands(num, den, int(n.max(initial=1)))
                fresh, seen = np.zeros(len(n), dtype=bool), set()  # equal sets of a flush send their keys once
                for i in np.flatnonzero(known & (n > 0)).tolist():
                    if (at := (d1[i], d2[i], n[i])) not in seen:
                        seen.add(at)
                        fresh[i] = True
                own = np.searchsorted(edges, n, "right") - 1
                reach = n * den // num
                keys, entry, entries = [], [], []
                held, step = 0, 0
                docs = np.flatnonzero(fresh)
                while len(docs):
                    band = own[docs] + step
                    smax = n[docs] + np.minimum(edges[band + 1] - 1, reach[docs])
                    k, at, empty = sets.keys(docs, band, parts[band], smax, num, den)
                    keys.append(k)
                    entry.append(at + held)
                    entries.append((ids[docs], n[docs], empty, np.full(len(docs), step)))
                    held += len(docs)
                    step += 1
                    docs = docs[edges[own[docs] + step] <= reach[docs]]
                del sets
                if not held:
                    continue
                keys, entry = np.concatenate(keys), np.concatenate(entry)
                ids, sizes, empty, steps = (np.concatenate(c) for c in zip(*entries, strict=True))
                bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
                keys = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
                rank = np.empty(held, dtype=np.int32)
                rank[np.lexsort((ids, steps > 0))] = np.arange(held)
                order = np.lexsort((rank[entry], keys))  # the first of a key is a document of the band, if there is one
                keys, entry = keys[order], entry[order]
                starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                runs = np.diff(np.append(starts, len(keys)))
                hot = np.repeat(runs > limits.local_group, runs)
                if hot.any():
                    first = np.repeat(starts, runs)
                    mine = np.flatnonzero(hot & (first != np.arange(len(keys))))
                    x, y = entry[first[mine]], entry[mine]
                    low, high = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
                    fit = (low * den >= high * num) & (ids[x] != ids[y])
                    tally = Tally(0)
                    tally.add(np.minimum(ids[x], ids[y])[fit], np.maximum(ids[x], ids[y])[fit], common_keys(edges, parts, low[fit], high[fit], empty[x[fit]], empty[y[fit]], num, den))
                    yield _batch(schema, 1, kind=[2], bucket=deal(1), **dict(zip(("ids", "keys", "sizes", "empty"), ([c.tobytes()] for c in tally.parts[0]), strict=True)))
                    yield _batch(schema, 1, kind=[3], bucket=deal(1), keys=[keys[mine].tobytes()], ids=[ids[entry[mine]].tobytes()], sizes=[sizes[entry[mine]].astype(np.int32).tobytes()], empty=[empty[entry[mine]].astype(np.uint32).tobytes()], steps=[steps[entry[mine]].astype(np.uint8).tobytes()])
                    stay = ~hot | (first == np.arange(len(keys)))
                    keys, entry, hot = keys[stay], entry[stay], hot[stay]
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                found, starts = np.unique(bucket, return_index=True)
                rows = []
                for x, s, e in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                    used, at = np.unique(entry[s:e], return_inverse=True)
                    rows.append((x, keys[s:e].astype(np.uint32).tobytes(), at.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes(), np.packbits(hot[s:e]).tobytes(), ids[used].tobytes(), sizes[used].astype(np.int32).tobytes(), empty[used].astype(np.uint32).tobytes(), steps[used].astype(np.uint8).tobytes()))
                columns = dict(zip(("bucket", "keys", "entry", "hot", "ids", "sizes", "empty", "steps"), map(list, zip(*rows, strict=True)), strict=True))
                yield _batch(schema, len(rows), kind=np.ones(len(rows), np.int32), **columns)

    return source.mapInArrow(run, _ROW + _BLOB)


class Pieces:
    """The keys of a task as they came, and their entries; slices of the key range are put together one at a time."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.held, self.tables, self.count, self.entries = [], [], 0, 0

    def add(self, keys, entry, hot, ids, sizes, empty, steps):
        import numpy as np

        keys = np.frombuffer(keys, dtype=np.uint32)
        self.held.append((keys, np.frombuffer(entry, dtype=np.uint16 if len(entry) == 2 * len(keys) else np.uint32), np.frombuffer(hot, dtype=np.uint8), self.entries))
        self.tables.append((np.frombuffer(ids, dtype=np.int64), np.frombuffer(sizes, dtype=np.int32), np.frombuffer(empty, dtype=np.uint32), np.frombuffer(steps, dtype=np.uint8)))
        self.count += len(keys)
        self.entries += len(self.tables[-1][0])

    def slices(self):
        """(keys, entry, hot) of one range of keys after another."""
        import numpy as np

        self.tables = [np.concatenate(c) for c in zip(*self.tables, strict=True)]
        steps = -(-self.count // self.limits.slice_keys)
        bounds = [(k << 32) // steps for k in range(steps + 1)]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            got = []
            for keys, entry, hot, base in self.held:
                s, e = (len(keys) if x >> 32 else int(np.searchsorted(keys, np.uint32(x))) for x in (low, high))
                if e > s:
                    got.append((keys[s:e], entry[s:e].astype(np.int64) + base, np.unpackbits(hot[s // 8 : -(-e // 8)])[s % 8 : s % 8 + e - s].astype(bool)))
            if got:
                yield tuple(np.concatenate(c) for c in zip(*got, strict=True))


class Tally:
    """Pairs with their common keys and the number that they need, summed up as they come."""

    def __init__(self, most: int):
        self.parts, self.held, self.most = [], 0, most

    def add(self, a, b, need, hits=None):
        import numpy as np

        self.parts.append((a, b, np.ones(len(a), dtype=np.int64) if hits is None else hits, need))
        self.held += len(a)
        if self.held > self.most:
            self.sum()

    def sum(self):
        import numpy as np

        a, b, hits, need = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), dtype=bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        if len(a):
            a, b, hits, need = a[starts], b[starts], np.add.reduceat(hits[order], starts), np.minimum.reduceat(need[order], starts)
        self.parts, self.held = [(a, b, hits, need)], len(a)

    def taken(self, least: int, buckets: int):
        """What is held, if that is more than ``least``, by a bucket of the first id."""
        import numpy as np

        if self.parts and self.held > least:
            self.sum()
            a, b, hits, need = self.parts[0]
            self.parts, self.held = [], 0
            yield from _packed(4, a, buckets, ids=a, keys=b, sizes=hits.astype(np.int32), empty=need.astype(np.int32))


def _grouped(pieces: Pieces, bucket: int, num: int, den: int, tally: Tally, buckets: int):
    """Pairs and rows of frequent keys of one bucket."""
    import numpy as np

    limits, edges, parts = pieces.limits, None, None
    for keys, entry, hot in pieces.slices():
        ids, sizes, empty, steps = pieces.tables
        if edges is None:
            edges, parts = bands(num, den, int(sizes.max()))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False])) | hot[order]]  # keys of one document go at once
        keys, entry, hot = keys[order], entry[order], hot[order]
        order = np.lexsort((ids[entry], steps[entry] > 0, keys))
        keys, entry, hot = keys[order], entry[order], hot[order]
        if not len(keys):
            continue
        # Pairs are met in the band of the larger document: a group without a document of the band has none.
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        runs = np.diff(np.append(starts, len(keys)))
        own = np.repeat(steps[entry[starts]] == 0, runs)
        keys, entry, hot = keys[own], entry[own], hot[own]
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        runs = np.diff(np.append(starts, len(keys)))
        large = np.repeat((runs > limits.small_group) | np.logical_or.reduceat(hot, starts), runs)
        first, length = np.repeat(starts, runs), np.repeat(runs, runs)
        place = np.arange(len(keys)) - first
        member = steps[entry] == 0
        a, b = [first[large & (place > 0)]], [np.flatnonzero(large & (place > 0))]
        for step in range(1, limits.small_group):
            left = np.flatnonzero(~large & member & (place + step < length))
            a.append(left)
            b.append(left + step)
        x, y = entry[np.concatenate(a)], entry[np.concatenate(b)]
        low, high = np.minimum(sizes[x], sizes[y]).astype(np.int64), np.maximum(sizes[x], sizes[y]).astype(np.int64)
        fit = (low * den >= high * num) & (ids[x] != ids[y])
        x, y, low, high = x[fit], y[fit], low[fit], high[fit]
        tally.add(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), common_keys(edges, parts, low, high, empty[x], empty[y], num, den))
        yield from tally.taken(2 * limits.slice_keys, buckets)
        x = entry[large]
        yield from _packed(5, ids[x], buckets, ids=ids[x], keys=keys[large].astype(np.uint64) | np.uint64(bucket << 32), sizes=sizes[x], empty=empty[x], steps=steps[x])


#: Kinds of numbers in blobs.
_KINDS = {"ids": "<i8", "keys": "<u8", "sizes": "<i4", "empty": "<u4", "steps": "u1"}


def _read(batch, names):
    """Arrays of the blobs of a batch, row by row."""
    import numpy as np

    for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
        yield [np.frombuffer(x, dtype=_KINDS[c]) for c, x in zip(names, row, strict=True)]


def _of_kind(batch, *kinds):
    import pyarrow as pa
    import pyarrow.compute as pc

    return batch.filter(pc.is_in(batch.column("kind"), pa.array(kinds, pa.int32())))


def _candidates(signed: DataFrame, num: int, den: int, buckets: int, limits: Limits) -> DataFrame:
    """Rows of kind 0 as they are, pairs with common keys (4), and rows of frequent keys (5), by a bucket of the id.

    A partition holds whole keys. They are kept as they came; only a slice of the key range is unpacked at a time.
    """

    def run(batches):
        import numpy as np

        held, tally = {}, Tally(4 * limits.slice_keys)
        for batch in batches:
            if (plain := _of_kind(batch, 0)).num_rows:
                yield plain
            for a, b, hits, need in zip(*([np.frombuffer(x, dtype=np.int64) for x in _of_kind(batch, 2).column(c).to_pylist()] for c in ("ids", "keys", "sizes", "empty")), strict=True):
                tally.add(a, b, need, hits)
            for ids, keys, sizes, empty, steps in _read(_of_kind(batch, 3), list(_KINDS)):
                yield from _packed(5, ids, buckets, ids=ids, keys=keys, sizes=sizes, empty=empty, steps=steps)
            blobs = _of_kind(batch, 1)
            for bucket, *blob in zip(*(blobs.column(c).to_pylist() for c in ("bucket", "keys", "entry", "hot", "ids", "sizes", "empty", "steps")), strict=True):
                held.setdefault(bucket, Pieces(limits)).add(*blob)
        for bucket in list(held):
            yield from _grouped(held.pop(bucket), bucket, num, den, tally, buckets)
        yield from tally.taken(0, buckets)

    return signed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _ROW + _BLOB)


def _settled(found: DataFrame, num: int, den: int, buckets: int, limits: Limits) -> DataFrame:
    """Kind 0: the documents. Kind 4: pairs (id, b) with as many common keys as a linked pair has. Kind 5: rows (id, key) of
    documents with more frequent keys in a band than their slack there; an id whose rows differ is counted over
    all of them, which only adds rows. A partition holds all of an id."""

    def run(batches):
        import numpy as np

        schema, tally, hot = _arrow(_OUT), Tally(8 * limits.slice_keys), []

        def rows(kind, **columns):
            for at in range(0, len(columns["id"]), 100_000):
                some = {c: v[at : at + 100_000] for c, v in columns.items()}
                yield _batch(schema, len(some["id"]), kind=np.full(len(some["id"]), kind, np.int32), **some)

        for batch in batches:
            if (plain := _of_kind(batch, 0)).num_rows:
                yield _batch(schema, plain.num_rows, **{c: plain.column(c) for c in _arrow(_ROW).names})
            for a, b, hits, need in _read(_of_kind(batch, 4), ["ids", "keys", "sizes", "empty"]):
                tally.add(a, b.view(np.int64), need.astype(np.int64), hits.astype(np.int64))
            hot += _read(_of_kind(batch, 5), list(_KINDS))
        if tally.parts:
            tally.sum()
            a, b, hits, need = tally.parts[0]
            enough = hits >= need
            yield from rows(4, id=a[enough], b=b[enough])
        if hot:
            ids, keys, sizes, empty, steps = (np.concatenate(c) for c in zip(*hot, strict=True))
            hot.clear()
            edges, parts = bands(num, den, int(sizes.max()))
            order = np.lexsort((keys, steps, ids))
            ids, keys, sizes, empty, steps = ids[order], keys[order], sizes[order], empty[order], steps[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (steps[1:] != steps[:-1]))))
            runs = np.diff(np.append(starts, len(ids)))
            over = np.logical_or.reduceat(np.repeat(runs, runs) > slack(edges, parts, sizes.astype(np.int64), empty, steps, num, den), starts)
            over = np.repeat(over, runs)
            over[1:] &= (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
            yield from rows(5, id=ids[over], key=keys[over].view(np.int64))

    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _OUT)


def _shingle_sets(source: DataFrame, ids: DataFrame, width: int, limits: Limits) -> DataFrame:
    """(id, shingles) of the documents in ``ids``. Few ids are broadcast after they are counted; more are joined by a shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, data, ends in _chunks(batch, limits):
                sets = Sets(data, ends, width)
                lists = pa.ListArray.from_arrays(pa.array(sets.at, pa.int32()), pa.array(sets.hashes.view("int64"), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "shingles"])

    few = ids.count() <= BROADCAST_IDS
    return source.join(F.broadcast(ids) if few else ids, "id").mapInArrow(run, "id long, shingles array<long>")


def _verified(pairs: DataFrame, source: DataFrame, width: int, num: int, den: int, limits: Limits) -> DataFrame:
    """The pairs whose sets reach the Jaccard index. A hot left or right id is split by adaptive execution."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _shingle_sets(source, ids, width, limits)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    linked = cut(both.where(f"size(array_intersect(x, y)) * {den + num}L >= (size(x) + size(y)) * {num}L").select("a", "b").distinct())
    forget(ids)
    return linked


def _near(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and whole sketches allow a link: a fraction of a byte per shingle is moved, not the sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = pa.array([sketch_distance(*two) <= max_difference(i + j, num, den) for i, j, *two in zip(na, nb, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = pairs.join(info.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), "a")
    both = left.join(info.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
    return both.where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _across(unsafe: DataFrame, info: DataFrame, comps: DataFrame, num: int, den: int, limits: Limits, again: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of a frequent key in different components whose sizes and whole sketches allow a link.

    Every document outside the key's largest component is compared with all others of the key, once. Of the
    pairs of a document with one component the one of the least distance is returned; ``again`` names documents
    of which all pairs are. A key's documents are dealt to blocks of at most about ``block`` rows on either side.
    """
    if again is not None:  # keys of none of these documents have nothing to compare
        unsafe = unsafe.join(unsafe.join(again.select("id"), "id", "left_semi").select("key").distinct(), "key", "left_semi")
    known = unsafe.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    counted = known.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("id").alias("lead"))
    stats = counted.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("t"), F.sum("c").alias("g"), F.min("lead").alias("lead"), F.count("*").alias("k")).where("k > 1")
    stats = stats.selectExpr("key", "lead", "g", "t.comp as top", f"ceil(g / {limits.block}) as ms", f"ceil((g - t.c) / {limits.block}) as qs")
    # Keys of about the same documents share their first one; they go to one task, which meets their pairs once, or to a few.
    shares = stats.groupBy("lead").agg(F.ceil(F.sum("g") / limits.lead_rows).alias("shares"))
    stats = stats.join(shares, "lead").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares"))).drop("g", "shares")
    rows = known.join(stats, "key").join(info.select("id", "n", "sketch"), "id")
    if again is None:
        rows = rows.withColumn("asks", F.col("comp") != F.col("top"))
    else:
        rows = rows.join(again.select("id", F.lit(True).alias("asks")), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False))).withColumn("qs", F.col("ms"))
    rows = rows.withColumn("m", F.pmod(F.xxhash64("id"), F.col("ms"))).withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.col("qs")))
    stands = F.expr("transform(sequence(0L, qs - 1), q2 -> struct(m as am, q2 as aq))")
    asks = F.expr("if(asks, transform(sequence(0L, ms - 1), m2 -> struct(m2 as am, q as aq)), array())")
    dealt = rows.withColumn("at", F.explode(F.array_union(stands, asks)))
    dealt = dealt.selectExpr("lead", "share", "key", "at.am am", "at.aq aq", "id", "comp", "top", "n", "sketch", "at.am = m as stands", "asks and at.aq = q as asks")
    best = again is None

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def joined(group):
            """Ordered pairs (asking, standing) of the rows of one block."""
            ids, comp, top, n = (np.array([r[k] for r in group], dtype=np.int64) for k in ("id", "comp", "top", "n"))
            stand, ask = (np.array([r[k] for r in group], dtype=bool) for k in ("stands", "asks"))
            words = np.array([len(r["sketch"]) // 8 for r in group])
            for cl in np.unique(words[ask]).tolist():
                left = np.flatnonzero(ask & (words == cl))
                for cr in np.unique(words[stand]).tolist():
                    right = np.flatnonzero(stand & (words == cr))
                    w = min(cl, cr)
                    x, y = (folded(np.array([np.frombuffer(group[i]["sketch"], dtype=np.uint64) for i in at.tolist()]), w) for at in (left, right))
                    some = max(1, PRODUCT_WORDS // (w * len(right)))
                    for at in range(0, len(left), some):
                        i = left[at : at + some]
                        total = n[i][:, None] + n[right][None, :]
                        fit = comp[i][:, None] != comp[right][None, :]
                        fit &= np.minimum(n[i][:, None], n[right][None, :]) * den >= np.maximum(n[i][:, None], n[right][None, :]) * num
                        if best:
                            fit &= (comp[right] == top[right])[None, :] | (ids[i][:, None] < ids[right][None, :])
                        if not fit.any():
                            continue
                        apart = np.bitwise_count(x[at : at + some][:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                        row, col = np.nonzero(fit & (apart <= max_difference(total, num, den)))
                        if best:
                            order = np.lexsort((apart[row, col], comp[right[col]], row))
                            row, col = row[order], col[order]
                            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), dtype=bool), (row[1:] != row[:-1]) | (comp[right[col[1:]]] != comp[right[col[:-1]]]))))
                            row, col = row[new], col[new]
                        yield from zip(ids[i[row]].tolist(), ids[right[col]].tolist(), strict=True)

        group, here, lead, seen = [], None, None, set()

        def flush():
            nonlocal seen, lead
            if here[0] != lead:
                lead, seen = here[0], set()
            fresh = [p for p in dict.fromkeys(joined(group)) if p not in seen]
            seen.update(fresh)
            if len(seen) > 100_000:
                seen = set()
            for at in range(0, len(fresh), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*fresh[at : at + 100_000], strict=True)], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["lead"], r["key"], r["am"], r["aq"])) != here:
                    if group:
                        yield from flush()
                    group, here = [], now
                group.append(r)
        if group:
            yield from flush()

    order = ["lead", "share", "am", "aq"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "key").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, limits: Limits = Limits()) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``: components of the links with Jaccard index >= num / den.

    Words are runs of characters other than white space (\\x20, \\x09-\\x0D), A-Z lower-cased; a text of fewer
    than ``width`` words is one shingle. Null and empty texts have no shingle and link with nothing. A row
    without an id gets no component; rows that repeat an id count as one node with the links of all their
    texts. Very long texts are hashed in segments. An empty table gives an empty result. Other columns are
    not read, so their names can't clash.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    keys = _signatures(source, width, num, den, buckets, limits)
    signed = cut(_settled(_candidates(keys, num, den, buckets, limits), num, den, buckets, limits))
    info = signed.where("kind = 0").select("id", "n", "d1", "d2", "sketch")
    filled = info.where("n > 0 and id is not null")
    near = cut(_near(signed.where("kind = 4").select(F.col("id").alias("a"), "b"), filled, num, den))
    # Equal sets: a star around the smallest id, from a combined aggregate.
    classes = filled.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = filled.join(classes, ["n", "d1", "d2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    linked = _verified(near, source, width, num, den, limits)
    comps = connected_components(copies.unionByName(linked))
    used = [near, linked]
    unsafe = signed.where("kind = 5").select("id", "key")
    tried, again = None, None
    while not unsafe.isEmpty():
        more = _across(unsafe, filled, comps, num, den, limits, again)
        more = cut(more if tried is None else more.join(tried, ["a", "b"], "left_anti"))
        used.append(more)
        if more.isEmpty():
            break
        linked = _verified(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), source, width, num, den, limits)
        used.append(linked)
        comps = connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked))
        if tried is not None:
            break
        # A pair that fails says nothing of others between the document and that component: those come in a second round.
        met = more.join(linked.select(F.col("a").alias("x"), F.col("b").alias("y")), F.expr("x = least(a, b) and y = greatest(a, b)"), "left_anti")
        tried, again = more, cut(met.select(F.col("a").alias("id")).distinct())
        used.append(again)
        if again.isEmpty():
            break
    out = info.join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
    out = cut(out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
    for table in (signed, *used):
        forget(table)
    return out
