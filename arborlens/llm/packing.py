"""Packing documents into fixed windows by minimum bin slack.

Each document is tokenised and ends with one more id. Full windows are cut off; what remains is kept as a
multiset of lengths. A window is filled by subset sums: a bit set (one Python integer) holds the sums that the
lengths so far can reach, one length after another with its count, and the search ends as soon as the capacity
is reached; the counts are found by walking the bit sets back. If no subset fills the window, the best one is
completed with a piece cut from the next document. At the end of a task's rows the last ids are cut at powers
of two, so no window is padded.

Each task packs its own rows: no shuffle, and memory bounded by the pool, whatever the size of the table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Remainders held before windows are filled, and left when filling stops; more choice fills better.
POOL, KEEP = 2048, 512
#: One of so many texts is encoded by both libraries.
CHECKED = 500


def subset(counts: dict[int, int], goal: int) -> dict[int, int]:
    """Lengths and how many of each, with the largest sum up to ``goal``; at most ``counts`` of each.

    The bit set after each length is kept; going back from the best sum, the least number of a length that the
    earlier bit set can complete is taken.
    """
    mask = (1 << (goal + 1)) - 1
    sets, lengths = [1], []
    for length in sorted((x for x in counts if x <= goal), reverse=True):
        reach, left, step = sets[-1], min(counts[length], goal // length), 1
        while left > 0:  # binary splitting of the count
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        lengths.append(length)
        sets.append(reach)
        if reach >> goal & 1:
            break
    at = sets[-1].bit_length() - 1
    chosen = {}
    for k in range(len(lengths) - 1, -1, -1):
        n = 0
        while not sets[k] >> at & 1:
            at -= lengths[k]
            n += 1
        if n:
            chosen[lengths[k]] = n
    return chosen


class Packer:
    """Turns (doc_id, ids) into pieces (doc_id, start, ids, doc_tokens, sequence, offset); ids are uint32 arrays."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, 0
        self.pool: dict[int, deque] = defaultdict(deque)
        self.held = 0

    def _put(self, piece):
        self.pool[len(piece[2])].append(piece)
        self.held += 1

    def _take(self, length):
        piece = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= 1
        return piece

    def add(self, doc_id, ids):
        total, at = len(ids), 0
        while total - at >= self.capacity:
            yield (doc_id, at, ids[at : at + self.capacity], total, self.sequence, 0)
            self.sequence += 1
            at += self.capacity
        if at < total:
            self._put((doc_id, at, ids[at:], total))
        if self.held >= POOL:
            yield from self.fill(KEEP)

    def _emit(self, pieces):
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield (doc_id, start, ids, total, self.sequence, offset)
            offset += len(ids)
        self.sequence += 1

    def fill(self, keep: int):
        while self.held > keep and sum(length * len(q) for length, q in self.pool.items()) >= self.capacity:
            pieces = [self._take(max(self.pool))]
            room = self.capacity - len(pieces[0][2])
            for length, n in subset({k: len(q) for k, q in self.pool.items()}, room).items():
                for _ in range(n):
                    pieces.append(self._take(length))
                    room -= length
            if room:  # every subset leaves slack: cut the rest from the longest document left
                doc_id, start, ids, total = self._take(max(self.pool))
                pieces.append((doc_id, start, ids[:room], total))
                self._put((doc_id, start + room, ids[room:], total))
            yield from self._emit(pieces)

    def finish(self):
        yield from self.fill(0)
        rest = [self._take(length) for length in sorted(self.pool, reverse=True) for _ in range(len(self.pool[length]))]
        left = sum(len(p[2]) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)  # a window of a power of two needs no padding
            room, pieces = size, []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc_id, start, ids, total))
                room -= len(ids)
            yield from self._emit(pieces)
            left -= size


def encoder(path: str, ranks: str | None = None, pattern: str | None = None):
    """A function text -> ids (array of uint32), for a byte-level BPE file of the tokenizers library.

    ``ranks`` names a file with the same vocabulary as ranks, and ``pattern`` how it cuts words: texts without a special
    token's string are then encoded several times faster. One text in CHECKED, the first of them too, is encoded both ways, and
    ids that differ end the job.
    """
    import array
    import base64

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(text):
        return array.array("I", own.encode(text, add_special_tokens=False).ids)

    if ranks is None:
        return plain
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    seen = 0

    def encode(text):
        nonlocal seen
        if any(t in text for t in special):
            return plain(text)
        ids = array.array("I", fast(text))
        if seen % CHECKED == 0 and ids != plain(text):
            raise ValueError(f"{ranks} gives other ids than {path}")
        seen += 1
        return ids

    return encode


def pack(df: DataFrame, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, uint32).

    Every document has at least its end id, so null and empty texts have one piece. Every id lies in one piece;
    pieces of a sequence have no gaps. Sequences hold ``capacity`` ids, but for the last of a task, which hold a
    power of two. The string of a special token inside a text becomes that token, as the tokenizer has it. Null ids and repeated rows are packed like others; an empty table has no piece. A text is
    encoded whole. Sequence ids carry the partition in the bits above 32. Other columns are not read.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode, packer = encoder(tokenizer, ranks, pattern), Packer(capacity)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        part, rows = 0, []

        def table():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def note(pieces):
            for doc_id, start, ids, total, sequence, offset in pieces:
                raw = ids.tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, (part << 32) + sequence, offset, raw))

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py())
                ids.append(end_id)
                ids = np.frombuffer(ids, dtype=np.uint32).astype("<u4", copy=False)
                note(packer.add(doc_id.as_py(), ids))
                if len(rows) >= 2000:
                    yield table()
        note(packer.finish())
        if rows:
            yield table()

    return src.mapInArrow(run, f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
