"""Toxicity by compression distance.

Two pairs of zstandard dictionaries are made, each with one for ordinary and one for toxic text. Those of the
first pair are trained by zstandard on the windows of each class. In the second, the ordinary words have a list
of stems that mark toxic texts before them; it is sharper where single words tell, and blind to phrases of
ordinary words and to what under 1 % of toxic texts hold, which the first pair sees. A text is cut into windows
of whole words; each window is compressed with every dictionary, and a window that comes out shorter with
the toxic one of a pair counts towards toxicity. A small logistic model, fitted on documents that the dictionaries
of its fold have not seen, turns a text's window gains into a score between 0 and 1.

Inputs of a score: the text alone. Null and empty texts have no window and get the score of zero gains.
Ties can't arise; repeated rows get equal scores; a label table without both classes gives the constant
score of the share of toxic labels. Extra columns don't matter: only the id and the text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of what is fitted on. The sample takes whole documents in the order of a hash of their id.
SAMPLE_DOCS_PER_CLASS = 1000
SAMPLE_MAX_CHARS = 6_000
DICTIONARY_BYTES = 16384
#: Size of a dictionary trained on windows, and the segment and run lengths that training looks at.
TRAINED_BYTES, TRAINED_K, TRAINED_D = 112640, 48, 8
#: Short enough that zstandard leaves what it can't match as plain bytes, so a match shows in the length.
WINDOW_BYTES = 48
GRAM_SIZES = (4, 5, 6, 7, 8, 10, 12)
#: Stems of the toxic dictionary that a toxic training text should hold.
COVER = 3
#: Gains (in bytes) from which a window counts.
LEVELS = (1, 2, 3, 4, 6)

_PARAMS = zstd.ZstdCompressionParameters.from_level(
    3, strategy=zstd.STRATEGY_LAZY2, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False
)


def windows(text: str | None, size: int = WINDOW_BYTES):
    """Cut a text, lower-cased, into consecutive windows of about ``size`` bytes that end at white space."""
    data = " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    at, n = 0, len(data)
    while at < n:
        end = data.find(b" ", at + size)
        if end < 0 or end > at + 4 * size:
            end = min(n, at + 4 * size) if n - at > 4 * size else n
        yield data[at : end + 1]
        at = end + 1 if data[end : end + 1] == b" " else end


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    trained: tuple[bytes, bytes] = (b"", b"")
    constant: float | None = None


class Scorer:
    """Holds the compressors of a model; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.pairs = _pairs((model.ordinary, model.toxic), model.trained) if model.constant is None else None

    def features(self, text: str | None) -> list[float]:
        return _features(self.pairs, text)

    def score(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        z = float(np.dot(self.model.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _compressor(content: bytes):
    book = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=_PARAMS)
    return zstd.ZstdCompressor(dict_data=book, compression_params=_PARAMS).compress


def _pairs(*books: tuple[bytes, bytes]) -> list:
    return [[_compressor(d or b" " * 8) for d in pair] for pair in books]


def _features(pairs, text) -> list[float]:
    cut_up = list(windows(text))
    out = [1.0]
    for k, (ordinary, toxic) in enumerate(pairs):
        # The trained dictionaries hold texts they were fitted on; such a text's large gains must not run off the fitted range.
        low, high = ((-math.inf, math.inf), (0.0, 4.0))[k]
        counts, total, best, n = [0] * len(LEVELS), 0, 0, max(len(cut_up), 1)
        for w in cut_up:
            gain = len(ordinary(w)) - len(toxic(w))
            total += gain
            if gain > 0:
                best = max(best, gain)
                for j, level in enumerate(LEVELS):
                    counts[j] += gain >= level
        out += [*(math.log1p(c) for c in counts), *(min(1.0, 10 * c / n) for c in counts), max(low, min(high, total / n)), min(best, 12) / 4]
    return out


def _grams(words: set[str]) -> set[str]:
    """Beginnings of words: what marks a word is looked for in its stem."""
    return {w[:size] for w in words for size in GRAM_SIZES if len(w) >= size}


def _fill(words: list[str], limit: int) -> bytes:
    """Join words to a dictionary; the first are the most valuable and go last, where zstandard finds them at least cost."""
    out, used = [], 0
    for w in words:
        b = w.encode("utf-8", "surrogatepass") + b" "
        if used + len(b) > limit:
            break
        out.append(b)
        used += len(b)
    return b"".join(reversed(out))


def train_dictionaries(texts: list[str], toxic: list[int], size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries: the words of ordinary texts, and before them what marks toxic ones."""
    n = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    sets = [set((t or "").lower().split()) for t in texts]
    words = [Counter(), Counter()]
    grams = [Counter(), Counter()]
    for s, x in zip(sets, toxic, strict=True):
        words[x].update(s)
    for s, x in zip(sets, toxic, strict=True):
        if x:
            grams[1].update(_grams(s))
    need = max(3, math.ceil(0.01 * n[1]))
    wanted = {g for g, c in grams[1].items() if c >= need}
    for s, x in zip(sets, toxic, strict=True):
        if not x:
            grams[0].update(_grams(s) & wanted)

    def lift(g: str) -> float:
        """How many times as often toxic texts have it, with a pessimistic count for ordinary ones."""
        return math.log(grams[1][g] / n[1]) - math.log((grams[0][g] + 1) / n[0])

    marked = {g: lift(g) for g in wanted if lift(g) >= math.log(8)}
    # Greedy cover: take the stem that most toxic texts with under COVER stems so far still lack, and stop
    # when what is left would only copy the wording of a few texts.
    held = [sorted(_grams(s) & marked.keys()) for s, x in zip(sets, toxic, strict=True) if x]
    covered = [0] * len(held)
    chosen: list[str] = []
    while len(chosen) < 150:
        open_now = Counter(g for h, k in zip(held, covered, strict=True) if k < COVER for g in h)
        left = [g for g, c in open_now.items() if c >= need and not any(g.startswith(c) or c.startswith(g) for c in chosen)]
        if not left:
            break
        g = max(left, key=lambda g: (open_now[g] * marked[g], len(g), g))
        chosen.append(g)
        for i, h in enumerate(held):
            covered[i] += g in h
    begins = tuple(chosen)
    plain = sorted(words[0], key=lambda w: (-words[0][w], w))
    ordinary = _fill([w for w in plain if not (chosen and w.startswith(begins))], size)
    # What both share lies at the end of either, at equal distances: it gives equal lengths and so no noise.
    return ordinary, _fill(chosen, size // 2) + ordinary


def train_on_windows(texts: list[str], toxic: list[int], size: int = TRAINED_BYTES) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries of the windows of each class; a class that fits is its own dictionary."""
    out = []
    for y in (0, 1):
        own = [w for t, x in zip(texts, toxic, strict=True) if x == y for w in windows(t)]
        book = b" ".join(own)
        if len(book) > size:
            try:
                book = zstd.train_dictionary(size, own, k=TRAINED_K, d=TRAINED_D).as_bytes()
            except zstd.ZstdError:  # too few windows to train on
                book = book[-size:]
        out.append(book)
    return out[0], out[1]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; rows of the rarer class don't weigh more."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """Fit on labelled texts: cross-fitted window gains in two folds, then dictionaries of all texts.

    ``share`` is the share of toxic rows where the model is to be used; the sample may hold more of them.
    """
    if len(set(toxic)) < 2:
        return Model(b"", b"", (), constant=float(toxic[0]) if toxic else 0.0)
    fold = [0] * len(texts)
    for cls in (0, 1):
        for k, i in enumerate(i for i, x in enumerate(toxic) if x == cls):
            fold[i] = k % 2
    rows, ys = [], []
    for f in (0, 1):
        inside = [i for i in range(len(texts)) if fold[i] != f]
        if len({toxic[i] for i in inside}) < 2:
            inside = list(range(len(texts)))
        given = [texts[i] for i in inside], [toxic[i] for i in inside]
        pairs = _pairs(train_dictionaries(*given), train_on_windows(*given))
        for i in range(len(texts)):
            if fold[i] == f:
                rows.append(_features(pairs, texts[i]))
                ys.append(toxic[i])
    w = _fit(np.array(rows), np.array(ys, dtype=float))
    if share and 0 < share < 1:
        here = sum(toxic) / len(toxic)
        w[0] += math.log(share / (1 - share)) - math.log(here / (1 - here))
    ordinary, tox = train_dictionaries(texts, toxic)
    return Model(ordinary or b" " * 8, tox or b" " * 8, tuple(map(float, w)), train_on_windows(texts, toxic))


def learn(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", held_out_fold: int | None = 0, folds: int = 5) -> Model:
    """Learn from labelled rows outside the held-out fold (crc32 of the id as text, modulo ``folds``).

    The sample: of each class, the first SAMPLE_DOCS_PER_CLASS documents of at most SAMPLE_MAX_CHARS
    characters, in the order of a hash of the id. An id labelled both ways counts as toxic; null ids
    and labels other than 0 and 1 are not used.
    """
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    if held_out_fold is not None:
        lab = lab.where(F.crc32(F.col("_id").cast("string")) % folds != held_out_fold)
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # Lengths first: the text of the few sampled rows alone is moved.
    known = docs.where(F.length("_text").between(1, SAMPLE_MAX_CHARS)).select("_id").join(lab, "_id").distinct().withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
    picks = []
    for y in (0, 1):
        picks += known.where(f"_y = {y}").orderBy("_h", "_id").limit(SAMPLE_DOCS_PER_CLASS).select("_id", "_y").collect()
    if not picks:
        return fit([], [])
    spark = documents.sparkSession
    # At most 2 * SAMPLE_DOCS_PER_CLASS ids: a proven bound for the broadcast.
    chosen = spark.createDataFrame([(int(r["_id"]), int(r["_y"])) for r in picks], "_id long, _y int")
    got = docs.join(F.broadcast(chosen), "_id").where(F.length("_text") <= SAMPLE_MAX_CHARS).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rows = sorted((r["_id"], r["_y"], r["_text"]) for r in got.collect())
    counts = {r["_y"]: r["count"] for r in lab.groupBy("_y").count().collect()}
    return fit([r[2] for r in rows], [r[1] for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def score_texts(documents: DataFrame, model: Model, *, text_col="text", keep: list[str]) -> DataFrame:
    """``keep`` columns and a column ``score`` for every row; whole texts, in Arrow batches, without a shuffle."""
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = pa.array((scorer.score(t.as_py()) for t in texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    src = documents.select(*keep, F.col(text_col).cast("string").alias("_scored_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, score double")
