"""Language identification: nearest of several TF-IDF n-gram centroids per language, with rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import map_batches, per_worker

DIMENSIONS = 8192
PER_LANGUAGE = 400
CENTROIDS = 4
MAX_LANGUAGES = 500
#: Rows the driver learns from, and the fewest of one language: 8,000 rows take 262 MB.
SAMPLE_ROWS = 8000
MIN_PER_LANGUAGE = 16
CHUNK = 1 << 20
TOGETHER = 32
BUCKETS = 24
FOLDS = 4
QUANTILE = 0.99
NEIGHBOURS = 100
#: Least radius: a sample of nearly equal texts does not say how far others lie.
LEAST = 0.1


def _letters() -> np.ndarray:
    return per_worker("letters", _letter_table)


def _letter_table() -> np.ndarray:
    """Code point to lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the 1- to 3-grams of letters; words are bounded by 0."""
    a = points.astype(np.uint32)
    one = np.flatnonzero(a)
    two = np.flatnonzero(a[:-1] | a[1:]) if len(a) > 1 else one[:0]
    three = np.flatnonzero(a[1:-1]) if len(a) > 2 else one[:0]
    k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    h1 = a[one] * k1 + np.uint32(1)
    h2 = a[two] * k2 + a[two + 1] * k1 + np.uint32(2)
    h3 = a[three] * k3 + a[three + 1] * k2 + a[three + 2] * k1 + np.uint32(3)
    h = np.concatenate([h1, h2, h3])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.concatenate([one, two, three]), h >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """(texts, DIMENSIONS) counts of hashed n-grams over whole texts, short ones together, long ones in overlapping chunks."""
    counts = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    parts, owners, size = [], [], 0

    def points_of(text: str) -> np.ndarray:
        return _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]

    def flush() -> None:
        nonlocal parts, owners, size
        if parts:
            # the 0 before a text is its own, so the grams that begin there are too
            lengths = np.array([*(len(p) + 1 for p in parts), 1])
            owner = np.repeat(np.array([*owners, owners[-1]]), lengths)
            at, grams = _grams(points_of("\0".join(["", *parts, ""])))
            low = owners[0]
            flat = np.bincount((owner[at] - low) * DIMENSIONS + grams, minlength=(owners[-1] - low + 1) * DIMENSIONS)
            counts[low : owners[-1] + 1] += flat.reshape(-1, DIMENSIONS)
        parts, owners, size = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > CHUNK:
            bounded = f"\0{text}\0"
            for start in range(0, len(text) + 1, CHUNK):
                # two characters more, so that the grams which begin in the chunk are whole
                at, grams = _grams(points_of(bounded[start : start + CHUNK + 2]))
                counts[i] += np.bincount(grams[at < CHUNK], minlength=DIMENSIONS)
            continue
        parts.append(text)
        owners.append(i)
        size += len(text)
        if size >= CHUNK or i - owners[0] >= TOGETHER - 1:
            flush()
    flush()
    return counts


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``counts`` turned, in place, into weights of length 1."""
    np.log1p(counts, out=counts)
    counts *= idf
    length = np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None]
    counts /= np.where(length > 0, length, 1)
    return counts


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]  # of each centroid
    radius: np.ndarray  # largest accepted distance by centroid and size class of a text

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts = gram_counts(texts)
        blank, size = counts.sum(axis=1) == 0, _bucket(counts)
        cosine = _weigh(counts, self.idf) @ self.centroids.T if self.languages else np.zeros((len(texts), 1), np.float32)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        names = ["und" if none or not self.languages else self.languages[b] for b, none in zip(best, blank)]
        score[blank] = 0
        rejected = blank | (1 - score > (self.radius[best, size] if self.languages else 1)) | np.full(len(texts), not self.languages)
        return names, score, rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a fixed start: the row nearest to the mean, then always the farthest row."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        chosen.append(int(near.argmin()))
    centres = x[chosen].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (nearest == j).any():
                centres[j] = x[nearest == j].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _reach(far: np.ndarray) -> float:
    """A high quantile of distances: what ``QUANTILE`` of the rows keep within, or, as few rows
    do not show that, four times the spread above the median."""
    middle = np.median(far)
    spread = 1.4826 * np.median(far[far >= middle] - middle)
    return max(LEAST, float(middle + 4 * spread), float(np.quantile(far, QUANTILE)))


def _radii(x: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Largest accepted distance from one language by size class, from rows that took no part in the centroids.

    Each fold is measured from centroids of the others. A class looks at its own rows and, until there are
    ``NEIGHBOURS``, those of the nearest classes; shorter texts are allowed at least what longer ones are.
    """
    fold, far = np.arange(len(x)) % min(FOLDS, len(x)), np.zeros(len(x))
    if len(x) == 1:
        return np.ones(BUCKETS)
    for f in range(fold.max() + 1):
        far[fold == f] = 1 - (x[fold == f] @ _clusters(x[fold != f], k).T).max(axis=1)
    radius = np.zeros(BUCKETS)
    for b in range(BUCKETS):
        gap = np.abs(sizes - b)
        reach = np.sort(gap)[min(NEIGHBOURS, len(gap)) - 1]
        radius[b] = _reach(far[gap <= reach])
    return np.minimum(1.0, np.maximum.accumulate(radius[::-1])[::-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    centroids: int = CENTROIDS,
) -> Model:
    """Learn from about ``per_language`` labelled rows of each language, taken by a hash of the id.

    Languages are counted over all rows, and the ``MAX_LANGUAGES`` with the most rows are learned: labels beyond that are
    rare ones of a dirty column. The driver receives about ``SAMPLE_ROWS`` rows in all, so many languages have fewer each.
    A row is taken if its hash falls below its language's rate, and the driver receives its n-gram counts, never its
    text: at most ``DIMENSIONS`` numbers a row. Rows with a null id, text or language teach nothing.
    Every language has a radius for each size class of texts, from distances of sampled rows to centroids that
    were made without them (see :func:`_radii`). The only row of a language rejects nothing.
    """
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    per_language = min(per_language, max(MIN_PER_LANGUAGE, SAMPLE_ROWS // max(1, len(found))))
    if not found:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), (), np.ones((0, BUCKETS)))
    rate = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.2 * per_language / r["count"])))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sampled = rows.withColumn("draw", draw).filter(F.col("draw") < F.try_element_at(rate, F.col("lang")))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = gram_counts(batch.column("text").to_pylist())
        places = [np.flatnonzero(row).astype(np.int16) for row in counts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("draw"),
                pa.array(places, pa.list_(pa.int16())),
                pa.array([row[p] for row, p in zip(counts, places)], pa.list_(pa.float32())),
            ],
            names=["lang", "draw", "place", "number"],
        )

    sample = map_batches(
        sampled.select("lang", "draw", "text"), counted, "lang string, draw double, place array<smallint>, number array<float>", 64
    ).toArrow()
    labels, draws = sample["lang"].to_pylist(), sample["draw"].to_pylist()
    chosen, taken = [], {}
    for i in sorted(range(sample.num_rows), key=lambda i: (labels[i], draws[i])):
        taken[labels[i]] = taken.get(labels[i], 0) + 1
        if taken[labels[i]] <= per_language and len(sample["place"][i].values):
            chosen.append(i)
    if not chosen:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), (), np.ones((0, BUCKETS)))
    # one matrix, weighed where it stands: it is what the driver's memory is needed for
    counts, langs = np.zeros((len(chosen), DIMENSIONS), dtype=np.float32), np.array([labels[i] for i in chosen])
    for row, i in enumerate(chosen):
        counts[row, sample["place"][i].values.to_numpy(zero_copy_only=False)] = sample["number"][i].values.to_numpy(zero_copy_only=False)
    del sample
    pa.default_memory_pool().release_unused()
    sizes = _bucket(counts)
    idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + np.float32(0.05)
    x = _weigh(counts, idf)
    parts = [(lang, _clusters(x[langs == lang], centroids)) for lang in sorted(set(langs))]
    names = tuple(str(lang) for lang, c in parts for _ in c)
    centres = np.concatenate([c for _, c in parts]).astype(np.float32)
    reach = {lang: _radii(x[langs == lang], sizes[langs == lang], centroids) for lang in sorted(set(langs))}
    radius = np.stack([reach[lang] for lang, c in parts for _ in c])
    return Model(idf, centres, names, radius)


def predict(
    docs: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    results: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """``(id, lang_pred, score, rejected)`` of every whole text, with the columns ``keep`` beside them.

    The results are named by ``results``; a kept column of such a name gives way to them.

    Only the text is looked at. Null texts and texts without a letter are ``und`` with score 0 and
    rejected. Any other text gets the language of the nearest centroid (ties: the first by name), its
    cosine as the score, and is rejected if it lies farther away than texts of that language and length do.
    Null ids and repeated rows are predicted like any other; an empty table gives an empty result;
    with nothing to learn from, everything is ``und``. The model (well under 1 MB a language) goes with the tasks.
    """
    rest = [id_col, *[c for c in keep or [] if c != id_col]]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    rows = docs.select(*columns, F.col(f"`{text_col}`").alias("t"))
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if name != "t"]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, rejected = model.predict(batch.column("t").to_pylist())
        own = batch.schema.names[:-1]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in own], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
            names=[*own, "pred", "score", "rejected"],
        )

    found = map_batches(rows, judge, ", ".join([*kinds, "pred string", "score double", "rejected boolean"]), 256)
    judged = [F.col(column).alias(name) for column, name in zip(("pred", "score", "rejected"), results)]
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest) if c not in results], *judged)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, then predict every document."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
