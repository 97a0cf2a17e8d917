"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes.  A byte's probability
comes from the longest context seen, with escapes to shorter ones (method C, symbols
already excluded), and the statistics stay frozen while texts are scored.  A text belongs
to the language that codes it in the fewest bits; the score is that language's share of
the likelihoods.

The trees are learned from about ``sample`` texts a language, chosen by a hash of the key
(of the ``MOST_LANGUAGES`` languages with the most texts), and hold at most ``CELLS`` probabilities, so the model's size does not grow with the
tables.  Bytes are lower-cased, digits count as one symbol, and bytes that the sample
lacks count as one rare symbol.  Texts that are null or have no letter are ``und`` with
score 0, and so is every text if no language could be learned.  Ties go to the language
first in order.  Repeated rows are scored each; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.packed import LOWER, chunks, flat

SAMPLE = 400
MOST_LANGUAGES = 200
CELLS = 8_000_000
MOST_SYMBOLS = 127
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = LOWER.copy()
_FOLD[48:58] = 48


def _padded(data: np.ndarray, limits: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each behind three line breaks, and the places of the bytes."""
    n = len(limits) - 1
    place = np.arange(len(data)) + 3 * np.repeat(np.arange(1, n + 1), np.diff(limits))
    out = np.full(len(data) + 3 * n, symbols[10], dtype=np.int64)
    out[place] = symbols[data]
    return out, place


def _grams(sample: DataFrame) -> DataFrame:
    """``lang, gram, n``: four bytes in a number, and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                data, limits = flat(texts)
                for _, _, part, ends in chunks(data, limits):
                    s, at = _padded(part, ends, _FOLD.astype(np.int64))
                    grams, n = np.unique(((s[at - 3] * 256 + s[at - 2]) * 256 + s[at - 1]) * 256 + s[at], return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()),
                                           "gram": pa.array(grams, pa.int64()), "n": pa.array(n, pa.int64())})

    return sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


def _tree(contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray, rows: np.ndarray, lower: np.ndarray, width: int):
    """Probabilities after the contexts ``rows``; ``lower`` are those after their shorter context."""
    counts = np.zeros((len(rows), width), dtype=np.float64)
    at = np.searchsorted(rows, contexts)
    known = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == contexts) if len(rows) else np.zeros(len(at), bool)
    np.add.at(counts, (at[known], symbols[known]), n[known])
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0.0, lower)
    escaped = rest.sum(1, keepdims=True)
    out = np.where(counts > 0, counts / np.maximum(total + kinds, 1),
                   kinds / np.maximum(total + kinds, 1) * rest / np.maximum(escaped, 1e-300))
    out = np.where(total > 0, out, lower)
    return out / out.sum(1, keepdims=True)


def fit(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE, cells: int = CELLS) -> dict:
    """The trees of all languages in ``docs(key, text, lang)``."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(key, "text", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("rows")).filter("lang IS NOT NULL")
    most = sizes.orderBy(F.col("rows").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not most:
        return {"langs": []}
    rows = F.create_map(*(F.lit(v) for r in most for v in (r["lang"], r["rows"])))
    place = F.crc32(F.concat(F.lit("lang"), F.col(key).cast("string"))) / 4294967296.0
    chosen = known.filter(place * F.element_at(rows, F.col("lang")) < sample)
    counted = _grams(chosen).toPandas()  # grams of a bounded sample
    if not len(counted):
        return {"langs": []}
    langs = sorted(counted["lang"].unique())
    gram, n = counted["gram"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    lang = np.searchsorted(langs, counted["lang"].to_numpy(dtype=str))
    seen = np.bincount(gram & 255, weights=n, minlength=256)
    seen[10] += 1
    kept = np.sort(np.argsort(-seen, kind="stable")[:MOST_SYMBOLS])
    kept = kept[seen[kept] > 0]
    width = len(kept) + 1  # symbol 0 is any other byte
    code = np.zeros(256, dtype=np.int64)
    code[kept] = np.arange(1, width)
    parts = [code[(gram >> shift) & 255] for shift in (24, 16, 8, 0)]
    last = parts[3]
    contexts = [np.zeros(len(gram), np.int64), parts[2], parts[1] * width + parts[2],
                (parts[0] * width + parts[1]) * width + parts[2]]

    def most(values: np.ndarray, limit: int) -> np.ndarray:
        rows, back = np.unique(values, return_inverse=True)
        order = np.argsort(-np.bincount(back, weights=n), kind="stable")[:limit]
        return np.sort(rows[order])

    limit = max(width, cells // (2 * width * len(langs)))
    rows2, rows3 = most(contexts[2], limit), most(contexts[3], limit)
    rows1 = np.arange(width)
    tables = []
    for k in range(len(langs)):
        own = lang == k
        c, s, m = [x[own] for x in contexts], last[own], n[own]
        p0 = _tree(c[0], s, m, np.zeros(1, np.int64), np.full((1, width), 1 / width), width)
        p1 = _tree(c[1], s, m, rows1, np.repeat(p0, width, 0), width)
        p2 = _tree(c[2], s, m, rows2, p1[rows2 % width], width)
        shorter = rows3 % (width * width)
        at = np.minimum(np.searchsorted(rows2, shorter), len(rows2) - 1)
        below = np.where((rows2[at] == shorter)[:, None], p2[at], p1[rows3 % width])
        p3 = _tree(c[3], s, m, rows3, below, width)
        tables.append(-np.log2(np.maximum(np.concatenate([p1, p2, p3]), 1e-12)))
    # The row of the longest kept context for every three symbols.
    row2 = np.tile(rows1, width)
    row2[rows2] = width + np.arange(len(rows2))
    row3 = np.tile(row2, width)
    row3[rows3] = width + len(rows2) + np.arange(len(rows3))
    fold = code[_FOLD.astype(np.int64)]
    return {"langs": langs, "width": width, "code": fold, "row": row3.astype(np.int32),
            "bits": np.stack(tables, axis=-1).astype(np.float32).reshape(-1, len(langs))}


def code_lengths(model: dict, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bits that every language needs for every text."""
    width, langs = model["width"], len(model["langs"])
    out = np.zeros((len(limits) - 1, langs))
    for first, last, part, ends in chunks(data, limits, 1 << 18):
        s, at = _padded(part, ends, model["code"])
        row = model["row"][(s[at - 3] * width + s[at - 2]) * width + s[at - 1]]
        bits = model["bits"][row * np.int64(width) + s[at]].astype(np.float64)
        filled = np.flatnonzero(np.diff(ends) > 0)
        if len(filled):
            out[first + filled] = np.add.reduceat(bits, ends[filled], axis=0)
    return out


def identify(docs: DataFrame, model: dict, key: str = "doc_id", carry=()) -> DataFrame:
    """``key, *carry, lang_pred, score, bits`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(key, *carry, "text")
    kinds = dict(taken.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model["langs"]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = len(texts)
            pred, share, bits = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            if langs and n:
                lengths = code_lengths(model, *flat(texts))
                best = lengths.argmin(1)
                bits = lengths.min(1)
                share = 1 / np.exp2(np.minimum(0, bits[:, None] - lengths)).sum(1)
                letters = [bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()]
                pred = [langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
                share = np.where(letters, share, 0.0)
            arrays = batch.columns[:-1] + [pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "lang_pred", "score", "bits"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry))
    return taken.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")
