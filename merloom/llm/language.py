"""Language of texts and of their blocks, by a byte convolutional network.

Filters of widths 2 to 5 run over the byte classes of windows of fixed length, each filter's maximum over the window is
kept, and a softmax gives the language. The network is trained in numpy on labelled text: all rows of a sample table
and a bounded sample of the labelled documents, whose windows are dropped where a first network contradicts the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.llm.ragged import row_slices, spread, text_bytes

LANGUAGES = ("da", "de", "en", "es", "fr", "it", "nl", "no", "pl", "pt")
#: Bytes of a window, filters of each width, widths, byte classes.
WINDOW, FILTERS, WIDTHS, CLASSES = 64, 24, (2, 3, 4, 5), 102
#: The bound of the training sample: labelled documents, and windows of each.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 2000, 16
#: Least log probability that one window can speak against a language with.
FLOOR = -4.0


@cache
def _byte_classes() -> np.ndarray:
    """0 is padding, then white space, other signs, digits, letters, lead bytes, and each continuation byte."""
    table = np.full(256, 2, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[48:58] = 3
    table[65:91] = table[97:123] = np.arange(4, 30)
    table[192:] = 37
    for k, lead in enumerate((0xC2, 0xC3, 0xC4, 0xC5, 0xCC, 0xCD, 0xE2)):
        table[lead] = 30 + k
    table[128:192] = np.arange(38, 102)
    return table


def _classes(data: np.ndarray) -> np.ndarray:
    """Byte classes; capital letters with an accent count as small ones."""
    data = data.copy()
    high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) else []
    data[high] += 32
    return _byte_classes()[data]


@cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for k in range(0x110000):
        if not 0xD800 <= k < 0xE000 and chr(k).isalpha():
            table[k] = True
    return table


class Network:
    """The filters `k` (offset, class, filter), their bias `b`, and the output weights `w` and bias `c`."""

    def __init__(self, k: np.ndarray, b: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        self.k, self.b, self.w, self.c = k, b, w, c

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a pair of classes adds at the offsets 0 and 1 (all filters), at 2 and 3 (those wider than 2), and a class at 4 (those of width 5)."""
        n = FILTERS
        first = (self.k[0][:, None] + self.k[1][None]).reshape(-1, self.k.shape[2])
        second = (self.k[2][:, None, n:] + self.k[3][None, :, n:]).reshape(-1, self.k.shape[2] - n)
        return np.ascontiguousarray(first), np.ascontiguousarray(second), np.ascontiguousarray(self.k[4][:, 3 * n :])

    def pooled(self, x: np.ndarray, tables: tuple, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum over the windows x (rows of WINDOW classes), and where it is."""
        n = FILTERS
        x = np.concatenate([x, np.zeros((len(x), 4), x.dtype)], 1).astype(np.int64)
        pair = np.ascontiguousarray((x[:, :-1] * CLASSES + x[:, 1:]).T)
        last = np.ascontiguousarray(x.T)
        first, second, third = tables
        best = np.full((len(x), first.shape[1]), -np.inf, np.float32)
        at = np.zeros(best.shape, np.int64) if where else None
        for p in range(WINDOW):
            value = first.take(pair[p], 0)
            value[:, n:] += second.take(pair[p + 2], 0)
            value[:, 3 * n :] += third.take(last[p + 4], 0)
            if where:
                at[value > best] = p
            np.maximum(best, value, out=best)
        return best, at

    def log_probabilities(self, x: np.ndarray, step: int = 2048) -> np.ndarray:
        tables = self.tables()
        out = [np.empty((0, len(LANGUAGES)), np.float32)]
        for lo in range(0, len(x), step):
            h = np.maximum(self.pooled(x[lo : lo + step], tables)[0] + self.b, 0)
            z = h @ self.w + self.c
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 256, seed: int = 11, rate: float = 0.01) -> Network:
    """Adam on the cross entropy, with random bytes of the windows blanked; each language has the same weight."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    k = rng.normal(0, 0.15, (5, CLASSES, total)).astype(np.float32)
    mask = np.zeros((5, 1, total), np.float32)
    for g, width in enumerate(WIDTHS):
        mask[:width, :, g * FILTERS : (g + 1) * FILTERS] = 1
    net = Network(k * mask, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(LANGUAGES))).astype(np.float32), np.zeros(len(LANGUAGES), np.float32))
    weight = (1 / np.maximum(np.bincount(y, minlength=len(LANGUAGES)), 1))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    names = ("k", "b", "w", "c")
    mean, square = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            xb = np.where(rng.random((len(rows), WINDOW)) < 0.04, 2, x[rows])
            raw, at = net.pooled(xb, net.tables(), True)
            h = np.maximum(raw + net.b, 0)
            keep = (rng.random(h.shape) < 0.8).astype(np.float32) / 0.8
            z = (h * keep) @ net.w + net.c
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(rows)), y[rows]] -= 1
            z *= weight[rows, None] / len(rows)
            dh = (z @ net.w.T) * keep * (h > 0)
            wide = np.concatenate([xb, np.zeros((len(rows), 4), xb.dtype)], 1).astype(np.int64)
            column = np.arange(total)
            dk = np.stack([np.bincount((np.take_along_axis(wide, at + o, 1) * total + column).ravel(), dh.ravel(), CLASSES * total).reshape(CLASSES, total) for o in range(5)]) * mask
            grads = {"k": dk + 1e-5 * net.k, "b": dh.sum(0), "w": (h * keep).T @ z + 1e-4 * net.w, "c": z.sum(0)}
            step += 1
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for n in names:
                mean[n] += 0.1 * (grads[n] - mean[n])
                square[n] += 0.01 * (grads[n] ** 2 - square[n])
                setattr(net, n, (getattr(net, n) - now * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return net


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (bytes) of each block: a maximal run of lines that are not blank."""
    feeds = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    start = start[start < offsets[-1]]
    if not len(start):
        return (np.empty(0, np.int64),) * 3
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.r_[start[1:], offsets[-1]]
    ink = np.r_[0, np.cumsum((data != 32) & (data != 9) & (data != 13) & (data != 10))]
    full = ink[end] > ink[start]
    first = full & np.r_[True, ~full[:-1] | (row[1:] != row[:-1])]
    last = full & np.r_[~full[1:] | (row[1:] != row[:-1]), True]
    return row[first], start[first], end[last]


def _windows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each block its windows: classes, block number, and the bytes [from, to) that only this window speaks for."""
    count = np.maximum(-(-(end - start) // WINDOW), 1)
    block = np.repeat(np.arange(len(start)), count)
    lo = spread(np.zeros(len(start), np.int64), count) * WINDOW + np.repeat(start, count)
    hi = np.minimum(lo + WINDOW, end[block])
    at = np.maximum(np.minimum(lo, end[block] - WINDOW), start[block])
    place = at[:, None] + np.arange(WINDOW)
    classes = _classes(data)[np.minimum(place, len(data) - 1)]
    classes[place >= end[block][:, None]] = 0
    return classes, block, lo, hi


def _letter_sums(data: np.ndarray) -> np.ndarray:
    """Letters before each byte of a UTF-8 text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(data) + 1, np.int64)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    out[begins[: len(points)] + 1] = _letters()[points[: len(begins)]]
    return np.cumsum(out)


def _labelled(batches: Iterator[pa.RecordBatch], windows: int) -> Iterator[pa.RecordBatch]:
    """(language number, window) rows of labelled texts: at most `windows` of a text, spread over it."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        if not len(data):
            continue
        row, start, end = _blocks(data, offsets)
        if not len(row):
            continue
        classes, block, lo, hi = _windows(data, start, end)
        sums = _letter_sums(data)
        good = np.flatnonzero(sums[hi] - sums[lo] >= 24)
        owner = row[block[good]]
        size = np.bincount(owner, minlength=len(offsets))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        part = np.maximum(size[owner] / windows, 1)
        chosen = good[np.floor(place / part) != np.floor((place - 1) / part)]
        label = batch.column(0).to_numpy()[row[block[chosen]]]
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array([classes[k].tobytes() for k in chosen], pa.binary())], ["label", "window"])


def normalised(lang: Column) -> Column:
    """A label trimmed, cut before the first ``-`` or ``_`` and lower-cased."""
    return F.lower(F.split(F.trim(lang, F.lit(" \t\r\n")), "[-_]")[0])


def fitted(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCUMENTS) -> Network:
    """The network trained on all labelled samples (at most 10,000 rows) and at most `most` labelled documents, those with the smallest hash of their id."""
    number = F.array_position(F.array(*map(F.lit, LANGUAGES)), normalised(F.col(lang_col))).cast("int") - 1
    known = documents.select(number.alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("mix")).where("label >= 0 and text is not null")
    # about twice as many as wanted pass the bound on the hash, so that few rows are sorted at any size
    bound = min(-(1 << 63) + int(min(1.0, 2 * most / max(documents.count(), 1)) * (1 << 64)), (1 << 63) - 1)
    known = known.where(F.col("mix") <= F.lit(bound)).orderBy("mix").limit(most).select("label", "text")
    clean = samples.select(number.alias("label"), F.col(text_col).alias("text")).where("label >= 0 and text is not null").limit(10_000)
    schema = "label int, window binary"
    parts = []
    for df, windows in ((clean, 64), (known, SAMPLE_WINDOWS)):
        t = df.mapInArrow(lambda it, n=windows: _labelled(it, n), schema).toArrow().sort_by([("label", "ascending"), ("window", "ascending")])
        x = np.frombuffer(b"".join(t.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
        parts.append((x, t.column("label").to_numpy().astype(np.int64)))
    x, y = (np.concatenate(p) for p in zip(*parts, strict=True))
    if not len(x):
        raise ValueError("no labelled text to train on")
    net = train(x, y, epochs=2)
    said = net.log_probabilities(x)
    agrees = said[np.arange(len(y)), y] >= np.log(0.2)
    agrees[: len(parts[0][1])] = True
    return train(x[agrees], y[agrees])


def _identified(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    net = Network(*shared.value)
    n = len(LANGUAGES)
    names = np.array([*LANGUAGES, "und"])
    for batch in batches:
        all_data, all_offsets = text_bytes(batch.column(1))
        for a, b in row_slices(all_offsets, 1 << 20):
            data, offsets = all_data[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a]
            row, start, end = _blocks(data, offsets)
            sums = _letter_sums(data)
            classes, block, lo, hi = _windows(data, start, end) if len(row) else (np.empty((0, WINDOW), np.uint8), *(np.empty(0, np.int64),) * 3)
            score = net.log_probabilities(classes)
            weight = (sums[hi] - sums[lo]).astype(np.float64)
            speaks, share = np.maximum(score, FLOOR) * weight[:, None], np.exp(score) * weight[:, None]

            def both(owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                total, part = (np.stack([np.bincount(owner, m[:, c], size) for c in range(n)], 1) for m in (speaks, share))
                letters = np.bincount(owner, weight, size)
                best = np.where(letters > 0, total.argmax(1), n)
                sure = np.where(letters > 0, part[np.arange(size), np.minimum(best, n - 1)] / np.maximum(letters, 1), 0)
                return best, sure, letters.astype(np.int64)

            of_text, of_block = both(row[block], b - a), both(block, len(row))
            ids = batch.column(0).slice(a, b - a)
            number = np.arange(len(row)) - np.searchsorted(row, row) + 1
            which = np.r_[np.arange(b - a), row]
            best, sure, letters = (np.r_[p, q] for p, q in zip(of_text, of_block, strict=True))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(np.r_[np.zeros(b - a, np.int32), number.astype(np.int32)]), pa.array(names[best]), pa.array(sure), pa.array(letters), pa.array(names[of_text[0][which]]), pa.array(of_text[2][which]), batch.column(2).slice(a, b - a).take(pa.array(which))], ["id", "block_no", "lang", "confidence", "letters", "text_lang", "text_letters", "label"])


def languages(documents: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, block_no, lang, confidence, letters, text_lang, text_letters, label: block 0 is the whole text, the others are its blocks; label is the given one, normalised.

    A text is judged whole, in windows. Null, empty and blank texts, and any without a letter, have the language `und`
    with confidence 0; blocks without a letter too. Rows with one id are judged each. An empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast((network.k, network.b, network.w, network.c))
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), normalised(F.col(lang_col)).alias("label"))
    schema = "id bigint, block_no int, lang string, confidence double, letters bigint, text_lang string, text_letters bigint, label string"
    return rows.mapInArrow(lambda it: _identified(it, shared), schema)


def label_errors(documents: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", text_least: int = 200, block_least: int = 80, sure: float = 0.5) -> DataFrame:
    """id, block_no, lang of documents with at least `text_least` letters: block 0 if the label is missing or another language; and each block of at least `block_least` letters in another language than the document, if its confidence is `sure` or more."""
    said = languages(documents, network, id_col, text_col, lang_col).where(F.col("text_letters") >= text_least)
    whole = (F.col("block_no") == 0) & ~F.col("lang").eqNullSafe(F.col("label"))
    block = (F.col("block_no") > 0) & (F.col("letters") >= block_least) & (F.col("lang") != F.col("text_lang")) & (F.col("confidence") >= sure)
    return said.where(whole | block).select("id", "block_no", "lang")
