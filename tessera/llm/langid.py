"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes. A byte that followed a context c times costs
``-log2(c / (T + U))`` bits there, where T is the number of bytes that followed and U the number of distinct
ones; a byte that never did costs the escape ``-log2(U / (T + U))`` and is coded in the next shorter context, down
to 8 bits without any. Counts are frozen after training, so every cost is a fixed number: a whole text's code
length is a sum of table entries, looked up for all bytes of a batch at once. Costs are whole 1/1024 bits, so sums are
exact in any order. The language with the shortest code wins (ties: the smaller name).

Before counting and coding, capitals of ASCII and Latin-1 letters are folded to small ones.

Training uses ``TRAIN_BYTES`` bytes for each language, or fewer where there are over 20 languages: a model has a cost for each string and language, so
the bytes of all languages times their number stay under ``CELLS``. Documents come in the order of
a hash of id and text, to the one that crosses the bound, which is cut there; a language with less is used whole. So every language
with a labelled text is learned, and driver, model and workers hold a bounded amount whatever the data.
Only text and language of documents outside the held-out third are read for it.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without any training document (as in an empty table) all
are ``und``; repeated rows get equal results; rows without a doc_id are not held out, and are drawn by their texts; before a text's start its
context is zero bytes; a text of any length is coded a slice after the other; extra columns are ignored by the query and
kept by the pipeline stage, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import _arrays as A

ORDER, TRAIN_BYTES, CELLS, UNITS = 3, 1_500_000, 600_000_000, 1024
HASH_BITS = 56
#: A text of more bits a byte than this (less FREE_BITS for all) in its best language is in none of the learned languages.
MAX_BITS = 7.5
#: Bits that aren't counted there: a few letters say little about their language.
FREE_BITS = 64


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fold(x: np.ndarray) -> np.ndarray:
    """Small letters for A-Z and for the capitals of the Latin-1 block in UTF-8."""
    y = A.LOWER[x]
    if len(x) > 1:
        y[1:][(x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)] += 32
    return y


def padded(x: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes with ``order`` zero bytes before every document, and the documents' offsets there."""
    n = len(off) - 1
    at = np.repeat(np.arange(1, n + 1) * order, np.diff(off)) + np.arange(len(x))
    out = np.zeros(len(x) + n * order, np.uint8)
    out[at] = fold(x)
    return out, off + np.arange(n + 1) * order


@dataclass(frozen=True)
class Model:
    """grams[g]: sorted codes of the byte strings of g + 1 bytes; cost[g]: units for its last byte; escape[g]: units to leave it as a context."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]
    start: np.ndarray  # the escape of the empty context


def _codes(x: np.ndarray, g: int) -> np.ndarray:
    """Codes of the strings of g bytes that end at each byte from g - 1 on."""
    c = np.zeros(len(x) - g + 1, np.uint64)
    for k in range(g):
        c = (c << np.uint64(8)) | x[k : len(x) - g + 1 + k]
    return c


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Model | None:
    """A model of whole texts by language."""
    samples = {k: v for k, v in samples.items() if any(v)}
    if not samples:
        return None
    names = sorted(samples)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for name in names:
        x = np.frombuffer(b"".join(samples[name]), np.uint8)
        off = np.cumsum([0, *map(len, samples[name])])
        p, poff = padded(x, off, order)
        scored = np.ones(len(p), bool)
        for k in range(order):
            scored[poff[:-1] + k] = False
        found.append([np.unique(_codes(p, g)[scored[g - 1 :]], return_counts=True) for g in range(1, order + 2)])
    grams = [np.unique(np.concatenate([np.zeros(1, np.uint64), *(f[g][0] for f in found)])) for g in range(order + 1)]  # 0: the padding as a context
    count = []
    for g in range(order + 1):
        c = np.zeros((len(grams[g]), len(names)))
        for i, f in enumerate(found):
            c[np.searchsorted(grams[g], f[g][0]), i] = f[g][1]
        count.append(c)
    cost: list[np.ndarray] = []
    escapes: list[np.ndarray] = []  # by context length
    with np.errstate(divide="ignore", invalid="ignore"):
        for g in range(order + 1):
            above = np.zeros(len(grams[0]), np.int64) if g == 0 else np.searchsorted(contexts := np.unique(grams[g] >> np.uint64(8)), grams[g] >> np.uint64(8))
            n = 1 if g == 0 else len(contexts)
            total, kinds = np.zeros((n, len(names))), np.zeros((n, len(names)))
            np.add.at(total, above, count[g])
            np.add.at(kinds, above, count[g] > 0)
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            lower = np.full((len(grams[g]), len(names)), 8.0 * UNITS) if g == 0 else cost[g - 1][np.searchsorted(grams[g - 1], grams[g] & np.uint64(256**g - 1))]
            seen = -np.log2(count[g] / (total + kinds)[above])
            cost.append(np.where(count[g] > 0, np.rint(seen * UNITS), np.rint(escape[above] * UNITS) + lower).astype(np.int32))
            if g == 0:
                escapes.append(np.rint(escape * UNITS).astype(np.int32))
            else:  # of the strings of g bytes, as contexts
                e = np.zeros((len(grams[g - 1]), len(names)), np.int32)
                at = np.minimum(np.searchsorted(grams[g - 1], contexts), len(grams[g - 1]) - 1)
                ok = grams[g - 1][at] == contexts
                e[at[ok]] = np.rint(escape[ok] * UNITS)
                escapes.append(e)
    return Model(names, order, grams, cost, escapes[1:], escapes[0][0])


class Coder:
    """Code lengths of whole texts under a model; the trees' steps are dense tables, made once a worker."""

    def __init__(self, model: Model):
        self.m = model
        self.steps = [np.zeros(256, np.int32)]
        self.steps[0][model.grams[0].astype(np.int64)] = np.arange(1, len(model.grams[0]) + 1)
        for g in range(1, model.order + 1):
            prefix, last = model.grams[g] >> np.uint64(8), (model.grams[g] & np.uint64(255)).astype(np.int64)
            at = np.minimum(np.searchsorted(model.grams[g - 1], prefix), len(model.grams[g - 1]) - 1)
            ok = model.grams[g - 1][at] == prefix
            step = np.zeros((len(model.grams[g - 1]) + 1, 256), np.int32)
            step[at[ok] + 1, last[ok]] = np.flatnonzero(ok) + 1
            self.steps.append(step.reshape(-1))
        zero = np.zeros((1, len(model.languages)), np.int32)
        self.cost = [np.ascontiguousarray(np.concatenate([zero, c]).T) for c in model.cost]
        self.escape = [np.ascontiguousarray(np.concatenate([zero, e]).T) for e in model.escape]

    def lengths(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Units of code for each document (rows) and language."""
        k, n, ll = self.m.order, len(off) - 1, len(self.m.languages)
        total = np.zeros((n, ll), np.int64)
        for a in range(0, len(x), A.SLICE):  # of a very long text, a slice after the other
            b = min(len(x), a + A.SLICE)
            first, last = (int(v) for v in (np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")))
            local = np.clip(off[first : last + 1], a, b)
            before = max(int(off[first]), a - k - 1)  # bytes of context from the slice before; one more for folding
            p, _ = padded(x[before:b], np.concatenate([[before], local[1:]]) - before, k)
            # the first row of the slice holds a - before bytes that were scored already
            lengths = np.diff(local)
            lengths_p = np.diff(np.concatenate([[before], local[1:]])) + k
            start = np.cumsum(lengths_p) - lengths_p + k
            start[0] += a - before
            at = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(b - a)
            cost = self._bytes(p, at)
            rows = np.flatnonzero(lengths)
            if len(rows):
                cuts = (np.cumsum(lengths) - lengths)[rows]
                total[first + rows] += np.add.reduceat(cost, cuts, axis=1).T
        return total

    def _bytes(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Units for the byte at each position, by language."""
        ids = [self.steps[0][p]]
        for g in range(1, self.m.order + 1):
            step = np.zeros(len(p), np.int32)
            step[1:] = self.steps[g][ids[-1][:-1].astype(np.int64) * 256 + p[1:]]
            ids.append(step)
        top = ids[-1][at]
        out = np.stack([c[top] for c in self.cost[-1]]).astype(np.int64)
        miss = np.flatnonzero(top == 0)
        if len(miss):
            left, spot = miss, at[miss]
            for g in range(self.m.order, 0, -1):  # escape from the context of g bytes, then try the shorter string
                out[:, left] += self.escape[g - 1][:, ids[g - 1][spot - 1]]
                got = ids[g - 1][spot]
                hit = got > 0
                out[:, left[hit]] += self.cost[g - 1][:, got[hit]]
                left, spot = left[~hit], spot[~hit]
            out[:, left] += self.m.start[:, None] + 8 * UNITS
        return out


def _limits(known: DataFrame, bound: int, cells: int) -> tuple[dict[str, int], int]:
    """The hash up to which a language's texts are pulled: those reach the bound, or are all; and that bound, lowered to keep to ``cells``.

    Each pass sums bytes by the next 8 bits of the hash, inside the bin in which the sum reaches the bound, until that bin is one
    hash or the sum with it is at most twice the bound.
    """
    limits: dict[str, int] = {}
    under: dict[str, int] = {}
    inside: dict[str, int] = {}
    for step in range(HASH_BITS - 8, -1, -8):
        rows = known
        if inside:
            spans = known.sparkSession.createDataFrame(list(inside.items()), "lang string, inside long")
            rows = known.join(F.broadcast(spans), "lang").where(F.shiftright("h", step + 8) == F.col("inside"))
        sums = rows.groupBy("lang", F.shiftright("h", step).alias("bin")).agg(F.sum("b").alias("b"), F.min("h").alias("least"), F.max("h").alias("most"))
        found = sums.collect()
        if not inside:
            bound = max(1, min(bound, cells // max(1, len({r["lang"] for r in found}) ** 2)))
        inside = {}
        for r in sorted(found, key=lambda r: (r["lang"], r["bin"])):
            lang, before = r["lang"], under.get(r["lang"], 0)
            if lang in inside or (before >= bound and lang in limits):
                continue
            limits[lang] = r["most"]
            if before + r["b"] > 2 * bound and r["least"] < r["most"]:
                inside[lang] = r["bin"]
            else:
                under[lang] = before + r["b"]
        if not inside:
            break
    return limits, bound


def _sample(docs: DataFrame, bound: int, cells: int = CELLS) -> dict[str, list[bytes]]:
    """Texts of each language in the order of their hashes, to the one by which they reach the bound, which is cut there; equal rows count each."""
    text = F.col("text").cast("string")
    h = F.xxhash64("doc_id", text).bitwiseAND(F.lit(2**HASH_BITS - 1))
    known = docs.where(~held_out() & F.col("lang").isNotNull() & (F.octet_length(text) > 0)).select(F.col("lang").cast("string"), text.alias("text"), h.alias("h"), F.octet_length(text).alias("b"))
    limits, bound = _limits(known.drop("text"), bound, cells)
    if not limits:
        return {}
    spans = known.sparkSession.createDataFrame(list(limits.items()), "lang string, most long")
    pulled = known.join(F.broadcast(spans), "lang").where("h <= most").withColumn("text", F.substring("text", 1, bound)).groupBy("lang", "h", "text").count()
    out: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for r in sorted(pulled.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        got, data = out.setdefault(r["lang"], []), r["text"].encode()
        for _ in range(r["count"]):
            room = bound - size.get(r["lang"], 0)
            if room <= 0:
                break
            got.append(data[:room])
            size[r["lang"]] = size.get(r["lang"], 0) + len(got[-1])
    return out


def fit(docs: DataFrame, bound: int = TRAIN_BYTES, order: int = ORDER) -> Model | None:
    """A model of the documents' non-null languages, without the held-out third."""
    return train(_sample(docs, bound), order)


_coders: dict[int, Coder | None] = {}


def _predict(shared, carry: bool):
    """Predictions of batches with text and has_letter; carry: only the columns ``row`` and ``text`` of texts that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _coders:
            _coders.clear()  # a worker keeps one model
            _coders[id(model)] = Coder(model) if model else None
        coder = _coders[id(model)]
        for unit in A.units(batches):
            x, off = A.text_bytes(unit["text"])
            n, known = unit.num_rows, unit["has_letter"].to_numpy().astype(bool)
            size = np.diff(off)
            if coder:
                code = coder.lengths(x, off)
                best = code.argmin(1)
                low = code[np.arange(n), best]
                score = 1 / np.exp2(np.maximum((low[:, None] - code) / UNITS, -1000.0)).sum(1)
                bits = np.maximum(low / UNITS - FREE_BITS, 0) / np.maximum(size, 1)
            else:
                known, best, score, bits = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n)
            if carry:
                yield from unit.select(["row", "text"]).filter(pa.array(known & (bits <= MAX_BITS))).to_batches()
                continue
            names = [*(model.languages if model else []), "und"]
            pred = pa.array(names, pa.string()).take(pa.array(np.where(known, best, len(names) - 1)))
            yield pa.record_batch([unit["doc_id"].combine_chunks(), unit["held_out"].combine_chunks(), pred, pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, bits, 0.0))], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return run


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the winner's share of 2^-length) and bits_per_byte of every document."""
    spark = docs.sparkSession
    A.tune(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"), _has_letter().alias("has_letter"))
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), False), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language: it has letters and codes in at most MAX_BITS a byte."""
    spark = docs.sparkSession
    A.tune(spark)
    others = F.struct(*(docs[c] for c in docs.columns if c != "text"))  # one column, whatever the names inside
    rows = docs.select(others.alias("row"), F.col("text").cast("string").alias("text"), _has_letter().alias("has_letter"))
    out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), True), StructType([rows.schema["row"], rows.schema["text"]]))
    return out.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
