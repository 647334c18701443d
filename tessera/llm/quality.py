"""Quality rules: a base rule and gradient-boosted trees over document statistics.

The statistics are counted over every whole text; lines, words and windows count as equal only if their bytes are. The trees are fitted by Newton boosting on the logistic loss
over histogram bins, with monotonic constraints (more symbols, repeated lines or repeated words never raise a
document's score), and flattened into node arrays, by which a batch is scored one level at a time.

The classifier is fitted on at most ``MAX_LABELLED`` labelled documents, those with the smallest hash of their
id, one row each (of several, that of the smallest text digest); that bound is a parameter. Without labels of both kinds only the base rule decides.

Defined cases: null or empty text has no words and fails the base rule; repeated rows are judged alike; labels
that are null are not used; a very long text is a batch of its own; empty tables of documents or labels give an empty result or
the base rule alone; extra columns are ignored by the query and kept by the pipeline stage, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _arrays as A

MAX_LABELLED = 8000
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WORDS, WINDOW = 10, 20, 5
#: Name and monotonic direction (-1: a larger value never raises the score) of each feature.
FEATURES = [
    ("log_words", 0), ("mean_chars", 0), ("symbol_rate", -1), ("dup_line_share", -1), ("repeat_share", -1),
    ("upper_share", 0), ("digit_share", 0), ("exclaim_rate", 0), ("words_per_line", 0), ("distinct_share", 0), ("stop_rate", 0),
]
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _DIGIT, _EXCLAIM, _STOP = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!"), _table(b".")
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of ids (numbers under 2^32) that occur more than once in their document, and of those that occurred before."""
    key = (doc.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    more, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    more[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return more, later


def line_spans(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty lines of every document, without their line ends."""
    if not len(x):
        z = np.zeros(0, np.int64)
        return z, z, z
    breaks = np.flatnonzero(x == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(x)]
    doc = A.owner(off, starts)
    ends = np.minimum(np.append(breaks, len(x))[np.searchsorted(breaks, starts)], off[doc + 1])
    ok = ends > starts
    return starts[ok], ends[ok], doc[ok]


def statistics(x: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the features of every document of a unit."""
    n = len(off) - 1
    starts, ends, doc = A.word_spans(x, off)
    ids = A.exact_ids(x, starts, ends)
    words = np.bincount(doc, minlength=n).astype(np.int64)
    out = {"n_words": words, "word_chars": _per_doc(_CHAR[x] & ~A.SPACE[x], off), "n_symbols": _per_doc(_SYMBOL[x], off)}

    ls, le, ld = line_spans(x, off)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, ld = ls[has_word], le[has_word], ld[has_word]
    _, later = _repeats(ld, A.exact_ids(x, ls, le))
    out["n_dup_lines"] = np.bincount(ld[later], minlength=n).astype(np.int64)
    lines = np.bincount(ld, minlength=n)

    windows = A.exact_windows(ids, WINDOW)
    at = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    more, _ = _repeats(doc[at], windows[at])
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[at[more]] += 1
    edge[at[more] + WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=n).astype(np.int64)

    _, again = _repeats(doc, ids)
    w, c = np.maximum(words, 1), np.maximum(out["word_chars"], 1)
    features = [
        np.log1p(words), out["word_chars"] / w, out["n_symbols"] / w, out["n_dup_lines"] / np.maximum(lines, 1), out["n_repeat_words"] / w,
        _per_doc(_UPPER[x], off) / c, _per_doc(_DIGIT[x], off) / c, _per_doc(_EXCLAIM[x], off) / w, words / np.maximum(lines, 1), 1 - np.bincount(doc[again], minlength=n) / w, _per_doc(_STOP[x], off) / w,
    ]
    return out | {"x": np.column_stack(features)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_WORDS * s["n_words"])


@dataclass(frozen=True)
class Trees:
    """Node arrays of all trees; a leaf points to itself. roots: the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of x."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, reg: float = 1.0, least: int = 5) -> Trees | None:
    """Newton boosting; None if y has one kind only. signs: the monotonic direction of each feature (0: free)."""
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(feature)
        for a, b in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, v)):
            a.append(b)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        k = node(float(np.clip(-gs / (hs + reg), low, high)) * rate)
        if level == depth or len(rows) < 2 * least:
            return k
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            m = len(c) + 1
            gl, hl, nl = (np.cumsum(np.bincount(codes[rows, j], w, m))[:-1] for w in (g[rows], h[rows], None))
            vl, vr = np.clip(-gl / (hl + reg), low, high), np.clip(-(gs - gl) / (hs - hl + reg), low, high)
            gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
            ok = (nl >= least) & (len(rows) - nl >= least) & (signs[j] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1)
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (float(gain[b]), j, b, float(vl[b]), float(vr[b]))
        _, j, b, vl, vr = best
        if j < 0:
            return k
        goes = codes[rows, j] <= b
        mid = (vl + vr) / 2
        lows, highs = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
        feature[k], threshold[k] = j, float(cuts[j][b])
        left[k] = grow(rows[goes], g, h, level + 1, *lows)
        right[k] = grow(rows[~goes], g, h, level + 1, *highs)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        last = Trees(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array(roots[-1:]), depth, 0.0)
        q = last.score(x)
        f = f + np.log(q / (1 - q))
    return Trees(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array(roots), depth, bias)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for unit in A.units(batches):
        s = statistics(*A.text_bytes(unit["text"]))
        yield pa.record_batch([unit["y"].combine_chunks(), pa.array(list(s["x"]), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_LABELLED) -> Trees | None:
    """Trees fitted on at most ``bound`` labelled documents (those of the smallest hashed ids)."""
    A.tune(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("double")).alias("y")).where("y is not null")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(marks), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.md5("text")).alias("text")).select("y", "text")
    got = rows.mapInArrow(_labelled, "y double, x array<double>").toArrow()
    y = got["y"].to_numpy()
    x = np.array(got["x"].to_pylist()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order], [s for _, s in FEATURES])


def _judged(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in A.units(batches):
            s = statistics(*A.text_bytes(unit["text"]))
            failed = base_failed(s)
            score = trees.score(s["x"]) if trees else np.ones(len(failed))
            rest = unit.drop_columns(["text"]).combine_chunks()
            columns = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns), *(pa.array(s[c]) for c in COLUMNS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0.5))]
            yield pa.record_batch(columns, names=[*rest.column_names, *COLUMNS, "base_failed", "score", "kept"])

    return run


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every document."""
    A.tune(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judged(trees), schema)


def _kept(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in A.units(batches):
            s = statistics(*A.text_bytes(unit["text"]))
            keep = ~base_failed(s) & ((trees.score(s["x"]) >= 0.5) if trees else True)
            yield from unit.filter(pa.array(keep)).to_batches()

    return run


def keep_good(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    A.tune(docs.sparkSession)
    return docs.mapInArrow(_kept(trees), docs.schema)


#: The base counts and the base rule in SQL (the trees' verdict is beyond it).
BASE_SQL = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT rid, CAST(SUM(c - 1) AS BIGINT) AS n FROM (SELECT rid, line, COUNT(*) AS c FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line) GROUP BY rid),
g AS (SELECT rid, unnest([w[i:i + {WINDOW - 1}] for i in range(1, len(w) - {WINDOW - 2})]) AS g, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}),
m AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, COUNT(DISTINCT i + o) AS n FROM m, range(0, {WINDOW}) x(o) GROUP BY rid),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(d.n, 0) AS n_dup_lines, CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN d ON w.rid = d.rid LEFT JOIN r ON w.rid = r.rid)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_WORDS} * n_words AS base_failed FROM b"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op9_quality`` SQL can express: the counts and the base rule of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), None).drop("score", "kept")
