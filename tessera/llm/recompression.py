"""Repeated passages by recompression.

Every text is parsed into symbols by rounds that look at symbols and their neighbours only, never at positions: short
runs of one symbol get one name, then pairs (a, b) with a on the left and b on the right side of a coin thrown for
each symbol. A name is computed from the names it stands for, so it is global without a
dictionary, and equal passages get the same symbols except near their ends. Symbols stand for at most ``CAP`` words, and
a round can change the parse by at most that much further in from an end: of a window of 35 words, the symbols that start
after its first ``EDGE`` words and end before its last are the same wherever the window occurs. (With longer symbols nothing
inside a window of 35 words would be sure to be the same.)

1. *Reveal.* From these interior symbols each window takes the triple of neighbours with the least name, the next symbol up
   (its anchor). Windows that occur twice have the same anchor, so only windows whose anchor is at two places can repeat. One
   packed exchange finds those anchors.
2. *Meet.* The windows of one place of an anchor are consecutive; the words they cover are a snippet. Of snippets that are equal within a unit, one goes
   on, marked as repeated. All snippets of an anchor meet in one task.
3. *Verify.* There the rounds start again from the words themselves: words get numbers that are equal for equal bytes only, and pairs of
   numbers get numbers in turn, until one stands for a whole window. Windows with a number that occurs twice repeat; the
   words under them go.

An anchor with more than ``HOT`` snippets is hot: its windows go one by one as text, counted by an aggregate (combined before the
shuffle) and joined back over salts, so that no anchor or window is too frequent for a task. Texts that are equal as a whole are known by 128 bits of
their SHA-256: one of them takes part, all lose their words. All else is decided on words: names only say where to look.

Defined cases: null, empty and blank texts have no words; texts under a window keep all; repeated rows count as
places of their own; a null doc_id is a document like others; a text of any length is a unit by itself; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _arrays as A
from tessera.llm._exchange import NULL_ID, SHORT, first_copies, keyed, packed_spans, shared_names, spread_join
from tessera.llm._store import checkpoint, drop, n_parts, text_bytes

WINDOW, CAP, PAIR_ROUNDS = 35, 4, 2
#: Words at either end of a window where its parse may depend on what stands outside.
EDGE = CAP + PAIR_ROUNDS * (CAP - 1)
#: Bytes of text for each part of the name space; snippets over which an anchor is hot; snippets of a task.
PART_BYTES, HOT, TASK_SNIPPETS = 16 << 20, 20_000, 8_000
NONE = np.uint64(2**64 - 1)


def name_runs(sym: np.ndarray, size: np.ndarray, start: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of 2 to CAP equal words become one symbol."""
    if not len(sym):
        return sym, size, start, doc
    head = np.ones(len(sym), bool)
    head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(sym)))
    short = (run > 1) & (run <= CAP)
    keep = head | ~np.repeat(short, run)
    sym, size = sym.copy(), size.copy()
    sym[at[short]] = A.pair_names(sym[at[short]], run[short].astype(np.uint64), 7)
    size[at[short]] = run[short]
    return sym[keep], size[keep], start[keep], doc[keep]


def name_pairs(sym: np.ndarray, size: np.ndarray, start: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """Pairs of a left and a right symbol of at most CAP words together become one symbol."""
    if len(sym) < 2:
        return sym, size, start, doc
    right = (A.mix(sym + np.uint64(salt * 2654435761)) & np.uint64(1)).astype(bool)
    merge = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= CAP)
    keep = np.ones(len(sym), bool)
    keep[1:] = ~merge
    at = np.flatnonzero(merge)
    new, wide = sym.copy(), size.copy()
    new[at] = A.pair_names(sym[at], sym[at + 1], salt)
    wide[at] += size[at + 1]
    return new[keep], wide[keep], start[keep], doc[keep]


def anchors(names: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window of words (by its first word) the name and first word of its anchor; NONE where it would cross documents."""
    n = len(names)
    out = np.full(max(n - window + 1, 0), NONE)
    place = np.arange(len(out))
    if n < window:
        return out, place
    level = name_runs(names, np.ones(n, np.int64), np.arange(n), doc)
    for r in range(PAIR_ROUNDS):
        level = name_pairs(*level, salt=r + 1)
    sym, size, start, sdoc = level
    inner = window - 2 * EDGE
    grid, length = np.full(n + window, NONE), np.full(n + window, inner + 1, np.int64)
    if len(sym) >= 3:
        ok = sdoc[:-2] == sdoc[2:]
        triple = A.pair_names(A.pair_names(sym[:-2], sym[1:-1], 11), sym[2:], 12)
        grid[start[:-2][ok]] = triple[ok]
        length[start[:-2][ok]] = (start[2:] + size[2:] - start[:-2])[ok]
    for step in range(inner - 2):
        a, b = EDGE + step, EDGE + step + len(out)
        name = np.where(length[a:b] <= inner - step, grid[a:b], NONE)
        less = name < out
        out = np.where(less, name, out)
        place[less] = np.flatnonzero(less) + a
    out[doc[: len(out)] != doc[window - 1 :]] = NONE
    return out, place


def _anchor_names(window: int):
    def run(unit: pa.Table):
        x, off = A.text_bytes(unit["text"])
        starts, ends, doc = A.word_spans(x, off)
        found, place = anchors(A.word_names(x, starts, ends), doc, window)
        new = np.ones(len(found), bool)
        new[1:] = (place[1:] != place[:-1]) | (found[:-1] == NONE)
        pick = np.flatnonzero(new & (found != NONE))  # one entry for each place of an anchor
        return A.mix(found[pick]), doc[pick]

    return run


def _member(sets: list[bytes], doc: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether each name is in its document's set (ascending names of 8 bytes)."""
    out = np.zeros(len(names), bool)
    cuts = np.searchsorted(doc, np.arange(len(sets) + 1))
    for i, s in enumerate(sets):
        a, b = cuts[i], cuts[i + 1]
        if s and b > a:
            known = np.frombuffer(s, "<u8")
            out[a:b] = known[np.minimum(np.searchsorted(known, names[a:b]), len(known) - 1)] == names[a:b]
    return out


def _joined(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one blank after each: the bytes, and where words start and end there."""
    inside = np.zeros(len(x) + 1, bool)
    inside[:-1] = ~A.SPACE[x]
    length = ends - starts
    to = np.cumsum(length + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[to - 1] = False
    out[keep] = x[inside[:-1]]
    return out, to - 1 - length, to - 1


def _snippets(window: int):
    """Rows (dk, th, start, n, key, known, snippet): n windows from a word on, with the words they cover, or, without those, n windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in A.units(batches):
            x, off = A.text_bytes(unit["text"])
            starts, ends, doc = A.word_spans(x, off)
            found, place = anchors(A.word_names(x, starts, ends), doc, window)
            d = doc[: len(found)]
            key = A.mix(found)
            hit = (found != NONE) & _member(unit["names"].to_pylist(), d, key & SHORT)
            head = hit.copy()
            head[1:] &= ~hit[:-1] | (place[1:] != place[:-1])  # places never cross documents
            first = np.flatnonzero(head)
            if not len(first):
                continue
            n = np.add.reduceat(hit.astype(np.int64), first)
            text, ws, we = _joined(x, starts, ends)
            same = A.exact_ids(text, ws[first], we[first + n + window - 2])
            _, lead, group, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
            known = count[group] > 1
            data = text.tobytes()
            a, b = ws[first].tolist(), we[first + n + window - 2].tolist()
            rows = np.concatenate([lead, np.flatnonzero(known)])
            snippet = [data[a[i] : b[i]] for i in lead.tolist()] + [None] * int(known.sum())
            row = doc[first[rows]]
            base = np.searchsorted(doc, np.arange(unit.num_rows))
            th = unit["th"].combine_chunks()
            yield pa.record_batch(
                [pa.array(unit["dk"].to_numpy()[row]), th.take(pa.array(row)), pa.array(first[rows] - base[row]), pa.array(n[rows]), pa.array(key[first[rows]].view(np.int64)), pa.array(known[rows]), pa.array(snippet, pa.binary())],
                names=["dk", "th", "start", "n", "key", "known", "snippet"],
            )

    return run


def _strings(window: int):
    """Every window of hot snippets as text: (dk, th, start, known, string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dk, th, start, n, known, snippet = (b.column(b.schema.get_field_index(c)) for c in ("dk", "th", "start", "n", "known", "snippet"))
            for i, data in enumerate(snippet.to_pylist()):
                words, size = data.split(b" "), n[i].as_py()
                string = [b" ".join(words[k : k + window]) for k in range(size)]
                row = pa.array(np.full(size, i))
                yield pa.record_batch([dk.take(row), th.take(row), pa.array(start[i].as_py() + np.arange(size)), known.take(row), pa.array(string, pa.binary())], names=["dk", "th", "start", "known", "string"])

    return run


def _hot_spans(rows: DataFrame, window: int) -> DataFrame:
    """Repeated windows of hot anchors; how often each occurs is summed before the shuffle."""
    strings = rows.mapInArrow(_strings(window), "dk long, th binary, start long, known boolean, string binary")
    often = strings.groupBy("string").agg(F.count("*").alias("c"), F.max("known").alias("k")).where("c > 1 or k").select("string")
    return spread_join(strings.where("not known"), often, "string").select("dk", "th", "start", F.lit(1).cast("long").alias("n"))


def _verified(window: int):
    """Of the snippets of some anchors: the runs of windows (dk, th, start, n) that occur at another place too."""

    def run(table: pa.Table) -> pa.Table:
        coded = table["snippet"].combine_chunks().dictionary_encode()  # equal snippets are numbered once
        code = coded.indices.to_numpy().astype(np.int64)
        x, off = A.text_bytes(coded.dictionary.cast(pa.large_binary()))
        starts, ends, doc = A.word_spans(x, off)
        number = A.exact_windows(A.exact_ids(x, starts, ends), window)
        words = np.bincount(doc, minlength=len(off) - 1)
        base = np.cumsum(words) - words  # of a snippet's first window
        own = doc[: len(number)]
        inside = own == doc[window - 1 :]
        known = table["known"].to_numpy(zero_copy_only=False).astype(bool)
        times = np.bincount(code, 1 + known, len(words))
        total = np.bincount(number[inside], times[own[inside]])
        again = np.zeros(len(number), bool)
        again[inside] = total[number[inside]] > 1
        todo = np.flatnonzero(~known)
        n = table["n"].to_numpy().astype(np.int64)[todo]
        row = np.repeat(todo, n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = again[base[code[row]] + place]
        row, place = row[hit], place[hit]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(row)))
        row, place = row[at], place[at]
        start = table["start"].to_numpy().astype(np.int64)[row] + place
        return pa.table([table["dk"].take(pa.array(row)), table["th"].take(pa.array(row)), pa.array(start), pa.array(size.astype(np.int64))], names=["dk", "th", "start", "n"])

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in A.units(batches):
            out: tuple[list, ...] = ([], [], [])
            for text, spans, copied in zip(unit["text"].to_pylist(), unit["spans"].to_pylist(), unit["copied"].to_pylist()):
                words = text.encode().split()  # of bytes: at ASCII white space only
                count = len(words)
                if copied and count >= window:
                    words = []
                elif spans:
                    s = np.frombuffer(spans, "<i8").reshape(-1, 2)
                    edge = np.zeros(count + 1, np.int64)
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s[:, 0] + s[:, 1] + window - 1, -1)
                    words = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                for column, v in zip(out, (count, count - len(words), hashlib.sha256(b" ".join(words)).hexdigest())):
                    column.append(v)
            yield pa.record_batch([unit["dk"].combine_chunks(), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], names=["dk", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    if window < 2 * EDGE + 3 * CAP + 2:
        raise ValueError(f"a window needs at least {2 * EDGE + 3 * CAP + 2} words")
    spark = docs.sparkSession
    A.tune(spark)
    rows = keyed(docs)
    size = text_bytes(docs)
    ids = checkpoint(rows.select("dk", "th"), "texts")
    classes = ids.groupBy("th").agg(F.min("dk").alias("rep"), (F.count("*") > 1).alias("copied"))
    found = checkpoint(shared_names(rows, _anchor_names(window), n_parts(size, PART_BYTES, 8), True, size), "anchors")
    reps = found.join(classes.select("th", F.col("rep").alias("dk")), ["dk", "th"], "left_semi").select("dk", "th", "names")
    some = rows.join(reps, ["dk", "th"]).select("dk", "th", "text", "names").mapInArrow(first_copies, "dk long, th binary, text string, names binary")
    snippets = checkpoint(some.mapInArrow(_snippets(window), "dk long, th binary, start long, n long, key long, known boolean, snippet binary"), "snippets")
    drop(found)
    todo = snippets.where("snippet is not null")
    tasks = n_parts(todo.count(), TASK_SNIPPETS, 8)
    hot = checkpoint(todo.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
    hot_spans = None if hot.isEmpty() else _hot_spans(todo.join(hot, "key", "left_semi"), window)
    todo = todo if hot_spans is None else todo.join(hot, "key", "left_anti")
    todo = todo.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    spans = todo.groupBy("task").applyInArrow(_verified(window), "dk long, th binary, start long, n long")
    spans = spans.unionByName(snippets.where("snippet is null").select("dk", "th", "start", "n"))
    spans = spans if hot_spans is None else spans.unionByName(hot_spans)
    spans = spans.withColumn("task", F.pmod(F.xxhash64("dk", "th"), F.lit(tasks)))
    spans = checkpoint(spans.groupBy("task").applyInArrow(packed_spans, "dk long, th binary, spans binary"), "spans")
    drop(snippets)
    marks = ids.distinct().join(classes.select("th", "copied"), "th").join(spans, ["dk", "th"], "left").where("copied or spans is not null")
    full = rows.join(marks, ["dk", "th"], "left").select("dk", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    out = full.mapInArrow(_removed(window), "dk long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("dk") != NULL_ID, F.col("dk")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract in SQL: all windows of all documents, grouped by their words.
ORACLE = f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT rid, [md5(array_to_string(w[j:j + {WINDOW - 1}], ' ')) for j in range(1, len(w) - {WINDOW - 2})] AS k FROM w WHERE len(w) >= {WINDOW}),
v AS (SELECT rid, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM k),
d AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY k) AS c FROM v) WHERE c > 1),
g AS (SELECT DISTINCT rid, i + o AS j FROM d, range(0, {WINDOW}) t(o)),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
y AS (SELECT x.rid, COUNT(*) AS n, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.j = g.j WHERE g.j IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON w.rid = y.rid"""
