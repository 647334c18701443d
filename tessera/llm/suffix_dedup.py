"""Repeated byte strings by bucket-pointer refinement of a sampled suffix array.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id.
The suffixes of all texts are sorted to that depth, in the manner of bucket-pointer refinement: first into buckets of q-grams,
then each bucket by the buckets that its members' later offsets are in, whose refined numbers are used again at the next step.

1. *Initial buckets, globally.* Each string of LENGTH bytes names the q-gram (Q bytes) of least hash inside it; equal strings name equal
   q-grams at equal places, so the bucket of a string is that of its named q-gram. One packed exchange tells every
   document which of its q-grams other texts hold too. Only strings in such buckets can repeat.
2. *Snippets.* The strings that name one place of a document are consecutive; the bytes they cover are a
   snippet. Of equal snippets within a unit only those of the smallest doc_id go on, one for each of its texts; for the others
   all strings are known to repeat.
3. *Refinement.* Snippets meet by their q-gram's hash, many buckets to a task. All their suffixes get bucket numbers
   for 8 bytes; numbers for 16, 32 and LENGTH bytes come from sorting, within buckets of more than one
   member, by the number of the suffix at the offset that is already sorted. The smallest document of each final bucket
   decides over the others.

A bucket of more than ``HOT`` snippets is hot: its strings go one by one, the smallest document of each is found by an
aggregate (combined before the shuffle) and joined back over salts, so a bucket or string of any size is spread over many tasks. Texts that are
equal as a whole are known by 128 bits of their SHA-256; one of them takes part. All else is decided on bytes: names only say where to look.

Defined cases: null is the empty text; texts under LENGTH bytes keep all; rows with one doc_id don't remove each
other's bytes; a null doc_id counts as the largest; a text of any length is a unit by itself, sorted a slice after the other;
an empty table gives an empty result; extra columns are ignored by the query and kept by the pipeline stage, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import _arrays as A
from tessera.llm._exchange import NULL_ID, SHORT, digest, first_copies, keyed, packed_spans, shared_names, spread_join
from tessera.llm._store import checkpoint, drop, n_parts, text_bytes

LENGTH, Q = 50, 32
#: Snippets over which a q-gram's bucket is hot; bytes of text for each part of the name space; snippets of a refinement task.
HOT, PART_BYTES, TASK_SNIPPETS = 20_000, 16 << 20, 8_000
#: Places of a slice in which q-grams are named; with a string's bytes they stay under 2^16.
PLACES = 1 << 15


def gram_names(x: np.ndarray, q: int = Q) -> np.ndarray:
    """A name of each q bytes (q a power of two from 8 on), by doubling from words of 8 bytes."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    h = A.mix(np.ndarray((len(x) - 7,), "<u8", x.tobytes(), strides=(1,)) ^ A.SEEDS[0])
    size = 8
    while size < q:
        h = A.pair_names(h[:-size], h[size:], size)
        size *= 2
    return h


def named_places(x: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of consecutive strings that name one q-gram: name, first and last string's start, document.

    A slice is short enough for the processor's cache, and for a place in it to go under the 48 bits of a name that are compared.
    """
    width, size = length - q + 1, min(A.SLICE, PLACES)
    cuts = np.unique(np.concatenate([off[:-1], np.maximum(off[1:] - length + 1, off[:-1])]))  # from where on strings are in a document, and no more
    names, firsts, lasts = [], [], []
    for a in range(0, max(len(x) - length + 1, 0), size):
        b = min(len(x), a + size + length - 1)  # strings that start in the slice
        h = gram_names(x[a:b], q)
        low, reach = (h & SHORT) | np.arange(len(h), dtype=np.uint64), 1
        while reach < width:  # the leftmost least of each string's q-grams
            step = min(reach, width - reach)
            low = np.minimum(low[step:], low[:-step])
            reach += step
        n = len(low)
        head = np.ones(n, bool)
        head[1:] = low[1:] != low[:-1]
        head[cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, a + n)] - a] = True
        at = np.flatnonzero(head)
        names.append(h[(low[at] & ~SHORT).astype(np.int64)])
        firsts.append(at + a)
        lasts.append(np.append(at[1:], n) - 1 + a)
    if not names:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    name, first, last = (np.concatenate(c) for c in (names, firsts, lasts))
    doc = A.owner(off, first)
    ok = first + length <= off[doc + 1]
    return name[ok], first[ok], last[ok], doc[ok]


def _grams(unit: pa.Table):
    name, _, _, doc = named_places(*A.text_bytes(unit["text"]))
    return name, doc


def refine(ids: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """Bucket numbers of suffixes ``at`` to the sum of the depths: those in buckets of several members are sorted by the number at the offset."""
    key = (ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + offset].astype(np.uint64)
    count = np.bincount(ids[at])
    many = np.flatnonzero(count[ids[at]] > 1)
    out = np.empty(len(at), np.int64)
    order = many[np.argsort(key[many], kind="stable")]
    k = key[order]
    head = np.ones(len(order), bool)
    head[1:] = k[1:] != k[:-1]
    out[order] = np.cumsum(head) - 1
    alone = np.ones(len(at), bool)
    alone[many] = False
    out[alone] = int(head.sum()) + np.arange(int(alone.sum()))
    return out


def suffix_buckets(x: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number for each string x[s : s + length], equal for equal strings: bucket-pointer refinement to that depth."""
    depth = 8
    wide = np.concatenate([x, np.zeros(8, np.uint8)])
    words = np.zeros(len(x), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | wide[k : k + len(x)]
    need = [length]  # depths at which all numbers within a string are needed, from the last
    while need[-1] > 8:
        need.append(8 if need[-1] <= 16 else 1 << (need[-1] - 1).bit_length() - 1)
    ids = np.unique(words, return_inverse=True)[1]
    for to in need[-2::-1]:
        if to == length:
            return refine(ids, starts, to - depth)
        at = np.arange(len(x) - (to - depth))
        new = np.full(len(x), 0, np.int64)
        new[: len(at)] = refine(ids, at, to - depth)
        ids, depth = new, to
    return ids[starts]


def _slices(group: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal consecutive values."""
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist() if len(group) else [0]
    return list(zip(cuts[:-1], cuts[1:]))


def _runs(places: np.ndarray) -> np.ndarray:
    """Ascending places as pairs of the first of a run of successors and its length."""
    head = np.ones(len(places), bool)
    head[1:] = places[1:] != places[:-1] + 1
    at = np.flatnonzero(head)
    return np.column_stack([places[at], np.diff(np.append(at, len(places)))]).astype("<i8")


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dk, th, start, n, key, snippet, places): a snippet to be refined, or, with null snippet, n strings from start that repeat.

    places: all places of the snippet in its document, if there are several, as pairs of a place and how many follow each other.
    """
    for unit in A.units(batches):
        x, off = A.text_bytes(unit["text"])
        name, first, last, doc = named_places(x, off)
        sets = unit["names"].to_pylist()
        keep = np.zeros(len(name), bool)
        cuts = np.searchsorted(doc, np.arange(len(sets) + 1))
        for i, s in enumerate(sets):
            known, own = np.frombuffer(s, "<u8"), name[cuts[i] : cuts[i + 1]] & SHORT
            keep[cuts[i] : cuts[i + 1]] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        name, first, last, doc = name[keep], first[keep], last[keep], doc[keep]
        if not len(name):
            continue
        ids = unit["dk"].to_numpy()
        # equal snippets of the unit: those of the smallest id go on, one for each text with that id
        end = last + LENGTH
        same = A.exact_ids(x, first, end)
        th = unit["th"].combine_chunks()
        text = th.dictionary_encode().indices.to_numpy()[doc]
        order = np.lexsort((first, doc, text, ids[doc], same))
        head = np.ones(len(order), bool)
        head[1:] = same[order][1:] != same[order][:-1]
        at = np.flatnonzero(head)
        low = ids[doc[order[at]]][np.cumsum(head) - 1]
        later, least = order[ids[doc[order]] > low], order[ids[doc[order]] == low]
        new = np.ones(len(least), bool)
        new[1:] = (same[least][1:] != same[least][:-1]) | (text[least][1:] != text[least][:-1])
        sent, group = least[new], np.cumsum(new) - 1
        rest = ~new & (doc[least] == doc[sent][group])  # more places in that row
        again, group = least[rest], group[rest]
        more: list[bytes | None] = [None] * len(sent)
        for a, b in _slices(group):
            g = int(group[a])
            more[g] = _runs(np.concatenate([first[sent[g : g + 1]], first[again[a:b]]]) - off[doc[sent[g]]]).tobytes()
        data = x.tobytes()
        rows = np.concatenate([sent, later])
        snippet = [data[a:b] for a, b in zip(first[sent].tolist(), end[sent].tolist())] + [None] * len(later)
        yield pa.record_batch(
            [pa.array(ids[doc[rows]]), th.take(pa.array(doc[rows])), pa.array(first[rows] - off[doc[rows]]), pa.array((last - first + 1)[rows].astype(np.int32)), pa.array(name[rows].view(np.int64)), pa.array(snippet, pa.binary()), pa.array(more + [None] * len(later), pa.binary())],
            names=["dk", "th", "start", "n", "key", "snippet", "places"],
        )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of hot snippets at each of its places: (dk, th, start, string)."""
    for b in batches:
        dk, th, start, n, snippet, places = b.columns
        x, off = A.text_bytes(snippet.cast(pa.large_binary()))
        n = n.to_numpy().astype(np.int64)
        row, first = np.arange(len(n)), start.to_numpy().astype(np.int64)
        many = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
        if len(many):  # all places of these; the others have one
            pairs = [np.frombuffer(p, "<i8").reshape(-1, 2) for p in places.take(pa.array(many)).to_pylist()]
            each = [np.repeat(q[:, 0] - (np.cumsum(q[:, 1]) - q[:, 1]), q[:, 1]) + np.arange(int(q[:, 1].sum())) for q in pairs]
            one = np.setdiff1d(row, many)
            row, first = np.concatenate([one, *(np.full(len(f), r) for r, f in zip(many, each))]), np.concatenate([first[one], *each])
        size = n[row]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        row, first = np.repeat(row, size), np.repeat(first, size) + place
        for i in range(0, len(row), 100_000):
            r, p = row[i : i + 100_000], place[i : i + 100_000]
            data = x[(off[:-1][r] + p)[:, None] + np.arange(LENGTH)].tobytes()
            cuts = (np.arange(len(r) + 1) * LENGTH).astype(np.int32)
            string = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)])
            yield pa.record_batch([dk.take(pa.array(r)), th.take(pa.array(r)), pa.array(first[i : i + 100_000]), string], names=["dk", "th", "start", "string"])


def _hot_spans(rows: DataFrame) -> DataFrame:
    """What a smaller document holds of hot buckets' strings; each string's smallest document is found before the shuffle."""
    strings = rows.select("dk", "th", "start", "n", "snippet", "places").mapInArrow(_strings, "dk long, th binary, start long, string binary")
    low = strings.groupBy("string").agg(F.min("dk").alias("low"), F.max("dk").alias("high")).where("low < high").drop("high")
    return spread_join(strings, low, "string").where("low < dk").select("dk", "th", "start", F.lit(1).cast("long").alias("n"))


def _refined(table: pa.Table) -> pa.Table:
    """Of the snippets of some buckets: the runs of strings (dk, th, start, n) that a smaller document holds too."""
    coded = table["snippet"].combine_chunks().dictionary_encode()  # equal snippets are sorted once
    code = coded.indices.to_numpy().astype(np.int64)
    x, off = A.text_bytes(coded.dictionary.cast(pa.large_binary()))
    strings = np.diff(off) - LENGTH + 1
    base = np.cumsum(strings) - strings
    own = np.repeat(np.arange(len(strings)), strings)
    bucket = suffix_buckets(x, off[:-1][own] + np.arange(len(own)) - base[own])
    dk, n = table["dk"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
    least = np.full(len(strings), NULL_ID, np.int64)
    np.minimum.at(least, code, dk)
    low = np.full(int(bucket.max()) + 1, NULL_ID, np.int64)
    np.minimum.at(low, bucket, least[own])
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = low[bucket[base[code[row]] + place]] < dk[row]
    row, place = row[hit], place[hit]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(head)
    row, place, size = row[at], place[at], np.diff(np.append(at, len(row)))
    start = table["start"].to_numpy().astype(np.int64)[row] + place
    places = table["places"].take(pa.array(row)).to_pylist() if table["places"].null_count < len(n) else []
    rows, starts, sizes = [row], [start], [size]
    for i, p in enumerate(places):
        if p:  # the first place is in the arrays already; a run of several places has one string each
            pairs = np.frombuffer(p, "<i8").reshape(-1, 2)
            rows.append(np.full(len(pairs), row[i]))
            starts.append(pairs[:, 0] + place[i])
            sizes.append(np.maximum(pairs[:, 1], size[i]))
    row, start, size = np.concatenate(rows), np.concatenate(starts), np.concatenate(sizes)
    return pa.table([table["dk"].take(pa.array(row)), table["th"].take(pa.array(row)), pa.array(start), pa.array(size.astype(np.int64))], names=["dk", "th", "start", "n"])


def _marked(row_spans: bytes | None, n: int, copied: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that go."""
    if copied and n >= LENGTH:
        return np.array([0]), np.array([n])
    if not row_spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.frombuffer(row_spans, "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, end = spans[:, 0], np.maximum.accumulate(spans[:, 0] + spans[:, 1] + LENGTH - 1)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(head)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text): the rows' structs as they are, and their texts without the repeated bytes."""
    for unit in A.units(batches):
        texts = []
        for text, spans, copied in zip(unit["text"].to_pylist(), unit["spans"].to_pylist(), unit["copied"].to_pylist()):
            if text is not None and (spans or copied):
                data = text.encode()
                text = _cut(data, *_marked(spans, len(data), copied)).decode("utf-8", "ignore")
            texts.append(text)
        yield from pa.table([unit["row"], pa.array(texts, pa.string())], names=["row", "text"]).to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for unit in A.units(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for text, spans, copied in zip(unit["text"].to_pylist(), unit["spans"].to_pylist(), unit["copied"].to_pylist()):
            data = text.encode()
            a, b = _marked(spans, len(data), copied)
            for column, v in zip(out, (len(data), int((b - a).sum()), len(a), hashlib.sha256(_cut(data, a, b)).hexdigest())):
                column.append(v)
        yield pa.record_batch([unit["dk"].combine_chunks(), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3])], names=["dk", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> DataFrame:
    """(dk, th, spans, copied) of documents with bytes to remove; spans: pairs of the first string's start and the number of strings."""
    spark = docs.sparkSession
    A.tune(spark)
    rows = keyed(docs)
    size = text_bytes(docs)
    ids = checkpoint(rows.select("dk", "th"), "texts")
    classes = ids.groupBy("th").agg(F.min("dk").alias("rep"))
    found = checkpoint(shared_names(rows, _grams, n_parts(size, PART_BYTES, 8), False, size), "grams")
    reps = found.join(classes.select("th", F.col("rep").alias("dk")), ["dk", "th"], "left_semi").select("dk", "th", "names")
    some = rows.join(reps, ["dk", "th"]).select("dk", "th", "text", "names").mapInArrow(first_copies, "dk long, th binary, text string, names binary")
    snippets = checkpoint(some.mapInArrow(_snippets, "dk long, th binary, start long, n int, key long, snippet binary, places binary"), "snippets")
    drop(found)
    todo = snippets.where("snippet is not null")
    tasks = n_parts(todo.count(), TASK_SNIPPETS, 8)
    hot = checkpoint(todo.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
    hot_spans = None if hot.isEmpty() else _hot_spans(todo.join(hot, "key", "left_semi"))
    todo = todo if hot_spans is None else todo.join(hot, "key", "left_anti")
    todo = todo.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    refined = todo.groupBy("task").applyInArrow(_refined, "dk long, th binary, start long, n long")
    spans = refined.unionByName(snippets.where("snippet is null").select("dk", "th", "start", F.col("n").cast("long")))
    spans = spans if hot_spans is None else spans.unionByName(hot_spans)
    spans = spans.withColumn("task", F.pmod(F.xxhash64("dk", "th"), F.lit(tasks)))
    spans = checkpoint(spans.groupBy("task").applyInArrow(packed_spans, "dk long, th binary, spans binary"), "spans")
    drop(snippets)
    copied = ids.distinct().join(classes, "th").where("dk > rep").select("dk", "th", F.lit(True).alias("copied"))
    return spans.join(copied, ["dk", "th"], "full").withColumn("copied", F.coalesce("copied", F.lit(False)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    full = keyed(docs).join(repeats(docs), ["dk", "th"], "left").select("dk", "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    out = full.mapInArrow(_digests, "dk long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("dk") != NULL_ID, F.col("dk")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def trim(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without their repeated bytes (a character cut in two goes whole); n_chars, if there, follows."""
    row = F.struct(*(docs[c] for c in docs.columns if c != "text"))  # one column, whatever the names inside
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk"), digest(plain).alias("th"), F.col("text").cast("string").alias("text"), row.alias("row"))
    full = rows.join(repeats(docs), ["dk", "th"], "left").select("row", "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    out = full.mapInArrow(_trimmed, StructType([rows.schema["row"], rows.schema["text"]]))
    length = lambda c: F.char_length("text").cast(docs.schema[c].dataType)
    return out.select(*((F.col("text") if c == "text" else length(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract in SQL: all byte strings (in hex) of all documents, grouped by their bytes.
ORACLE = f"""WITH h AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
k AS (SELECT rid, doc_id, [md5(substr(h, 2 * i + 1, {2 * LENGTH})) for i in range(0, length(h) // 2 - {LENGTH - 1})] AS k FROM h WHERE length(h) >= {2 * LENGTH}),
v AS (SELECT rid, doc_id, unnest(k) AS k, generate_subscripts(k, 1) - 1 AS i FROM k),
d AS (SELECT rid, i FROM (SELECT rid, i, doc_id, MIN(doc_id) OVER (PARTITION BY k) AS low FROM v) WHERE low < doc_id),
g AS (SELECT DISTINCT rid, i + o AS j FROM d, range(0, {LENGTH}) t(o)),
c AS (SELECT a.rid, COUNT(*) AS n, SUM(CASE WHEN b.j IS NULL THEN 1 ELSE 0 END) AS spans FROM g a LEFT JOIN g b ON a.rid = b.rid AND a.j = b.j + 1 GROUP BY a.rid),
x AS (SELECT rid, unnest([substr(h, 2 * i + 1, 2) for i in range(0, length(h) // 2)]) AS byte, unnest(range(0, length(h) // 2)) AS j FROM h),
y AS (SELECT x.rid, string_agg(byte, '' ORDER BY x.j) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.j = g.j WHERE g.j IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(kept, ''))) AS kept_sha256
FROM h LEFT JOIN c ON h.rid = c.rid LEFT JOIN y ON h.rid = y.rid"""
