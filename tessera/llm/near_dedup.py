"""Near-duplicate documents by SetSketch registers.

1. *Sketch.* Each distinct shingle of a document draws one exponential variate for each of ``M`` registers, from a 64-bit name
   (stratified, in ascending order, each to the next register of its own
   affine order, so that most elements stop after one or two draws); a register keeps the least, on an
   exponentially spaced scale of base ``BASE``, truncated to 16 bits. Registers of unions are minima of variates, so
   sketches merge, and two sets agree in a register with a probability of about their similarity.
2. *Classes.* Documents with the same sequence of lower-cased words (by a digest of 128 bits) are one class, represented by its smallest row.
3. *Bands.* Classes that agree in all registers of some band share a bucket. With 25 bands of 5 registers a pair at
   similarity 0.85 misses all with probability 4e-7, one at 0.8 with 5e-5.
4. *Star round.* Every class of a bucket is paired with the first one there. The joint likelihood of the
   registers' comparison estimates the pair's similarity; pairs ``SIGMAS`` under the threshold go (3e-7 of those at it), the others are verified.
5. *The rest.* Where a bucket still holds several components, each class outside the first class's component is compared with the classes
   of other components, by registers alone, in blocks, once for each pair (in the first band that holds it). Its likeliest partner is
   verified at once, which joins most of what belongs together. Classes that still have a pair left meet with their texts, block by block, and
   every pair is verified there unless its components have been joined by then: pairs never leave a task.

*Verification* counts the shingles themselves: the texts of a group of pairs go to a task once each, where words and shingles get numbers
that are equal only for equal content. A group too large for one task is dealt over a grid of blocks. So a text travels
with its groups, not with its pairs, and a link never rests on a hash.

Defined cases: null, empty and blank texts have no set and are linked with nothing, not with other rows of their doc_id either; a text with fewer words than a
shingle is one element, so it is linked with its class only; rows with one doc_id are one document of the query (the pipeline stage compares their texts); a null
doc_id counts as the largest; a very long text is sketched by itself; an empty table gives an empty result;
extra columns are ignored by the query and kept by the pipeline stage, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _arrays as A
from tessera.llm._store import checkpoint, drop, n_parts
from tessera.llm.components import components

M, BAND, BASE = 128, 5, 1.02
#: Estimates this far under the threshold (in standard deviations of a register count) are hopeless.
SIGMAS = 5.0
#: Shingles on each side of a verified block, and sketches on each side of a compared one.
BLOCK_SHINGLES, BLOCK_SKETCHES = 250_000, 1024
#: Rounds in which a class tries its likeliest partner before all pairs that are left are verified.
TRIES = 1
NULL_ID = 2**63 - 1
U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; a link at ``num / den`` or more of similarity."""

    width: int = 5
    num: int = 80
    den: int = 100


def shingle_sets(x: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' sets: numbers of the unit (equal exactly for equal shingles, ascending in a document), names, and the documents' offsets there.

    Texts with fewer words than a shingle have no entry.
    """
    n = len(off) - 1
    low = A.LOWER[x]
    starts, ends, doc = A.word_spans(low, off)
    windows = A.exact_windows(A.exact_ids(low, starts, ends), width)
    names = A.window_names(A.word_names(low, starts, ends), width)
    at = np.flatnonzero(doc[: len(windows)] == doc[width - 1 :]) if len(windows) else np.zeros(0, np.int64)
    key, first = np.unique((doc[at].astype(U64) << U64(32)) | windows[at].astype(U64), return_index=True)
    off = np.concatenate([[0], np.cumsum(np.bincount((key >> U64(32)).astype(np.int64), minlength=n))])
    return (key & U64(2**32 - 1)).astype(np.int64), names[at[first]], off


def sequences(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of words of each text, and a digest of its lower-cased words in their order."""
    starts, ends, doc = A.word_spans(x, off)
    low = A.LOWER[x]
    inside = np.zeros(len(x) + 1, np.int64)
    np.cumsum(~A.SPACE[x], out=inside[1:])
    words = np.bincount(doc, minlength=len(off) - 1)
    data, lengths = low[~A.SPACE[x]].tobytes(), (ends - starts).astype("<u4").tobytes()
    cuts, rows = inside[off].tolist(), np.concatenate([[0], 4 * np.cumsum(words)]).tolist()
    out = []
    for a, b, i, j in zip(cuts[:-1], cuts[1:], rows[:-1], rows[1:]):
        h = hashlib.blake2b(data[a:b], digest_size=16)
        h.update(lengths[i:j])
        h.update((j - i).to_bytes(8, "little"))
        out.append(h.digest())
    return words, out


def sketch(names: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each set, a row of M each; of the empty set all are 0."""
    n = len(off) - 1
    low = np.full(n * M, np.inf)
    doc = np.repeat(np.arange(n), np.diff(off))
    h = names
    start, stride = (h & U64(M - 1)).astype(np.int64), ((h >> U64(7)) & U64(M - 1)).astype(np.int64) | 1
    for j in range(M):
        if not len(h):
            break
        u = (A.mix(h + U64(j * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) * 2.0**-53
        value = -np.log1p(-(j + u) / M)
        np.minimum.at(low, doc * M + ((start + j * stride) & (M - 1)), value)
        # a set is done when no later draw can be under any of its registers
        open_ = low.reshape(n, M).max(1) > -np.log1p(-min(j + 1, M - 1) / M)
        stay = open_[doc]
        h, doc, start, stride = h[stay], doc[stay], start[stay], stride[stay]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / np.log(BASE))
    return np.clip(np.where(np.isfinite(low), k + 1024, 0), 0, 65535).astype(np.uint16).reshape(n, M)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sets of known sizes, from all registers of both jointly.

    With u and v the sizes' shares of their sum, a register of the first set is the greater one with probability
    u - v J, the less with v - u J, and equal otherwise (base near 1). The likelihood of the three counts has its
    maximum at the smaller root of a quadratic.
    """
    m = a.shape[-1]
    up, down = (a > b).sum(-1).astype(np.float64), (a < b).sum(-1).astype(np.float64)
    same = m - up - down
    u = na / (na + nb)
    v = 1 - u
    p, q = u * u * (same + down), v * v * (same + up)
    return (p + q - np.sqrt((p - q) ** 2 + 4 * up * down * u * u * v * v)) / (2 * m * u * v)


def _sketched(width: int):
    """Of rows of key columns and a text: the keys, n (shingles), sid (the words' digest), regs (null for texts under a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in A.units(batches):
            x, off = A.text_bytes(unit["text"])
            _, names, cuts = shingle_sets(x, off, width)
            words, ids = sequences(x, off)
            n = np.diff(cuts)
            regs = [r.tobytes() if k else None for r, k in zip(sketch(names, cuts), n.tolist())]
            rest = unit.drop_columns(["text"]).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns]
            yield pa.record_batch([*columns, pa.array(np.where(words > 0, np.maximum(n, 1), 0)), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())], names=[*rest.column_names, "n", "sid", "regs"])

    return run


def _hopeful(rule: Rule):
    """Of pairs (x, y, nx, ny, rx, ry): those whose registers leave a similarity over the threshold possible."""
    least = least_estimate(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (4, 5))
                sizes = (b.column(k).to_numpy().astype(np.float64) for k in (2, 3))
                yield b.select([0, 1, 2, 3]).filter(pa.array(similarity(a, c, *sizes) >= least))

    return run


def bands(rule: Rule) -> tuple[int, int]:
    """How many bands of how many registers."""
    return M // BAND, BAND


def least_estimate(rule: Rule) -> float:
    j = rule.num / rule.den
    return j - SIGMAS * (j * (1 - j) / M) ** 0.5


def _candidates(table: pa.Table, rule: Rule, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left rows, right rows and estimates of the pairs of a block of sketches that an estimate leaves: other components and no earlier band in common.

    once: of two classes outside the pivot's component each pair comes once, with the greater component on the left.
    """
    least = least_estimate(rule)
    n_bands, size = bands(rule)
    comp, n, band = (table[c].to_numpy().astype(np.int64) for c in ("c", "n", "band"))
    left, minor = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("is_left", "minor"))
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, M)
    ri = np.flatnonzero(~left)
    ours, theirs, estimates = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k in np.flatnonzero(left).tolist():
        r = ri[(comp[ri] != comp[k]) & (rule.den * np.minimum(n[ri], n[k]) >= rule.num * np.maximum(n[ri], n[k]))]
        if once:
            r = r[~minor[r] | (comp[r] < comp[k])]
        equal = regs[r] == regs[k]
        stay = equal.sum(1) >= least * M
        r, equal = r[stay], equal[stay]
        if len(r):
            common = equal[:, : n_bands * size].reshape(len(r), n_bands, size).all(2)
            estimate = similarity(regs[k], regs[r], np.full(len(r), float(n[k])), n[r].astype(np.float64))
            stay = (common.argmax(1) == band[k]) & (estimate >= least)
            ours.append(np.full(int(stay.sum()), k)), theirs.append(r[stay]), estimates.append(estimate[stay])
    return np.concatenate(ours), np.concatenate(theirs), np.concatenate(estimates)


def _best(rule: Rule):
    """Of a block of sketches: for each class outside the pivot's component the one pair with the greatest estimate."""

    def run(table: pa.Table) -> pa.Table:
        i, j, estimate = _candidates(table, rule, False)
        cid, comp, n = (table[c].to_numpy().astype(np.int64) for c in ("cid", "c", "n"))
        order = np.lexsort((cid[j], -estimate, i))
        i, j = i[order], j[order]
        first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
        i, j = i[first], j[first]
        return pa.table([pa.array(a) for a in (cid[i], cid[j], n[i], n[j], comp[i], comp[j])], names=["x", "y", "nx", "ny", "cx", "cy"])

    return run


def _meeting(rule: Rule):
    """The rows of a block of sketches that are in some pair."""

    def run(table: pa.Table) -> pa.Table:
        i, j, _ = _candidates(table, rule, True)
        return table.take(pa.array(np.unique(np.concatenate([i, j]))))

    return run


def _settled(rule: Rule):
    """Links (cx, cy) that join components, of a block of sketches with texts: all its pairs are verified, the likeliest first."""
    verify = _verified(rule)

    def run(table: pa.Table) -> pa.Table:
        i, j, estimate = _candidates(table, rule, True)
        cid, comp = (table[c].to_numpy().astype(np.int64) for c in ("cid", "c"))
        _, own = np.unique(cid, return_index=True)
        none = pa.nulls(len(own), pa.int64())
        nodes = pa.table([pa.array(cid[own]), none, none, none, table["text"].take(pa.array(own))], names=["x", "y", "cx", "cy", "text"])
        pairs = pa.table([*(pa.array(a) for a in (cid[i], cid[j], comp[i], comp[j])), pa.nulls(len(i), pa.string())], names=nodes.column_names)
        return verify(pa.concat_tables([nodes, pairs])).select(["cx", "cy"])

    return run


def _verified(rule: Rule):
    """Links (x, y, cx, cy) of a task that join components: rows with a text (node x) and pairs without one."""

    def run(table: pa.Table) -> pa.Table:
        given = table["text"].is_valid().to_numpy()
        nodes, pairs = table.filter(pa.array(given)), table.filter(pa.array(~given))
        ids = nodes["x"].to_numpy().astype(np.int64)
        code, _, cuts = shingle_sets(*A.text_bytes(nodes["text"]), rule.width)
        at = {c: i for i, c in enumerate(ids.tolist())}
        order = np.lexsort((pairs["x"].to_numpy(), pairs["y"].to_numpy()))
        x, y, cx, cy = (pairs[c].to_numpy().astype(np.int64)[order] for c in ("x", "y", "cx", "cy"))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        flag = np.zeros(int(code.max(initial=0)) + 1, bool)
        links = []
        ends = np.flatnonzero(np.concatenate([y[1:] != y[:-1], [True]])) + 1 if len(y) else np.zeros(0, np.int64)
        a = 0
        for b in ends.tolist():
            own = root(int(cy[a]))
            todo = [k for k in range(a, b) if root(int(cx[k])) != own]
            t = at[int(y[a])]
            mine = code[cuts[t] : cuts[t + 1]]
            flag[mine] = True
            for first in range(0, len(todo), 256):  # of a node with very many pairs, some at a time
                part = todo[first : first + 256]
                rows = np.array([at[int(x[k])] for k in part])
                size = cuts[rows + 1] - cuts[rows]
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                hits = np.concatenate([[0], np.cumsum(flag[code[np.repeat(cuts[rows], size) + place]])])
                stop = np.cumsum(size)
                both = hits[stop] - hits[stop - size]
                ok = (both > 0) & (rule.den * both >= rule.num * (size + len(mine) - both))
                for k in np.array(part)[ok].tolist():
                    p, q = root(int(cx[k])), root(int(cy[k]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append(k)
            flag[mine] = False
            a = b
        return pa.table([pa.array(c[links]) for c in (x, y, cx, cy)], names=["x", "y", "cx", "cy"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, text) of rows (cid, sid, text) whose words have that digest, one of each class in a task."""
    seen: set[int] = set()
    for unit in A.units(batches):
        _, found = sequences(*A.text_bytes(unit["text"]))
        keep = []
        for c, s, f in zip(unit["cid"].to_pylist(), unit["sid"].to_pylist(), found):
            keep.append(s == f and c not in seen)
            if keep[-1]:
                seen.add(c)
        yield from unit.select(["cid", "text"]).filter(pa.array(keep, pa.bool_())).to_batches()


def _texts(cids: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, text) of the classes' first rows."""
    some = cids.select("cid").distinct().join(classes.select("cid", "sid", "rep", "th"), "cid")
    found = rows.join(some, (rows["dk"] == some["rep"]) & (F.xxhash64(rows["text"]) == some["th"]))
    return found.select("cid", "sid", "text").mapInArrow(_once, "cid long, text string")


def _links(pairs: DataFrame, texts: DataFrame, rule: Rule, size: int) -> DataFrame:
    """(cx, cy): components joined by pairs (x, y, nx, ny, cx, cy, g) whose full sets are similar enough.

    Pairs of one g meet in one task, or in a grid of blocks over x and y if their texts are many. A text goes once to each task. size: about how many pairs there are.
    """
    pairs = checkpoint(pairs, "pairs", size)
    size, shingles = pairs.agg(F.count("*"), F.sum("nx")).first()
    sides = [pairs.select("g", F.col(k).alias("cid"), F.col(f"n{k}").alias("n")).distinct().groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias(f"b{k}")) for k in "xy"]
    tasks = n_parts(2 * (shingles or 0), BLOCK_SHINGLES)
    cell = F.xxhash64("g", F.pmod(F.xxhash64("x"), "bx"), F.pmod(F.xxhash64("y"), "by"))
    whole = (F.col("bx") == 1) & (F.col("by") == 1)
    dealt = pairs.join(sides[0].join(sides[1], "g"), "g").withColumn("task", F.when(whole, F.pmod(F.xxhash64("g"), F.lit(tasks))).otherwise(cell))
    dealt = checkpoint(dealt.select("task", "x", "y", "cx", "cy"), "pairs", size)
    members = dealt.select("task", F.col("x").alias("cid")).union(dealt.select("task", F.col("y").alias("cid"))).distinct()
    none = F.lit(None).cast("long")
    work = members.join(texts, "cid").select("task", F.col("cid").alias("x"), none.alias("y"), none.alias("cx"), none.alias("cy"), "text")
    work = work.union(dealt.select("task", "x", "y", "cx", "cy", F.lit(None).cast("string").alias("text")))
    found = checkpoint(work.groupBy("task").applyInArrow(_verified(rule), "x long, y long, cx long, cy long").select("cx", "cy").distinct(), "links", size)
    drop(pairs)
    drop(dealt)
    return found


_BLOCK = "band int, key long, lb long, rb long, is_left boolean, minor boolean, cid long, c long, n long, regs binary"


def _blocks(buckets: DataFrame, classes: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Sketches of the buckets that hold several components, without pivots, in blocks: classes outside the pivot's component (left) against all.

    Each pair is compared in some block; the rows grow with the square of a bucket over BLOCK_SKETCHES only.
    """
    rows = buckets.where("size > 2").join(labels.select(F.col("node").alias("cid"), F.col("component").alias("c")), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    rows = checkpoint(rows, "members", size)
    main = rows.where("cid = pivot").select("band", "key", F.col("c").alias("main"))
    several = rows.groupBy("band", "key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("band", "key")
    some = rows.join(several, ["band", "key"], "left_semi").where("cid <> pivot").join(main, ["band", "key"]).withColumn("minor", F.col("c") != F.col("main"))
    some = checkpoint(some.join(classes.select("cid", "n", "regs"), "cid"), "sketches", size)
    drop(rows)
    shape = some.groupBy("band", "key").agg(F.ceil(F.sum(F.col("minor").cast("int")) / BLOCK_SKETCHES).alias("lefts"), F.ceil(F.count("*") / BLOCK_SKETCHES).alias("rights")).where("lefts > 0")
    some = some.join(shape, ["band", "key"])
    h = F.xxhash64("cid", "band")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = some.where("minor").withColumns({"lb": F.pmod(h, "lefts"), "rb": numbers("rights"), "is_left": F.lit(True)})
    right = some.withColumns({"lb": numbers("lefts"), "rb": F.pmod(h, "rights"), "is_left": F.lit(False)})
    cols = [f.split()[0] for f in _BLOCK.split(", ")]
    return left.select(*cols).union(right.select(*cols))


def _joined(labels: DataFrame, more: DataFrame, size: int) -> DataFrame:
    """Labels after links between components: components of components."""
    again = components(more.toDF("x", "y")).toDF("component", "joined")
    every = labels.union(again.select(F.col("component").alias("node"), "component")).distinct()  # with classes that had no link before
    return checkpoint(every.join(again, "component", "left").groupBy("node").agg(F.min(F.coalesce("joined", "component")).alias("component")), "labels", size)


def _rest(buckets: DataFrame, texts: DataFrame, classes: DataFrame, labels: DataFrame, rule: Rule, size: int) -> DataFrame:
    """Labels after the links between components that share a bucket of three or more classes.

    First each class outside its pivot's component tries its likeliest partner, which joins most of what belongs together. What is
    then left in a block with a pair meets with its text and all pairs are verified there, so that pairs never leave a task.
    """
    cell = ["band", "key", "lb", "rb"]
    for _ in range(TRIES):
        best = _blocks(buckets, classes, labels, size).groupBy(*cell).applyInArrow(_best(rule), "x long, y long, nx long, ny long, cx long, cy long")
        more = _links(best.distinct().withColumn("g", F.col("cy")), texts, rule, size)
        if more.isEmpty():
            break
        labels = _joined(labels, more, size)
    meeting = checkpoint(_blocks(buckets, classes, labels, size).groupBy(*cell).applyInArrow(_meeting(rule), _BLOCK), "meeting")
    work = meeting.join(texts, "cid")
    more = checkpoint(work.groupBy(*cell).applyInArrow(_settled(rule), "cx long, cy long").distinct(), "links", size)
    drop(meeting)
    return labels if more.isEmpty() else _joined(labels, more, size)


def near_duplicates(rows: DataFrame, rule: Rule = Rule(), merge: bool = True) -> DataFrame:
    """dk, n and first (the smallest dk of the row's component) of rows (dk, text); dk may be of any ordered kind.

    merge: rows of one dk are one document.
    """
    spark = rows.sparkSession
    A.tune(spark)
    kind = rows.schema["dk"].dataType.simpleString()
    sig = rows.select("dk", F.xxhash64("text").alias("th"), "text").mapInArrow(_sketched(rule.width), f"dk {kind}, th long, n long, sid binary, regs binary")
    sig = checkpoint(sig, "sketches")
    n_rows = sig.count()
    least = F.min(F.struct("dk", "th"))
    classes = sig.where("n > 0").groupBy("sid").agg(least.alias("at"), F.first("regs").alias("regs"), F.first("n").alias("n"))
    # the number of a class is fixed once the table is written
    classes = checkpoint(classes.select(F.monotonically_increasing_id().alias("cid"), "sid", F.col("at.dk").alias("rep"), F.col("at.th").alias("th"), "regs", "n"), "classes", n_rows)
    mine = checkpoint(sig.where("n > 0").select("dk", "sid").join(classes.select("sid", "cid", "rep"), "sid").select("dk", "cid", "rep"), "ids", n_rows) if merge else None
    n_bands, size = bands(rule)
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring("regs", i * (2 * size) + 1, F.lit(2 * size))).alias("key")))).alias("b")
    keys = classes.where("regs is not null").select("cid", band).select("cid", "b.band", "b.key")
    shared = keys.groupBy("band", "key").agg(F.min("cid").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    buckets = checkpoint(keys.join(shared, ["band", "key"]), "buckets", n_rows * n_bands)
    members = buckets.count()
    side = lambda k: classes.select(F.col("cid").alias(k), F.col("regs").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    stars = buckets.where("cid <> pivot").select(F.col("cid").alias("x"), F.col("pivot").alias("y")).distinct()
    stars = stars.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "rx", "ry")
    stars = stars.mapInArrow(_hopeful(rule), "x long, y long, nx long, ny long").withColumns({"cx": F.col("x"), "cy": F.col("y"), "g": F.col("y")})
    texts = checkpoint(_texts(buckets, rows, classes), "class_texts")  # of classes that share a bucket; joined below instead of all documents
    links = _links(stars, texts, rule, members)
    if merge:
        several = mine.groupBy("dk").agg(F.min("cid").alias("cx"), F.max("cid").alias("cy")).where("cx <> cy").select("dk", "cx")
        same = checkpoint(mine.join(several, "dk").select("cx", F.col("cid").alias("cy")).where("cx <> cy").distinct(), "links", n_rows)
        links = links.union(same)
    labels = components(links.toDF("x", "y"))
    labels = _rest(buckets, texts, classes, labels, rule, members)
    drop(texts)
    named = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("first")), "component").select(F.col("node").alias("cid"), "first")
    of_class = checkpoint(classes.select("sid", "cid", "rep").join(named, "cid", "left").select("sid", F.coalesce("first", "rep").alias("first")), "first", n_rows)
    drop(buckets)
    found = sig.select("dk", "n", "sid").join(of_class, "sid", "left")
    return found.select("dk", "n", F.coalesce("first", "dk").alias("first"))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk"), F.col("text").cast("string").alias("text"))


def components_of(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document is its component's smallest) for every row."""
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    found = near_duplicates(_with_key(docs), rule)
    return found.select(back("dk").alias("doc_id"), F.col("n").alias("n_shingles"), back("first").alias("component_id"), (F.col("first") == F.col("dk")).alias("kept"))


def keep_first(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, among its texts that of the smallest digest.

    Here a document is a doc_id with a text: rows that share a doc_id, or have none, are compared like all others. Rows
    whose text has no set stay. Those that go are fewer than those that stay, so they are joined.
    """
    dk, name = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), F.substring(F.unhex(F.sha2(docs["text"].cast("string"), 256)), 1, 16)
    rows = docs.select(F.struct(dk.alias("id"), name.alias("name")).alias("dk"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = near_duplicates(rows, rule, merge=False).where("n > 0").groupBy("dk").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    found = found.select("dk", "n", (F.col("dk") != F.col("first")).alias("goes")).where("goes or n > 1")
    marks = checkpoint(found.select(F.col("dk.id").alias("__mark_id"), F.col("dk.name").alias("__mark_name"), "goes"), "gone", docs.count())
    on = (dk == marks["__mark_id"]) & (name == marks["__mark_name"])
    kept = docs.join(marks, on, "left_anti")
    again = marks.where("not goes")  # first of their component, but in several equal rows
    return kept if again.isEmpty() else kept.unionByName(docs.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))


#: The contract of op7: three words, 0.85.
CONTRACT = Rule(3, 85, 100)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), CONTRACT)


#: The contract in SQL: all pairs that share a shingle, compared on full sets, and what each document reaches.
ORACLE = """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [w[i:i + 2] for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, t.y FROM r JOIN t ON r.c = t.x)
SELECT n.doc_id, n.n AS n_shingles, MIN(r.c) AS component_id, n.doc_id = MIN(r.c) AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n"""
