"""Best-fit packing with certified bounds.

Pieces of at most ``capacity`` tokens go into as few sequences as can be found. Only their lengths travel:

1. Pieces are dealt over partitions and each partition packs its own by best-fit decreasing (BFD).
2. Every partition computes a lower bound of its bin count from dual feasible functions. A partition
   whose count equals its bound is certified: nobody could pack its pieces into fewer bins.
3. A certified partition closes its bins that are all but full; a partition with a gap closes only full
   bins. The pieces of open bins are exchanged: dealt anew over as few partitions as hold them, packed
   and certified again. The last round (one partition, or ``ROUNDS``) closes all bins.

Each piece carries the certificate of the partition that placed it: the round, how many bins that partition used, and the
bound of how few it could have used.

Defined cases: null and empty texts are one end-of-text token; documents over the capacity, of any length, are cut into
full pieces and a rest; repeated rows, also such without doc_id, are packed once each and dealt over all partitions; an empty table gives no
sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _arrays as A
from tessera.llm._memo import Memo
from tessera.llm._store import checkpoint

CAPACITY, EOT = 4096, 1
#: Pieces in a partition (bounds a task), rounds at most, and the free share of a bin that a certified partition may close.
PART_PIECES, ROUNDS, SLACK = 50_000, 4, 0.01
#: Words whose ids a worker keeps; beyond it, rarer words are encoded once a unit.
CACHE_WORDS = 400_000


#: Marks that may end a word, and ASCII white space.
MARKS = ".,!?;:|&%$*#"
#: Letters under this code point fold and compose one by one (but for U+0130).
LATIN_END = "\u0250"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The vocabulary's spelling of a byte: printable ones are themselves, the others in turn from 256 on.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


class WordIds(Memo):
    """Token ids, as little-endian bytes, of words without white space.

    The vocabulary's splitting never joins characters across ASCII white space, so a text's ids are those of
    its words in turn. Words come to the tokenizer in one call for all that are new in a unit.
    """

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__(keep)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tails: dict[str, bytes] = {}
        self[""] = b""

    def encode_new(self, words: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """The vocabulary splits a word before marks that end it; Latin letters alone are one input of its merging model, in small letters."""
        rare: dict[str, bytes] = {}
        get, tokenize, other = self.get, self.model.tokenize, []
        for w in words:
            if w in self:
                continue
            stem = w.rstrip(MARKS)
            plain = stem.isascii()
            if not stem.isalpha() or not plain and (max(stem) >= LATIN_END or "\u0130" in stem):
                other.append(w)
                continue
            key = stem.lower()
            got = get(key) or rare.get(key)
            if got is None:
                got = array("I", [t.id for t in tokenize(key if plain else key.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
                (self if len(self) < self.keep else rare)[key] = got
            if stem != w:
                tail = w[len(stem) :]
                if tail not in self.tails:
                    self.tails[tail] = self.encode_new([tail])[0]
                got += self.tails[tail]
            if w != key:
                (self if len(self) < self.keep else rare)[w] = got
        rare.update(zip(other, self.encode_new(other)))
        self.rare = rare


def words_of(text: str | None) -> list[str]:
    """A text's parts between white space. str.split also cuts at four control characters that the vocabulary keeps."""
    if not text:
        return []
    return text.translate(_SPACES).split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


_ids: dict[str, WordIds] = {}


def pieces_of(path: str, capacity: int, eot: int):
    """Rows (doc_id, piece, start, length, ids_crc32) of batches with doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _ids[path] = _ids.get(path) or WordIds(path)
        end = np.array([eot], "<u4").tobytes()
        for unit in A.units(batches):
            split = [words_of(t) for t in unit["text"].to_pylist()]
            seen: set[str] = set()
            for words in split:
                seen.update(words)
            ids.learn(seen)
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, words in zip(unit["doc_id"].to_pylist(), split):
                data = b"".join(map(ids.__getitem__, words)) + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    to = min(n, at + capacity)
                    for column, v in zip(out, (doc, k, at, to - at, zlib.crc32(data[4 * at : 4 * to]))):
                        column.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins; ties go to the bin opened last."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at, n = 0, 0  # bit r of open_at: some bin has r tokens free
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = open_at >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_at ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            if not stacks[room - size]:
                open_at |= 1 << (room - size)
            stacks[room - size].append(b)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions.

    For a threshold t <= capacity / 2 the first counts a piece over capacity - t as a whole bin, one under t as
    nothing and others by size; the second (for whole k) counts x as floor((k + 1) x) / k where (k + 1) x isn't whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    n_from, s_from = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    for t in np.flatnonzero(count[: capacity // 2 + 1]).tolist():
        big = int(n_from[capacity - t + 1]) if t else 0
        rest = int(s_from[t] - (s_from[capacity - t + 1] if t else 0))
        best = max(best, big + -(-rest // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def pack_groups(capacity: int, last: bool, round_no: int):
    """Packs one partition's pieces; closed bins get their ids, pieces of open bins go on (sequence_id null).

    Pieces are taken in an order of their content, so a partition that is computed again is packed alike.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        lengths = table["length"].to_numpy().astype(np.int64)
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, n)
        bound = lower_bound(lengths, capacity)
        keep = np.ones(n, bool) if last else fill >= capacity * (1 - SLACK * (n <= bound))
        part = int(table["part"][0].as_py())
        closed = ~keep[bins]
        found = {"sequence_id": (round_no << 56) + (part << 32) + bins, "offset": offsets, "round": np.full(len(bins), round_no), "part_bins": np.full(len(bins), n), "part_bound": np.full(len(bins), bound)}
        out = table.select(_FIELDS)
        for name, values in found.items():
            out = out.append_column(name, pa.array(values, pa.int64(), mask=closed))
        return out

    return run


_ROW = "doc_id long, piece int, start long, length long, ids_crc32 long"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Adds sequence_id, offset and the certificate (round, part_bins, part_bound) to rows of ``_ROW``.

    ``pieces`` should be a written table: its rows are dealt by their places in it, so equal rows spread over all partitions.
    """
    out, round_no, left = None, 0, pieces
    n = pieces.count()
    while True:
        parts = max(1, -(-n // part_pieces))
        final = parts == 1 or round_no == ROUNDS
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no)), F.lit(parts)).cast("long")
        packed = left.select(*_FIELDS).withColumn("part", deal).groupBy("part").applyInArrow(pack_groups(capacity, final, round_no), f"{_ROW}, sequence_id long, offset long, round long, part_bins long, part_bound long")
        packed = packed if final else checkpoint(packed, f"pack{round_no}")
        done = packed.where("sequence_id is not null")
        out = done if out is None else out.unionByName(done)
        if final:
            return out
        left = packed.where("sequence_id is null")
        n, round_no = left.count(), round_no + 1


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, eot: int = EOT) -> DataFrame:
    """One row for each piece of every document: where its ids are and where they go."""
    A.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = checkpoint(rows.mapInArrow(pieces_of(path, capacity, eot), _ROW), "pieces")
    return pack(pieces, capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
