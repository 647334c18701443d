"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary's pieces and their scores are taken from a model file as they are and read as log scores.
A text is escaped (blank to U+2581, one put in front) and cut into words where no piece can cross: before
each run of U+2581, and around characters that no longer piece holds. So the best path of a text is that of its words
in turn, and words that repeat are encoded once. New words of a batch go through the trie together, one
character step at a time, and through the Viterbi recursion together, one position at a time.
Ties go to the longest last piece, as in the public library. A character without a piece becomes its
UTF-8 bytes as byte pieces.

Decoding joins the pieces' bytes, turns markers into blanks and takes the front one away.

The public vocabularies at hand hold no unigram file: the registered query reads ``piece_bpe_32k.model``, whose scores are minus the
ranks of its merges. The search is the same for any scores; with those it finds the path of the least sum of ranks,
not that of the likeliest unigrams. A vocabulary of true log scores is in the tests.

Defined cases: null and empty texts have no pieces; bytes that are not UTF-8 decode to U+FFFD; U+2581 in
a text is the same as a blank (the one case that a round trip changes); repeated rows are encoded each; a text of any length is encoded whole, in
time proportional to it (a word without a cut goes one position at a time); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _arrays as A
from tessera.llm._memo import Memo

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEEP_WORDS = 400_000


def double_array(words: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie of code sequences (codes from 1): a child of node s by code c is t = base[s] + c with check[t] = s."""
    words_at = sorted(range(len(words)), key=lambda i: words[i])
    base: dict[int, int] = {}
    check: dict[int, int] = {0: 0}
    value: dict[int, int] = {}
    skip: dict[int, int] = {0: 1}  # of a taken slot: some later slot before which none is free

    def free(at: int) -> int:
        seen = []
        while at in skip:
            seen.append(at)
            at = skip[at]
        for s in seen:
            skip[s] = at
        return at

    far = 1  # nodes with several children are placed from here on
    todo = [(0, 0, len(words_at), 0)]  # node, range of sorted words, depth
    while todo:
        node, a, b, depth = todo.pop()
        while a < b and len(words[words_at[a]]) == depth:
            value[node] = words_at[a]
            a += 1
        kids = []
        while a < b:
            code, first = words[words_at[a]][depth], a
            while a < b and words[words_at[a]][depth] == code:
                a += 1
            kids.append((code, first, a))
        if not kids:
            continue
        low = kids[0][0]
        at = free(max(far if len(kids) > 1 else 1, low + 1))
        while any(at - low + c in check for c, _, _ in kids):
            at = free(at + 1)
        if len(kids) > 1:
            far = at + 1
        base[node] = at - low
        for code, first, last in kids:
            slot = at - low + code
            check[slot], skip[slot] = node, slot + 1
            todo.append((slot, first, last, depth + 1))

    def flat(found: dict[int, int], default: int) -> np.ndarray:
        out = np.full(max(check) + 1, default, np.int32)
        out[list(found)] = list(found.values())
        return out

    return flat(base, 0), flat(check, -1), flat(value, -1)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; ``alphabet``: code of each character of the trie, by code point (0: none)."""

    pieces: list[bytes]
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    alphabet: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    longest: int
    crosses: bool  # some piece has U+2581 after another character
    alone: str  # characters that a text is cut around

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        texts = {i: m.id_to_piece(i) for i in normal}
        pieces = [b""] * n
        byte_ids = np.full(256, m.unk_id(), np.int64)
        for i in range(n):
            if i in texts:
                pieces[i] = texts[i].replace(MARK, " ").encode()
            elif m.is_byte(i):
                byte = int(m.id_to_piece(i)[3:5], 16)
                pieces[i], byte_ids[byte] = bytes([byte]), i
            elif m.is_unknown(i):
                pieces[i] = "⁇".encode()
        return Vocabulary.make(texts, {i: m.get_score(i) for i in normal}, pieces, byte_ids, m.unk_id())

    @staticmethod
    def make(texts: dict[int, str], scores: dict[int, float], pieces: list[bytes], byte_ids: np.ndarray, unknown: int) -> Vocabulary:
        points = sorted({ord(c) for t in texts.values() for c in t})
        alphabet = np.zeros(0x110000, np.int32)
        alphabet[points] = np.arange(1, len(points) + 1)
        ids = list(texts)
        base, check, value = double_array([tuple(alphabet[[ord(c) for c in texts[i]]].tolist()) for i in ids])
        value = np.where(value >= 0, np.array([*ids, -1])[value], -1).astype(np.int32)
        score = np.zeros(len(pieces))
        for i, s in scores.items():
            score[i] = s
        joined = {c for t in texts.values() if len(t) > 1 for c in t}
        return Vocabulary(pieces, score, base, check, value, alphabet, byte_ids, unknown, min(scores.values()) - UNKNOWN_PENALTY, max(map(len, texts.values())), any(MARK in t.lstrip(MARK) for t in texts.values()), "".join(c for c in "\n\r\t" if c not in joined))


def viterbi(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of the best paths of all words, and the words' offsets there; -1 - code point for a character without a piece."""
    lengths = np.array([len(w) for w in words], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = v.alphabet[points]
    ends = np.repeat(np.cumsum(lengths), lengths)
    n = len(points)
    at, state = np.arange(n), np.zeros(n, np.int64)
    edges = []
    single = np.zeros(n, bool)
    for size in range(1, v.longest + 1):
        code = codes[at + size - 1]
        to = v.base[state] + code
        ok = (code > 0) & (to < len(v.check))
        ok[ok] = v.check[to[ok]] == state[ok]
        at, state = at[ok], to[ok].astype(np.int64)
        got = v.value[state]
        hit = got >= 0
        edges.append((at[hit], np.full(int(hit.sum()), size), got[hit].astype(np.int64), v.scores[got[hit]]))
        if size == 1:
            single[at[hit]] = True
        more = at + size < ends[at]
        at, state = at[more], state[more]
        if not len(at):
            break
    lone = np.flatnonzero(~single)
    edges.append((lone, np.ones(len(lone), np.int64), -1 - points[lone], np.full(len(lone), v.unknown_score)))
    start, size, piece, score = (np.concatenate(c) for c in zip(*edges))
    first = np.cumsum(lengths) - lengths
    step = start - np.repeat(first, lengths)[start]  # place in the word
    order = np.argsort(step, kind="stable")
    start, size, piece, score, step = (a[order] for a in (start, size, piece, score, step))
    # nodes: each word has one more than characters; node of place i of word w is i + w
    word = np.repeat(np.arange(len(words)), lengths)
    node = start + word[start]
    best = np.full(n + len(words), -np.inf)
    back, via = np.zeros(n + len(words), np.int64), np.zeros(n + len(words), np.int64)
    roots = first + np.arange(len(words))
    best[roots] = 0
    cuts = np.searchsorted(step, np.arange(int(step[-1]) + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        target, value = node[a:b] + size[a:b], best[node[a:b]] + score[a:b]
        better = value > best[target]
        t = target[better]
        best[t], back[t], via[t] = value[better], node[a:b][better], piece[a:b][better]
    now, who, taken = roots + lengths, np.arange(len(words)), []
    while True:
        open_ = now > roots[who]
        now, who = now[open_], who[open_]
        if not len(now):
            break
        taken.append((who, via[now]))
        now = back[now]
    owners, ids = (np.concatenate(c) for c in zip(*taken))
    order = np.argsort(owners[::-1], kind="stable")  # steps were taken from the end
    return ids[::-1][order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


class Pieces(Memo):
    """Ids, as little-endian bytes, of escaped words."""

    def __init__(self, v: Vocabulary, keep: int = KEEP_WORDS):
        super().__init__(keep)
        self.v = v

    def encode_new(self, words: list[str]) -> list[bytes]:
        out, a = [], 0
        while a < len(words):  # bounded groups
            b, size = a, 0
            while b < len(words) and (b == a or size < 200_000):
                size += len(words[b])
                b += 1
            ids, off = viterbi(self.v, words[a:b])
            lone = ids < 0
            if lone.any():
                parts = [self.v.byte_ids[list(chr(-1 - i).encode())] for i in ids[lone].tolist()]
                width = np.ones(len(ids), np.int64)
                width[lone] = [len(p) for p in parts]
                wide = np.repeat(ids, width)
                wide[wide < 0] = np.concatenate(parts)
                ids, off = wide, np.concatenate([[0], np.cumsum(width)])[off]
            data, cuts = ids.astype("<u4").tobytes(), (4 * off).tolist()
            out += [data[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
            a = b
        return out


def splitter(v: Vocabulary):
    """A function from a text to its words, in order."""
    if v.crosses:
        return lambda t: [MARK + t.replace(" ", MARK)] if t else []
    lone = re.escape(v.alone)
    find = re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
    return lambda t: find(MARK + t.replace(" ", MARK)) if t else []


def encode_units(memo: Pieces, unit: pa.Table) -> list[bytes]:
    """The ids of every text of a unit."""
    split = splitter(memo.v)
    words = [split(t or "") for t in unit["text"].to_pylist()]
    seen: set[str] = set()
    for w in words:
        seen.update(w)
    memo.learn(seen)
    return [b"".join([memo[w] for w in ws]) for ws in words]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    data = b"".join([v.pieces[i] for i in ids.tolist()])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_memos: dict[int, Pieces] = {}


def _memo(shared) -> Pieces:
    v = shared.value
    if id(v) not in _memos:
        _memos.clear()  # a worker keeps the words of one vocabulary
        _memos[id(v)] = Pieces(v)
    return _memos[id(v)]


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared)
        for unit in A.units(batches):
            ids = encode_units(memo, unit)
            values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            off = np.cumsum([0, *(len(b) // 4 for b in ids)])
            yield pa.record_batch([unit["doc_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))], names=["doc_id", "ids"])

    return run


def _digests(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared)
        is_byte = np.zeros(len(memo.v.pieces), bool)
        is_byte[memo.v.byte_ids] = True
        for unit in A.units(batches):
            ids = encode_units(memo, unit)
            arrays = [np.frombuffer(b, "<u4") for b in ids]
            same = [decode(memo.v, a) == (t or "").replace(MARK, " ") for a, t in zip(arrays, unit["text"].to_pylist())]
            yield pa.record_batch([unit["doc_id"].combine_chunks(), pa.array([len(a) for a in arrays], pa.int64()), pa.array([int(is_byte[a].sum()) for a in arrays], pa.int64()), pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return run


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [None if i is None else decode(v, np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    A.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the piece ids of every text. The vocabulary (bounded by its file) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    return _rows(docs).mapInArrow(_encoded(shared), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(shared), "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces and byte pieces, checksum of the ids, and whether they decode to the text, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.sparkContext.broadcast(Vocabulary.load(default_model()))
    return _rows(docs).mapInArrow(_digests(shared), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
