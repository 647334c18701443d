"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, so tokens are those that a model would see. Byte-level tokens
concatenate to the document, so the token spans follow from the tokens' byte lengths; with the
document's character starts they are character spans. Sections (lines by default, or the fields a document
was joined from) are intervals of the same axis. The spans are interval-joined by binary search, and a token over
a boundary is allocated by an explicit rule:

* ``majority``: to the section with most of its bytes, ties to the earlier one;
* ``first``: to the section of its first byte;
* ``proportional``: to each by its share of the bytes (counts are then fractions).

Under each rule a document's sections sum to its number of tokens.

Defined cases: null or empty text is one empty section 0 with no tokens; a section without bytes gets none;
repeated rows are counted each; a text of any length is encoded whole (runs of white space too long for the splitting pattern's stack are
split by rule, with the same tokens); an empty table gives no rows; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _arrays as A

#: Splits a text before merging: letters, digits, other marks (each after one optional blank), contractions, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "first", "proportional")
#: The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space over this length are split without the pattern, which would need a step of its stack for each character.
LONG_RUN = 20_000


class Tokenizer:
    """Byte-level tokens of a rank file, and the byte length of each."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)

    def spans(self, text: str, long_run: int = LONG_RUN) -> np.ndarray:
        """Byte offsets of the tokens; one more than there are tokens."""
        parts, at = [], 0
        for run in re.finditer(f"[{WHITE}]{{{long_run},}}", text):
            # the pattern takes a run as one part, but leaves its last character to what follows
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [self._ids(text[at : run.start()]), np.asarray(self.encoding._encode_single_piece(text[run.start() : end]), np.int64)]
            at = end
        parts.append(self._ids(text[at:]))
        return np.concatenate([[0], np.cumsum(self.length[np.concatenate(parts)])])


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those that touch it cross a boundary of it.

    tokens, sections: offsets that tile the same bytes; sections may be empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n, m = len(tokens) - 1, len(sections) - 1
    counts, crossing = np.zeros(m, np.float64 if rule == "proportional" else np.int64), np.zeros(m, np.int64)
    if n == 0:
        return counts, crossing
    first = np.searchsorted(sections, tokens[:-1], "right") - 1
    last = np.searchsorted(sections, tokens[1:], "left") - 1
    whole = first == last
    np.add.at(counts, first[whole], 1)
    for t in np.flatnonzero(~whole).tolist():  # few: those over a boundary
        k = np.arange(first[t], last[t] + 1)
        share = np.minimum(sections[k + 1], tokens[t + 1]) - np.maximum(sections[k], tokens[t])
        crossing[k[share > 0]] += 1
        if rule == "proportional":
            counts[k] += share / share.sum()
        else:
            counts[k[0] if rule == "first" else k[int(np.argmax(share))]] += 1
    return counts, crossing


_tokenizers: dict[str, Tokenizer] = {}


def _lines(x: np.ndarray) -> np.ndarray:
    """Offsets of the lines of a text, each with its line end."""
    breaks = np.flatnonzero(x == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(x)], [len(x)]])


def _counted(path: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or Tokenizer(path)
        _tokenizers[path] = tokenizer
        for unit in A.units(batches):
            x, off = A.text_bytes(unit["text"])
            parts: list[list] = [[], [], [], [], [], [], []]
            ends = unit["section_ends"].to_pylist() if given else [None] * unit.num_rows
            for i, (doc, text) in enumerate(zip(unit["doc_id"].to_pylist(), unit["text"].to_pylist())):
                b = x[off[i] : off[i + 1]]
                chars = np.zeros(len(b) + 1, np.int64)
                np.cumsum((b & 0xC0) != 0x80, out=chars[1:])
                if ends[i] is None:
                    sections = _lines(b)
                else:  # ends are in characters
                    sections = np.concatenate([[0], np.searchsorted(chars, np.minimum(np.maximum.accumulate(np.array(ends[i], np.int64)), chars[-1]), "left")])
                    sections[-1] = len(b)
                counts, crossing = attribute(tokenizer.spans(text) if text else np.zeros(1, np.int64), sections, rule)
                m = len(counts)
                for part, v in zip(parts, (np.full(m, -1 if doc is None else doc), np.full(m, doc is None), np.arange(m), chars[sections[:-1]], chars[sections[1:]], counts.astype(np.float64), crossing)):
                    part.append(v)
            doc, null, section, start, end, counts, crossing = (np.concatenate(p) for p in parts)
            yield pa.record_batch([pa.array(doc, pa.int64(), mask=null), pa.array(section, pa.int32()), pa.array(start), pa.array(end), pa.array(counts), pa.array(crossing)], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return run


_OUT = "doc_id long, section int, start_char long, end_char long, n_tokens double, n_crossing long"


def count_sections(docs: DataFrame, path: str, rule: str = "majority", section_ends: str | None = None) -> DataFrame:
    """One row for each section of every document.

    Sections are lines, or those of the named column (array of character offsets, ascending; the last
    section always reaches the text's end).
    """
    A.tune(docs.sparkSession)
    given = [F.col(section_ends).alias("section_ends")] if section_ends else []
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *given)
    out = rows.mapInArrow(_counted(path, rule, bool(given)), _OUT)
    return out if rule == "proportional" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def join_fields(fields: list[Column], separator: str = "\n") -> tuple[Column, Column]:
    """The text of several fields and its ``section_ends``: each field with the separator after it is a section; null is empty."""
    parts = [F.concat(F.coalesce(f.cast("string"), F.lit("")), F.lit(separator if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    ends, total = [], F.lit(0).cast("long")
    for p in parts:
        total = total + F.char_length(p)
        ends.append(total)
    return F.concat(*parts), F.array(*ends)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, by the majority rule."""
    return count_sections(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
