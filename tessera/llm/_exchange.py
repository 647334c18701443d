"""Which content names are shared: a packed exchange between units of documents and parts of the name space.

Every unit sends the names it holds once for each document, in one row for each part; a part sees all units' rows,
finds names held by two different texts, and answers each unit; the answers become one row for each document.
A name that is already known to be shared inside a unit is answered there and sent on once,
so a part gets at most one row's entry from each unit for a name in however many documents it occurs.
Rows are blobs of arrays, so the shuffle moves 8 to 20 bytes for a name.

With more than ``FAN`` parts a unit's row for one part would hold few names. Then a unit sends to ``FAN`` groups of parts, and what
``GROUP`` units sent to one of those is merged there (names found to be shared are answered and sent on once again) and dealt to its
parts; answers go back the same way. So rows stay packed, and a frequent name thins out, at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _arrays as A

NULL_ID = 2**63 - 1
#: Bits of a name that travel: a false match is found out where strings or words are compared.
SHORT = np.uint64(2**64 - 2**16)
#: Parts that a unit sends to; units whose rows are merged where parts are more.
FAN, GROUP = 2048, 1024
_BLOB = "ids binary, texts binary, units binary, owners binary, names binary, known binary"
_ROW = f"part long, team long, answered boolean, {_BLOB}"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 6]
_NAMES = [f.split()[0] for f in _ROW.split(", ")]


def digest(text: Column) -> Column:
    """128 bits of the SHA-256 of a text: texts with equal digests are taken for equal."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def keyed(docs: DataFrame) -> DataFrame:
    """dk (the doc_id; null counts as the largest), th (the digest of the text) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk"), digest(text).alias("th"), text.alias("text"))


def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with equal dk and th in a task, the first."""
    seen: set[tuple[int, bytes]] = set()
    for b in batches:
        keep = []
        for key in zip(b.column(b.schema.get_field_index("dk")).to_pylist(), b.column(b.schema.get_field_index("th")).to_pylist()):
            keep.append(key not in seen)
            seen.add(key)
        yield b.filter(pa.array(keep, pa.bool_()))


def packed_spans(table: pa.Table) -> pa.Table:
    """The spans (start, n) of each document (dk, th) of a group, packed."""
    dk, start, n = (table[c].to_numpy().astype(np.int64) for c in ("dk", "start", "n"))
    th = np.frombuffer(b"".join(table["th"].to_pylist()), "<u8").reshape(-1, 2)
    order = np.lexsort((start, th[:, 1], th[:, 0], dk))
    dk, th, both = dk[order], th[order], np.column_stack([start, n])[order].astype("<i8")
    head = np.ones(len(dk), bool)
    head[1:] = (dk[1:] != dk[:-1]) | (th[1:] != th[:-1]).any(1)
    cuts = np.append(np.flatnonzero(head), len(dk)).tolist()
    return pa.table([pa.array(dk[head]), pa.array([th[a].tobytes() for a in cuts[:-1]], pa.binary()), pa.array([both[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["dk", "th", "spans"])


def spread_join(rows: DataFrame, found: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """An inner join on a column of which some value may be in very many ``rows`` (dk, start, ...) but in one row of ``found``."""
    salt = F.pmod(F.xxhash64("dk", "start"), F.lit(salts))
    return rows.withColumn("salt", salt).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [on, "salt"]).drop("salt")


class Entries:
    """Names, each with its document: ids, texts (digests) and units of documents, then owner (row there), name and known for each entry."""

    def __init__(self, ids: np.ndarray, texts: np.ndarray, units: np.ndarray, owner: np.ndarray, names: np.ndarray, known: np.ndarray):
        self.ids, self.texts, self.units, self.owner, self.names, self.known = ids, texts, units, owner, names, known

    @staticmethod
    def read(rows: list[dict]) -> Entries:
        parts = []
        base = 0
        for r in rows:
            packed = np.frombuffer(r["names"], np.uint8).reshape(-1, 6)
            names = np.zeros((len(packed), 8), np.uint8)
            names[:, 2:] = packed
            n, docs = len(packed), len(r["ids"]) // 8
            owner = np.frombuffer(r["owners"], "<u2" if len(r["owners"]) == 2 * n else "<u4").astype(np.int64)
            units = np.frombuffer(r["units"], "<i8")
            known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=n).astype(bool)
            parts.append((np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["texts"], "S16"), np.broadcast_to(units, docs) if len(units) == 1 else units, owner + base, names.view("<u8").reshape(-1), known))
            base += docs
        return Entries(*(np.concatenate(c) for c in zip(*parts)))

    def blob(self, pick: np.ndarray, known: np.ndarray) -> tuple[bytes, ...]:
        """Some of the entries, with the documents that hold them."""
        used, local = np.unique(self.owner[pick], return_inverse=True)
        names = np.ascontiguousarray(self.names[pick].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
        units = self.units[used]
        units = units[:1] if len(units) and (units == units[0]).all() else units
        return self.ids[used].astype("<i8").tobytes(), self.texts[used].tobytes(), units.astype("<i8").tobytes(), local.astype("<u2" if len(used) < 2**16 else "<u4").tobytes(), names.tobytes(), np.packbits(known).tobytes()

    def resolve(self, repeats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries whose name is found to be shared here; entries to send on; and whether those are of shared names.

        repeats: a name that one document holds twice counts as shared.
        """
        order = np.lexsort((self.owner, self.names))
        name, owner, known = self.names[order], self.owner[order], self.known[order]
        head = np.ones(len(order), bool)
        head[1:] = name[1:] != name[:-1]
        again = np.zeros(len(order), bool)
        again[1:] = ~head[1:] & (owner[1:] == owner[:-1])
        at, group = np.flatnonzero(head), np.cumsum(head) - 1
        low, high = (np.frombuffer(self.texts.tobytes(), "<u8").reshape(-1, 2)[owner, k] for k in (0, 1))
        differ = np.zeros(len(order), bool)
        differ[1:] = ~head[1:] & ((low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        shared = (np.add.reduceat((differ | known | again if repeats else differ | known).astype(np.int64), at) > 0)[group]
        send = np.where(shared, head, ~again)
        return order[shared & ~again & ~known], order[send], shared[send]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _dealt(entries: Entries, repeats: bool, part_of: Callable[[np.ndarray], np.ndarray], team: int, home: int) -> Iterator[pa.RecordBatch]:
    """Rows of answered entries (for part ``home``), and of entries that are sent on to their parts."""
    answered, send, flags = entries.resolve(repeats)
    out = []
    if len(answered):
        out.append((home, team, True, *entries.blob(answered, np.ones(len(answered), bool))))
    part = part_of(entries.names[send])
    by = np.argsort(part, kind="stable")
    send, flags, part = send[by], flags[by], part[by]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out.append((int(part[a]), team, False, *entries.blob(send[a:b], flags[a:b])))
        if len(out) == 500:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _number(names: np.ndarray, parts: int) -> np.ndarray:
    return ((names >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _send(names_of: Callable, parts: int, each: int, teams: int, repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in A.units(batches):
            names, doc = names_of(unit)
            if not len(names):
                continue
            ids = unit["dk"].to_numpy().astype("<i8")
            texts = np.frombuffer(b"".join(unit["th"].to_pylist()), "S16")
            code = int.from_bytes(hashlib.blake2b(ids.tobytes() + texts.tobytes(), digest_size=8).digest(), "little", signed=True)
            entries = Entries(ids, texts, np.full(len(ids), code), doc, names & SHORT, np.zeros(len(names), bool))
            yield from _dealt(entries, repeats, lambda n: _number(n, parts) // each, code % teams if each > 1 else code, code % -(-parts // each))

    return run


def _merge(parts: int, each: int):
    """Of the rows that a team of units sent to a group of parts: rows for each part."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        group, team = rows[0]["part"], rows[0]["team"]
        out = [_batch([(group * each, team, True, *(r[c] for c in _NAMES[3:]))]) for r in rows if r["answered"]]
        rows = [r for r in rows if not r["answered"]]
        if rows:
            out += _dealt(Entries.read(rows), False, lambda n: _number(n, parts), team, group * each)
        return pa.Table.from_batches(out)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of the rows of one part, those entries whose name is shared."""
    rows = table.to_pylist()
    out = [tuple(r[c] for c in _NAMES) for r in rows if r["answered"]]
    teams: dict[int, list[dict]] = {}
    for r in rows:
        if not r["answered"]:
            teams.setdefault(r["team"], []).append(r)
    if teams:
        entries = Entries.read([r for t in teams.values() for r in t])
        answered, _, _ = entries.resolve(False)
        ends = np.cumsum([sum(len(r["ids"]) // 8 for r in t) for t in teams.values()])
        of = np.searchsorted(ends, entries.owner[answered], "right")
        for i, team in enumerate(teams):
            pick = answered[of == i]
            if len(pick):
                out.append((rows[0]["part"], team, True, *entries.blob(pick, np.ones(len(pick), bool))))
    return pa.Table.from_batches([_batch(out)]) if out else pa.table([pa.array([], k) for k in _KINDS], names=_NAMES)


def _split(table: pa.Table) -> pa.Table:
    """Answers of a team of units, one row for each unit."""
    entries = Entries.read(table.to_pylist())
    units = entries.units[entries.owner]
    order = np.argsort(units, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], units[order][1:] != units[order][:-1], [True]]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        pick = order[a:b]
        out.append((0, int(units[pick[0]]), True, *entries.blob(pick, np.ones(len(pick), bool))))
    return pa.Table.from_batches([_batch(out)])


def _collect(table: pa.Table) -> pa.Table:
    """One row for each document of a unit: all its shared names, ascending."""
    e = Entries.read(table.to_pylist())
    ids, texts, names = e.ids[e.owner], np.frombuffer(e.texts.tobytes(), "<u8").reshape(-1, 2)[e.owner], e.names
    order = np.lexsort((names, texts[:, 1], texts[:, 0], ids))
    ids, texts, names = ids[order], texts[order], names[order]
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]).any(1)
    cuts = np.append(np.flatnonzero(head), len(ids)).tolist()
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.table([pa.array(ids[head]), pa.array([texts[a].tobytes() for a, _ in spans], pa.binary()), pa.array([names[a:b].tobytes() for a, b in spans], pa.binary())], names=["dk", "th", "names"])


def shared_names(rows: DataFrame, names_of: Callable, parts: int, repeats: bool, size: int) -> DataFrame:
    """(dk, th, names): for each document the names of its own (48 bits each) that another text holds too.

    rows: dk, th, text and whatever ``names_of(unit)`` reads; it returns names and the row of the unit that each belongs to. repeats: a
    name that one document holds twice counts as shared. size: bytes of all texts.
    """
    each = max(1, -(-parts // FAN))
    teams = max(1, -(-size // (A.UNIT_BYTES * GROUP)))
    sent = rows.mapInArrow(_send(names_of, parts, each, teams, repeats), _ROW)
    if each > 1:
        sent = sent.groupBy("part", "team").applyInArrow(_merge(parts, each), _ROW)
    answers = sent.groupBy("part").applyInArrow(_answer, _ROW)
    if each > 1:  # a row of answers is of a team, not of a unit
        answers = answers.withColumn("part", F.floor(F.col("part") / each))
        answers = answers.groupBy("part", "team").applyInArrow(_split, _ROW)
    return answers.groupBy(F.col("team").alias("unit")).applyInArrow(_collect, "dk long, th binary, names binary").groupBy("dk", "th").agg(F.first("names").alias("names"))
