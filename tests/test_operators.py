"""Closed-form fixtures, defined corner cases, and properties of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.operators import group, join, order, perm, scan, share, sort
from tessera.operators.filter import where
from tessera.operators.join import JoinSpec
from tessera.plans.gates import Builder, Gate, Op, compile_gates, literal
from tessera.plans.schema import ColumnInfo, Kind, Schema
from tessera.plans.table import ACTIVE, ROW_ID, FlagTable
from tessera.sources import binary_format, tables, text_format

INT, BOOL, STR, BIN = Kind.INT, Kind.BOOLEAN, Kind.STRING, Kind.BIN


def make(spark, rows, *columns, active=None):
    return FlagTable.from_rows(spark, rows, Schema.of(*columns), active)


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("key_bits", [9, 100])
@pytest.mark.parametrize("compact", [True, False])
def test_join_small_keys(spark, key_bits, compact):
    num = __import__("decimal").Decimal if key_bits > 64 else int
    left = make(spark, [(num(3 * i), i % 4 + 256 * (i % 3)) for i in range(11)], ("L1", INT, key_bits), ("L2", INT, 16))
    right = make(spark, [(num(4 * (i // 2)), i % 3) for i in range(8)], ("R1", INT, key_bits), ("R2", INT, 7))
    out = join.om_join(left, right, JoinSpec("L1", "R1", (("l", "L1"), ("r", "R2"), ("l", "L2"))), compact=compact)
    assert values(out.compact()) == [(0, 0, 0), (0, 1, 0), (12, 0, 256), (12, 1, 256)]
    if not compact:
        assert out.df.count() == 8
        assert values(out.df.where(~F.col(ACTIVE)).select("L1", "R2", "L2")) == sorted((0, i % 3, 0) for i in (2, 3, 4, 5))


def test_join_many_rows(spark):
    left = make(spark, [(i, i % 4) for i in range(20)], ("L1", INT, 9), ("L2", INT, 8))
    right = make(spark, [(2 * i, i % 3) for i in range(29)], ("R1", INT, 9), ("R2", INT, 7))
    out = join.om_join(left, right, JoinSpec("L1", "R1", (("r", "R1"), ("r", "R2"), ("l", "L2"))))
    assert values(out.compact()) == [(k, (k // 2) % 3, k % 4) for k in range(0, 20, 2)]


def test_join_duplicate_left_keys(spark):
    left = make(spark, [(1, 10), (1, 20), (2, 30)], ("k", INT, 8), ("v", INT, 8))
    right = make(spark, [(1,), (2,), (3,)], ("r", INT, 8))
    spec = JoinSpec("k", "r", (("r", "r"), ("l", "v")))
    assert values(join.om_join(left, right, spec).padded()) == [(1, 10, 1), (2, 30, 1), (3, 0, 0)]
    with pytest.raises(Exception, match="duplicate key"):
        join.om_join(left, right, spec, left_keys="check").compact().collect()
    assert values(join.duplicate_keys(left, "k")) == [(1, 2)]


def test_join_activity(spark):
    left = make(spark, [(1, 10), (2, 20)], ("k", INT, 8), ("v", INT, 8), active=[False, True])
    right = make(spark, [(1,), (2,), (2,)], ("r", INT, 8), active=[True, True, False])
    spec = JoinSpec("k", "r", (("r", "r"), ("l", "v")))
    assert values(join.om_join(left, right, spec).padded()) == [(1, 0, 0), (2, 0, 0), (2, 20, 1)]
    assert values(join.om_join(left, right, spec, ignore_active=True).compact()) == [(1, 10), (2, 20), (2, 20)]


def test_join_rejects(spark):
    left = make(spark, [(1,)], ("k", INT, 8))
    right = make(spark, [("a",)], ("r", STR, 8))
    with pytest.raises(TypeError):
        join.om_join(left, right, JoinSpec("k", "r", (("l", "k"),)))
    with pytest.raises(KeyError):
        join.om_join(left, left, JoinSpec("k", "k", (("l", "x"),)))


def test_semi_anti_union_outer(spark):
    left = make(spark, [(1, 5), (3, 6)], ("k", INT, 8), ("v", INT, 8))
    right = make(spark, [(1, 7), (2, 8)], ("r", INT, 8), ("w", INT, 8))
    assert values(join.semi_join(right, left, "r", "k").compact()) == [(1, 7)]
    assert values(join.anti_join(right, left, "r", "k").compact()) == [(2, 8)]
    u = join.right_union(left, right, "k", "r", [("k", "r"), ("v", "w")])
    assert values(u.compact()) == [(1, 5), (2, 8), (3, 6)]
    assert u.df.select(ROW_ID).distinct().count() == 3
    spec = JoinSpec("k", "r", (("r", "r"), ("l", "v")))
    assert {tuple(x) for x in join.right_outer_join(left, right, spec).collect()} == {(1, 5), (2, None)}
    with pytest.raises(Exception, match="duplicate key"):
        join.one_to_one(left, make(spark, [(1, 1), (1, 2)], ("r", INT, 8), ("w", INT, 8)), spec, compact=True).compact().collect()


def test_group_fixture(spark):
    t = make(spark, [(i % 5, 257 * (i % 4), 257 * (i % 4)) for i in range(10)], ("L1", INT, 12), ("L2", INT, 16), ("L3", INT, 16))
    expected = [(0, 257, 257, 2), (1, 771, 771, 2), (2, 1285, 1285, 2), (3, 771, 771, 2), (4, 257, 257, 2)]
    assert values(group.group_sum(t, "L1", ["L2", "L3"]).compact()) == expected
    padded = group.group_sum(t, "L1", ["L2", "L3"], compact=False)
    assert values(padded.compact()) == expected
    assert [r[0] for r in padded.df.orderBy(ROW_ID).select(ACTIVE).collect()] == [True] * 5 + [False] * 5


def test_group_activity_and_wrap(spark):
    t = make(spark, [(1, 100), (1, 100), (1, 7), (2, 5)], ("k", INT, 8), ("v", INT, 8), active=[True, True, False, True])
    assert values(group.group_sum(t, "k", ["v"]).compact()) == [(1, 200, 2), (2, 5, 1)]
    assert values(group.group_sum(t, "k", ["v"], include_inactive=True).compact()) == [(1, 207, 3), (2, 5, 1)]
    assert values(group.group_sum(t, "k", ["v"], wrap_rule="declared").compact()) == [(1, -56, 2), (2, 5, 1)]
    assert values(group.group_sum(t, "k", ["v"], compact=False, wrap_rule="bytes").compact()) == [(1, -56, 2), (2, 5, 1)]
    assert values(group.group_average(t, "k", ["v"])) == [(1, 100.0), (2, 5.0)]
    assert values(group.group_sum(t, "k", ["v"], reduce="max").compact()) == [(1, 100, 2), (2, 5, 1)]
    assert values(group.first_of_group(t, "k").compact()) == [(1, 100), (2, 5)]


def test_group_wrap_at_64_bits(spark):
    t = make(spark, [(1, 2**63 - 1), (1, 1)], ("k", INT, 8), ("v", INT, 64))
    assert values(group.group_sum(t, "k", ["v"], wrap_rule="declared").compact()) == [(1, -(2**63), 2)]


def test_mixed_filter_fixture(spark):
    words = ["hello world", "goodbye world", "what world"]
    t = make(spark, [(i, words[i % 3]) for i in range(20)], ("idx", INT, 16), ("str", STR, 256))
    bit = lambda i: B.bit(F.col("idx"), i) == 1
    pred = ((F.col("str") == words[0]) | (F.col("str") == words[1])) & (bit(0) != bit(1))
    assert [r[0] for r in where(t, pred).extract().df.orderBy(ROW_ID).select("idx").collect()] == [1, 6, 9, 10, 13, 18]


@pytest.mark.parametrize("op", [Op.EQUALS, Op.AND, Op.OR, Op.NOT_EQUALS, Op.XOR])
def test_boolean_gates(spark, op):
    rows = list(itertools.product([False, True], repeat=2))
    t = make(spark, rows, ("b0", BOOL, 1), ("b1", BOOL, 1))
    truth = {Op.EQUALS: lambda a, b: a == b, Op.NOT_EQUALS: lambda a, b: a != b, Op.XOR: lambda a, b: a != b, Op.AND: lambda a, b: a and b, Op.OR: lambda a, b: a or b}[op]
    lits = ["0", "1", "false", "true"]
    for i, j in itertools.product(range(6), repeat=2):
        pred = compile_gates(t.schema, [Gate(op, i, j, 6)], ["b0", "b1"], lits, [BOOL] * 4)
        slot = lambda r, k: (*r, False, True, False, True)[k]
        assert values(where(t, pred).compact()) == sorted(r for r in rows if truth(slot(r, i), slot(r, j)))


@pytest.mark.parametrize("op", [Op.EQUALS, Op.NOT_EQUALS, Op.LESS_THAN, Op.GREATER_THAN_EQUALS])
def test_int_predicates(spark, op):
    r = random.Random(1)
    rows = [(r.randrange(-(2**15), 2**15), r.randrange(-128, 128)) for _ in range(30)] + [(-64, 64), (64, -64), (5, 5)]
    t = make(spark, rows, ("int0", INT, 16), ("int1", INT, 8))
    f = {Op.EQUALS: lambda a, b: a == b, Op.NOT_EQUALS: lambda a, b: a != b, Op.LESS_THAN: lambda a, b: a < b, Op.GREATER_THAN_EQUALS: lambda a, b: a >= b}[op]
    for i, j in itertools.permutations(range(4), 2):
        pred = compile_gates(t.schema, [Gate(op, i, j, 4)], ["int0", "int1"], ["-64", "64"], [INT, INT])
        assert values(where(t, pred).compact()) == sorted(x for x in rows if f((*x, -64, 64)[i], (*x, -64, 64)[j]))


def test_int_addition_wraps_at_the_wider_operand(spark):
    rows = [(a, b) for a in (32767, -32768, 0, 100) for b in (127, -128, 1)]
    t = make(spark, rows, ("a", INT, 16), ("b", INT, 8))
    pred = compile_gates(t.schema, [Gate(Op.ADDITION, 0, 1, 2), Gate(Op.GREATER_THAN_EQUALS, 2, 1, 3)], ["a", "b"])
    wrap = lambda v: (v + 2**15) % 2**16 - 2**15
    assert values(where(t, pred).compact()) == sorted((a, b) for a, b in rows if wrap(a + b) >= b)


def test_gate_errors(spark):
    t = make(spark, [(1, "a")], ("i", INT, 8), ("s", STR, 8))
    for gates, error in [([Gate(Op.LESS_THAN, 0, 1, 2)], TypeError), ([Gate(Op.EQUALS, 0, 0, 5)], ValueError), ([Gate(Op.ADDITION, 0, 0, 2)], TypeError), ([], ValueError), ([Gate(Op.AND, 0, 0, 2)], TypeError)]:
        with pytest.raises(error):
            compile_gates(t.schema, gates, ["i", "s"])
    with pytest.raises(KeyError):
        compile_gates(t.schema, [Gate(Op.EQUALS, 0, 0, 1)], ["x"])
    with pytest.raises(ValueError):
        literal("yes", BOOL)
    assert literal("-64", INT).bits == 7 and literal("64", INT).bits == 8 and literal("0aff", BIN).bits == 16


def test_string_and_bin_gates(spark):
    rows = [("hello world", b"\x01"), ("goodbye world", b"\x02"), ("", b"\x01")]
    t = make(spark, rows, ("s", STR, 128), ("b", BIN, 8))
    b = Builder(t.schema, "s", "b")
    b.gate(Op.OR, b.gate(Op.EQUALS, b.col("s"), b.lit("hello world", STR)), b.gate(Op.NOT_EQUALS, b.col("b"), b.lit("01", BIN)))
    assert [r[0] for r in where(t, b).compact().orderBy("s").collect()] == ["goodbye world", "hello world"]


@pytest.mark.parametrize("n,bits", [(64, 2), (64, 7), (6, 8), (100, 17)])
def test_sort_is_stable_and_inverse(spark, n, bits):
    r = random.Random(n + bits)
    keys = [r.randrange(-(2 ** (bits - 1)), 2 ** (bits - 1)) for _ in range(n)]
    t = make(spark, [(k,) for k in keys], ("k", INT, bits))
    by = sorted(range(n), key=lambda i: (keys[i] % 2**bits, i))
    fwd, inv = sort.sort_permutation(t, ["k"]), sort.sort_permutation(t, ["k"], inverse=True)
    assert [x["pi"] for x in fwd.orderBy("i").collect()] == by
    assert values(perm.compose(fwd, inv)) == [(i, i) for i in range(n)]
    assert perm.is_permutation(fwd)
    radix = sort.radix_sort(t.df, "k", bits, ROW_ID, 4).select("pos", "k").orderBy("pos").collect()
    assert [x["k"] for x in radix] == [keys[i] for i in by]


def test_sort_table_and_strings(spark):
    rows = [("ab", 2), ("b", 1), ("ab", 1), ("ba", 0)]
    t = make(spark, rows, ("s", STR, 16), ("k", INT, 8))
    assert [tuple(r) for r in sort.sort_table(t).df.orderBy(ROW_ID).select("s", "k").collect()] == [("b", 1), ("ba", 0), ("ab", 1), ("ab", 2)]
    assert [r["s"] for r in sort.sort_table(t, "natural").df.orderBy(ROW_ID).collect()] == ["ab", "ab", "b", "ba"]


@pytest.mark.parametrize("direction", scan.DIRECTIONS)
@pytest.mark.parametrize("op", ["dup", "xor", "add"])
def test_segmented_scans(spark, direction, op):
    r = random.Random(5)
    data = [(i, r.randrange(2**31), 0 if i == 0 else r.randrange(2)) for i in range(343)]
    df = spark.createDataFrame(data, "i long, v long, c int")
    got = [x["y"] for x in scan.bit_segments_scan(df, F.col("c"), "i", F.col("v"), op, direction).orderBy("i").collect()]
    f = {"dup": lambda vs: vs[0], "xor": lambda vs: __import__("functools").reduce(int.__xor__, vs), "add": sum}[op]
    segments, expected = [], []
    for _, v, c in data:
        segments.append([v]) if c == 0 else segments[-1].append(v)
    for s in segments:
        expected += [f(s[: k + 1]) if direction == "prefix" else f(s[k:]) if direction == "suffix" else f(s) for k in range(len(s))]
    assert got == expected


def test_custom_scan_and_control_bits(spark):
    df = spark.createDataFrame([(0, "a", 3), (1, "a", 5), (2, "b", 2), (3, "a", 1)], "i long, k string, v long")
    got = scan.segmented_scan(df, "k", "i", F.col("v"), lambda a, b: a * 10 + b).orderBy("i").collect()
    assert [r["y"] for r in got] == [3, 35, 2, 351]
    assert [r["c"] for r in scan.control_bits(df, "k", "i").orderBy("i").collect()] == [0, 1, 0, 1]


def test_running_sum_of_nothing(spark):
    df = spark.createDataFrame([], "i long, v long")
    assert order.running_sum(df, F.col("v"), ["i"], "s").count() == 0
    assert order.positions(df, ["i"]).count() == 0


def test_permutations(spark):
    p, q = perm.random(spark, 100, 1), perm.random(spark, 100, 2)
    data = spark.range(100).selectExpr("id as i", "id * 7 as v")
    assert perm.is_permutation(p) and perm.is_permutation(perm.identity(spark, 5))
    assert not perm.is_permutation(spark.createDataFrame([(0, 0), (1, 0)], "i long, pi long"))
    assert values(perm.apply(p, perm.apply(p, data, inverted=True))) == values(data)
    assert values(perm.apply(perm.inverse(p), data)) == values(perm.apply(p, data, inverted=True))
    assert values(perm.apply(perm.compose(p, q), data)) == values(perm.apply(p, perm.apply(q, data)))
    assert values(perm.apply_shared(p, q, perm.apply_shared(p, q, data), inverted=True)) == values(data)
    t = make(spark, [(10,), (20,), (30,)], ("v", INT, 8), active=[True, False, True])
    rot = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "i long, pi long")
    assert [(r["v"], r[ACTIVE]) for r in t.permute(rot).df.orderBy(ROW_ID).collect()] == [(20, False), (30, True), (10, True)]
    assert t.permute(rot).permute(rot, inverse=True).equals(t)


def test_share_reveal(spark):
    rows = [(i - 5, i % 2 == 0, "héllo"[: i % 6], bytes([i, 255 - i])) for i in range(12)]
    t = make(spark, rows, ("i", INT, 64), ("b", BOOL, 1), ("s", STR, 64), ("n", BIN, 16), active=[i % 3 > 0 for i in range(12)])
    a, b = share.share(t, 4)
    back = share.reveal(a, b, t, remove_inactive=False)
    assert back.equals(t) and values(back.df.select(ROW_ID, ACTIVE)) == values(t.df.select(ROW_ID, ACTIVE))
    assert share.reveal(a, b, t).df.count() == 8
    assert values(a.select("i")) != values(t.df.select("i"))


def test_bits(spark):
    df = spark.createDataFrame([(i,) for i in (-(2**63), -1, 0, 1, 5, 127, 128, 255, 2**63 - 1)], "v long")
    row = lambda c: [r[0] for r in df.select(c).collect()]
    vs = [r[0] for r in df.collect()]
    for bits in (8, 16, 62, 63, 64):
        expect = [(v + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1) for v in vs]
        assert row(B.wrap(F.col("v"), bits)) == expect
        assert row(B.sign_extend(F.col("v"), bits)) == expect
        assert [int(x) for x in row(B.unsigned(F.col("v"), bits))] == [v % (1 << bits) for v in vs]
    assert row(B.is_zero(F.col("v"), 7)) == [int(v % 128 == 0) for v in vs]
    assert row(B.bit_count(F.col("v"))) == [bin(v % 2**64).count("1") for v in vs]
    m = 2**64
    truth = {"a": lambda a, b: a, "and": lambda a, b: a & b, "nand": lambda a, b: ~(a & b), "or": lambda a, b: a | b, "nor": lambda a, b: ~(a | b), "na_and": lambda a, b: ~a & b, "nb_and": lambda a, b: a & ~b, "nb_or": lambda a, b: a | ~b, "xor": lambda a, b: a ^ b, "nxor": lambda a, b: ~(a ^ b)}
    for name, f in truth.items():
        assert [x % m for x in row(B.circuit([(name, 0, 1)], [F.col("v"), F.lit(77)])[-1])] == [f(v, 77) % m for v in vs]
    n = 7
    i = spark.range(n)
    pairs = i.select("id", B.unshuffle_index(B.shuffle_index(F.col("id"), n), n).alias("b")).collect()
    assert all(r["id"] == r["b"] for r in pairs)
    assert values(i.select(B.shuffle_index(F.col("id"), n))) == [(k,) for k in range(n)]
    assert {r[0] for r in i.select(B.mod3_sample(1, F.col("id"))).collect()} <= {0, 1, 2}
    assert df.select(B.from_hex(B.to_hex(F.lit(b"\x0a\xff")))).first()[0] == b"\x0a\xff"


def _formats(spark):
    rows = [(i * 17 % 251 - 100, "ab c"[: i % 5], i % 2 == 1, bytes(range(i, i + 8))) for i in range(10)]
    return make(spark, rows, ("a", INT, 16), ("s", STR, 64), ("b", BOOL, 1), ("n", BIN, 64))


def test_text_format(spark, tmp_path):
    t = _formats(spark)
    text_format.write(t, str(tmp_path / "t"))
    back = text_format.read(spark, str(tmp_path / "t"))
    masked = t.with_df(t.df.withColumn("a", B.unsigned(F.col("a"), 16)))  # a narrow negative number comes back unsigned
    assert back.equals(masked)
    first = sorted((tmp_path / "t").glob("part-*"))[0].read_text().splitlines()
    assert first[:2] == ["4 10", "a 0 16"]
    with pytest.raises(Exception, match="semicolon"):
        text_format.write(make(spark, [("a;b",)], ("s", STR, 64)), str(tmp_path / "x"))
    s = Schema.of(("a", INT, 8), ("b", BOOL, 1))
    assert text_format.parse_line(s, "5 1 ") == [5, True]
    for bad in ("05 1 ", "5 2 ", "999 1 ", "5 1 x"):
        with pytest.raises(ValueError):
            text_format.parse_line(s, bad)


def test_binary_format(spark, tmp_path):
    t = _formats(spark)
    path = str(tmp_path / "t.bin")
    binary_format.write(t, path)
    back = binary_format.read(spark, f"file://{path}")
    assert back.equals(t.with_df(t.df.withColumn("a", B.unsigned(F.col("a"), 16))))
    data = open(path, "rb").read()
    assert len(data) == 16 + sum(17 + len(n) for n in t.schema.names) + 10 * (2 + 8 + 1 + 8)
    with pytest.raises(ValueError):
        list(binary_format.decode_rows(data[:-1]))


def test_parquet_round_trip(spark, tmp_path):
    t = _formats(spark)
    tables.save(t, str(tmp_path / "p"))
    back = tables.load(spark, str(tmp_path / "p"))
    assert back.equals(t) and back.schema == t.schema


def test_tables(spark):
    t = make(spark, [(1, True), (2, False), (3, True)], ("a", INT, 8), ("b", BOOL, 1), active=[True, False, True])
    assert (t.rows(), t.cols(), t.schema.names) == (3, 2, ["a", "b"])
    assert [r["a"] for r in t.resize(5).df.orderBy(ROW_ID).collect()] == [1, 2, 3, 0, 0]
    assert [r["a"] for r in t.resize(2).df.orderBy(ROW_ID).collect()] == [1, 2]
    assert values(t.extract().df.select(ROW_ID, "a")) == [(0, 1), (2, 3)]
    assert values(t.extract_shuffled(3).compact()) == [(1, True), (3, True)]
    assert t.unzip_columns(t.zip_columns()).equals(t)
    assert values(FlagTable.zeros(spark, 2, t.schema).padded()) == [(0, False, 1)] * 2
    assert not t.equals(t.resize(2))
    with pytest.raises(ValueError):
        Schema.of(("a", INT, 8), ("a", INT, 8))
    with pytest.raises(ValueError):
        ColumnInfo("s", STR, 7)
    empty = t.with_df(t.df.where("a > 9"))
    assert empty.extract().rows() == 0


def test_padded_and_compact_agree(spark):
    r = random.Random(9)
    t = make(spark, [(r.randrange(6), r.randrange(100)) for _ in range(80)], ("k", INT, 8), ("v", INT, 8), active=[r.random() < 0.7 for _ in range(80)])
    pred = F.col("v") > 40
    assert values(where(t, pred).compact()) == values(where(t, pred, compact=True).compact())
    assert values(group.group_sum(t, "k", ["v"]).compact()) == values(group.group_sum(t, "k", ["v"], compact=False).compact())


def test_prefix_sum_of_a_hot_key(spark):
    data = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", i % 11 - 5) for i in range(400)]
    df = spark.createDataFrame(data, "i long, k string, v long")
    got = {r["i"]: r["y"] for r in scan.segmented_scan(df, "k", "i", F.col("v")).collect()}
    expected, sums = {}, {}
    for i, k, v in data:
        sums[k] = expected[i] = sums.get(k, 0) + v
    assert got == expected


def test_scans_of_segments_over_many_ranges(spark):
    """Every operator and direction, with one key that fills most ranges, against a plain loop."""
    r = random.Random(5)
    data = [(i, "hot" if r.random() < 0.8 else f"k{r.randrange(4)}", r.randrange(1, 100)) for i in range(300)]
    df = spark.createDataFrame(data, "i long, k string, v long")
    plain = {"add": lambda a, b: a + b, "xor": lambda a, b: a ^ b, "min": min, "max": max, "dup": lambda a, b: a}
    for op, f in plain.items():
        for direction in scan.DIRECTIONS:
            got = {x["i"]: x["y"] for x in scan.segmented_scan(df, "k", "i", F.col("v"), op, direction).collect()}
            for i, k, _ in data:
                own = [v for j, key, v in data if key == k and (direction == "full" or (j <= i if direction == "prefix" else j >= i))]
                y = own[0]
                for v in own[1:]:
                    y = f(y, v)
                assert got[i] == y, (op, direction, i)
    got = {x["i"]: x["y"] for x in scan.segmented_scan(df, "k", "i", F.col("v"), lambda a, b: F.greatest(a, b), "prefix").collect()}
    assert got == {x["i"]: x["y"] for x in scan.segmented_scan(df, "k", "i", F.col("v"), "max", "prefix").collect()}


def test_row_ranges_and_words(spark):
    t = make(spark, [(k,) for k in range(10)], ("v", INT, 8))
    assert [x[0] for x in values(t.rows_between(3, 4).compact())] == [3, 4, 5, 6] and t.rows_between(8).rows() == 2
    for first, count in ((10, 1), (8, 3), (-1, 2)):
        with pytest.raises(ValueError):
            t.rows_between(first, count)
    with pytest.raises(ValueError):
        t.reshape("v", 9)
    data = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\xff\x00"),), (bytearray(),)], "d binary")
    got = data.select(B.to_words(F.col("d"), 2), B.from_words(B.to_words(F.col("d"), 2), 2)).collect()
    assert got[0][0] == [0x0201, 0x0403, 0x00FF] and bytes(got[0][1]) == b"\x01\x02\x03\x04\xff\x00" and got[1][0] == []
    with pytest.raises(Exception, match="multiple of 4"):
        data.select(B.to_words(F.col("d"), 4)).collect()


def test_equality_across_kinds_pads_by_sign_or_zeros(spark):
    t = make(spark, [(-1, "a", True), (97, "a\0", False)], ("n", INT, 16), ("s", STR, 24), ("b", BOOL, 1))

    def equal(a, text, kind):
        b = Builder(t.schema, *t.schema.names)
        b.gate(Op.EQUALS, b.col(a), b.lit(text, kind))
        return [x[0] for x in t.df.orderBy("__row_id").select(b.compile()).collect()]

    assert equal("n", "ffff", Kind.BIN) == [True, False] and equal("n", "61", Kind.BIN) == [False, True] and equal("n", "ff", Kind.BIN) == [False, False]
    assert equal("n", "ffffffffffffffffffff", Kind.BIN) == [True, False]  # a sign fills up any width
    assert equal("s", "61", Kind.BIN) == [True, True] and equal("s", "97", INT) == [True, True] and equal("b", "1", INT) == [True, False]


def test_show_prints_rows(spark, capsys):
    make(spark, [(5,), (6,)], ("v", INT, 8), active=[True, False]).show()
    out = capsys.readouterr().out
    assert "is_active" in out and "|5" in out.replace(" ", "") and "|0" in out.replace(" ", "")


def test_union_keeps_ids_of_both_sides(spark):
    big = (1 << 62) + 5
    rows = spark.createDataFrame([(1, big), (2, big + 1)], "k long, r long")
    t = FlagTable.of(rows, "r", schema=Schema.of(("k", INT, 64)))
    out = join.right_union(t, t.with_df(t.df.withColumn("k", F.col("k") + 1)), "k", "k", [("k", "k")])
    assert sorted(x[0] for x in values(out.compact())) == [1, 2, 3] and out.df.select("__row_id").distinct().count() == 3
