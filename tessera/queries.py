"""The query catalogue of the flag-carrying tables: each query through its operator, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import bits as B
from tessera.operators import group, join, order, perm, scan, share, sort
from tessera.operators.filter import where
from tessera.operators.join import JoinSpec
from tessera.plans.gates import Builder, Op
from tessera.plans.schema import ColumnInfo, Kind, Schema
from tessera.plans.table import ACTIVE, ROW_ID, FlagTable, difference
from tessera.sources import binary_format, text_format
from tessera.sources.tables import read_table, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# tables

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def orders(s: SparkSession, d: str, *columns: str) -> FlagTable:
    return FlagTable.of(read_table(s, d, "orders").select("o_orderkey", *columns), "o_orderkey")


def customer(s: SparkSession, d: str, *columns: str) -> FlagTable:
    return FlagTable.of(read_table(s, d, "customer").select("c_custkey", *columns), "c_custkey")


def part(s: SparkSession, d: str, *columns: str, schema: Schema | None = None) -> FlagTable:
    return FlagTable.of(read_table(s, d, "part").select("p_partkey", *columns), "p_partkey", schema=schema)


def lineitem(s: SparkSession, d: str, *columns: str) -> FlagTable:
    """Line items under a composite id: (order, line) repeats, with part and supplier it doesn't."""
    raw = read_table(s, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    return FlagTable.of(raw, LINE_ID, schema=Schema.from_struct(raw.select(*columns).schema))


def select(kind: str, names: list[str]) -> tuple[tuple[str, str], ...]:
    return tuple(zip(kind, names))


# projection and joins


@query("SELECT o_orderkey, o_custkey FROM orders")
def scan_project(s, d):
    return orders(s, d, "o_custkey").compact()


@query("SELECT o_orderkey, COALESCE(c_custkey,0) AS c_custkey, COALESCE(c_nationkey,0) AS c_nationkey, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS is_active FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey")
def om_join_padded(s, d):
    left = where(customer(s, d, "c_nationkey"), "c_custkey % 2 = 0", compact=True)
    spec = JoinSpec("c_custkey", "o_custkey", select("rll", ["o_orderkey", "c_custkey", "c_nationkey"]))
    return join.om_join(left, orders(s, d, "o_custkey"), spec, left_keys="assume").padded()


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0")
def om_join_compact(s, d):
    left = where(orders(s, d, "o_custkey"), "o_orderkey % 3 = 0", compact=True)
    spec = JoinSpec("o_orderkey", "l_orderkey", select("rrl", ["l_orderkey", "l_linenumber", "o_custkey"]))
    return join.om_join(left, lineitem(s, d, "l_orderkey", "l_linenumber"), spec, compact=True, left_keys="assume").compact()


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def om_join_key_check(s, d):
    return join.duplicate_keys(orders(s, d, "o_custkey"), "o_custkey")


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderkey % 2 = 0")
def join_respects_active(s, d):
    raw = read_table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    left = FlagTable.of(raw, "c_custkey", F.col("c_acctbal") > 0, Schema.from_struct(raw.drop("c_acctbal").schema))
    right = where(orders(s, d, "o_custkey"), "o_orderkey % 2 = 0")
    return join.om_join(left, right, JoinSpec("c_custkey", "o_custkey", select("rl", ["o_orderkey", "c_nationkey"])), left_keys="assume").compact()


@query("SELECT c_custkey, COALESCE(f.k, 0) AS o_orderkey, CASE WHEN f.k IS NULL THEN 0 ELSE 1 END AS is_active FROM customer LEFT JOIN (SELECT o_custkey, MIN(o_orderkey) AS k FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey) f ON c_custkey = f.o_custkey")
def om_join_first_left(s, d):
    left = where(orders(s, d, "o_custkey"), "o_orderkey % 5 = 0", compact=True)
    return join.om_join(left, customer(s, d), JoinSpec("o_custkey", "c_custkey", select("rl", ["c_custkey", "o_orderkey"]))).padded()


@query("SELECT c_custkey, c_nationkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, MIN(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) f ON c_custkey = o_custkey")
def join_right_outer(s, d):
    spec = JoinSpec("o_custkey", "c_custkey", select("rrl", ["c_custkey", "c_nationkey", "o_orderkey"]))
    return join.right_outer_join(orders(s, d, "o_custkey"), customer(s, d, "c_nationkey"), spec)


@query("SELECT o_orderkey, COALESCE(c_nationkey, 0) AS c_nationkey, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS is_active FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 1) c ON o_custkey = c_custkey")
def join_left(s, d):
    right = where(customer(s, d, "c_nationkey"), "c_custkey % 4 = 1", compact=True)
    return join.left_join(orders(s, d, "o_custkey"), right, JoinSpec("o_custkey", "c_custkey", select("lr", ["o_orderkey", "c_nationkey"]))).padded()


@query("SELECT a.o_orderkey, a.o_custkey, b.o_orderstatus FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 3 = 0")
def join_one_to_one(s, d):
    left = where(orders(s, d, "o_custkey"), "o_orderkey % 2 = 0", compact=True)
    right = where(orders(s, d, "o_orderstatus"), "o_orderkey % 3 = 0", compact=True)
    return join.one_to_one(left, right, JoinSpec("o_orderkey", "o_orderkey", select("llr", ["o_orderkey", "o_custkey", "o_orderstatus"])), compact=True).compact()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(s, d):
    return join.semi_join(customer(s, d), orders(s, d, "o_custkey"), "c_custkey", "o_custkey").compact()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 20 = 0)")
def join_anti(s, d):
    some = where(orders(s, d, "o_custkey"), "o_orderkey % 20 = 0")
    return join.anti_join(customer(s, d), some, "c_custkey", "o_custkey").compact()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT a.o_orderkey, a.o_custkey FROM orders a WHERE a.o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey AND b.o_orderkey % 2 = 0)")
def right_union(s, d):
    t = orders(s, d, "o_custkey")
    left, right = (where(t, f"o_orderkey % {k} = 0", compact=True) for k in (2, 3))
    return join.right_union(left, right, "o_orderkey", "o_orderkey", [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey")]).compact()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem WHERE l_linenumber <= 2) UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_linenumber > 2 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2)")
def right_union_lines(s, d):
    t = lineitem(s, d, "l_orderkey", "l_linenumber", "l_quantity")
    names = ("l_orderkey", "l_linenumber", "l_quantity")
    return join.right_union(where(t, "l_linenumber <= 2"), where(t, "l_linenumber > 2"), "l_orderkey", "l_orderkey", [(n, n) for n in names]).compact()


@query("SELECT 'select' AS what, TRUE AS refused UNION ALL SELECT 'keys', TRUE UNION ALL SELECT 'good', FALSE")
def join_validation(s, d):
    """Which of three join specifications are refused: an unknown column, keys of two types, and none."""
    c, o = customer(s, d, "c_nationkey", "c_name"), orders(s, d, "o_custkey")
    specs = {"select": JoinSpec("c_custkey", "o_custkey", select("l", ["o_orderkey"])), "keys": JoinSpec("c_name", "o_custkey", select("r", ["o_orderkey"])), "good": JoinSpec("c_custkey", "o_custkey", select("rl", ["o_orderkey", "c_name"]))}

    def refused(spec: JoinSpec) -> bool:
        try:
            join.om_join(c, o, spec, left_keys="assume")
        except (TypeError, KeyError):
            return True
        return False

    return s.createDataFrame([(k, refused(v)) for k, v in specs.items()], "what string, refused boolean")


# groups


@query("SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS l_quantity, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag")
def group_sum_count(s, d):
    return group.group_sum(lineitem(s, d, "l_returnflag", "l_quantity"), "l_returnflag", ["l_quantity"], count="cnt").compact()


@query("SELECT l_orderkey, l_linenumber, CAST(SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY l_orderkey) AS cnt, CASE WHEN ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 THEN 1 ELSE 0 END AS is_active FROM lineitem")
def group_padded(s, d):
    t = lineitem(s, d, "l_orderkey", "l_quantity")
    out = group.group_sum(t, "l_orderkey", ["l_quantity"], compact=False, count="cnt").df
    return out.select("l_orderkey", F.col(ROW_ID)["l_linenumber"].alias("l_linenumber"), F.col("l_quantity").alias("s"), "cnt", F.col(ACTIVE).cast("int").alias(ACTIVE))


@query("SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, COUNT(*) AS cnt FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")
def group_active_only(s, d):
    raw = read_table(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("s"), "l_discount", *LINE_ID)
    t = FlagTable.of(raw, LINE_ID, F.col("l_discount") > 0.05, Schema.from_struct(raw.select("l_returnflag", "s").schema))
    return group.group_sum(t, "l_returnflag", ["s"], count="cnt").compact()


@query("SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS BIGINT)) % 65536 AS BIGINT) AS s, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag")
def group_sum_wrap16(s, d):
    t = lineitem(s, d, "l_returnflag", "l_quantity")
    narrow = FlagTable(t.df, Schema((t.schema["l_returnflag"], ColumnInfo("l_quantity", Kind.INT, 16))))
    out = group.group_sum(narrow, "l_returnflag", ["l_quantity"], wrap_rule="declared", count="cnt").compact()
    return out.select("l_returnflag", B.unsigned(F.col("l_quantity"), 16).alias("s"), "cnt")


@query("SELECT l_orderkey, CAST(SUM(q) AS BIGINT) AS s, COUNT(*) AS cnt FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, FIRST_VALUE(l_discount > 0.05) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem) GROUP BY l_orderkey, a HAVING a")
def group_sum_all_rows(s, d):
    """Sums over all rows, inactive ones too, of the groups whose first row is active."""
    raw = read_table(s, d, "lineitem").select(*LINE_ID, F.col("l_quantity").cast("long").alias("s"), "l_discount")
    t = FlagTable.of(raw, LINE_ID, F.col("l_discount") > 0.05, Schema.from_struct(raw.select("l_orderkey", "s").schema))
    return group.group_sum(t, "l_orderkey", ["s"], include_inactive=True, count="cnt").compact()


@query("SELECT l_orderkey, AVG(CAST(l_quantity AS BIGINT)) AS l_quantity FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey")
def group_average(s, d):
    return group.group_average(where(lineitem(s, d, "l_orderkey", "l_quantity", "l_linenumber"), "l_linenumber <= 3"), "l_orderkey", ["l_quantity"])


@query("SELECT o_custkey, MIN(o_orderkey) AS o_orderkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey")
def group_reduce_min(s, d):
    return group.group_sum(orders(s, d, "o_custkey"), "o_custkey", ["o_orderkey"], reduce="min", count="cnt").compact()


@query("SELECT o_custkey, BIT_XOR(o_orderkey) AS o_orderkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey")
def group_reduce_custom(s, d):
    return group.group_sum(orders(s, d, "o_custkey"), "o_custkey", ["o_orderkey"], reduce=lambda a, b: a.bitwiseXOR(b), count="cnt").compact()


# filters


def _gates(s, d, build: Callable[[Builder], object], schema: Schema | None = None, *columns: str) -> DataFrame:
    t = part(s, d, "p_size", *columns, schema=schema)
    b = Builder(t.schema, *t.schema.names)
    build(b)
    return where(t, b, compact=True).compact().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = 15")
def where_eq(s, d):
    return _gates(s, d, lambda b: b.gate(Op.EQUALS, b.col("p_size"), b.lit("15", Kind.INT)))


@query("SELECT p_partkey FROM part WHERE p_size <> 15")
def where_neq(s, d):
    return _gates(s, d, lambda b: b.gate(Op.NOT_EQUALS, b.col("p_size"), b.lit("15", Kind.INT)))


@query("SELECT p_partkey FROM part WHERE p_size < p_partkey")
def where_lt(s, d):
    return _gates(s, d, lambda b: b.gate(Op.LESS_THAN, b.col("p_size"), b.col("p_partkey")))


@query("SELECT p_partkey FROM part WHERE p_size >= 25")
def where_ge(s, d):
    return _gates(s, d, lambda b: b.gate(Op.GREATER_THAN_EQUALS, b.col("p_size"), b.lit("25", Kind.INT)))


@query("SELECT p_partkey FROM part WHERE p_size < 30 AND p_partkey >= 50")
def where_and(s, d):
    return _gates(s, d, lambda b: b.gate(Op.AND, b.gate(Op.LESS_THAN, b.col("p_size"), b.lit("30", Kind.INT)), b.gate(Op.GREATER_THAN_EQUALS, b.col("p_partkey"), b.lit("50", Kind.INT))))


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_partkey < 20")
def where_or(s, d):
    return _gates(s, d, lambda b: b.gate(Op.OR, b.gate(Op.LESS_THAN, b.col("p_size"), b.lit("5", Kind.INT)), b.gate(Op.LESS_THAN, b.col("p_partkey"), b.lit("20", Kind.INT))))


@query("SELECT p_partkey FROM part WHERE (p_size < 20) <> (p_partkey % 2 = 0)")
def where_xor(s, d):
    raw = read_table(s, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 2 == 0).alias("even"))
    t = FlagTable.of(raw, "p_partkey")
    b = Builder(t.schema, *t.schema.names)
    b.gate(Op.XOR, b.gate(Op.LESS_THAN, b.col("p_size"), b.lit("20", Kind.INT)), b.col("even"))
    return where(t, b, compact=True).compact().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE ((((p_partkey + p_size + 128) % 256) + 256) % 256) - 128 >= 10")
def where_add_wrap8(s, d):
    schema = Schema.of(("p_partkey", Kind.INT, 8), ("p_size", Kind.INT, 8))
    return _gates(s, d, lambda b: b.gate(Op.GREATER_THAN_EQUALS, b.gate(Op.ADDITION, b.col("p_partkey"), b.col("p_size")), b.lit("10", Kind.INT)), schema)


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT IN (12, 17)")
def where_derived(s, d):
    def build(b: Builder):
        size = b.col("p_size")
        inside = b.between(size, b.lit("10", Kind.INT), b.lit("20", Kind.INT))
        b.gate(Op.AND, inside, b.negate(b.is_in(size, [b.lit("12", Kind.INT), b.lit("17", Kind.INT)])))

    return _gates(s, d, build)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def where_string_eq(s, d):
    t = orders(s, d, "o_orderstatus")
    b = Builder(t.schema, "o_orderstatus")
    b.gate(Op.EQUALS, b.col("o_orderstatus"), b.lit("F", Kind.STRING))
    return where(t, b, compact=True).compact().select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE (p_size < 20) = TRUE OR p_size = 1")
def where_boolean_literal(s, d):
    def build(b: Builder):
        small = b.gate(Op.LESS_THAN, b.col("p_size"), b.lit("20", Kind.INT))
        b.gate(Op.OR, b.gate(Op.EQUALS, small, b.lit("true", Kind.BOOLEAN)), b.gate(Op.EQUALS, b.col("p_size"), b.lit("1", Kind.INT)))

    return _gates(s, d, build)


@query("SELECT o_orderkey, o_orderstatus = 'F' AS bin_string, o_orderkey % 256 = 65 AS bin_int, o_custkey % 2 = 1 AS int_boolean, FALSE AS long_bin FROM orders")
def where_cross_kind(s, d):
    """Operands of different kinds are equal if their bits are, padded to the greater width: F is 46, A is 65, and a longer value differs."""
    raw = read_table(s, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 256).alias("low"), (F.col("o_custkey") % 2).alias("odd"))
    t = FlagTable.of(raw, "o_orderkey", schema=Schema.of(("o_orderkey", Kind.INT, 64), ("o_orderstatus", Kind.STRING, 64), ("low", Kind.INT, 16), ("odd", Kind.INT, 64)))

    def equal(name: str, text: str, kind: Kind) -> Column:
        b = Builder(t.schema, *t.schema.names)
        b.gate(Op.EQUALS, b.col(name), b.lit(text, kind))
        return b.compile()

    found = {"bin_string": ("o_orderstatus", "46", Kind.BIN), "bin_int": ("low", "41", Kind.BIN), "int_boolean": ("odd", "true", Kind.BOOLEAN), "long_bin": ("o_orderstatus", "4600000000000000ff", Kind.BIN)}
    return t.df.select("o_orderkey", *[equal(*v).alias(k) for k, v in found.items()])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey < 500 THEN 1 ELSE 0 END AS is_active FROM orders")
def where_padded(s, d):
    t = where(orders(s, d, "o_custkey", "o_orderstatus"), (F.col("o_orderstatus") == "F") & (F.col("o_custkey") < 500))
    return t.select("o_orderkey").padded()


@query("SELECT o_orderkey, CASE WHEN (o_custkey < 500) AND (o_orderstatus = 'F') AND (o_orderkey % 2 = 0) THEN 1 ELSE 0 END AS is_active FROM orders")
def where_chain(s, d):
    t = orders(s, d, "o_custkey", "o_orderstatus")
    t = where(t, "o_custkey < 500")
    t = where(t, lambda status: status == "F", inputs=["o_orderstatus"])
    return where(t, F.col("o_orderkey") % 2 == 0).select("o_orderkey").padded()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 3")
def extract_active(s, d):
    return where(orders(s, d, "o_custkey"), "o_custkey % 7 = 3").extract().compact()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 4")
def extract_shuffled(s, d):
    return where(orders(s, d, "o_custkey"), "o_custkey % 7 = 4").extract_shuffled(7).compact()


# sorts and permutations


@query("SELECT k, CAST(ROW_NUMBER() OVER (ORDER BY ((k % 256) + 256) % 256, id) - 1 AS BIGINT) AS pos FROM (SELECT p_partkey AS id, (p_size - 25) AS k FROM part) t")
def sort_unsigned_pos(s, d):
    raw = read_table(s, d, "part").select((F.col("p_size") - 25).alias("k"), "p_partkey")
    t = FlagTable.of(raw, "p_partkey", schema=Schema.of(("k", Kind.INT, 8)))
    return sort.sorted_positions(t, ["k"]).select("k", "pos")


@query("SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY LENGTH(p_name), REVERSE(p_name), p_partkey) - 1 AS BIGINT) AS pos FROM part")
def sort_string_le_pos(s, d):
    return sort.sorted_positions(part(s, d, "p_name"), ["p_name"]).select("p_partkey", "pos")


@query("SELECT p_size, p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS pos FROM part")
def table_sort(s, d):
    t = sort.sort_table(part(s, d, "p_size").select("p_size", "p_partkey"))
    return t.df.select("p_size", "p_partkey", F.col(ROW_ID).alias("pos"))


def _sort_perm(s, d, column: str, inverse: bool) -> DataFrame:
    return sort.sort_permutation(part(s, d, column), [column], "natural", inverse)


@query("SELECT CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS i, p_partkey AS pi FROM part")
def sort_perm(s, d):
    return _sort_perm(s, d, "p_size", False)


@query("WITH a AS (SELECT p_partkey AS i, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS pi FROM part), b AS (SELECT p_partkey AS i, CAST(ROW_NUMBER() OVER (ORDER BY p_name, p_partkey) - 1 AS BIGINT) AS pi FROM part) SELECT b.i AS i, a.pi AS pi FROM b JOIN a ON b.pi = a.i")
def perm_compose(s, d):
    return perm.compose(_sort_perm(s, d, "p_name", True), _sort_perm(s, d, "p_size", True))


@query("SELECT p_partkey AS i, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS pi FROM part")
def perm_inverse(s, d):
    return perm.inverse(_sort_perm(s, d, "p_size", False))


@query("SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS i FROM part")
def perm_apply(s, d):
    data = read_table(s, d, "part").select("p_partkey", F.col("p_partkey").alias("i"))
    return perm.apply(_sort_perm(s, d, "p_size", False), data)


@query("SELECT p_partkey AS i, p_partkey AS back, TRUE AS is_permutation, TRUE AS moves FROM part")
def perm_random(s, d):
    """A random permutation moves rows, is one-to-one, and its inverse brings every row of the table back."""
    rows = read_table(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("back"))
    p = perm.random(s, rows.count(), 11)
    moved = perm.apply(p, rows)
    good, moves = perm.is_permutation(p), not moved.where("i <> back").isEmpty()
    return perm.apply(perm.inverse(p), moved).select("i", "back", F.lit(good).alias("is_permutation"), F.lit(moves).alias("moves"))


@query("SELECT 'good' AS what, TRUE AS is_permutation UNION ALL SELECT 'twice', FALSE UNION ALL SELECT 'beyond', FALSE UNION ALL SELECT 'shared', TRUE UNION ALL SELECT 'broken', FALSE")
def perm_validate(s, d):
    """Whole and shared permutations of all parts, and such as name a place twice or one that isn't there."""
    p = _sort_perm(s, d, "p_size", False)
    a, b = perm.split(p, 3)
    swap = lambda q, to: q.withColumn("pi", F.when(F.col("i") == 1, to).otherwise(F.col("pi")))
    found = {"good": perm.is_permutation(p), "twice": perm.is_permutation(swap(p.withColumn("pi", F.col("i")), F.lit(0).cast("long"))), "beyond": perm.is_permutation(swap(p, F.lit(1 << 40))), "shared": perm.shared_is_permutation(a, b), "broken": perm.shared_is_permutation(a, swap(b, F.col("pi").bitwiseXOR(F.lit(1 << 40))))}
    return s.createDataFrame(list(found.items()), "what string, is_permutation boolean")


@query("WITH a AS (SELECT p_partkey AS id, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS pos FROM part) SELECT a.id AS p_partkey, b.pos AS i FROM a JOIN a b ON b.id = a.pos")
def perm_apply_shared(s, d):
    """A permutation held as two, applied in turn."""
    data = read_table(s, d, "part").select("p_partkey", F.col("p_partkey").alias("i"))
    p = _sort_perm(s, d, "p_size", False)
    return perm.apply_shared(p, p, data)


@query("SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS i, CASE WHEN p_size < 25 THEN 1 ELSE 0 END AS is_active FROM part")
def table_permute(s, d):
    t = where(part(s, d, "p_size"), "p_size < 25").select("p_partkey").permute(_sort_perm(s, d, "p_size", False))
    return t.df.select("p_partkey", F.col(ROW_ID).alias("i"), F.col(ACTIVE).cast("int").alias(ACTIVE))


@query("SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_size % 4, p_partkey) - 1 AS BIGINT) AS dst FROM part")
def radix_digit_rank(s, d):
    return sort.digit_pass(read_table(s, d, "part").select("p_partkey", "p_size"), sort.digit(F.col("p_size"), 0, 2), "p_partkey").select("p_partkey", "dst")


@query("SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS pos FROM part")
def radix_sort(s, d):
    return sort.radix_sort(read_table(s, d, "part").select("p_partkey", "p_size"), "p_size", 6, "p_partkey", 3).select("p_partkey", "pos")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_size WHEN 2 THEN p_partkey + p_size ELSE 7 END AS y FROM part")
def radix_hadamard_sum(s, d):
    rows = read_table(s, d, "part").select("p_partkey", "p_size", *sort.one_hot(sort.digit(F.col("p_size"), 0, 2), 4))
    values = [F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") + F.col("p_size"), F.lit(7)]
    return rows.select("p_partkey", sort.hadamard_sum([F.col(f"f{j}") for j in range(4)], values).alias("y"))


@query("SELECT p_partkey, CAST(p_size & 21 AS BIGINT) AS y FROM part")
def bit_injection(s, d):
    bits = [B.bit(F.col("p_size"), i) if i % 2 == 0 else F.lit(0) for i in range(6)]
    return read_table(s, d, "part").select("p_partkey", B.inject_bits(bits).alias("y"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS f0, CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS f1, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS f2, CASE WHEN p_size % 4 = 3 THEN 1 ELSE 0 END AS f3 FROM part")
def radix_onehot(s, d):
    return read_table(s, d, "part").select("p_partkey", *sort.one_hot(sort.digit(F.col("p_size"), 0, 2), 4))


# segmented scans


@query("SELECT o_orderkey, CASE WHEN o_custkey = LAG(o_custkey) OVER (ORDER BY o_custkey, o_orderkey) THEN 1 ELSE 0 END AS c FROM orders")
def control_bits(s, d):
    return scan.control_bits(read_table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "c")


def _scan(s, d, op: str, direction: str) -> DataFrame:
    rows = read_table(s, d, "orders").select("o_orderkey", "o_custkey")
    return scan.segmented_scan(rows, "o_custkey", "o_orderkey", F.col("o_orderkey"), op, direction).select("o_orderkey", "y")


@query("SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y FROM orders")
def seg_prefix_sum(s, d):
    return _scan(s, d, "add", "prefix")


@query("SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS y FROM orders")
def seg_suffix_sum(s, d):
    return _scan(s, d, "add", "suffix")


@query("SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT) AS y FROM orders")
def seg_full_sum(s, d):
    return _scan(s, d, "add", "full")


@query("SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM orders")
def seg_prefix_dup(s, d):
    return _scan(s, d, "dup", "prefix")


@query("SELECT o_orderkey, BIT_XOR(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM orders")
def seg_prefix_xor(s, d):
    return _scan(s, d, "xor", "prefix")


@query("WITH a AS (SELECT event_id, user_id AS v, CASE WHEN event_id % 3 = 0 OR ROW_NUMBER() OVER (ORDER BY event_id) = 1 THEN 0 ELSE 1 END AS c FROM events), b AS (SELECT event_id, v, SUM(1 - c) OVER (ORDER BY event_id) AS seg FROM a) SELECT event_id, CAST(SUM(v) OVER (PARTITION BY seg ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y FROM b")
def seg_scan_explicit_bits(s, d):
    rows = read_table(s, d, "events").select("event_id", "user_id")
    bits = F.when(F.col("event_id") % 3 == 0, 0).otherwise(1)
    return scan.bit_segments_scan(rows, bits, "event_id", F.col("user_id")).select("event_id", "y")


@query("SELECT p_partkey, CAST(SUM(p_size % 3) OVER (ORDER BY p_partkey) % 3 AS BIGINT) AS acc FROM part")
def f3_accumulate(s, d):
    rows = order.running_sum(read_table(s, d, "part").select("p_partkey", "p_size"), F.col("p_size") % 3, ["p_partkey"], "acc")
    return rows.select("p_partkey", F.pmod("acc", F.lit(3)).cast("long").alias("acc"))


@query("SELECT p_partkey, CASE WHEN p_partkey < (n + 1) // 2 THEN 2 * p_partkey ELSE 2 * (p_partkey - (n + 1) // 2) + 1 END AS dst FROM part, (SELECT COUNT(*) AS n FROM part) c")
def perfect_shuffle(s, d):
    rows = read_table(s, d, "part").select("p_partkey")
    return rows.select("p_partkey", B.shuffle_index(F.col("p_partkey"), rows.count()).alias("dst"))


# shares


@query("SELECT o_orderkey, o_custkey FROM orders")
def share_reveal_xor(s, d):
    t = orders(s, d, "o_custkey")
    return share.reveal(*share.share(t, 5), t).compact()


@query("SELECT p_partkey, p_name, p_size > 20 AS big FROM part")
def share_reveal_strings(s, d):
    raw = read_table(s, d, "part").select("p_partkey", "p_name", (F.col("p_size") > 20).alias("big"))
    t = FlagTable.of(raw, "p_partkey")
    return share.reveal(*share.share(t, 6), t).compact()


@query("SELECT o_orderkey, o_custkey % 4294967296 AS o_custkey FROM orders")
def share_reveal_u32(s, d):
    a, b = share.share_u32(F.col("o_custkey"), F.col("o_orderkey"), 9)
    shares = read_table(s, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return shares.select("o_orderkey", share.reveal_u32(F.col("a"), F.col("b")).alias("o_custkey"))


@query("SELECT CAST(ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS i, p_partkey AS pi FROM part")
def share_reveal_perm(s, d):
    return perm.reveal(*perm.split(_sort_perm(s, d, "p_size", False), 4))


# bits and residues


@query("SELECT p_partkey, p_partkey & p_size AS a, p_partkey | p_size AS o, CAST(BIT_COUNT(p_partkey) AS BIGINT) AS pc FROM part")
def circuit_bitops(s, d):
    wires = B.circuit([("and", 0, 1), ("or", 0, 1)], [F.col("p_partkey"), F.col("p_size")])
    return read_table(s, d, "part").select("p_partkey", wires[2].alias("a"), wires[3].alias("o"), B.bit_count(F.col("p_partkey")).alias("pc"))


@query("SELECT p_partkey, ~(p_partkey & p_size) AS nand, ~(p_partkey | p_size) AS nor, ~p_partkey & p_size AS na_and, p_partkey & ~p_size AS nb_and, p_partkey | ~p_size AS nb_or, xor(p_partkey, p_size) AS y, ~xor(p_partkey, p_size) AS nxor, p_partkey AS a FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def circuit_gates(s, d):
    names = ["nand", "nor", "na_and", "nb_and", "nb_or", "xor", "nxor", "a"]
    wires = B.circuit([(n, 0, 1) for n in names], [F.col("p_partkey"), F.col("p_size")])
    return read_table(s, d, "part").select("p_partkey", *[w.alias("y" if n == "xor" else n) for n, w in zip(names, wires[2:]) if n != "a"], wires[-1].alias("a"))


@query("SELECT p_partkey, (p_partkey & p_size) | xor(p_partkey, p_size) AS y FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def circuit_inline(s, d):
    both, one = B.inline([("and", 0, 1), ("xor", 0, 1)], [F.col("p_partkey"), F.col("p_size")], [2, 3])
    (y,) = B.inline([("or", 0, 1)], [both, one], [2])
    return read_table(s, d, "part").select("p_partkey", y.alias("y"))


@query("SELECT p_partkey, (((p_size - 25) & 15) + 8) % 16 - 8 AS extended, p_size < 25 AS negative, (p_partkey & 7) = (p_size & 7) AS same_bits, p_partkey & 31 AS trimmed FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def bit_widths(s, d):
    """Sign extension, sign, equality up to a width, and trimming to it."""
    a, b = F.col("p_partkey"), F.col("p_size").cast("long")
    return read_table(s, d, "part").select("p_partkey", B.sign_extend(b - 25, 4).alias("extended"), B.sign(b - 25).alias("negative"), B.equal_bits(a, b, 3).alias("same_bits"), B.low_bits(a, 5).alias("trimmed"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS h, p_name AS back FROM part")
def hex_codec(s, d):
    h = B.to_hex(F.col("p_name").cast("binary"))
    return read_table(s, d, "part").select("p_partkey", h.alias("h"), B.from_hex(h).cast("string").alias("back"))


@query("SELECT o_orderkey, 256 * (o_orderkey % 256) + o_custkey % 256 AS w0, 65536 * (256 * (o_orderkey % 256) + o_custkey % 256) + 258 AS w1, 4 AS n FROM orders")
def byte_casts(s, d):
    """Bytes read as words of two bytes, as one of four, and back as four."""
    low, high = F.col("o_custkey") % 256, F.col("o_orderkey") % 256
    data = B.from_words(F.array(F.lit(2).cast("long"), F.lit(1).cast("long"), low.cast("long"), high.cast("long")), 1)
    two, four = B.to_words(data, 2), B.cast_words(B.to_words(data, 2), 2, 4)
    return read_table(s, d, "orders").select("o_orderkey", two[1].alias("w0"), four[0].alias("w1"), F.size(B.cast_words(four, 4, 1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 1 ELSE 0 END AS z, CASE WHEN p_size & 7 = 0 THEN 1 ELSE 0 END AS low FROM part")
def circuit_is_zero(s, d):
    return read_table(s, d, "part").select("p_partkey", B.is_zero(F.col("p_size")).alias("z"), B.is_zero(F.col("p_size"), 3).alias("low"))


@query("SELECT b.i AS bit_idx, CAST(SUM(CAST((p_size >> b.i) & 1 AS BIGINT)) AS BIGINT) AS ones FROM part CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) b GROUP BY b.i")
def bit_transpose(s, d):
    return B.transpose(read_table(s, d, "part").select("p_size"), "p_size", 6).groupBy("bit_idx").agg(F.sum("bit").alias("ones"))


@query("SELECT p_partkey, (p_partkey % 3 + p_size % 3) % 3 AS z, (p_partkey % 3 - p_size % 3 + 3) % 3 AS d FROM part")
def mod3_add(s, d):
    a, b = F.col("p_partkey"), F.col("p_size")
    return read_table(s, d, "part").select("p_partkey", B.mod3_add(a, b).alias("z"), B.mod3_sub(a, b).alias("d"))


@query("SELECT p_partkey, CAST(BIT_COUNT(p_partkey & 45) % 2 AS BIGINT) AS w0, CAST(BIT_COUNT(p_partkey & 102) % 2 AS BIGINT) AS w1 FROM part")
def f2_parity_code(s, d):
    w0, w1 = B.f2_code(F.col("p_partkey"), [45, 102])
    return read_table(s, d, "part").select("p_partkey", w0.alias("w0"), w1.alias("w1"))


@query("SELECT p_partkey, sha256('k1:' || CAST(p_partkey AS VARCHAR)) AS h FROM part")
def keyed_names(s, d):
    return read_table(s, d, "part").select("p_partkey", B.keyed_name(F.col("p_partkey"), "k1").alias("h"))


# tables and formats


@query("SELECT c_custkey, c_nationkey, -1 AS n, TRUE AS same, FALSE AS other FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, 99, 1, TRUE, FALSE FROM customer WHERE c_nationkey = 3")
def table_equality(s, d):
    """The rows by which a table differs from itself with some values changed, and whether tables are equal to themselves and to that."""
    t = customer(s, d, "c_nationkey")
    changed = FlagTable(t.df.withColumn("c_nationkey", F.when(F.col("c_nationkey") == 3, 99).otherwise(F.col("c_nationkey"))), t.schema)
    rows = difference(changed.df.select(*t.schema.names), t.df.select(*t.schema.names))
    same, other = t.equals(customer(s, d, "c_nationkey")), t.equals(changed)
    return rows.select(*t.schema.names, F.col("__n").cast("int").alias("n"), F.lit(same).alias("same"), F.lit(other).alias("other"))


@query("SELECT column_name AS name, COUNT(*) OVER () AS cols, (SELECT COUNT(*) FROM orders) AS n, (SELECT CAST(SUM(o_custkey) AS BIGINT) FROM orders) AS total FROM (SELECT 'o_orderkey' AS column_name UNION ALL SELECT 'o_custkey')")
def table_shape(s, d):
    """Names, number of columns and rows, and a column taken by place."""
    t = orders(s, d, "o_custkey")
    total = t.df.agg(F.sum(t[1]).alias("total")).first()[0]
    return s.createDataFrame([(c.name, t.cols(), t.rows(), total) for c in t.column_info()], "name string, cols long, n long, total long")


@query("SELECT c_custkey AS i, CAST(0 AS BIGINT) AS k, '' AS t, FALSE AS b, 1 AS is_active FROM customer")
def table_zeros(s, d):
    """As many rows of zeros as there are customers (their keys count from 0)."""
    t = FlagTable.zeros(s, read_table(s, d, "customer").count(), Schema.of(("k", Kind.INT, 64), ("t", Kind.STRING, 80), ("b", Kind.BOOLEAN, 1)))
    return t.df.select(F.col(ROW_ID).alias("i"), "k", "t", "b", F.col(ACTIVE).cast("int").alias(ACTIVE))


@query("SELECT c_custkey, c_nationkey, c_custkey - n // 3 AS i FROM customer, (SELECT COUNT(*) AS n FROM customer) WHERE c_custkey >= n // 3 AND c_custkey < n // 3 + n // 2")
def table_rows_between(s, d):
    """The middle rows of the table, with a column declared narrower."""
    t = customer(s, d, "c_nationkey")
    n = t.rows()
    out = t.reshape("c_nationkey", 6).rows_between(n // 3, n // 2)
    return out.df.select("c_custkey", "c_nationkey", F.col(ROW_ID).alias("i"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey < 500 THEN 1 ELSE 0 END AS is_active FROM orders")
def table_zip_columns(s, d):
    """Columns in one struct, and out of it again."""
    t = where(orders(s, d, "o_custkey", "o_orderstatus"), "o_custkey < 500")
    return t.unzip_columns(t.zip_columns("row"), "row").padded()


@query("SELECT r.i, CAST(COALESCE(c_nationkey, 0) AS INTEGER) AS c_nationkey FROM (SELECT UNNEST(range(6 * COUNT(*) // 5)) AS i FROM customer) r LEFT JOIN customer ON c_custkey = r.i")
def table_resize(s, d):
    t = customer(s, d, "c_nationkey")
    return t.resize(6 * t.rows() // 5).df.select(F.col(ROW_ID).alias("i"), "c_nationkey")


@query("SELECT p_partkey, p_name, p_size FROM part")
def text_round_trip(s, d):
    t = part(s, d, "p_name", "p_size")
    path = f"{shared_folder(s)}/text-{uuid.uuid4().hex}"
    text_format.write(t, path)
    return text_format.read(s, path).compact().withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def binary_round_trip(s, d):
    t = customer(s, d, "c_name", "c_nationkey")
    path = f"{shared_folder(s)}/customer-{uuid.uuid4().hex}.bin"
    binary_format.write(t, path)
    return binary_format.read(s, path).compact().select("c_custkey", "c_name", F.col("c_nationkey").cast("int"))


@query("SELECT c_nationkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS l_quantity, COUNT(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_nationkey")
def join_where_group(s, d):
    """The flagship: filter, two joins and a grouped sum."""
    o = where(orders(s, d, "o_custkey", "o_orderstatus"), F.col("o_orderstatus") == "F", compact=True)
    oc = join.om_join(customer(s, d, "c_nationkey"), o, JoinSpec("c_custkey", "o_custkey", select("rl", ["o_orderkey", "c_nationkey"])), compact=True, left_keys="assume")
    lines = join.om_join(oc, lineitem(s, d, "l_orderkey", "l_quantity"), JoinSpec("o_orderkey", "l_orderkey", select("lr", ["c_nationkey", "l_quantity"])), compact=True, left_keys="assume")
    return group.group_sum(lines, "c_nationkey", ["l_quantity"], count="cnt").compact()


def _event_stream(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The events as a stream: a folder of files that a file stream watches."""
    raw = read_table(s, d, "events").select(*columns)
    source = f"{shared_folder(s)}/events-{uuid.uuid4().hex}"
    raw.write.parquet(source)
    return s.readStream.schema(raw.schema).parquet(source)


@query("SELECT user_id, COUNT(*) AS cnt, CAST(SUM(event_id) AS BIGINT) AS event_id FROM events WHERE event_type <> 'click' GROUP BY user_id")
def stream_group(s, d):
    stream = streaming.stream_where(_event_stream(s, d, "event_id", "user_id", "event_type"), F.col("event_type") != "click")
    return streaming.to_table(streaming.stream_group_sum(stream, "user_id", ["event_id"], "cnt"), f"{shared_folder(s)}/stream-{uuid.uuid4().hex}", "complete")


@query("SELECT event_id, user_id, c_nationkey FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 3 = 1")
def stream_join(s, d):
    some = read_table(s, d, "customer").where("c_custkey % 3 = 1").select("c_custkey", "c_nationkey")
    joined = streaming.stream_join(_event_stream(s, d, "event_id", "user_id"), some, "user_id", "c_custkey").drop("is_active")
    return streaming.to_table(joined, f"{shared_folder(s)}/stream-{uuid.uuid4().hex}")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, user_id % 5 AS k, CAST(SUM(event_id) AS BIGINT) AS event_id, COUNT(*) AS cnt FROM events GROUP BY ALL")
def stream_window_sum(s, d):
    stream = _event_stream(s, d, "event_id", "user_id", "ts").withColumns({"k": F.col("user_id") % 5, "ts": F.col("ts").cast("timestamp")})
    sums = streaming.stream_window_sum(stream, "ts", "1 hour", "3650 days", "k", "event_id")
    return streaming.to_table(sums, f"{shared_folder(s)}/stream-{uuid.uuid4().hex}", "complete").select(F.unix_timestamp(F.col("window.start")).alias("start"), "k", "event_id", F.col("Count").alias("cnt"))
