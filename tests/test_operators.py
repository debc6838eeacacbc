"""Operators on small hand-written frames: edges that the sample tables lack."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from lamina.functions import compensated_sum, kahan_sum, widened
from lamina.operators import Arithmetic, Filter, GroupBuilder, JoinBuilder, Selection, argsort, clusters, distinct_key_count, group_ids, group_sum, intersect, lookup_gids, lookup_join, materialize, multi_sort, refine, representatives, sort_values, unite
from lamina.sources import byte_count, column, rank_rows, slice_rows, with_file_pos, with_pos


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("n", [0, 1, 3, 7, 63, 64, 65, 130])
def test_positions_at_any_length(spark, n):
    df = column(spark, range(n))
    got = Filter("ge", n - 2).select(df, "value", "positions").df
    assert [r[0] for r in rows(got, "pos")] == list(range(max(0, n - 2), n))


@pytest.mark.parametrize("name, want", [("eq", [1]), ("neq", [0, 2]), ("lt", [0]), ("gt", [2]), ("le", [0, 1]), ("ge", [1, 2])])
def test_comparisons(spark, name, want):
    df = frame(spark, [(0, 1), (1, 2), (2, 3), (3, None)], "pos long, v int")
    assert [r[0] for r in rows(Filter(name, 2).select(df, "v", "positions").df, "pos")] == want


def test_nan_and_null(spark):
    df = frame(spark, [(0, 1.0), (1, math.nan), (2, None)], "pos long, v double")
    pick = lambda f: [r[0] for r in rows(f.select(df, "v", "positions").df, "pos")]
    assert pick(Filter("ge", 1.0)) == [0, 1]
    assert pick(Filter("ge", 1.0, ieee_nan=True)) == [0]
    assert rows(Filter("ge", 1.0).select(df, "v", "mask").df, "pos") == [(0, True), (1, True), (2, False)]


def test_filter_errors():
    with pytest.raises(ValueError, match="unknown comparison"):
        Filter("like", 1)
    with pytest.raises(ValueError, match="constants"):
        Filter("between", 1)
    with pytest.raises(ValueError, match="selection is one of"):
        Selection("words", None)


def test_selectivity_all_encodings(spark):
    rng = random.Random(4)
    for percent in (0, 1, 50, 100):
        values = [int(rng.random() * 100 < percent) for _ in range(128)]
        df = column(spark, values)
        want = [i for i, v in enumerate(values) if v]
        for kind in ("mask", "bitmap", "positions"):
            s, n = Filter("eq", 1).select_with_count(df, "value", kind)
            assert [r[0] for r in rows(s.to_positions().df, "pos")] == want
            assert rows(n) == [(len(want),)] == rows(s.count())
            assert sorted(r[0] for r in rows(s.to_mask(df).df.where("sel").select("pos"))) == want


def test_bitmap_bucket_edges(spark):
    at = [0, 1, 32767, 32768, 65535, 65536, 1_000_000]
    s = Selection("positions", frame(spark, [(p,) for p in at], "pos long"))
    assert [r[0] for r in rows(s.to_bitmap().to_positions().df, "pos")] == at


def test_set_operations_agree_over_kinds(spark):
    df = column(spark, range(70_000))
    a = lambda k: Filter("lt", 40_000).select(df, "value", k)
    b = lambda k: Filter(lambda x: x % 1000 == 0).select(df, "value", k)
    both = {k: [r[0] for r in rows(intersect(a(k), b(k)).to_positions().df, "pos")] for k in ("mask", "bitmap", "positions")}
    either = {k: rows(unite(a(k), b(k)).count()) for k in ("mask", "bitmap", "positions")}
    assert both["mask"] == both["bitmap"] == both["positions"] == list(range(0, 40_000, 1000))
    assert either["mask"] == either["bitmap"] == either["positions"] == [(40_030,)]
    with pytest.raises(ValueError, match="differ in kind"):
        intersect(a("mask"), b("positions"))


def test_materialize_keeps_duplicates_and_order(spark):
    base = column(spark, [10, 20, 30])
    listed = Selection("positions", frame(spark, [(0, 2), (1, 0), (2, 2)], "ordinal long, pos long"))
    assert rows(materialize(base, listed, "value"), "ordinal") == [(0, 2, 30), (1, 0, 10), (2, 2, 30)]


@pytest.mark.parametrize("kind", ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float", "double"])
def test_arithmetic_by_type(spark, kind):
    of = float if kind in ("float", "double") else Decimal if kind == "uint64" else int
    df = frame(spark, [(of(9), of(3)), (of(7), of(2))], f"a {widened(kind).simpleString()}, b {widened(kind).simpleString()}")
    for op, want in (("add", [9, 12]), ("sub", [5, 6]), ("mul", [14, 27]), ("div", [3, 3] if of is not float else [3, 3.5])):
        assert sorted(r[0] for r in rows(Arithmetic(op).apply(df, "a", "b").select("result"))) == want


def test_division(spark):
    df = frame(spark, [(-7, 2), (7, 0), (None, 1)], "a long, b long")
    assert [r[0] for r in rows(Arithmetic("div").apply(df, "a", "b").orderBy(F.col("a").asc_nulls_last()).select("result"))] == [-3, None, None]


def test_overflow_raises(spark):
    df = frame(spark, [(127, 1)], "a byte, b byte")
    with pytest.raises(ArithmeticException):
        Arithmetic("add").apply(df, "a", "b").collect()


def test_sums(spark):
    wide = frame(spark, [(i, 100, i % 2 == 0) for i in range(600)], "pos long, v byte, sel boolean")
    assert rows(Arithmetic("sum").reduce(wide, "v", sel=F.col("sel"))) == [(30_000,)]
    assert rows(Arithmetic("avg").reduce(wide, "v", sel=F.col("sel"))) == [(100.0,)]
    assert rows(Arithmetic("avg").reduce(wide, "v")) == [(100.0,)]
    empty = wide.where("false")
    assert rows(Arithmetic("sum").reduce(empty, "v")) == [(None,)] == rows(Arithmetic("avg").reduce(empty, "v"))
    tenths = frame(spark, [(i, 0.1) for i in range(10)], "pos long, v double")
    assert rows(Arithmetic("sum", "kahan").reduce(tenths, "v")) == [(1.0,)]
    assert rows(tenths.where("false").agg(kahan_sum(F.col("v"), F.col("pos")))) == [(None,)]
    with pytest.raises(ValueError):
        Arithmetic("mod")
    with pytest.raises(ValueError):
        Arithmetic("add").reduce(wide, "v")


def test_group_ids_and_recreate(spark):
    rng = random.Random(17)
    keys = [rng.randrange(129) for _ in range(3000)] + [None]
    df = frame(spark, list(enumerate(keys)), "pos long, k long").repartition(7)
    groups = group_ids(df, "k")
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    want = sorted(((k, p, g) for g, (k, p) in enumerate(sorted(first.items(), key=lambda x: x[1]))), key=repr)
    assert sorted(rows(groups), key=repr) == want
    assert lookup_gids(df, groups, "k").count() == len(keys)
    assert representatives(df, groups, "k").where("not (k <=> rep)").isEmpty()
    assert rows(distinct_key_count(df, "k")) == [(len(first),)]


def test_masked_grouping(spark):
    df = frame(spark, [(0, 5, False), (1, 6, True), (2, 5, True), (3, 6, True)], "pos long, k long, sel boolean")
    assert rows(group_ids(df, "k", sel=F.col("sel")), "gid") == [(6, 1, 0), (5, 2, 1)]
    assert rows(group_ids(df, "k", sel=F.col("sel"), preserve_positions=False), "gid") == [(6, 0, 0), (5, 1, 1)]
    groups = group_ids(df, "k")
    assert rows(lookup_gids(df, groups, "k", sel=F.col("sel")), "pos") == [(0, None), (1, 1), (2, 0), (3, 1)]
    some = group_ids(df.where("k = 5"), "k")
    assert rows(lookup_gids(df, some, "k"), "pos") == [(0, 0), (2, 0)]


@pytest.mark.parametrize("data, want", [([(0, 1, 5)], [(1, 5)]), ([(0, 0, 0), (1, 1, 2)], [(0, 0), (1, 2)]), ([(0, 0, 3), (1, 0, 4), (2, 2, 1)], [(0, 7), (2, 1)])])
def test_group_sum_with_and_without_key_zero(spark, data, want):
    df = frame(spark, data, "pos long, k long, v long")
    assert rows(group_sum(df, "k", "v"), "k") == want


def test_merge_equals_one_pass(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(50), i & 15) for i in range(2000)]
    df = frame(spark, data, "pos long, k long, v long")
    parts = [GroupBuilder.sums("k", "v").feed(slice_rows(df, a, a + 500)) for a in range(0, 2000, 500)]
    tree = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]))
    assert rows(tree.finish(), "k") == rows(group_sum(df, "k", "v"), "k")
    with pytest.raises(ValueError):
        GroupBuilder.sums("k", "v").finish()
    with pytest.raises(ValueError):
        GroupBuilder.sums("k", "v").merge(GroupBuilder.sums("v", "k"))


def test_join_duplicates_misses_zero_and_null(spark):
    build = frame(spark, [(0, 7), (1, 0), (2, 7), (3, None)], "pos long, k long")
    probe = frame(spark, [(0, 7), (1, 8), (2, None), (3, 0)], "pos long, k long")
    pick = lambda **kw: rows(lookup_join(build, probe, "k", "k", **kw), "probe_pos", "build_pos")
    assert pick() == [(0, 0), (1, 3)]
    assert pick(duplicates="last") == [(2, 0), (1, 3)]
    assert pick(duplicates="all") == [(0, 0), (2, 0), (1, 3)]
    assert rows(lookup_join(build.where("k = 7"), probe, "k", "k"), "probe_pos") == [(0, 0)]
    with pytest.raises(ValueError):
        pick(duplicates="any")


def test_ranks(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([None, *range(-3, 4)]), rng.choice("abc")) for i in range(500)]
    df = frame(spark, data, "pos long, a long, b string")
    got = {r["pos"]: r["rank"] for r in rank_rows(df, [("b", False), ("a", True), ("pos", True)]).collect()}
    order = sorted(data, key=lambda r: (-ord(r[2]), (r[1] is not None, r[1] or 0), r[0]))
    assert [got[r[0]] for r in order] == list(range(500))
    down = {r["pos"]: r["rank"] for r in rank_rows(df, [("a", False), ("pos", True)]).collect()}
    order = sorted(data, key=lambda r: (-(r[1] if r[1] is not None else -99), r[0]))
    assert [down[r[0]] for r in order] == list(range(500))


def test_sorts(spark):
    df = column(spark, [3, 1, 2, 1])
    assert rows(sort_values(df, "value", "desc"), "rank") == [(0, 3), (1, 2), (2, 1), (3, 1)]
    assert rows(argsort(df, "value"), "rank") == [(0, 1), (1, 3), (2, 2), (3, 0)]
    assert rows(sort_values(df, "value", begin=1, end=3), "rank") == [(1, 1), (2, 2)]
    assert rows(clusters(df, "value")) == [(1, 0, 2)]
    with pytest.raises(ValueError):
        sort_values(df, "value", "up")
    assert rows(sort_values(df.where("false"), "value")) == []


def test_three_column_sort_and_refinement(spark):
    rng = random.Random(6)
    data = [(i, rng.randint(1, 5), rng.randint(3, 7), rng.randint(2, 9)) for i in range(1024)]
    df = frame(spark, data, "pos long, c1 int, c2 int, c3 int")
    keys = [("c1", "asc"), ("c2", "asc"), ("c3", "desc")]
    want = [r[0] for r in sorted(data, key=lambda r: (r[1], r[2], -r[3], r[0]))]
    assert [r[1] for r in rows(multi_sort(df, keys), "rank")] == want
    runs = rows(refine(df, keys), "start")
    by = {r[0]: r[1:] for r in data}
    for c1, c2, c3, start, n in runs:
        assert n > 1 and all(by[want[i]] == (c1, c2, c3) for i in range(start, start + n))


def test_positions(spark, tmp_path):
    df = column(spark, [5, 6, 7, 8])
    assert rows(slice_rows(df, 1, 3), "pos") == [(1, 6), (2, 7)]
    with pytest.raises(ValueError):
        slice_rows(df, 3, 1)
    with pytest.raises(ValueError):
        with_pos(df)
    assert rows(byte_count(df)) == [(32,)]
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    got = with_file_pos(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r["pos"] for r in got.collect()) == list(range(100))
    with pytest.raises(ValueError):
        widened("int128")


def test_uint64_division_beyond_64_bits(spark):
    top = 2**64 - 1
    df = frame(spark, [(Decimal(top), Decimal(1)), (Decimal(top), Decimal(2)), (Decimal(7), Decimal(0))], "a decimal(20,0), b decimal(20,0)")
    got = Arithmetic("div").apply(df, "a", "b")
    assert [r[0] for r in rows(got.select("result"), F.col("result").desc_nulls_last())] == [top, top // 2, None]


def test_compensated_sums_at_any_size(spark):
    rng = random.Random(13)
    values = [rng.choice([1e16, -1e16, 1.0, 0.1, -3e-9]) * rng.random() for _ in range(20_000)] + [None]
    df = frame(spark, [(i, i % 3, v) for i, v in enumerate(values)], "pos long, k long, v double").repartition(5)
    want = lambda k: math.fsum(v for i, v in enumerate(values) if v is not None and (k is None or i % 3 == k))
    assert rows(Arithmetic("sum", "kahan").reduce(df, "v"))[0][0] == pytest.approx(want(None), rel=1e-12)
    got = compensated_sum(df, F.col("v"), F.col("pos"), ("k",))
    assert [r[1] for r in rows(got, "k")] == [pytest.approx(want(k), rel=1e-12) for k in range(3)]
    masked = Arithmetic("avg", "kahan").reduce(df, "v", sel=F.col("k") == 1)
    assert rows(masked)[0][0] == pytest.approx(want(1) / sum(i % 3 == 1 and v is not None for i, v in enumerate(values)), rel=1e-12)
    assert rows(Arithmetic("sum", "kahan").reduce(df.where("false"), "v")) == [(None,)]


def test_count_of_the_same_pass(spark):
    mask, n = Filter("ge", 3).select_observed(column(spark, range(10)), "value")
    assert [r[1] for r in sorted(mask.df.collect())] == [False] * 3 + [True] * 7
    assert n.get == {"n": 7}


def test_own_selections_are_filters_and_foreign_ones_joins(spark):
    df = column(spark, range(1000)).withColumn("k", F.col("value") % 10)
    own = Filter("lt", 100).select(df, "value", "bitmap")
    foreign = Selection("bitmap", own.df)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(materialize(df, own, "value")) and "Join" in plan(materialize(df, foreign, "value"))
    other = Filter("ge", 50).select(df, "value", "bitmap")
    for a, b in ((own, other), (foreign, Selection("bitmap", other.df))):
        assert [r[0] for r in rows(intersect(a, b).to_positions().df, "pos")] == list(range(50, 100))
        assert rows(unite(a, b).count()) == [(1000,)]
    for sel in (own, foreign, own.to_mask(df), foreign.to_positions()):
        assert rows(group_sum(df, "k", "value", sel=sel), "k") == [(k, 450 + 10 * k) for k in range(10)]
        assert group_ids(df, "k", sel=sel).count() == 10
        groups = group_ids(df, "k")
        assert lookup_gids(df, groups, "k", sel=sel).where("gid is not null").count() == 100


def test_join_builders_merge(spark):
    build = frame(spark, [(i, i % 7) for i in range(70)] + [(70, None)], "pos long, k long")
    probe = frame(spark, [(0, 3), (1, 9), (2, None)], "pos long, k long")
    for keep, want in (("first", [(3, 0)]), ("last", [(66, 0)]), ("all", [(3 + 7 * i, 0) for i in range(10)])):
        parts = [JoinBuilder("k", duplicates=keep).feed(build.where(f"pos % 3 = {i}")) for i in range(3)]
        assert rows(parts[0].merge(parts[1].merge(parts[2])).probe(probe, "k"), "build_pos") == want
    with pytest.raises(ValueError):
        JoinBuilder("k").merge(JoinBuilder("k", duplicates="last"))
    with pytest.raises(ValueError):
        JoinBuilder("k").built()


def test_groups_of_a_sum_builder(spark):
    df = frame(spark, [(0, 1, 2), (1, None, 3), (2, 1, 4), (3, 5, 5)], "pos long, k long, v long")
    parts = [GroupBuilder.sums("k", "v").feed(df.where(f"pos % 2 = {i}")) for i in range(2)]
    assert rows(parts[0].merge(parts[1]).distinct_key_count()) == [(3,)]
