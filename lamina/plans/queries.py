"""The column algebra over the sample tables, one query per operator.

Positions are the dense keys of events, orders and part; lineitem has none, so its
position is a row's place in its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compare import ge, lt
from ..functions.numeric import compensated_sum
from ..operators import arithmetic, filters, gather as mat, grouping, joins, selection, setops, sorting
from ..sources import adopt, byte_count, column, load, new_path, slice_rows, store, with_file_pos, with_pos

Filter, Selection, Arithmetic = filters.Filter, selection.Selection, arithmetic.Arithmetic

QUERIES: dict = {}
LP = "(select row_number() over () - 1 as pos, * from lineitem)"


def query(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return with_pos(load(spark, d, "events"), key="event_id")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return with_pos(load(spark, d, "orders"), key="o_orderkey")


def lineitem(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return with_file_pos(load(spark, d, "lineitem")).select("pos", *columns)


def _filter(name: str, compare: str, col: str, const, sql: str) -> None:
    QUERIES[f"filter_{name}"] = (
        lambda spark, d: Filter(compare, const).select(events(spark, d), col, "positions").df.withColumnRenamed("pos", "event_id"),
        f"select event_id from events where {sql}",
    )


_filter("eq", "eq", "user_id", 42, "user_id = 42")
_filter("neq", "neq", "user_id", 42, "user_id <> 42")
_filter("lt", "lt", "value", 10.0, "value < 10")
_filter("gt", "gt", "value", 100.0, "value > 100")
_filter("le", "le", "value", 10.0, "value <= 10")
_filter("ge", "ge", "value", 100.0, "value >= 100")


@query("filter_between", "select event_id from events where value between 10 and 20")
def filter_between(spark, d):
    return Filter("between", 10.0, 20.0).select(events(spark, d), "value", "positions").df.withColumnRenamed("pos", "event_id")


@query("filter_generic", "select event_id from events where value % 7 < 2")
def filter_generic(spark, d):
    return Filter(lambda x, m, c: x % m < c, 7, 2).select(events(spark, d), "value", "positions").df.withColumnRenamed("pos", "event_id")


@query("filter_generic_range", "select event_id from events where value > 10 and value < 20")
def filter_generic_range(spark, d):
    return Filter(lambda x, lo, hi: (x > lo) & (x < hi), 10.0, 20.0).select(events(spark, d), "value", "positions").df.withColumnRenamed("pos", "event_id")


@query("filter_mask", "select event_id, value > 100 as sel from events")
def filter_mask(spark, d):
    return Filter("gt", 100.0).select(events(spark, d), "value", "mask").df.withColumnRenamed("pos", "event_id")


@query("filter_mask_words", "select cast(event_id // 64 as bigint) word, cast(sum(case when value > 100 then 1 else 0 end) as bigint) bits from events group by 1")
def filter_mask_words(spark, d):
    return Filter("gt", 100.0).select(events(spark, d), "value", "mask").words()


@query("filter_bitmap", "select event_id from events where value > 100")
def filter_bitmap(spark, d):
    return Filter("gt", 100.0).select(events(spark, d), "value", "bitmap").to_positions().df.withColumnRenamed("pos", "event_id")


@query("filter_count", "select cast(count(*) as bigint) n from lineitem where l_quantity < 24")
def filter_count(spark, d):
    return load(spark, d, "lineitem").agg(F.count_if(Filter("lt", 24).predicate("l_quantity")).alias("n"))


@query("filter_count_bitmap", "select cast(count(*) as bigint) n from events where value > 100")
def filter_count_bitmap(spark, d):
    return Filter("gt", 100.0).select(events(spark, d), "value", "bitmap").count()


@query("filter_mask_counted", "select event_id, value > 100 as sel, cast(sum(case when value > 100 then 1 else 0 end) over () as bigint) as n from events")
def filter_mask_counted(spark, d):
    """The mask together with its count."""
    mask, n = Filter("gt", 100.0).select_with_count(events(spark, d), "value", "mask")
    return mask.df.select(F.col("pos").alias("event_id"), "sel", n.scalar().alias("n"))


@query("filter_bitmap_counted", "select cast(event_id // 32768 as bigint) as slab, cast(count(*) as bigint) as n from events where value > 100 group by 1")
def filter_bitmap_counted(spark, d):
    """A bitmap counts its own bits, a value at a time."""
    bitmap = Filter("gt", 100.0).select(events(spark, d), "value", "bitmap").df
    return bitmap.select((F.col("bucket") - 1).cast("bigint").alias("slab"), F.bitmap_count("bits").cast("bigint").alias("n"))


@query("filter_start_position", "select event_id + 1000 as pos from events where value > 100")
def filter_start_position(spark, d):
    return Filter("gt", 100.0).select(events(spark, d), "value", "positions", start_position=1000).df


@query("filter_range_slice", "select event_id from events where event_id >= 100 and event_id < 900 and value > 50")
def filter_range_slice(spark, d):
    return Filter("gt", 50.0).select(slice_rows(events(spark, d), 100, 900), "value", "positions").df.withColumnRenamed("pos", "event_id")


def _two(spark, d, kind):
    e = events(spark, d)
    return Filter("gt", 100.0).select(e, "value", kind), Filter("lt", 75).select(e, "user_id", kind)


BOTH, EITHER = "value > 100 and user_id < 75", "value > 100 or user_id < 75"
for _kind, _short in (("mask", "mask"), ("positions", "pos")):
    QUERIES[f"sel_intersect_{_short}"] = (lambda s, d, k=_kind: setops.intersect(*_two(s, d, k)).to_positions().df.withColumnRenamed("pos", "event_id"), f"select event_id from events where {BOTH}")
    QUERIES[f"sel_union_{_short}"] = (lambda s, d, k=_kind: setops.unite(*_two(s, d, k)).to_positions().df.withColumnRenamed("pos", "event_id"), f"select event_id from events where {EITHER}")
for _short, _combine, _where in (("intersect", setops.intersect, BOTH), ("union", setops.unite, EITHER)):
    QUERIES[f"sel_{_short}_bits"] = (lambda s, d, c=_combine: c(*(Selection("bitmap", x.df) for x in _two(s, d, "bitmap"))).to_positions().df.withColumnRenamed("pos", "event_id"), f"select event_id from events where {_where}")
QUERIES["sel_intersect_bitmap"] = (lambda s, d: setops.intersect(*_two(s, d, "bitmap")).count(), f"select cast(count(*) as bigint) n from events where {BOTH}")
QUERIES["sel_union_bitmap"] = (lambda s, d: setops.unite(*_two(s, d, "bitmap")).count(), f"select cast(count(*) as bigint) n from events where {EITHER}")


@query("materialize_mask", "select event_id as pos, value, user_id from events where value > 100")
def materialize_mask(spark, d):
    e = events(spark, d)
    return mat.materialize(e, Filter("gt", 100.0).select(e, "value", "mask"), "value", "user_id")


@query("materialize_bitmap", "select event_id as pos, value from events where value > 100")
def materialize_bitmap(spark, d):
    e = events(spark, d)
    return mat.materialize(e, Filter("gt", 100.0).select(e, "value", "bitmap"), "value")


@query("materialize_pos", "select o.o_orderkey as ordinal, o.o_custkey as pos, e.value from orders o join events e on e.event_id = o.o_custkey")
def materialize_pos(spark, d):
    """A position list with repeated entries, in an order of its own: a join with another column."""
    listed = load(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("pos"))
    return mat.materialize(events(spark, d), Selection("positions", listed), "value")


def _arith(op: str, sql: str) -> None:
    QUERIES[f"arith_{op}"] = (
        lambda spark, d: Arithmetic(op).apply(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "result"),
        f"select o_orderkey, cast({sql} as bigint) as result from orders",
    )


_arith("add", "o_orderkey + o_custkey")
_arith("sub", "o_orderkey - o_custkey")
_arith("mul", "o_orderkey * o_custkey")
_arith("div", "o_orderkey // nullif(o_custkey, 0)")


@query("arith_div_float", "select o_orderkey, o_totalprice / nullif(cast(o_custkey as double), 0) as result from orders")
def arith_div_float(spark, d):
    return Arithmetic("div").apply(load(spark, d, "orders"), "o_totalprice", "o_custkey").select("o_orderkey", "result")


@query("sum_all", "select cast(sum(cast(value as decimal(18,2))) as decimal(28,2)) as sum from events")
def sum_all(spark, d):
    return Arithmetic("sum", "exact").reduce(load(spark, d, "events"), "value")


@query("sum_integers", "select cast(sum(user_id) as bigint) as sum from events")
def sum_integers(spark, d):
    return Arithmetic("sum").reduce(load(spark, d, "events"), "user_id")


@query("avg_all", "select avg(l_quantity) as avg from lineitem")
def avg_all(spark, d):
    return Arithmetic("avg").reduce(load(spark, d, "lineitem"), "l_quantity")


@query("sum_masked", "select cast(sum(cast(l_quantity as decimal(18,2))) filter (l_discount >= 0.05) as decimal(28,2)) as sum from lineitem")
def sum_masked(spark, d):
    return Arithmetic("sum", "exact").reduce(load(spark, d, "lineitem"), "l_quantity", sel=ge(F.col("l_discount"), 0.05))


@query("avg_masked", "select avg(l_quantity) filter (l_discount >= 0.05) as avg from lineitem")
def avg_masked(spark, d):
    return Arithmetic("avg").reduce(load(spark, d, "lineitem"), "l_quantity", sel=ge(F.col("l_discount"), 0.05))


@query("sum_compensated", "select user_id, round(kahan_sum(value), 6) as sum from events group by user_id")
def sum_compensated(spark, d):
    sums = compensated_sum(load(spark, d, "events"), F.col("value"), F.col("event_id"), ("user_id",))
    return sums.select("user_id", F.round("sum", 6).alias("sum"))


@query("sum_compensated_all", "select round(kahan_sum(value), 4) as sum from events")
def sum_compensated_all(spark, d):
    return Arithmetic("sum", "kahan").reduce(events(spark, d), "value").select(F.round("sum", 4).alias("sum"))


@query("arith_div_uint64", "select o_orderkey, cast((18446744073709551615 - o_orderkey) // cast(nullif(o_custkey, 0) as hugeint) as decimal(20,0)) as result from orders")
def arith_div_uint64(spark, d):
    big = F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("o_orderkey")
    o = load(spark, d, "orders").select("o_orderkey", big.cast("decimal(20,0)").alias("a"), F.col("o_custkey").cast("decimal(20,0)").alias("b"))
    return Arithmetic("div").apply(o, "a", "b").select("o_orderkey", "result")


GROUPS = "select user_id, first_pos, cast(row_number() over (order by first_pos) - 1 as bigint) gid from (select user_id, min(event_id) first_pos from events {} group by user_id) t"


@query("group_build", GROUPS.format(""))
def group_build(spark, d):
    return grouping.group_ids(events(spark, d), "user_id")


@query("group_build_masked", GROUPS.format("where value > 100"))
def group_build_masked(spark, d):
    return grouping.group_ids(events(spark, d), "user_id", sel=F.col("value") > 100)


@query("group_build_renumbered", GROUPS.format("").replace("from events ", "from (select user_id, cast(row_number() over (order by event_id) - 1 as bigint) event_id from events where value > 100) u "))
def group_build_renumbered(spark, d):
    return grouping.group_ids(events(spark, d), "user_id", sel=F.col("value") > 100, preserve_positions=False)


@query("group_build_bitmap", GROUPS.format("where value > 100"))
def group_build_bitmap(spark, d):
    """The rows of a bitmap that was made elsewhere."""
    e = events(spark, d)
    bitmap = Selection("bitmap", Filter("gt", 100.0).select(e, "value", "bitmap").df)
    return grouping.group_ids(e, "user_id", sel=bitmap)


@query("group_lookup", f"select e.event_id as pos, g.gid from events e join ({GROUPS.format('')}) g on e.user_id = g.user_id")
def group_lookup(spark, d):
    e = events(spark, d)
    return grouping.lookup_gids(e, grouping.group_ids(e, "user_id"), "user_id")


@query("group_lookup_masked", f"select e.event_id as pos, case when e.value > 100 then g.gid end as gid from events e join ({GROUPS.format('')}) g on e.user_id = g.user_id")
def group_lookup_masked(spark, d):
    e = events(spark, d)
    return grouping.lookup_gids(e, grouping.group_ids(e, "user_id"), "user_id", sel=F.col("value") > 100)


@query("group_recreate", f"select e.event_id as pos, e.user_id, r.user_id as rep from events e join ({GROUPS.format('')}) g on e.user_id = g.user_id join events r on r.event_id = g.first_pos")
def group_recreate(spark, d):
    e = events(spark, d)
    return grouping.representatives(e, grouping.group_ids(e, "user_id"), "user_id")


@query("group_merge", "select user_id, min(event_id) first_pos, cast(count(*) as bigint) as rows from events group by user_id")
def group_merge(spark, d):
    """Four parts by position, each with a builder of its own, merged in two steps."""
    e = events(spark, d)
    parts = [grouping.GroupBuilder.positions("user_id").feed(e.where(F.col("pos") % 4 == i)) for i in range(4)]
    return parts[0].merge(parts[1]).merge(parts[2].merge(parts[3])).finish()


@query("group_distinct_count", "select cast(count(distinct l_partkey) as bigint) n from lineitem")
def group_distinct_count(spark, d):
    return grouping.distinct_key_count(load(spark, d, "lineitem"), "l_partkey")


PART_SUM = "select l_partkey, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as sum from lineitem {} group by l_partkey"


@query("group_sum", PART_SUM.format(""))
def group_sum(spark, d):
    return grouping.group_sum(load(spark, d, "lineitem"), "l_partkey", "l_quantity", as_type="decimal(18,2)")


@query("group_sum_masked", PART_SUM.format("where l_discount >= 0.05"))
def group_sum_masked(spark, d):
    return grouping.group_sum(load(spark, d, "lineitem"), "l_partkey", "l_quantity", sel=F.col("l_discount") >= 0.05, as_type="decimal(18,2)")


@query("group_sum_bitmap", "select user_id, cast(sum(cast(value as decimal(18,2))) as decimal(28,2)) as sum from events where value > 100 group by user_id")
def group_sum_bitmap(spark, d):
    e = events(spark, d)
    return grouping.group_sum(e, "user_id", "value", sel=Filter("gt", 100.0).select(e, "value", "bitmap"), as_type="decimal(18,2)")


@query("group_sum_distinct_count", "select cast(count(distinct l_partkey) as bigint) n from lineitem")
def group_sum_distinct_count(spark, d):
    whole = load(spark, d, "lineitem")
    build = lambda cond: grouping.GroupBuilder.sums("l_partkey", "l_quantity").feed(whole.where(cond))
    return build("l_orderkey % 2 = 0").merge(build("l_orderkey % 2 <> 0")).distinct_key_count()


@query("group_sum_merge", "select l_partkey, cast(sum(cast(l_quantity as bigint)) as bigint) as sum from lineitem group by l_partkey")
def group_sum_merge(spark, d):
    whole = load(spark, d, "lineitem")
    build = lambda cond: grouping.GroupBuilder.sums("l_partkey", "l_quantity", "bigint").feed(whole.where(cond))
    return build("l_orderkey % 2 = 0").merge(build("l_orderkey % 2 <> 0")).finish().select("l_partkey", F.col("sum").cast("bigint").alias("sum"))


@query("join_unique", f"select o.o_orderkey as build_pos, cast(p.pos as bigint) as probe_pos from {LP} p join orders o on p.l_orderkey = o.o_orderkey")
def join_unique(spark, d):
    return joins.lookup_join(orders(spark, d), lineitem(spark, d, "l_orderkey"), "o_orderkey", "l_orderkey", unique=True)


for _pick, _fold in (("first", "min"), ("last", "max")):
    QUERIES[f"join_{_pick}"] = (
        lambda s, d, p=_pick: joins.lookup_join(orders(s, d), events(s, d), "o_custkey", "user_id", duplicates=p),
        f"select b.bp as build_pos, e.event_id as probe_pos from events e join (select o_custkey, {_fold}(o_orderkey) bp from orders group by o_custkey) b on e.user_id = b.o_custkey",
    )


@query("join_all", "select o.o_orderkey as build_pos, e.event_id as probe_pos from events e join orders o on e.user_id = o.o_custkey")
def join_all(spark, d):
    return joins.lookup_join(orders(spark, d), events(spark, d), "o_custkey", "user_id", duplicates="all")


@query("join_miss", "select o.o_orderkey as build_pos, cast(p.pos as bigint) as probe_pos from {LP} p join orders o on p.l_partkey + p.l_suppkey * 1000 = o.o_orderkey".format(LP=LP))
def join_miss(spark, d):
    """Whole tables, on probe keys of which most have no build row."""
    probe = lineitem(spark, d, "l_partkey", "l_suppkey").withColumn("k", F.expr("l_partkey + l_suppkey * 1000"))
    return joins.lookup_join(orders(spark, d), probe, "o_orderkey", "k")


@query("join_merge", "select b.bp as build_pos, e.event_id as probe_pos from events e join (select o_custkey, min(o_orderkey) bp from orders group by o_custkey) b on e.user_id = b.o_custkey")
def join_merge(spark, d):
    """Two builds, each of half the rows, merged before the probe."""
    o = orders(spark, d)
    odd, even = (joins.JoinBuilder("o_custkey").feed(o.where(f"o_orderkey % 2 = {i}")) for i in (1, 0))
    return odd.merge(even).probe(events(spark, d), "user_id")


@query("join_payload", "select b.bp as build_pos, e.event_id as probe_pos, o.o_totalprice, o.o_orderstatus from events e join (select o_custkey, min(o_orderkey) bp from orders group by o_custkey) b on e.user_id = b.o_custkey join orders o on o.o_orderkey = b.bp")
def join_payload(spark, d):
    o = orders(spark, d)
    pairs = joins.lookup_join(o, events(spark, d), "o_custkey", "user_id")
    return joins.payload(pairs, o, "pos", "build_pos", "o_totalprice", "o_orderstatus")


for _o in ("asc", "desc"):
    QUERIES[f"sort_{_o}"] = (lambda s, d, o=_o: sorting.sort_values(events(s, d), "value", o), f"select cast(row_number() over (order by value {_o}, event_id) - 1 as bigint) as rank, value from events")
    QUERIES[f"argsort_{_o}"] = (lambda s, d, o=_o: sorting.argsort(events(s, d), "value", o), f"select cast(row_number() over (order by value {_o}, event_id) - 1 as bigint) as rank, event_id as pos from events")


@query("sort_pairs", "select cast(row_number() over (order by value, event_id) - 1 as bigint) as rank, value, event_id as pos from events")
def sort_pairs(spark, d):
    return sorting.sort_pairs(events(spark, d), "value")


@query("sort_subrange", "select cast(row_number() over (order by value, event_id) - 1 + 100 as bigint) as rank, value from events where event_id >= 100 and event_id < 700")
def sort_subrange(spark, d):
    return sorting.sort_values(events(spark, d), "value", begin=100, end=700)


@query("sort_clusters", "select value, cast(min(r) as bigint) as start, cast(count(*) as bigint) as len from (select value, row_number() over (order by value, event_id) - 1 r from events) t group by value having count(*) > 1")
def sort_clusters(spark, d):
    return sorting.clusters(events(spark, d), "value")


@query("cluster_refine", "select l_returnflag, l_quantity, cast(min(r) as bigint) as start, cast(count(*) as bigint) as len from (select l_returnflag, l_quantity, row_number() over (order by l_returnflag, l_quantity desc) - 1 r from lineitem) t group by 1, 2 having count(*) > 1")
def cluster_refine(spark, d):
    return sorting.refine(load(spark, d, "lineitem"), [("l_returnflag", "asc"), ("l_quantity", "desc")])


@query("multi_sort", f"select cast(row_number() over (order by l_returnflag, l_quantity, l_extendedprice desc, pos) - 1 as bigint) as rank, cast(pos as bigint) as pos from {LP} t")
def multi_sort(spark, d):
    return sorting.multi_sort(lineitem(spark, d, "l_returnflag", "l_quantity", "l_extendedprice"), [("l_returnflag", "asc"), ("l_quantity", "asc"), ("l_extendedprice", "desc")])


@query("range_scan", f"select cast(pos as bigint) as pos, l_quantity from {LP} t where pos >= 1000 and pos < 2000")
def range_scan(spark, d):
    return slice_rows(lineitem(spark, d, "l_quantity"), 1000, 2000).select("pos", "l_quantity")


@query("selection_bytes", "select cast(count(*) * 8 as bigint) as bytes from events where value > 100")
def selection_bytes(spark, d):
    return byte_count(Filter("gt", 100.0).select(events(spark, d), "value", "positions").df)


@query(
    "pipeline_q6",
    "select cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as decimal(38,4)) as revenue, cast(count(*) as bigint) as n from lineitem "
    "where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity < 24",
)
def pipeline_q6(spark, d):
    """Filters, intersection, materialisation, multiplication, sum - one scan."""
    year = Filter(lambda x, a, b: ge(x, a) & lt(x, b), F.expr("timestamp_ntz '1996-01-01 00:00:00'"), F.expr("timestamp_ntz '1997-01-01 00:00:00'"))
    chosen = setops.all_of(year.predicate("l_shipdate"), Filter("between", 0.05, 0.07).predicate("l_discount"), Filter("lt", 24).predicate("l_quantity"))
    rows = load(spark, d, "lineitem").where(chosen)
    revenue = Arithmetic("mul").column(F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)"))
    return rows.agg(F.sum(revenue).cast("decimal(38,4)").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(
    "pipeline_join_group",
    "select o_orderpriority, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as sum from lineitem join orders on l_orderkey = o_orderkey where l_quantity < 24 group by o_orderpriority",
)
def pipeline_join_group(spark, d):
    line = Filter("lt", 24).rows(load(spark, d, "lineitem"), "l_quantity").select("l_orderkey", "l_extendedprice")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return grouping.group_sum(line.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_orderpriority", "l_extendedprice", as_type="decimal(18,2)")


@query("source_column", "select cast(i as bigint) as pos, cast(i * i % 251 as smallint) as value from range(1000) t(i)")
def source_column(spark, d):
    return column(spark, [i * i % 251 for i in range(1000)], "uint8")


@query("source_adopted", "select n_nationkey, n_name, n_regionkey from nation")
def source_adopted(spark, d):
    """An Arrow table that is in memory already: the fixed 25 nations."""
    return adopt(spark, load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toArrow())


@query("sink_parquet", "select p_partkey, p_retailprice from part where p_size > 25")
def sink_parquet(spark, d):
    path = new_path(spark, "sink")
    store(Filter("gt", 25).rows(load(spark, d, "part"), "p_size").select("p_partkey", "p_retailprice"), path)
    return spark.read.parquet(path)
