"""The registered queries of the engine's own operators, each beside its SQL.

Tables are independent noise, so targets are derived: ``l_extendedprice *
l_discount`` is a pure product of two columns. Doubles are rounded relative to
their size before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses, scalar
from ..operators import cells, diagnostics, survival, transformers, zones
from ..sources import frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

QUANTITY_CUTS = (11.0, 21.0, 31.0, 41.0)
DISCOUNT_CUTS = (0.025, 0.055, 0.075)
QUANTITY_CENTERS = (5.0, 15.0, 25.0, 35.0, 45.0)
DISCOUNT_CENTERS = (0.01, 0.04, 0.065, 0.09)
TARGET = "l_extendedprice*l_discount"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frames.read(spark, sf_dir, name)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the target y and the zones zq (quantity) and zd (discount)."""
    df = table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))  # some rows without x
    return df.withColumns({"x": quantity, "y": F.expr(TARGET), "zq": scalar.zone_index(quantity, QUANTITY_CUTS), "zd": scalar.zone_index(F.col("l_discount"), DISCOUNT_CUTS)})


def case(x: str, cuts: tuple[float, ...]) -> str:
    steps = " ".join(f"when {x} < {c} then {i}" for i, c in enumerate(cuts))
    return f"(case when {x} is null then {len(cuts) + 1} {steps} else {len(cuts)} end)"


X = "(case when l_linenumber <> 3 then l_quantity end)"
ZQ, ZD = case(X, QUANTITY_CUTS), case("l_discount", DISCOUNT_CUTS)
BASE = f"b as (select *, {X} x, {TARGET} y, {ZQ} zq, {ZD} zd from lineitem)"


# Sources

@query("select (select count(*) from lineitem) n_rows, 11 n_columns, round(avg(l_quantity), 6) mean_quantity from lineitem")
def scan_fingerprint(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return frames.fingerprint(df).crossJoin(df.agg(r(F.avg("l_quantity")).alias("mean_quantity"))).select(F.col("n_rows"), F.col("n_columns"), "mean_quantity")


# Zones

@query(f"with {BASE} select zq zone, count(*) n from b group by 1")
def zone_index_fixed(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy(F.col("zq").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select l_discount x, count(*) w, sum(l_extendedprice*l_discount) s from lineitem where l_discount is not null group by 1),
c as (select x, sum(w) over o lw, sum(s) over o ls, sum(w) over () n, sum(s) over () t, lead(x) over (order by x) nx
      from g window o as (order by x rows between unbounded preceding and current row)),
v as (select var_pop(l_extendedprice*l_discount) * count(l_extendedprice*l_discount) ss from lineitem where l_discount is not null)
select (x+nx)/2 cut, round((ls*ls/lw + (t-ls)*(t-ls)/(n-lw) - t*t/n) / ss, 6) gain_share
from c cross join v where nx is not null and lw >= greatest(20, floor(n*0.02)) and n-lw >= greatest(20, floor(n*0.02))
order by gain_share desc, cut limit 1""")
def zone_best_split(spark, sf_dir):
    return zones.best_cut_table(lineitem(spark, sf_dir), "l_discount", "y")


_SEGMENT = """with g as (select l_discount x, count(*) w, sum(l_extendedprice*l_discount) s from lineitem group by 1),
n0 as (select sum(w) n from g),
a as (select g.x, lead(g.x) over (order by g.x) nx, sum(w) over o lw, sum(s) over o ls, sum(w) over () n, sum(s) over () t from g window o as (order by x rows between unbounded preceding and current row)),
c1 as (select (x+nx)/2 cut, x from a, n0 where nx is not null and lw >= greatest(20, floor(n0.n*0.02)) and a.n-lw >= greatest(20, floor(n0.n*0.02)) order by ls*ls/lw+(t-ls)*(t-ls)/(a.n-lw)-t*t/a.n desc, cut limit 1),
h as (select g.*, case when g.x <= c1.x then 0 else 1 end seg from g, c1),
e as (select x, seg, lead(x) over (partition by seg order by x) nx, sum(w) over o lw, sum(s) over o ls, sum(w) over (partition by seg) n, sum(s) over (partition by seg) t from h window o as (partition by seg order by x rows between unbounded preceding and current row)),
c2 as (select (x+nx)/2 cut from e, n0 where nx is not null and lw >= greatest(20, floor(n0.n*0.02)) and e.n-lw >= greatest(20, floor(n0.n*0.02)) order by ls*ls/lw+(t-ls)*(t-ls)/(e.n-lw)-t*t/e.n desc, seg, cut limit 1)
select round(cut, 6) cut from (select cut from c1 union all select cut from c2)"""


@query(_SEGMENT)
def zone_boundaries_k3(spark, sf_dir):
    cuts = zones.adaptive_cuts(lineitem(spark, sf_dir), "l_discount", "y", max_zones=3)
    return spark.createDataFrame([(round(c, 6),) for c in cuts], "cut double")


@query("""with b as (select l_quantity x, abs(l_quantity-25)*1000 + l_extendedprice*0.001 y from lineitem),
g as (select x, count(*) w, sum(y) sy, sum(x) sx, sum(x*x) sxx, sum(x*y) sxy from b group by 1),
c as (select x, lead(x) over (order by x) nx, sum(w) over o w, sum(sy) over o y, sum(sx) over o xs, sum(sxx) over o xx, sum(sxy) over o xy,
 sum(w) over () tw, sum(sy) over () ty, sum(sx) over () tx, sum(sxx) over () txx, sum(sxy) over () txy from g window o as (order by x rows between unbounded preceding and current row)),
s as (select (x+nx)/2 cut, (w*xy-xs*y)/nullif(w*xx-xs*xs,0) l, ((tw-w)*(txy-xy)-(tx-xs)*(ty-y))/nullif((tw-w)*(txx-xx)-(tx-xs)*(tx-xs),0) r, w, tw from c where nx is not null)
select cut from s where l*r < 0 and w >= greatest(20, floor(tw*0.02)) and tw-w >= greatest(20, floor(tw*0.02)) order by least(abs(l),abs(r)) desc, cut limit 1""")
def zone_best_split_correlation(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("y", F.abs(F.col("l_quantity") - 25) * 1000 + F.col("l_extendedprice") * 0.001)
    cuts = zones.adaptive_cuts(df, "l_quantity", "y", max_zones=2, criterion="correlation")
    return spark.createDataFrame([(c,) for c in cuts], "cut double")


@query(f"with {BASE} select zq zone, round(avg(x), 6) center from b where x is not null group by 1")
def zone_centers(spark, sf_dir):
    centers = zones.zone_centers(lineitem(spark, sf_dir), "x", QUANTITY_CUTS)
    return spark.createDataFrame([(z, round(c, 6)) for z, c in enumerate(centers)], "zone int, center double")


@query("select o_orderpriority category, dense_rank() over (order by o_orderpriority) - 1 idx from (select distinct o_orderpriority from orders where o_orderpriority is not null)")
def categorical_zones(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    own = zones.categories(df, "o_orderpriority")
    return df.select(F.col("o_orderpriority").alias("category"), scalar.category_index(F.col("o_orderpriority"), own).cast("long").alias("idx")).distinct()


_QBINS = ",".join(f"quantile_cont(p_retailprice, {i / 5}) q{i}" for i in range(1, 5))


@query(f"with q as (select {_QBINS} from part) select (case when p_retailprice < q1 then 0 when p_retailprice < q2 then 1 when p_retailprice < q3 then 2 when p_retailprice < q4 then 3 else 4 end) bin, count(*) n from part, q group by 1")
def quantile_bins(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    inner = zones.quantile_bins(df, "p_retailprice", 5)
    return df.groupBy(scalar.zone_index(F.col("p_retailprice"), inner).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# Cells

@query(f"with {BASE} select zq zone, round(sum(l_tax*y)/sum(l_tax), 4) value from b group by 1")
def zone_weighted_mean(spark, sf_dir):
    return cells.zone_stats(lineitem(spark, sf_dir), ["zq"], "y", "l_tax").select(F.col("zq").alias("zone"), r(F.col("mean"), 4).alias("value"))


@query(f"with {BASE}, s as (select zq, y, row_number() over (partition by zq order by y) rn, count(*) over (partition by zq) n from b) select zq zone, round(avg(y), 4) value from s where rn > floor(n*0.1) and rn <= n - floor(n*0.1) group by 1")
def zone_trimmed_mean(spark, sf_dir):
    return cells.zone_trimmed_mean(lineitem(spark, sf_dir), "zq", "y", 0.1).select(F.col("zq").alias("zone"), r(F.col("value"), 4).alias("value"))


@query(f"with {BASE} select zq zone, round(quantile_cont(y, 0.9), 4) value from b group by 1")
def zone_quantile(spark, sf_dir):
    return cells.zone_quantile(lineitem(spark, sf_dir), "zq", "y", 0.9).select(F.col("zq").alias("zone"), r(F.col("value"), 4).alias("value"))


_MAIN = "o as (select avg(y) o from b), md as (select zd, count(*) n, (count(*)*avg(y)+10*o)/(count(*)+10)-o d from b, o group by zd, o), mq as (select zq, count(*) n, (count(*)*avg(y)+10*o)/(count(*)+10)-o d from b, o group by zq, o)"


@query(f"with {BASE}, {_MAIN} select zd zone, n, round(d, 4) dev from md")
def main_effect_shrunk(spark, sf_dir):
    return cells.main_effect(lineitem(spark, sf_dir), "zd", "y").select(F.col("zd").alias("zone"), F.col("n").cast("long").alias("n"), r(F.col("dev"), 4).alias("dev"))


@query(f"with {BASE}, {_MAIN}, c as (select zq, zd, count(*) n, avg(y) s from b group by 1, 2) select c.zq, c.zd, c.n, round((c.n*s+10*(o+mq.d+md.d))/(c.n+10)-o, 4) dev from c join mq using (zq) join md using (zd) cross join o")
def pair_effect_shrunk(spark, sf_dir):
    return cells.pair_effect(lineitem(spark, sf_dir), "zq", "zd", "y").select("zq", "zd", F.col("n").cast("long").alias("n"), r(F.col("dev"), 4).alias("dev"))


def _pair_dev(a: str, b: str) -> str:
    return f"p{a}{b} as (select {a}, {b}, (count(*)*avg(y)+10*(o+m{a}.d+m{b}.d))/(count(*)+10)-(o+m{a}.d+m{b}.d) d from b join m{a} using ({a}) join m{b} using ({b}) cross join o group by {a}, {b}, o, m{a}.d, m{b}.d)"


_MAINS3 = "o as (select avg(y) o from b), " + ", ".join(f"m{z} as (select {z}, (count(*)*avg(y)+10*o)/(count(*)+10)-o d from b, o group by {z}, o)" for z in ("zq", "zd", "l_returnflag"))


@query(f"with {BASE}, {_MAINS3}, {_pair_dev('zq', 'zd')}, {_pair_dev('zq', 'l_returnflag')}, {_pair_dev('zd', 'l_returnflag')}, c as (select zq, zd, l_returnflag, count(*) n, avg(y) s from b group by 1, 2, 3) "
       "select c.zq, c.zd, c.l_returnflag, c.n, round((c.n*s + 10*(o+mzq.d+mzd.d+ml_returnflag.d+pzqzd.d+pzql_returnflag.d+pzdl_returnflag.d))/(c.n+10) - o, 4) dev from c join mzq using (zq) join mzd using (zd) join ml_returnflag using (l_returnflag) "
       "join pzqzd using (zq, zd) join pzql_returnflag using (zq, l_returnflag) join pzdl_returnflag using (zd, l_returnflag) cross join o")
def triple_effect_shrunk(spark, sf_dir):
    return cells.triple_effect(lineitem(spark, sf_dir), ["zq", "zd", "l_returnflag"], "y").select("zq", "zd", "l_returnflag", F.col("n").cast("long").alias("n"), r(F.col("dev"), 4).alias("dev"))


_DL = "c as (select {z} z, count(*) n, avg(y) mean, greatest(avg(y*y)-avg(y)*avg(y),0) var from b group by 1), w as (select sum(n*var)/sum(n) v from c), s as (select count(*) k, v, sum(n)/v sw, sum(n*n)/(v*v) sww, sum(n*mean)/sum(n) mu from c, w group by v), q as (select sum(n/s.v*(mean-mu)*(mean-mu)) q from c, s), m as (select v/nullif(greatest(0,(q-(k-1))/(sw-sww/sw)),0) m from s, q)"


@query(f"with {BASE}, {_DL.format(z='zd')} select round(coalesce(m, 10), 6) m from m")
def dersimonian_laird_m(spark, sf_dir):
    return cells.learned_m(cells.zone_stats(lineitem(spark, sf_dir), ["zd"], "y")).select(r(F.col("m")).alias("m"))


@query(f"with {BASE}, t as (select avg(y) o, stddev_pop(y) sd from b), c as (select zq, zd, count(*) n, avg(y) m from b group by 1, 2), a as (select zq, avg(y) m from b group by 1), d as (select zd, avg(y) m from b group by 1) select round(sum(n*(c.m-(a.m+d.m-o))*(c.m-(a.m+d.m-o)))/sum(n)/(max(sd)*max(sd)), 8) score from c join a using (zq) join d using (zd) cross join t")
def pair_interaction_score(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    scaled = df.crossJoin(F.broadcast(df.agg(F.stddev_pop("y").alias("sd")))).withColumn("y", F.col("y") / F.col("sd"))
    return cells.pair_score(scaled, "zq", "zd", "y").select(r(F.col("score"), 8).alias("score"))


@query(f"with {BASE}, p as (select 'zd' a, 'l_returnflag' b, zd::varchar za, l_returnflag zb, y from b union all select 'zd', 'zq', zd::varchar, zq::varchar, y from b union all select 'l_returnflag', 'zq', l_returnflag, zq::varchar, y from b), "
       "t as (select avg(y) o, var_pop(y) v from b), c as (select a, b, za, zb, count(*) n, avg(y) m from p group by all), r as (select a, b, za, avg(y) m from p group by all), k as (select a, b, zb, avg(y) m from p group by all) "
       "select a, b, round(sum(n*(c.m-(r.m+k.m-o))*(c.m-(r.m+k.m-o)))/sum(n)/max(v), 8) score from c join r using (a, b, za) join k using (a, b, zb) cross join t group by a, b")
def batched_pair_scores(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    scaled = df.crossJoin(F.broadcast(df.agg(F.stddev_pop("y").alias("sd")))).withColumns({"y": F.col("y") / F.col("sd"), "zd": F.col("zd").cast("string"), "zq": F.col("zq").cast("string")})
    return cells.batched_pair_scores(scaled, ["zd", "l_returnflag", "zq"], "y").select("a", "b", r(F.col("score"), 8).alias("score"))


@query(f"with {BASE}, b2 as (select *, l_orderkey % 5 f from b), c as (select zd, f, count(*) n, sum(y) s from b2 group by 1, 2), t as (select zd, sum(n) n, sum(s) s from c group by 1), g as (select f, sum(n) n, sum(s) s from c group by 1), a as (select sum(n) n, sum(s) s from c) "
       "select c.zd zone, c.f fold, round(((t.s-c.s)+10*((a.s-g.s)/(a.n-g.n)))/((t.n-c.n)+10)-(a.s-g.s)/(a.n-g.n), 4) dev from c join t using (zd) join g using (f) cross join a")
def oof_main_effect(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5)
    return cells.out_of_fold(df, "zd", "y", "fold").select(F.col("zd").alias("zone"), "fold", r(F.col("dev"), 4).alias("dev"))


_LINE_D = "(case when l_discount <= 0.01 then -3.0 when l_discount <= 0.04 then -3.0 + (l_discount-0.01)*(2.0/0.03) when l_discount <= 0.065 then -1.0 + (l_discount-0.04)*(2.0/0.025) when l_discount <= 0.09 then 1.0 + (l_discount-0.065)*(2.0/0.025) else 3.0 end)"


@query(f"select round(avg({_LINE_D}), 6) mean, round(min({_LINE_D}), 6) low, round(max({_LINE_D}), 6) high, count(*) n from lineitem")
def soft_zone_lookup(spark, sf_dir):
    value = scalar.interpolated(F.col("l_discount"), DISCOUNT_CENTERS, (-3.0, -1.0, 1.0, 3.0), 0.0)
    return table(spark, sf_dir, "lineitem").select(value.alias("v")).agg(r(F.avg("v")).alias("mean"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high"), F.count(F.lit(1)).alias("n"))


_U = "least(1, greatest(0, (l_quantity-15)/20))"
_V = "least(1, greatest(0, (l_discount-0.03)/0.04))"


@query(f"select round(avg((1-{_U})*((1-{_V})*1.0+{_V}*2.0) + {_U}*((1-{_V})*3.0+{_V}*5.0)), 6) mean from lineitem")
def pair_bilinear_lookup(spark, sf_dir):
    oa, na, wa = scalar.soft_weights(F.col("l_quantity"), (15.0, 35.0), (25.0,))
    ob, nb, wb = scalar.soft_weights(F.col("l_discount"), (0.03, 0.07), (0.05,))
    grid = scalar.array_literal([1.0, 2.0, 3.0, 5.0])
    at = lambda a, b: F.get(grid, a * 2 + b)
    value = (1 - wa) * ((1 - wb) * at(oa, ob) + wb * at(oa, nb)) + wa * ((1 - wb) * at(na, ob) + wb * at(na, nb))
    return table(spark, sf_dir, "lineitem").agg(r(F.avg(value)).alias("mean"))


@query(f"with {BASE}, e as (select y/1000 y, (case zd when 0 then -3.0 when 1 then -1.0 when 2 then 1.0 else 3.0 end) h, {_LINE_D} s from b) select round((count(*) filter (where h <> s) * (case when sum((y-s)*(y-s)) <= sum((y-h)*(y-h)) then 1.0 else 0.0 end) + 50)/(count(*) filter (where h <> s) + 50), 6) lam from e")
def boundary_lambda(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("y", F.col("y") / 1000)
    hard = F.get(scalar.array_literal([-3.0, -1.0, 1.0, 3.0]), F.col("zd"))
    soft = scalar.interpolated(F.col("l_discount"), DISCOUNT_CENTERS, (-3.0, -1.0, 1.0, 3.0), 0.0)
    return cells.boundary_lambda(df, "y", hard, soft, 50.0, hard != soft).select(r(F.col("lam")).alias("lam"))


_H = ("1.0", "l_quantity", "greatest(l_quantity-20,0)", "greatest(l_quantity-35,0)")


@query(" union all ".join([f"select {i} i, {j} j, round(avg({_H[i]}*{_H[j]}), 4) mean from lineitem" for i in range(4) for j in range(i, 4)] + [f"select {i} i, -1 j, round(avg({_H[i]}*l_discount), 4) mean from lineitem" for i in range(4)]))
def spline_normal_equations(spark, sf_dir):
    return cells.spline_moments(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (20.0, 35.0)).select("i", "j", r(F.col("mean"), 4).alias("mean"))


@query(f"select round(regr_slope({TARGET}, l_extendedprice), 8) slope, round(corr({TARGET} , l_discount), 8) cor, round(regr_r2({TARGET}, l_extendedprice), 8) r2 from lineitem")
def ols_residualize(spark, sf_dir):
    return lineitem(spark, sf_dir).agg(r(F.regr_slope("y", "l_extendedprice"), 8).alias("slope"), r(F.corr("y", "l_discount"), 8).alias("cor"), r(F.regr_r2("y", "l_extendedprice"), 8).alias("r2"))


# Transformers

@query(f"with b as (select o_orderpriority z, o_totalprice y from orders), {_DL.format(z='z')}, o as (select avg(y) o from b) select z category, round((n*mean+coalesce(m,10)*o)/(n+coalesce(m,10)), 3) mean, n::double count, round(var/1e9, 6) var from c, m, o")
def zone_profile_categorical(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    profile = transformers.ZoneProfile(["o_orderpriority"], "o_totalprice", ["o_orderpriority"]).fit(df)
    out = profile.transform(df.select("o_orderpriority").distinct())
    return out.select(F.col("o_orderpriority").alias("category"), r(F.col("o_orderpriority__zone_mean"), 3).alias("mean"), F.col("o_orderpriority__zone_count").alias("count"), r(F.col("o_orderpriority__zone_var") / 1e9).alias("var"))


@query(f"""with k as ({_SEGMENT}), b as (select *, {TARGET} y, (select count(*) from k where k.cut <= l_discount) z from lineitem), {_DL.format(z='z')}, o as (select avg(y) o from b)
select z zone, n::double count, round((n*mean+coalesce(m,10)*o)/(n+coalesce(m,10)), 4) mean from c, m, o""")
def zone_profile_continuous(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    profile = transformers.ZoneProfile(["l_discount"], "y", max_zones=3).fit(df)
    out = profile.transform(df.select("l_discount").distinct()).withColumn("zone", profile.zones["l_discount"]().cast("long"))
    return out.select("zone", F.col("l_discount__zone_count").alias("count"), r(F.col("l_discount__zone_mean"), 4).alias("mean")).distinct()


@query("""with m as (select avg(c_acctbal) a, avg(c_nationkey::double) b, var_pop(c_acctbal)+1e-6 vaa, var_pop(c_nationkey::double)+1e-6 vbb, covar_pop(c_acctbal, c_nationkey::double) vab from customer)
select c_custkey, round(sqrt((vbb*(c_acctbal-a)*(c_acctbal-a) - 2*vab*(c_acctbal-a)*(c_nationkey-b) + vaa*(c_nationkey-b)*(c_nationkey-b))/(vaa*vbb-vab*vab)), 5) distance,
round(1/(1+sqrt((vbb*(c_acctbal-a)*(c_acctbal-a) - 2*vab*(c_acctbal-a)*(c_nationkey-b) + vaa*(c_nationkey-b)*(c_nationkey-b))/(vaa*vbb-vab*vab))), 5) coreness from customer, m""")
def mahalanobis_depth(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    out = transformers.Depth("g", ["c_acctbal", "c_nationkey"]).fit(df).transform(df)
    return out.select("c_custkey", r(F.col("g__depth_distance"), 5).alias("distance"), r(F.col("g__coreness"), 5).alias("coreness"))


@query("""with t as (select p_partkey, cume_dist() over (order by p_size) a, cume_dist() over (order by p_retailprice) b, cume_dist() over (order by p_partkey) c from part)
select p_partkey, round((a+b+c)/3, 6) mean, round(list_sort([a,b,c])[2], 6) median, round(sqrt(((a-(a+b+c)/3)**2+(b-(a+b+c)/3)**2+(c-(a+b+c)/3)**2)/3), 6) std, round(least(a,b,c), 6) min,
(case when a<=0.05 then 1 else 0 end)+(case when b<=0.05 then 1 else 0 end)+(case when c<=0.05 then 1 else 0 end) votes from t""")
def depth_crowd(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    out = transformers.DepthCrowd(["p_size", "p_retailprice", "p_partkey"]).fit(df).transform(df)
    rounded = lambda x: F.round(x * 1e6) / 1e6  # noqa: E731  as the SQL rounds: ranks k / n often end in half a digit
    return out.select("p_partkey", *(rounded(F.col(f"crowd__{c}")).alias(c) for c in ("mean", "median", "std", "min")), F.col("crowd__vote_count").alias("votes"))


@query("with c as (select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2) select l_returnflag, l_linestatus, n count, round(n/(select count(*) from lineitem), 8) coreness from c")
def categorical_depth(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = transformers.CategoricalDepth("g", ["l_returnflag", "l_linestatus"]).fit(df).transform(df.select("l_returnflag", "l_linestatus").distinct())
    return out.select("l_returnflag", "l_linestatus", F.col("g__count").alias("count"), r(F.col("g__coreness"), 8).alias("coreness"))


@query(f"""with j as (select o_orderpriority s, {case('l_discount', DISCOUNT_CUTS)} za, {case('l_tax', (0.03, 0.06))} zb, {TARGET} y, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey),
w as (select s, count(*) w, avg(y) o from j group by 1), c as (select s, za, zb, count(*) n, avg(y) m from j group by 1, 2, 3)
select c.s segment, za, zb, n::double count, round((n*m+10*o)/(n+10), 4) mean from c join w using (s) where w >= 50""")
def conditional_zone_grid(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).select("o_orderpriority", "l_discount", "l_tax", F.expr(TARGET).alias("y"))
    grid = transformers.ConditionalGrid("l_discount", "l_tax", "y", "o_orderpriority", DISCOUNT_CUTS, (0.03, 0.06), m=cells.FALLBACK_M).fit(df)
    out = grid.transform(df.select("o_orderpriority", "l_discount", "l_tax").distinct()).where("l_discount_l_tax__used_segment_grid")
    za, zb = scalar.zone_index(F.col("l_discount"), DISCOUNT_CUTS), scalar.zone_index(F.col("l_tax"), (0.03, 0.06))
    return out.select(F.col("o_orderpriority").alias("segment"), za.alias("za"), zb.alias("zb"), F.col("l_discount_l_tax__cell_count").alias("count"), r(F.col("l_discount_l_tax__cell_mean"), 4).alias("mean")).distinct()


@query(f"""with j as (select o_orderpriority s, l_discount a, l_tax b, {TARGET} y from lineitem join orders on l_orderkey = o_orderkey), p as (select * from j union all select 'none', a, b, y from j),
u as (select s, 'a' c, a x, y from p union all select s, 'b', b, y from p), h as (select s, c, x, count(*) n, sum(y) t from u where x is not null group by 1, 2, 3),
k as (select *, sum(n) over w ln, sum(t) over w lt, sum(n) over q nn, sum(t) over q tt, lead(x) over w nx from h window w as (partition by s, c order by x), q as (partition by s, c)),
g as (select s, c, (x+nx)/2 cut, lt*lt/ln + (tt-lt)*(tt-lt)/(nn-ln) - tt*tt/nn gain, row_number() over (partition by s, c order by lt*lt/ln + (tt-lt)*(tt-lt)/(nn-ln) desc, x) r from k where nx is not null and least(ln, nn-ln) >= greatest(20, floor(nn*0.02))),
cuts as (select s, max(case when c = 'a' then cut end) ca, max(case when c = 'b' then cut end) cb from g where r = 1 and gain > 0 group by 1),
z as (select s, a >= ca za, b >= cb zb, y from p join cuts using (s)), o as (select s, avg(y) o, var_pop(y) v from z group by 1), c as (select s, za, zb, count(*) n, avg(y) m from z group by 1, 2, 3),
e as (select s, o, v, count(*) k, sum(n) nn, sum(n*n) n2, sum(n*(m-o)*(m-o)) q from c join o using (s) group by 1, 2, 3), f as (select s, o, coalesce(v/nullif(greatest(0, (q/v-(k-1))/((nn-n2/nn)/v)), 0), 10) m0 from e)
select distinct s segment, n::double count, round((n*m+m0*o)/(n+m0), 4) mean, s <> 'none' own from c join f using (s)""")
def conditional_grid_own_cuts(spark, sf_dir):
    """Cuts and shrinkage of each segment's own; rows of a segment never seen take the pooled grid."""
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).select("o_orderpriority", "l_discount", "l_tax", F.expr(TARGET).alias("y"))
    grid = transformers.ConditionalGrid("l_discount", "l_tax", "y", "o_orderpriority", max_zones=2).fit(df)
    seen = df.select("o_orderpriority", "l_discount", "l_tax").distinct()
    out = grid.transform(seen.unionByName(seen.withColumn("o_orderpriority", F.lit("none"))))
    return out.select(F.col("o_orderpriority").alias("segment"), F.col("l_discount_l_tax__cell_count").alias("count"), r(F.col("l_discount_l_tax__cell_mean"), 4).alias("mean"), F.col("l_discount_l_tax__used_segment_grid").alias("own")).distinct()


@query("""with a as (select user_id, min(ts) + interval 10 day as "at" from events group by 1 union all select user_id, max(ts) from events group by 1),
e as (select user_id, ts, value from events where event_type = 'purchase'), d as (select distinct * from a)
select d.user_id, d."at", count(e.ts) > 0 had, round(coalesce(sum(exp(-ln(2.0)*((epoch_us(d."at")-epoch_us(e.ts))/86400e6)/7)), 0), 6) cnt7, round(coalesce(sum(coalesce(e.value,0)*exp(-ln(2.0)*((epoch_us(d."at")-epoch_us(e.ts))/86400e6)/7)), 0), 4) sum7,
round(coalesce(sum(exp(-ln(2.0)*((epoch_us(d."at")-epoch_us(e.ts))/86400e6)/0.5)), 0), 6) cnt05 from d left join e on d.user_id = e.user_id and e.ts <= d."at" group by 1, 2""")
def laplace_history(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    at = events.groupBy("user_id").agg((F.min("ts") + F.expr("interval 10 days")).alias("at")).unionByName(events.groupBy("user_id").agg(F.max("ts").alias("at"))).distinct()
    out = transformers.DecayedHistory("user_id", "ts", ["value"], [7, 0.5], "h").fit(events.where("event_type = 'purchase'")).transform(at, "at")
    return out.select("user_id", "at", (F.col("h__had_history") == 1).alias("had"), r(F.col("h__event_decay_count_7d")).alias("cnt7"), r(F.col("h__value__laplace_7d"), 4).alias("sum7"), r(F.col("`h__event_decay_count_0.5d`")).alias("cnt05"))


@query(f"""with c as (select {TARGET} - avg({TARGET}) over () y, l_extendedprice - avg(l_extendedprice) over () p, l_discount - avg(l_discount) over () d, l_quantity - avg(l_quantity) over () q from lineitem),
k as (select 'l_extendedprice' a, 'l_discount' b, y, p u, d v from c union all select 'l_extendedprice', 'l_quantity', y, p, q from c union all select 'l_discount', 'l_quantity', y, d, q from c),
s as (select a, b, covar_pop(u,u) uu, covar_pop(v,v) vv, covar_pop(u,v) uv, covar_pop(y,u) yu, covar_pop(y,v) yv, covar_pop(y,y) yy, covar_pop(u*v,u*v) rr, covar_pop(y,u*v) yr, covar_pop(u,u*v) ur, covar_pop(v,u*v) vr from k group by 1, 2),
t as (select *, (yu*vv-yv*uv)/(uu*vv-uv*uv) bu, (yv*uu-yu*uv)/(uu*vv-uv*uv) bv from s) select a, b, round(abs(yr-bu*ur-bv*vr)/sqrt((yy-bu*yu-bv*yv)*rr), 4) score from t""")
def suggest_interactions(spark, sf_dir):
    return transformers.suggest_interactions(lineitem(spark, sf_dir), ["l_extendedprice", "l_discount", "l_quantity"], "y").select("a", "b", r(F.col("score"), 4).alias("score"))


# Survival

_GAPS = "s as (select user_id, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts))/3600e6 d, case when lead(event_type) over (partition by user_id order by ts, event_id) = 'purchase' then 1 else 0 end e, value from events), g as (select * from s where d > 0)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between a user's events; an event of the process if the later one is a purchase."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    df = table(spark, sf_dir, "events").select("user_id", "value", ((F.lead(at).over(order) - at).cast("double") / 3600e6).alias("d"), F.when(F.lead("event_type").over(order) == "purchase", 1).otherwise(0).alias("e"))
    return df.where("d > 0")


@query(f"with {_GAPS}, i as (select * from (values (0, 0.0, 2.0), (1, 2.0, 5.0), (2, 5.0, null)) v(i, lo, hi)) select i.i interval, count(*) n, round(sum(least(d, coalesce(hi, d)) - lo), 3) exposure, sum(case when (hi is null or d <= hi) and e = 1 then 1 else 0 end)::double y from g join i on d > lo group by 1")
def person_period(spark, sf_dir):
    rows = survival.person_period(gaps(spark, sf_dir), "d", "e", [0.0, 2.0, 5.0, float("inf")])
    return rows.groupBy("interval").agg(F.count(F.lit(1)).alias("n"), r(F.sum("exposure"), 3).alias("exposure"), F.sum("y").alias("y"))


@query(f"with {_GAPS}, q as (select unnest([0.0, quantile_cont(d, 0.25), quantile_cont(d, 0.5), quantile_cont(d, 0.75)]) p from g where e = 1) select round(p, 6) point from q")
def survival_breakpoints(spark, sf_dir):
    points = survival.breakpoints(gaps(spark, sf_dir), "d", "e", 4)
    return spark.createDataFrame([(round(p, 6),) for p in points if p != float("inf")], "point double")


@query(f"with {_GAPS} select round(avg(0.1*least(d,2) + 0.2*greatest(least(d,5)-2,0) + 0.05*greatest(d-5,0)), 6) hazard, round(avg(exp(-(0.1*least(d,2) + 0.2*greatest(least(d,5)-2,0) + 0.05*greatest(d-5,0)))), 6) survival from g")
def cumulative_hazard(spark, sf_dir):
    h = survival.cumulative_hazard([F.lit(0.1), F.lit(0.2), F.lit(0.05)], [0.0, 2.0, 5.0, float("inf")], F.col("d"))
    return gaps(spark, sf_dir).select(h.alias("h")).agg(r(F.avg("h")).alias("hazard"), r(F.avg(survival.survival_curve(F.col("h")))).alias("survival"))


@query(f"with {_GAPS}, p as (select row_number() over () id, d, e, value r from g where value is not null) select round(sum(case when a.r > b.r then 1.0 when a.r = b.r then 0.5 else 0 end)/count(*), 8) c_index from p a join p b on a.e = 1 and (b.d > a.d or (b.d = a.d and b.e = 1 and a.id <> b.id))")
def concordance_index(spark, sf_dir):
    return survival.concordance(gaps(spark, sf_dir), "d", "e", "value").select(r(F.col("c_index"), 8).alias("c_index"))


# Losses

@query("select round(ln(sum(l_quantity)/sum(exp(ln(l_tax+1)))), 8) baseline from lineitem")
def glm_baseline_offset(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(r(F.log(F.sum("l_quantity") / F.sum(F.exp(F.log(F.col("l_tax") + 1)))), 8).alias("baseline"))


_MU = "(20.0 + l_discount*100)"


@query(f"select round(avg(2*((case when l_quantity > 0 then l_quantity*ln(l_quantity/{_MU}) else 0 end)-(l_quantity-{_MU}))), 6) poisson, round(avg(2*(l_quantity/{_MU}-1-ln(l_quantity/{_MU}))), 6) gamma, round(avg(2*(power(l_quantity,0.5)/(-0.25)-l_quantity*power({_MU},-0.5)/(-0.5)+power({_MU},0.5)/0.5)), 6) tweedie, round(avg(greatest(0.9*(l_quantity-{_MU}), -0.1*(l_quantity-{_MU}))), 6) pinball, round(sqrt(avg((l_quantity-{_MU})*(l_quantity-{_MU}))), 6) rmse, round(sqrt(sum(l_tax*(l_quantity-{_MU})*(l_quantity-{_MU}))/sum(l_tax)), 6) weighted_rmse from lineitem")
def deviances(spark, sf_dir):
    y, mu = F.col("l_quantity"), F.lit(20.0) + F.col("l_discount") * 100
    square = losses.loss_of("squared_error", y, mu)
    return table(spark, sf_dir, "lineitem").agg(r(F.avg(losses.poisson_deviance(y, mu))).alias("poisson"), r(F.avg(losses.gamma_deviance(y, mu))).alias("gamma"), r(F.avg(losses.tweedie_deviance(y, mu, 1.5))).alias("tweedie"), r(F.avg(losses.pinball(y, mu, 0.9))).alias("pinball"), r(F.sqrt(F.avg(square))).alias("rmse"), r(F.sqrt(F.sum(F.col("l_tax") * square) / F.sum("l_tax"))).alias("weighted_rmse"))


@query("with p as (select (case when l_returnflag = 'R' then 1 else 0 end) y, 1/(1+exp(-((l_discount-0.05)*20))) p from lineitem) select round(avg(-(y*ln(p)+(1-y)*ln(1-p))), 8) log_loss from p")
def log_loss(spark, sf_dir):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").agg(r(F.avg(losses.log_loss(y, scalar.sigmoid((F.col("l_discount") - 0.05) * 20))), 8).alias("log_loss"))


@query("with s as (select l_discount*10 a, l_tax*10 b, l_quantity/10 c from lineitem), e as (select exp(a-greatest(a,b,c)) a, exp(b-greatest(a,b,c)) b, exp(c-greatest(a,b,c)) c from s) select round(avg(a/(a+b+c)), 8) pa, round(avg(b/(a+b+c)), 8) pb, round(avg(c/(a+b+c)), 8) pc from e")
def softmax_probs(spark, sf_dir):
    p = scalar.softmax([F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 10])
    return table(spark, sf_dir, "lineitem").agg(*(r(F.avg(v), 8).alias(f"p{n}") for n, v in zip("abc", p)))


KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")


def sql_hash(*parts: str) -> str:
    """`frames.hash31` in SQL, of expressions that are text."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::bigint % {frames.PRIME})"


SQL_KEY = "(" + " || '-' || ".join(f"{c}::varchar" for c in KEY[:4]) + ")"


def keyed(df: DataFrame) -> DataFrame:
    """lineitem with a text key that SQL engines build alike."""
    return df.withColumn("k", F.concat_ws("-", *KEY[:4]))


def sql_unit(seed: int, key: str = SQL_KEY) -> str:
    return f"({sql_hash(repr(str(seed)), key)} / {frames.PRIME}.0)"


@query(f"with u as (select {sql_unit(7)} u, l_quantity from lineitem) select case when u < 0.2 then 'val' when u < 0.2 + 0.1 then 'cal' else 'fit' end part, count(*) n, round(avg(l_quantity), 6) mean from u group by 1")
def split_parts(spark, sf_dir):
    parts = frames.split(keyed(table(spark, sf_dir, "lineitem")), {"val": 0.2, "cal": 0.1}, "k", 7)
    every = None
    for name, part in parts.items():
        own = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean"))
        every = own if every is None else every.unionByName(own)
    return every


@query(f"select l_returnflag, count(*) n, round(avg(l_extendedprice), 4) mean from lineitem where {sql_unit(3)} < 0.3 group by 1")
def subsample_rows(spark, sf_dir):
    return frames.subsample(keyed(table(spark, sf_dir, "lineitem")), 0.3, "k", 3).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 4).alias("mean"))


def _sql_poisson(u: str) -> str:
    p, total, steps = 0.36787944117144233, 0.0, []
    for k in range(12):
        p = p if k == 0 else p / k
        total += p
        steps.append(f"(case when {u} >= {total!r} then 1 else 0 end)")
    return " + ".join(steps)


@query(f"with d as (select rep, {sql_hash("'5'", 'rep::varchar', SQL_KEY)} / {frames.PRIME}.0 u, l_quantity from lineitem, (select unnest(range(0, 4)) rep)), t as (select rep, {_sql_poisson('u')} times, l_quantity from d) select rep::int replicate, sum(times)::bigint n, round(sum(times * l_quantity) / sum(times), 6) mean from t group by 1")
def bootstrap_rows(spark, sf_dir):
    """Four bootstraps of the rows, each row a Poisson number of times."""
    drawn = frames.bootstrap(keyed(table(spark, sf_dir, "lineitem")), 4, "k", 5)
    return drawn.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean"))


@query(f"with c as (select l_returnflag g, count(*) c from lineitem group by 1), m as (select g, (select min(c) from c) * 1.0 / c share from c) select l_returnflag, count(*) n from lineitem join m on l_returnflag = g where {sql_unit(0)} < share group by 1")
def undersample_counts(spark, sf_dir):
    return frames.undersample(keyed(table(spark, sf_dir, "lineitem")), "l_returnflag", "k").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select l_discount * 40 - 2 s, l_quantity y from lineitem), m as (select exp(least(greatest(s, -30), 30)) mu, y from e) select round(avg(mu), 6) mean, round(avg(power(mu, -0.5) * (y - mu)), 6) tweedie, round(avg(y / mu - 1), 6) gamma, round(avg(y - mu), 6) poisson from m")
def log_link_residuals(spark, sf_dir):
    y, s = F.col("l_quantity"), F.col("l_discount") * 40 - 2
    return table(spark, sf_dir, "lineitem").agg(r(F.avg(scalar.exp_link(s))).alias("mean"), *(r(F.avg(losses.residual(n, y, s))).alias(n) for n in ("tweedie", "gamma", "poisson")))


# Intervals and drift

_SCORE = "abs(l_extendedprice - 50000)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("score", F.abs(F.col("l_extendedprice") - 50000))


_KTH = "with s as (select {g} g, {s} s from {t}), k as (select g, s, row_number() over (partition by g order by s) rn, count(*) over (partition by g) n from s)"


@query(_KTH.format(g="1", s=_SCORE, t="lineitem") + " select round(s, 6) margin, n from k where rn = least(ceil((n+1)*0.9 - 1e-9), n)")
def conformal_margin(spark, sf_dir):
    return diagnostics.order_statistic(scored(spark, sf_dir), "score", 0.1).select(r(F.col("margin")).alias("margin"), "n")


@query(_KTH.format(g="l_returnflag", s=_SCORE, t="lineitem") + ", a as (select s, row_number() over (order by s) rn, count(*) over () n from s), o as (select s from a where rn = least(ceil((n+1)*0.9 - 1e-9), n)) select g l_returnflag, n, round(case when n >= 20000 then k.s else o.s end, 6) margin, n >= 20000 own from k, o where rn = least(ceil((n+1)*0.9 - 1e-9), n)")
def mondrian_margin(spark, sf_dir):
    return diagnostics.mondrian_margins(scored(spark, sf_dir), "score", "l_returnflag", 0.1, 20000).select("l_returnflag", "n", r(F.col("margin")).alias("margin"), "own")


@query(_KTH.format(g="1", s="greatest((20000+l_quantity*10)-l_extendedprice, l_extendedprice-(80000-l_quantity*10))", t="lineitem") + " select round(s, 6) margin from k where rn = least(ceil((n+1)*0.9 - 1e-9), n)")
def cqr_margin(spark, sf_dir):
    score = diagnostics.conformal_score(F.col("l_extendedprice"), 20000 + F.col("l_quantity") * 10, 80000 - F.col("l_quantity") * 10)
    return diagnostics.order_statistic(table(spark, sf_dir, "lineitem").withColumn("score", score), "score", 0.1).select(r(F.col("margin")).alias("margin"))


_OLD, _NEW = (3.0, 20.0, 35.0), (5.0, 22.0, 40.0)


@query(f"select round(avg(case when {case('l_quantity', _OLD)} <> {case('l_quantity', _NEW)} then 1.0 else 0.0 end), 8) migration from lineitem")
def population_migration(spark, sf_dir):
    x = F.col("l_quantity")
    return diagnostics.migration(table(spark, sf_dir, "lineitem"), scalar.zone_index(x, _OLD), scalar.zone_index(x, _NEW)).select(r(F.col("migration"), 8).alias("migration"))


@query("select o_orderpriority, round(avg(o_totalprice*1.02 - o_totalprice), 4) shift, abs(avg(o_totalprice*1.02 - o_totalprice)) > 5000 drift from orders group by 1")
def drift_flags(spark, sf_dir):
    return diagnostics.drift_flags(table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_totalprice") * 1.02, 5000.0, ["o_orderpriority"]).select("o_orderpriority", r(F.col("shift"), 4).alias("shift"), "drift")


_YEARS = "i as (select year(o_orderdate) yr, o_orderpriority term, avg(o_totalprice)/1000 importance from orders group by 1, 2)"


@query(f"with {_YEARS}, a as (select * from i where yr = 1996 and term <> '1-URGENT'), b as (select * from i where yr = 1997 and term <> '5-LOW') select coalesce(a.term, b.term) term, round(coalesce(a.importance,0), 6) old, round(coalesce(b.importance,0), 6) new, round(coalesce(b.importance,0)-coalesce(a.importance,0), 6) change from a full join b on a.term = b.term")
def importance_change(spark, sf_dir):
    i = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("term")).agg((F.avg("o_totalprice") / 1000).alias("importance"))
    found = diagnostics.importance_change(i.where("yr = 1996 and term <> '1-URGENT'"), i.where("yr = 1997 and term <> '5-LOW'"))
    return found.select("term", *(r(F.col(c)).alias(c) for c in ("old", "new", "change")))


@query("with a as (select distinct o_orderpriority term from orders where o_orderpriority < '4'), b as (select distinct o_orderpriority term from orders where o_orderpriority > '2') select term, 'new' status from b where term not in (select term from a) union all select term, 'disappeared' from a where term not in (select term from b)")
def term_changes(spark, sf_dir):
    terms = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("term")).distinct()
    return diagnostics.term_changes(terms.where("term < '4'"), terms.where("term > '2'"))


def _windows(frame: str) -> str:
    return f"with p as (select date_trunc('year', o_orderdate)::timestamp period, count(*) c, sum(o_totalprice) s from orders group by 1) select period, coalesce(sum(c) over w, 0)::bigint train_rows, round(sum(s) over w / sum(c) over w, 4) train_mean, lag(period) over (order by period) previous from p window w as (order by period rows between {frame} and 1 preceding)"


def _periods(spark, sf_dir, window: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("period", scalar.period(F.col("o_orderdate"), "year"))
    return diagnostics.period_windows(df, "period", "o_totalprice", window).withColumn("train_mean", r(F.col("train_mean"), 4))


@query(_windows("unbounded preceding"))
def period_windows_expanding(spark, sf_dir):
    return _periods(spark, sf_dir, "expanding")


@query(_windows("3 preceding"))
def period_windows_rolling(spark, sf_dir):
    return _periods(spark, sf_dir, "rolling")


# Explanation

_SWEEP = "c{k} as (select zq, zd, n, v - sum(n*v) over (partition by {z}) / sum(n) over (partition by {z}) v from c{j})"


@query(f"with {BASE}, c0 as (select zq, zd, count(*)::double n, avg(y)/1000 v from b group by 1, 2), " + ", ".join(_SWEEP.format(k=k + 1, j=k, z=("zq", "zd")[k % 2]) for k in range(6)) + " select zq, zd, round(v, 5) v from c6")
def purify_contributions(spark, sf_dir):
    table_ = lineitem(spark, sf_dir).groupBy("zq", "zd").agg(F.count(F.lit(1)).cast("double").alias("n"), (F.avg("y") / 1000).alias("value"))
    for k in range(6):
        table_ = diagnostics.purify_sweep(table_, ("zq", "zd")[k % 2])
    return table_.select("zq", "zd", r(F.col("value"), 5).alias("v"))


@query("with s as (select ((case when l_quantity < 30 then 1.0 else 0.0 end)+(case when l_discount*1000 < 30 then 1.0 else 0.0 end))/2 low, l_extendedprice > 90000 ext from lineitem), t as (select (1-low)*(case when ext then 0.5 else 1.0 end) score from s) select case when score <= 0.5 then 'Low' when score <= 0.8 then 'Medium' else 'High' end quality, count(*) n, round(avg(score), 6) score from t group by 1")
def evidence_report(spark, sf_dir):
    found = diagnostics.evidence(table(spark, sf_dir, "lineitem"), [F.col("l_quantity"), F.col("l_discount") * 1000], F.col("l_extendedprice") > 90000)
    return found.groupBy(F.col("evidence_quality").alias("quality")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("evidence_score")).alias("score"))


@query(f"with {BASE}, q as (select zd, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) median, quantile_cont(l_extendedprice, 0.75) q3 from b group by 1) select zd zone, count(*) n, round(avg(l_extendedprice), 4) mean, round(any_value(q1), 4) q1, round(any_value(median), 4) median, round(any_value(q3), 4) q3, count(*) filter (where l_extendedprice < q1-1.5*(q3-q1) or l_extendedprice > q3+1.5*(q3-q1)) outlier_count, round(avg(case when l_extendedprice between 1000 and 90000 then 0.0 else 1.0 end), 8) invalid from b join q using (zd) group by 1")
def zone_boxplot(spark, sf_dir):
    box = diagnostics.boxplot(lineitem(spark, sf_dir), "zd", "l_extendedprice", (1000.0, 90000.0))
    return box.select(F.col("zd").alias("zone"), F.col("count").alias("n"), *(r(F.col(c), 4).alias(c) for c in ("mean", "q1", "median", "q3")), "outlier_count", r(F.col("pct_business_invalid"), 8).alias("invalid"))


@query(f"with {BASE}, c as (select zd, y - 2500 c from b) select zd zone, count(*) count, round(avg(c), 4) mean, round(avg(case when c > 0 then 1.0 else 0.0 end), 8) share_positive, round(avg(case when c < 0 then 1.0 else 0.0 end), 8) share_negative from c group by 1")
def signed_contribution_profile(spark, sf_dir):
    found = diagnostics.signed_profile(lineitem(spark, sf_dir).withColumn("c", F.col("y") - 2500), "zd", "c")
    return found.select(F.col("zd").alias("zone"), "count", r(F.col("mean"), 4).alias("mean"), *(r(F.col(c), 8).alias(c) for c in ("share_positive", "share_negative")))


@query("""with t as (select p_partkey k, unnest(['baseline', 'a', 'b', 'c']) term, unnest([100.0, p_size*1.0, -p_retailprice/10, (p_partkey % 7)*1.0]) v from part),
r as (select *, row_number() over (partition by k order by (case when term = 'baseline' then 0 else 1 end), abs(v) desc, term) rn from t), s as (select k, least(rn, 3) step, case when rn > 2 then 'other' else term end term, v from r),
g as (select k, step, term, sum(v) v from s group by 1, 2, 3) select k, step, term, round(v, 6) contribution, round(sum(v) over (partition by k order by step), 6) total from g""")
def prediction_waterfall(spark, sf_dir):
    terms = F.array(*(F.struct(F.lit(n).alias("term"), v.cast("double").alias("contribution")) for n, v in (("baseline", F.lit(100.0)), ("a", F.col("p_size")), ("b", -F.col("p_retailprice") / 10), ("c", F.col("p_partkey") % 7))))
    long = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(terms).alias("t")).select("k", "t.*")
    found = diagnostics.waterfall(long, "k", 1)
    return found.select("k", F.col("step").cast("long").alias("step"), "term", r(F.col("contribution")).alias("contribution"), r(F.col("total")).alias("total"))


@query("with v as (select l_returnflag term, l_linenumber % 3 rep, sum(l_tax)/1000 v from lineitem group by 1, 2) select term, round(quantile_cont(v, 0.05), 6) low, round(quantile_cont(v, 0.95), 6) high, count(distinct rep)/3.0 frequency from v group by 1")
def bootstrap_interval(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("term"), (F.col("l_linenumber") % 3).alias("rep")).agg((F.sum("l_tax") / 1000).alias("v"))
    low_high = diagnostics.percentile_intervals(v, ["term"], "v", 0.1)
    return low_high.join(diagnostics.inclusion_frequency(v, "term", "rep", 3), "term").select("term", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), "frequency")


# Models

FEATURES = ("l_extendedprice", "l_discount", "l_quantity", "l_returnflag")
ROUNDS = {"rounds": 3, "learning_rate": 0.5, "row_share": 1.0, "column_share": 1.0}


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a stable key and a target that is a product of two of their columns."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *FEATURES, "l_shipdate", (F.expr(TARGET) / 1000).alias("y"))
    return frames.row_id(df)


def regressor(df: DataFrame, **options):
    from .estimators import ZoneRegressor

    return ZoneRegressor(FEATURES, "y", **{**ROUNDS, "validation": 0.0, **options}).fit(df)


@query()
def regressor_explain(spark, sf_dir):
    """Flagship: fit by Spark aggregates, then every row with its prediction and exact contributions."""
    df = modelled(spark, sf_dir)
    model = regressor(df)
    return model.explain(model.predict(df), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "row_id", "y", "prediction"])


@query()
def regressor_quality(spark, sf_dir):
    """Share of the target's variance that the model explains, and how far contributions lie from the prediction at most."""
    df = modelled(spark, sf_dir)
    model = regressor(df, rounds=5)
    wide = model.explain(model.predict(df), ["y", "prediction"])
    names = ["baseline", *(scalar.term_name(*t) for t in model.model.term_columns())]
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col("baseline"))
    return wide.agg(r(1 - F.avg((F.col("y") - F.col("prediction")) ** 2) / F.var_pop("y")).alias("explained"), F.max(F.abs(total - F.col("prediction"))).alias("gap"))


# Fits of one round, repeated by SQL: categories need no cuts, one term's lasso weight is a quotient.

ONE = {"rounds": 1, "learning_rate": 0.5, "row_share": 1.0, "column_share": 1.0, "alpha": 0.002, "m": 10.0, "folds": 5, "seed": 42}


def sql_round(rows: str, name: str, salt: int = 0) -> str:
    """CTEs that fit one round to ``rows`` (k, z, w, r): ``<name>`` (z, step) is what each zone's score moves by."""
    from .boost import salted

    a, b = salted(ONE["seed"], 0, 1 + salt)
    fold = f"floor((({sql_hash('k')} * {a} + {b}) % {frames.PRIME}) / {frames.PRIME}.0 * {ONE['folds']})"
    m = ONE["m"]
    return f"""{name}_f as (select *, {fold} f from {rows}),
{name}_z as (select z, sum(w) n, sum(w*r) s from {name}_f group by 1), {name}_a as (select sum(n) n, sum(s) s from {name}_z),
{name}_k as (select f, sum(w) n, sum(w*r) s from {name}_f group by 1), {name}_c as (select z, f, sum(w) n, sum(w*r) s from {name}_f group by 1, 2),
{name}_d as (select x.z, (x.s + {m} * t.s/t.n) / (x.n + {m}) - t.s/t.n dev from {name}_z x, {name}_a t),
{name}_o as (select c.z, c.f, (x.s - c.s + {m} * (t.s - y.s)/(t.n - y.n)) / (x.n - c.n + {m}) - (t.s - y.s)/(t.n - y.n) v from {name}_c c join {name}_z x using (z) join {name}_k y using (f), {name}_a t),
{name}_m as (select sum(w*v)/sum(w) mv, sum(w*r)/sum(w) mr, sum(w*v*r)/sum(w) vr, sum(w*v*v)/sum(w) vv, stddev_pop(v) sv, stddev_pop(r) sr from {name}_f join {name}_o using (z, f)),
{name}_b as (select *, (vr - mv*mr) / (sv*sr) c, (vv - mv*mv) / (sv*sv) own from {name}_m),
{name}_w as (select *, sign(c) * greatest(abs(c) - {ONE['alpha']}, 0) / own * sr / sv weight from {name}_b),
{name} as (select z, {ONE['learning_rate']} * (mr - weight*mv + weight*dev) step from {name}_d, {name}_w)"""


_CATEGORY = "case when l_linenumber = 7 then null else l_returnflag || l_linestatus end"


def categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(table(spark, sf_dir, "lineitem")).select("k", F.expr(_CATEGORY.replace("||", "||")).alias("z"), (F.col("l_extendedprice") / 1000 + F.when(F.col("l_returnflag") == "R", 10).otherwise(0)).alias("y"), (F.col("l_quantity") / 10).alias("w"), F.when(F.expr("l_returnflag = 'R' or l_linenumber > 4"), 1).otherwise(0).alias("label"), F.log("l_quantity").alias("exposure"))


_CATEGORIZED = f"x as (select {SQL_KEY} k, coalesce({_CATEGORY}, '-') z, l_extendedprice/1000 + (case when l_returnflag = 'R' then 10 else 0 end) y, l_quantity/10 w, (case when l_returnflag = 'R' or l_linenumber > 4 then 1.0 else 0.0 end) l, l_quantity e from lineitem)"


def by_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(F.coalesce("z", F.lit("-")).alias("z")).agg(F.count(F.lit(1)).alias("n"), *(r(F.avg(F.col(f"`{c}`"))).alias(c) for c in columns))


def _fitted(cls, df: DataFrame, target: str, **options):
    return cls(["z"], target, categorical=["z"], key="k", **{**ONE, "validation": 0.0, **options}).fit(df)


_RESULT = "select x.z, count(*) n, {what} from x join s on x.z = s.z, b group by x.z"


@query(f"with {_CATEGORIZED}, b as (select avg(y) m from x), rows as (select k, z, 1.0 w, y - m r from x, b), {sql_round('rows', 's')} " + _RESULT.format(what="round(avg(m + step), 6) prediction"))
def regressor_one_round(spark, sf_dir):
    from .estimators import ZoneRegressor

    df = categorized(spark, sf_dir)
    return by_zone(_fitted(ZoneRegressor, df, "y").predict(df), "prediction")


@query(f"with {_CATEGORIZED}, b as (select sum(w*y)/sum(w) m from x), rows as (select k, z, w, y - m r from x, b), {sql_round('rows', 's')} " + _RESULT.format(what="round(avg(m + step), 6) prediction"))
def weighted_one_round(spark, sf_dir):
    from .estimators import ZoneRegressor

    df = categorized(spark, sf_dir)
    return by_zone(_fitted(ZoneRegressor, df, "y", weight="w").predict(df), "prediction")


@query(f"with {_CATEGORIZED}, b as (select ln(sum(y) / sum(e)) m from x), rows as (select k, z, 1.0 w, y - exp(m + ln(e)) r from x, b), {sql_round('rows', 's')} " + _RESULT.format(what="round(avg(exp(m + ln(e) + step)), 6) prediction"))
def poisson_one_round(spark, sf_dir):
    from .estimators import ZoneRegressor

    df = categorized(spark, sf_dir)
    return by_zone(_fitted(ZoneRegressor, df, "y", offset="exposure", loss="poisson").predict(df), "prediction")


@query(f"with {_CATEGORIZED}, b as (select ln(avg(l) / (1 - avg(l))) m, avg(l) p from x), rows as (select k, z, 1.0 w, l - p r from x, b), {sql_round('rows', 's')} " + _RESULT.format(what="round(avg(1 / (1 + exp(-(m + step)))), 6) p_1"))
def classifier_one_round(spark, sf_dir):
    from .estimators import ZoneClassifier

    df = categorized(spark, sf_dir)
    return by_zone(_fitted(ZoneClassifier, df, "label").predict(df), "p_1")


_CLASSES = ("F", "O", "P")
_ORDERS = "x as (select o_orderkey::varchar k, o_orderpriority z, o_orderstatus c from orders)"
_BASES = "b as (select " + ", ".join(f"avg(case when c = '{c}' then 1.0 else 0.0 end) {c.lower()}" for c in _CLASSES) + " from x)"
_JOINED = " join ".join(f"s{i}" + ("" if i == 0 else f" on s{i}.z = s0.z") for i in range(3))


@query(f"with {_ORDERS}, {_BASES}, " + ", ".join(f"r{i} as (select k, z, 1.0 w, (case when c = '{c}' then 1.0 else 0.0 end) - {c.lower()} r from x, b), " + sql_round(f"r{i}", f"s{i}", i) for i, c in enumerate(_CLASSES)) + f", j as (select s0.z, s0.step a, s1.step o, s2.step p, (s0.step + s1.step + s2.step)/3 mean from {_JOINED}), e as (select z, f*exp(a - mean) f, b.o*exp(j.o - mean) o, b.p*exp(j.p - mean) p from j, b) select z, round(f/(f+o+p), 8) \"p_F\", round(o/(f+o+p), 8) \"p_O\", round(p/(f+o+p), 8) \"p_P\" from e")
def softmax_one_round(spark, sf_dir):
    """Joint softmax of three classes: each class's step from its own residual, centred."""
    from .estimators import ZoneClassifier

    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("z"), F.col("o_orderstatus").alias("c"))
    found = _fitted(ZoneClassifier, df, "c").predict(df).select("z", *(r(F.col(f"p_{c}"), 8).alias(f"p_{c}") for c in _CLASSES))
    return found.distinct()


# A given model, repeated by its own SQL.


def given_model(shift: float = 0.0):
    """Mains with and without smoothing, a spline, a category, pairs of numbers and of a number and a category."""
    import numpy as np

    from .model import Model, Round, Spline, Zoning

    quantity = Zoning("l_quantity", [11.0, 31.0], [5.0, 20.0, 42.0])
    partly = Zoning("l_quantity", [21.0], [10.0, 35.0], lam=0.4)
    discount = Zoning("l_discount", [0.035, 0.065], [0.01, 0.05, 0.085])
    flag = Zoning("l_returnflag", categories=["A", "N"])
    q, d, f = ("l_quantity",), ("l_discount",), ("l_returnflag",)
    first = Round({"l_quantity": quantity, "l_discount": discount, "l_returnflag": flag}, {q: np.array([1.0, 2.5, 3.25 + shift, -1.0]), d: np.array([-0.5, 0.75, 1.5, 0.0]), f: np.array([0.5, -0.25, 0.1, 0.9]), q + d: np.arange(16.0).reshape(4, 4) / 10, f + d: np.arange(16.0).reshape(4, 4)[::-1] / 20}, {q: 0.8, d: 1.1, f: 0.7, q + d: 0.5, f + d: -0.4}, 0.2)
    second = Round({"l_quantity": partly, "l_discount": discount}, {q: np.array([0.4, -0.6, 0.3]), d: Spline([0.02, 0.07], [0.1, 3.0, -5.0, 9.0 + shift], -0.2)}, {q: 0.9, d: 0.6}, -0.1)
    return Model(2.0, 0.5, [first, second])


_GIVEN_FEATURES = ("l_quantity", "l_discount", "l_returnflag")


def given(spark: SparkSession, sf_dir: str, shift: float = 0.0, **options):
    """The given model as an estimator, and lineitem with its key, target and some unknown and missing values."""
    from .estimators import ZoneRegressor

    df = keyed(table(spark, sf_dir, "lineitem")).withColumns({"l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), "y": F.col("l_extendedprice") / 10000})
    model = ZoneRegressor(_GIVEN_FEATURES, "y", key="k", **options)
    return model.with_model(given_model(shift), df.where(frames.unit_hash(F.col("k"), seed=9) < 0.4), df), df


_GIVEN = f"g as (select * replace (case when l_linenumber <> 3 then l_quantity end as l_quantity), {SQL_KEY} k, l_extendedprice/10000 y from lineitem)"
_KEYS = ["k", "l_returnflag", "y"]


@query(f"with {_GIVEN}, p as ({given_model().to_sql('g', keys=_KEYS)}) select k, round(prediction, 9) prediction from p")
def scorecard_sql(spark, sf_dir):
    """The scorecard that `to_sql` writes, run by another engine, against the engine's own predictions."""
    model, df = given(spark, sf_dir)
    return model.predict(df).select("k", r(F.col("prediction"), 9).alias("prediction"))


@query(f"with {_GIVEN}, p as ({given_model().to_sql('g', keys=_KEYS)}), e as (select l_returnflag g, abs(y - prediction) e from p where {sql_unit(9, 'k')} < 0.4), n as (select g, e, row_number() over (partition by g order by e) rn, count(*) over (partition by g) n from e), m as (select g, e margin from n where rn = least(ceil((n+1)*0.9 - 1e-9), n)) select l_returnflag, count(*) n, round(avg(prediction - margin), 6) lower, round(avg(prediction + margin), 6) upper, round(avg(case when abs(y - prediction) <= margin then 1.0 else 0.0 end), 6) covered from p join m on g = l_returnflag group by 1")
def given_interval(spark, sf_dir):
    """Split conformal intervals by group around the given model."""
    model, df = given(spark, sf_dir, mondrian="l_returnflag")
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    return model.predict_interval(df, 0.1).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("lower")).alias("lower"), r(F.avg("upper")).alias("upper"), r(F.avg(inside)).alias("covered"))


@query(f"with {_GIVEN} " + " union all ".join(f"select '{scalar.term_name(*t)}' term, round(avg(abs(prediction)), 8) importance from ({given_model().only(t).to_sql('g')})" for t in given_model().terms()))
def given_importance(spark, sf_dir):
    model, df = given(spark, sf_dir)
    return model.importance(df).select("term", r(F.col("importance"), 8).alias("importance"))


_EDITED = given_model().only(("l_discount",)).to_sql("g", keys=["k", "l_discount"])


@query(f"with {_GIVEN}, p as ({_EDITED}), e as (select l_discount between 0.0 and 0.03 touched, (case when l_discount between 0.0 and 0.03 then -1.0 else prediction end) - prediction change from p) select count(*) filter (where touched) rows_touched, round(avg(change), 8) mean_change, round(max(abs(change)), 8) max_change from e")
def given_edit(spark, sf_dir):
    """A governed edit of one column's effect, and what it changes."""
    model, df = given(spark, sf_dir)
    return model.edit_report(df, "l_discount", 0.0, 0.03, -1.0).select("rows_touched", r(F.col("mean_change"), 8).alias("mean_change"), r(F.col("max_change"), 8).alias("max_change"))


_GRID = "t as (select k, x.l_quantity, 0.01 + i * (0.085 - 0.01) / 15 l_discount, x.l_returnflag from g x, (select unnest(range(0, 16)) i))"


@query(f"with {_GIVEN}, {_GRID}, p as ({given_model().to_sql('t', keys=['k', 'l_discount'])}), a as (select k, l_discount, abs(prediction - 3.1) gap, row_number() over (partition by k, l_discount) one from p), n as (select *, row_number() over (partition by k order by gap, l_discount) rn from a where one = 1) select k, round(gap, 8) gap from n where rn = 1 and k in (select k from g group by k having count(*) = 1)")
def counterfactual(spark, sf_dir):
    """For every row the discount whose score is nearest to 3.1, on a grid tried within the row."""
    model, df = given(spark, sf_dir)
    found = model.counterfactual(df, "l_discount", 3.1, 16)
    once = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("k")
    return found.join(once, "k").select("k", r(F.col("gap"), 8).alias("gap"))


@query(f"with {_GIVEN}, a as ({given_model().to_sql('g', 'a', keys=['k'])}), b as ({given_model(0.5).to_sql('g', 'b', keys=['k'])}), j as (select (select avg(a) from a) a, (select avg(b) from b) b) select round(b - a, 8) shift, abs(b - a) > 0.05 drift, round((select avg((y - prediction)*(y - prediction)) from ({given_model().to_sql('g', keys=['y'])})), 8) old_loss, round((select avg((y - prediction)*(y - prediction)) from ({given_model(0.5).to_sql('g', keys=['y'])})), 8) new_loss from j")
def given_comparison(spark, sf_dir):
    """Prediction shift and losses of two given models over the same rows."""
    from .estimators import compare_models

    (old, df), (new, _) = given(spark, sf_dir), given(spark, sf_dir, 0.5)
    found = compare_models(old, new, df, 0.05)
    rounded = lambda part: part.select(*(r(F.col(c), 8).alias(c) if c != "drift" else F.col(c) for c in part.columns))
    return rounded(found["prediction"]).crossJoin(rounded(found["performance"]))  # one row each


@query(f"with {_GIVEN}, a as ({given_model().to_sql('g', 'a', keys=['k', 'l_returnflag'])}), b as ({given_model(0.5).to_sql('g', 'b', keys=['k', 'l_returnflag'])}), j as (select l_returnflag, avg(a) m from a group by 1), i as (select l_returnflag, avg(b) m from b group by 1) select l_returnflag, round((j.m + i.m) / 2, 8) prediction from j join i using (l_returnflag)")
def given_forest(spark, sf_dir):
    """The mean of two given models."""
    from .estimators import ZoneForest

    _, df = given(spark, sf_dir)
    forest = ZoneForest(_GIVEN_FEATURES, "y", estimators=2, key="k")
    forest.models = [given_model(), given_model(0.5)]
    return forest.predict(df).groupBy("l_returnflag").agg(r(F.avg("prediction"), 8).alias("prediction"))


def given_rate():
    import numpy as np

    from .model import Model, Round, Zoning

    value, start = Zoning("value", [50.0], [20.0, 70.0]), Zoning("interval_start", [1.0, 15.0], [0.0, 10.0, 20.0])
    r_ = Round({"value": value, "interval_start": start}, {("value",): np.array([0.2, -0.3, 0.1]), ("interval_start",): np.array([0.3, -0.1, -0.4, 0.0])}, {("value",): 1.0, ("interval_start",): 1.0}, 0.0)
    return Model(-3.0, 1.0, [r_])


@query()
def regressor_interval(spark, sf_dir):
    df = modelled(spark, sf_dir)
    model = regressor(df, calibration=0.2, rounds=3, mondrian="l_returnflag")
    return model.predict_interval(df).select("row_id", "l_returnflag", "y", "prediction", "lower", "upper")


@query()
def regressor_importance(spark, sf_dir):
    df = modelled(spark, sf_dir)
    return regressor(df, rounds=3).importance(df)


@query()
def poisson_model(spark, sf_dir):
    df = frames.row_id(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", (F.col("l_discount") * 100).alias("y"), F.log(F.col("l_quantity")).alias("exposure")))
    from .estimators import ZoneRegressor

    model = ZoneRegressor(["l_tax", "l_returnflag", "l_quantity"], "y", offset="exposure", loss="poisson", **{**ROUNDS, "rounds": 3}, validation=0.0).fit(df)
    return model.predict(df).select("row_id", "y", "prediction")


@query()
def classifier_binary(spark, sf_dir):
    from .estimators import ZoneClassifier

    df = modelled(spark, sf_dir).withColumn("label", F.when(F.col("y") > 3, 1).otherwise(0))
    return ZoneClassifier(FEATURES, "label", **{**ROUNDS, "rounds": 3}).fit(df).predict(df).select("row_id", "label", "p_0", "p_1", "predicted")


@query()
def classifier_softmax(spark, sf_dir):
    from .estimators import ZoneClassifier

    df = frames.row_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"))
    found = ZoneClassifier(["o_totalprice", "o_orderpriority"], "o_orderstatus", **{**ROUNDS, "rounds": 2}).fit(df).predict(df)
    return found.drop("row_id", "o_totalprice")


@query()
def zone_forest(spark, sf_dir):
    from .estimators import ZoneForest

    df = modelled(spark, sf_dir)
    return ZoneForest(FEATURES, "y", estimators=4, rounds=5, learning_rate=0.5).fit(df).predict(df).select("row_id", "y", "prediction")


@query()
def bootstrap_stability(spark, sf_dir):
    from .estimators import BootstrapStability

    df = modelled(spark, sf_dir)
    fitted = BootstrapStability(FEATURES, "y", estimators=4, rounds=3, learning_rate=0.5).fit(df)
    frequency, interval = fitted.inclusion(), fitted.importance_interval()
    return spark.createDataFrame([(t, float(frequency.get(t, 0.0)), float(a), float(b)) for t, (a, b) in interval.items()], "term string, frequency double, low double, high double")


@query()
def survival_model(spark, sf_dir):
    from .estimators import ZoneSurvival

    df = frames.row_id(gaps(spark, sf_dir))
    model = ZoneSurvival(["value"], "d", "e", intervals=3, **{**ROUNDS, "rounds": 2}, validation=0.0).fit(df)
    return model.predict_hazard(df, F.lit(24.0))


@query()
def time_series_models(spark, sf_dir):
    from .estimators import ZoneTimeSeries

    df = frames.row_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", (F.col("o_totalprice") * (F.year("o_orderdate") - 1994)).alias("y")))
    model = ZoneTimeSeries(["o_totalprice", "o_orderpriority"], "y", "o_orderdate", "year", rounds=3, learning_rate=0.5).fit(df)
    return model.predict(df).select("o_orderkey", "y", "prediction")


@query()
def conformal_quantiles(spark, sf_dir):
    from .estimators import ConformalQuantiles

    df = modelled(spark, sf_dir)
    return ConformalQuantiles(FEATURES[:3], "y", validation=0.0, **{**ROUNDS, "rounds": 2}).fit(df).predict_interval(df).select("row_id", "y", "lower", "upper")


@query()
def model_comparison(spark, sf_dir):
    from .estimators import compare_models

    df = modelled(spark, sf_dir)
    return compare_models(regressor(df.where("year(l_shipdate) < 1998"), rounds=2), regressor(df.where("year(l_shipdate) >= 1998"), rounds=2), df)["importance"]


@query()
def model_evidence(spark, sf_dir):
    df = modelled(spark, sf_dir)
    return regressor(df, rounds=1).reliability(df).select("row_id", "pct_sparse", "extrapolates", "evidence_score", "evidence_quality")


@query()
def spline_effect(spark, sf_dir):
    """Hinge-basis ridge of the discount amount on the discount."""
    intercept, slope, bends = cells.fit_spline(lineitem(spark, sf_dir), "l_discount", "y", (0.03, 0.07))
    return spark.createDataFrame([(intercept, slope, *bends)], "intercept double, slope double, bend_low double, bend_high double")


@query()
def evidence_card(spark, sf_dir):
    df = modelled(spark, sf_dir)
    return spark.createDataFrame([(regressor(df, rounds=1).card(df),)], "card string")
