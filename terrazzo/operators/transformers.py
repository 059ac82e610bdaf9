"""Feature transformers: ``fit(df)`` aggregates once, ``transform(df)`` adds columns.

Output columns are named ``<column or group>__<what>``. Fitted state is small
and plain (cuts, centers, cell tables); transforms are narrow or join a table
of a checked size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import array_literal, category_index, coreness, days, half_life_name, mahalanobis, zone_index
from . import cells, zones
from .joins import MAX_BROADCAST_ROWS
from .joins import lookup as _lookup

class ZoneProfile:
    """Mean, count and variance of a target in each zone of each column, shrunk by a learned m."""

    def __init__(self, columns: Sequence[str], target: str, categorical: Sequence[str] = (), max_zones: int = zones.MAX_ZONES, weight: str | None = None):
        self.columns, self.target, self.categorical, self.max_zones, self.weight = list(columns), target, set(categorical), max_zones, weight

    def fit(self, df: DataFrame) -> ZoneProfile:
        self.zones, self.tables = {}, {}
        for c in self.columns:
            if c in self.categorical:
                own = zones.categories(df, c)
                self.zones[c], n = (lambda c=c, own=own: category_index(F.col(c), own)), len(own) + 2
            else:
                cuts = zones.adaptive_cuts(df, c, self.target, self.weight, self.max_zones)
                self.zones[c], n = (lambda c=c, cuts=cuts: zone_index(F.col(c), cuts)), len(cuts) + 2
            stats = cells.zone_stats(df.withColumn("_z", self.zones[c]()), ["_z"], self.target, self.weight).collect()
            total = sum(r["n"] for r in stats)
            overall = sum(r["n"] * r["mean"] for r in stats) / total if total else 0.0
            m = dersimonian_laird([r["n"] for r in stats], [r["mean"] for r in stats], [r["var"] for r in stats])
            table = [(overall, 0.0, 0.0)] * n
            for r in stats:
                table[r["_z"]] = ((r["n"] * r["mean"] + m * overall) / (r["n"] + m), r["n"], r["var"])
            self.tables[c] = table
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            z = self.zones[c]()
            for k, what in enumerate(("mean", "count", "var")):
                new[f"{c}__zone_{what}"] = F.get(array_literal([row[k] for row in self.tables[c]]), z)
        return df.withColumns(new)


def dersimonian_laird(n: Sequence[float], mean: Sequence[float], var: Sequence[float], fallback: float = cells.FALLBACK_M) -> float:
    """Shrinkage m from cell counts, means and variances; the fallback if it cannot be told."""
    n, mean, var = (np.asarray(v, dtype=float) for v in (n, mean, var))
    used = n > 0
    n, mean, var = n[used], mean[used], var[used]
    if len(n) <= 1:
        return fallback
    within = float((n * var).sum() / n.sum())
    if within <= 0:
        return fallback
    weight = n / within
    center = (weight * mean).sum() / weight.sum()
    below = weight.sum() - (weight**2).sum() / weight.sum()
    tau2 = max(0.0, ((weight * (mean - center) ** 2).sum() - (len(n) - 1)) / below) if below > 0 else 0.0
    return within / tau2 if tau2 > 0 else fallback


class Depth:
    """Mahalanobis distance from the center of a group of columns, and 1 / (1 + distance)."""

    def __init__(self, group: str, columns: Sequence[str], weight: str | None = None, ridge: float = 1e-6):
        if not columns:
            raise ValueError("columns are needed")
        self.group, self.columns, self.weight, self.ridge = group, list(columns), weight, ridge

    def fit(self, df: DataFrame) -> Depth:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        x = [F.col(c).cast("double") for c in self.columns]
        p = len(x)
        complete = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in self.columns)))
        first = complete.agg(F.sum(w).alias("w"), *(F.sum(w * v).alias(f"s{i}") for i, v in enumerate(x))).first()
        if not first["w"]:
            raise ValueError("no complete row")
        self.center = [first[f"s{i}"] / first["w"] for i in range(p)]
        # Centered second moments: no cancellation.
        gap = [v - F.lit(m) for v, m in zip(x, self.center)]
        second = complete.agg(*(F.sum(w * gap[i] * gap[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).first()
        cov = np.array([[second[f"c{min(i, j)}_{max(i, j)}"] / first["w"] for j in range(p)] for i in range(p)])
        self.inverse = np.linalg.pinv(cov + self.ridge * np.eye(p)).tolist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        distance = mahalanobis([F.col(c).cast("double") for c in self.columns], self.center, self.inverse)
        return df.withColumns({f"{self.group}__depth_distance": distance, f"{self.group}__coreness": coreness(distance)})


class DepthCrowd:
    """Agreement of several experts' scores: after ranking, mean, median, deviation, least, votes below a threshold and the least expert.

    A rank is the share of the fitted rows with that score or a lower one,
    exact however many scores there are; a missing score comes last, with 1.
    """

    def __init__(self, columns: Sequence[str], threshold: float = 0.05, rank: bool = True, name: str = "crowd"):
        if len(columns) < 2 or not 0 <= threshold <= 1:
            raise ValueError("two columns at least, and a threshold in [0, 1]")
        self.columns, self.threshold, self.rank, self.name = list(columns), threshold, rank, name

    def fit(self, df: DataFrame) -> DepthCrowd:
        """Edges of quantile blocks of each column and the rows before each block; the rows themselves stay a table."""
        if self.rank:
            self.fitted = _scores(df, self.columns)
            self.edges, self.before, self.rows = zones.quantile_blocks(self.fitted)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.rank:
            ranked, ranks = df, [F.col(c).cast("double") for c in self.columns]
        else:
            ranked, ranks = self._ranked(df)
        scored = ranked.withColumn("_r", F.array(*ranks)).select(*df.columns, "_r")
        return crowd_columns(scored, "_r", self.columns, self.threshold, self.name).drop("_r")

    def _ranked(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``df`` with a column for each expert's rank, joined by value, and the ranks.

        Distinct values are ordered inside their block, by one task a block.
        Tables are broadcast while they have ``MAX_BROADCAST_ROWS`` rows
        together (counted within 2 %), else shuffled.
        """
        wanted = _scores(df, self.columns)
        sizes = wanted.agg(*(F.approx_count_distinct(c, 0.02).alias(c) for c in wanted.columns)).first()
        room, ranks = MAX_BROADCAST_ROWS, {}
        for c in sorted(wanted.columns, key=lambda c: sizes[c]):
            i = wanted.columns.index(c)
            table = zones.shares_up_to(self.fitted, wanted, c, self.edges[i], self.before[i], self.rows)
            room -= sizes[c]
            score = _score(df, self.columns[i])
            df = df.join(F.broadcast(table) if room >= 0 else table.hint("merge"), score == F.col(c), "left")
            ranks[i] = F.when(score.isNull(), 1.0).otherwise(F.col(f"{c}_share"))
        return df, [ranks[i] for i in range(len(ranks))]


def _score(df: DataFrame, c: str) -> Column:
    """A number as it is, so that large keys stay distinct; anything else as a double."""
    return F.col(c) if isinstance(df.select(c).schema[0].dataType, NumericType) else F.col(c).cast("double")


def _scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(_score(df, c).alias(f"_x{i}") for i, c in enumerate(columns)))


def crowd_columns(df: DataFrame, ranks: str, names: Sequence[str], threshold: float, name: str = "crowd") -> DataFrame:
    """The seven crowd columns from an array of ranks; the first column wins a tie for the least."""
    r, k = F.col(ranks), len(names)
    total = F.aggregate(r, F.lit(0.0), lambda a, v: a + v)
    mean = total / k
    ordered = F.array_sort(r)
    median = F.get(ordered, F.lit(k // 2)) if k % 2 else (F.get(ordered, F.lit(k // 2 - 1)) + F.get(ordered, F.lit(k // 2))) / 2
    spread = F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / k)
    votes = F.size(F.filter(r, lambda v: v <= threshold))
    least = F.array_min(r)
    expert = F.get(array_literal(names, "array<string>"), (F.array_position(r, least) - 1).cast("int"))
    return df.withColumns({f"{name}__mean": mean, f"{name}__median": median, f"{name}__std": spread, f"{name}__min": least, f"{name}__vote_count": votes, f"{name}__vote_share": votes / k, f"{name}__most_atypical_expert": expert})


class CategoricalDepth:
    """How common a row's combination of categories is: its count in the fitted data and that over all rows."""

    def __init__(self, group: str, columns: Sequence[str]):
        self.group, self.columns = group, list(columns)

    def fit(self, df: DataFrame) -> CategoricalDepth:
        self.table = df.groupBy(*(F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(self.columns))).agg(F.count(F.lit(1)).alias("_count"))
        self.rows = df.count()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, c in enumerate(self.columns):
            same = same & F.col(c).cast("string").eqNullSafe(F.col(f"_{i}"))
        count = F.coalesce(F.col("_count"), F.lit(0))
        joined = _lookup(df, self.table, same).withColumns({f"{self.group}__count": count, f"{self.group}__coreness": count / max(self.rows, 1)})
        return joined.drop("_count", *(f"_{i}" for i in range(len(self.columns))))


class ConditionalGrid:
    """Cell statistics of a target over two columns, cut anew for each segment; the pooled grid where a segment is too light or unseen.

    A segment is a combination of values of one or more columns (null is a
    value of its own). Each one with a weight of ``least`` has its own cuts of
    both columns and its own shrinkage, learned where ``m`` is None. Cuts that
    are given hold for all segments.
    """

    def __init__(self, a: str, b: str, target: str, segment: str | Sequence[str], cuts_a: Sequence[float] | None = None, cuts_b: Sequence[float] | None = None, least: float = 50.0, m: float | None = None, max_zones: int = zones.MAX_ZONES, weight: str | None = None, criterion: str = "variance"):
        if a == b:
            raise ValueError("a grid needs two different columns")
        self.a, self.b, self.target, self.weight = a, b, target, weight
        self.segment = [segment] if isinstance(segment, str) else list(segment)
        self.least, self.m, self.max_zones, self.criterion = least, m, max_zones, criterion
        self.cuts = {a: cuts_a, b: cuts_b}

    def _key(self) -> Column:
        return F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.segment))))

    def _zone(self, x: Column, own: str, pooled: Sequence[float]) -> Column:
        cuts = F.coalesce(F.col(own), array_literal(pooled))
        return F.when(x.isNull(), F.size(cuts) + 1).otherwise(F.size(F.filter(cuts, lambda c: c <= x)))

    def fit(self, df: DataFrame) -> ConditionalGrid:
        w, weight = (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)), "_w" if self.weight else None
        double = lambda c: F.col(c).cast("double")
        rows = df.where(double(self.target).isNotNull()).select(self._key().alias("_s"), double(self.a).alias("_a"), double(self.b).alias("_b"), double(self.target).alias("_y"), w.alias("_w"))
        weigh = rows.groupBy(F.col("_s").alias("_k")).agg(F.sum("_w").alias("_kw"), F.try_divide(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).alias("_o")).persist()  # one row for each segment
        self.overall = weigh.agg(F.try_divide(F.sum(F.col("_kw") * F.col("_o")), F.sum("_kw"))).first()[0]
        segments = weigh.where(F.col("_kw") >= self.least).drop("_kw")
        sides = [(self.a, "_a", "_ca"), (self.b, "_b", "_cb")]
        self.pooled = {c: sorted(map(float, self.cuts[c])) for c, _, _ in sides if self.cuts[c] is not None}
        wanted = [(c, x) for c, x, _ in sides if c not in self.pooled]
        if wanted:
            # Both columns of every segment, and of all rows under the empty key, in one pass.
            packed = F.array(*(F.struct(F.concat(F.lit(x), key).alias("_g"), F.col(x).alias("_x")) for _, x in wanted for key in (F.col("_s"), F.lit(""))))
            found = zones.segment_cuts(rows.select(F.explode(packed).alias("_e"), "_y", "_w").select("_e.*", "_y", "_w"), "_g", "_x", "_y", weight, self.max_zones, criterion=self.criterion).persist()
            everywhere = {r["segment"]: r["cuts"] for r in found.where(F.col("segment").isin([x for _, x in wanted])).collect()}
            self.pooled.update({c: everywhere.get(x, []) for c, x in wanted})
        for c, x, own in sides:
            if self.cuts[c] is not None:
                segments = segments.withColumn(own, F.lit(None).cast("array<double>"))
                continue
            # A segment without any value of the column has no cuts, not the pooled ones.
            cut = found.select(F.col("segment").alias("_j"), F.col("cuts").alias(own))
            segments = segments.join(cut, F.concat(F.lit(x), F.col("_k")) == F.col("_j"), "left").drop("_j").withColumn(own, F.coalesce(own, F.array().cast("array<double>")))
        self.segments = segments.persist()
        own = self._zoned(rows, F.col("_s"), F.col("_a"), F.col("_b"))
        grids = F.array(F.struct(F.col("_k").alias("_g"), "_za", "_zb"), F.struct(F.lit("").alias("_g"), zone_index(F.col("_a"), self.pooled[self.a]).alias("_za"), zone_index(F.col("_b"), self.pooled[self.b]).alias("_zb")))
        both = own.select(F.explode(grids).alias("_e"), "_y", "_w").select("_e.*", "_y", "_w").where("_g is not null")
        self.table = self._shrunk(cells.zone_stats(both, ["_g", "_za", "_zb"], "_y", weight)).persist()
        return self

    def _zoned(self, df: DataFrame, key: Column, a: Column, b: Column) -> DataFrame:
        """``df`` with its grid (the segment's key, or the empty text for the pooled one) and zones _g, _za, _zb; _k and _o stay."""
        found = _lookup(df.withColumn("_r", key), self.segments, F.expr("_r = _k"))
        found = found.withColumns({"_g": F.coalesce(F.col("_k"), F.lit("")), "_za": self._zone(a, "_ca", self.pooled[self.a]), "_zb": self._zone(b, "_cb", self.pooled[self.b])})
        return found.drop("_r", "_ca", "_cb")

    def _shrunk(self, stats: DataFrame) -> DataFrame:
        """Cells with their means shrunk to their grid's; windows run over the cells of one grid."""
        grid = Window.partitionBy("_g")
        n = F.sum("n").over(grid)
        placed = stats.withColumns({"_gn": n, "_go": F.try_divide(F.sum(F.col("n") * F.col("mean")).over(grid), n), "_gk": F.count(F.lit(1)).over(grid), "_gnn": F.sum(F.col("n") * F.col("n")).over(grid)})
        gap = F.col("n") * (F.col("mean") - F.col("_go")) ** 2
        placed = placed.withColumns({"_gq": F.sum(gap).over(grid), "_gv": F.try_divide(F.sum(F.col("n") * F.col("var") + gap).over(grid), F.col("_gn"))})
        m = F.lit(float(self.m)) if self.m is not None else F.lit(None).cast("double")
        if self.m is None:
            spare = F.col("_gn") - F.try_divide(F.col("_gnn"), F.col("_gn"))
            between = F.try_divide(F.try_divide(F.col("_gq"), F.col("_gv")) - (F.col("_gk") - 1), F.try_divide(spare, F.col("_gv")))
            usable = (F.col("_gk") > 1) & (F.col("_gv") > 0) & (spare > 0) & (between > 0)
            m = F.when(usable, F.try_divide(F.col("_gv"), between)).otherwise(F.lit(cells.FALLBACK_M))
        return placed.select(F.col("_g").alias("_h"), F.col("_za").alias("_ha"), F.col("_zb").alias("_hb"), cells.shrunk(F.col("n"), F.col("mean"), F.col("_go"), m).alias("_mean"), F.col("n").alias("_n"), F.col("var").alias("_var"))

    def transform(self, df: DataFrame) -> DataFrame:
        row = self._zoned(df, self._key(), F.col(self.a).cast("double"), F.col(self.b).cast("double"))
        row = _lookup(row, self.table, F.expr("_g = _h and _za = _ha and _zb = _hb"))
        name, zero = f"{self.a}_{self.b}", F.lit(0.0)
        empty = F.coalesce(F.col("_o"), F.lit(self.overall))
        out = row.withColumns({f"{name}__cell_mean": F.coalesce(F.col("_mean"), empty), f"{name}__cell_count": F.coalesce(F.col("_n"), zero), f"{name}__cell_var": F.coalesce(F.col("_var"), zero), f"{name}__used_segment_grid": F.col("_k").isNotNull()})
        return out.drop("_k", "_o", "_g", "_za", "_zb", "_h", "_ha", "_hb", "_mean", "_n", "_var")


class DecayedHistory:
    """Events up to and including an instant, each weighted by 2 ** -(age / half-life).

    Time is cut into buckets of one half-life. Inside a bucket, events and the
    instants asked for meet in one sorted running sum; what earlier buckets
    carry over is the sum of their totals, halved once for each bucket between
    (``CARRIED`` buckets back it is below a double's precision). So neither
    side is multiplied by the other, and a hot entity is spread by its buckets.
    """

    CARRIED = 64

    def __init__(self, entity: str, time: str, values: Sequence[str], half_lives: Sequence[float], group: str = "history"):
        if not half_lives or min(half_lives) <= 0:
            raise ValueError("half-lives must be positive")
        self.entity, self.time, self.values, self.half_lives, self.group = entity, time, list(values), list(half_lives), group

    def fit(self, events: DataFrame) -> DecayedHistory:
        if events.where(F.col(self.time).isNull()).limit(1).count():
            raise ValueError("an event has no time")
        # Events of one entity and instant are one row from here on.
        sums = [F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(f"_v{i}") for i, v in enumerate(self.values)]
        self.events = events.where(F.col(self.entity).isNotNull()).groupBy(F.col(self.entity).alias("_e"), days(F.col(self.time)).alias("_t")).agg(F.count(F.lit(1)).cast("double").alias("_c"), *sums)
        return self

    def _decayed(self, wanted: DataFrame, half_life: float) -> DataFrame:
        """_e, _t and the decayed sums s0.. at each wanted instant."""
        h, names = float(half_life), ["_c", *(f"_v{i}" for i in range(len(self.values)))]
        inside = lambda t: F.pow(F.lit(2.0), (F.col(t) - F.col("_b") * h) / h)  # noqa: E731  in [1, 2)
        bucket = F.floor(F.col("_t") / h).alias("_b")
        events = self.events.select("_e", "_t", bucket, F.lit(0).alias("_o"), *names)
        asked = wanted.select("_e", "_t", bucket, F.lit(1).alias("_o"), *(F.lit(0.0).alias(n) for n in names))
        running = Window.partitionBy("_e", "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = events.unionByName(asked).select("_e", "_t", "_b", "_o", *((F.sum(F.col(n) * inside("_t")).over(running)).alias(f"w{k}") for k, n in enumerate(names))).where("_o = 1")
        totals = events.groupBy("_e", "_b").agg(*(F.sum(F.col(n) * inside("_t") / 2.0).alias(f"d{k}") for k, n in enumerate(names)))
        after = totals.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(self.CARRIED - 1))))
        carried = after.groupBy(F.col("_e").alias("_ce"), (F.col("_b") + 1 + F.col("_back")).alias("_cb")).agg(*(F.sum(F.col(f"d{k}") * F.pow(F.lit(2.0), -F.col("_back"))).alias(f"c{k}") for k in range(len(names))))
        both = within.join(carried, F.expr("_e = _ce and _b = _cb"), "left")
        return both.select("_e", "_t", *(((F.col(f"w{k}") + F.coalesce(F.col(f"c{k}"), F.lit(0.0))) / inside("_t")).alias(f"s{k}") for k in range(len(names))))

    def transform(self, df: DataFrame, asof: str) -> DataFrame:
        keyed = df.withColumn("_at", days(F.col(asof)))
        wanted = keyed.where(F.col(self.entity).isNotNull() & F.col("_at").isNotNull()).select(F.col(self.entity).alias("_e"), F.col("_at").alias("_t")).distinct()
        first = self.events.groupBy(F.col("_e").alias("_xe")).agg(F.min("_t").alias("_first"))
        name = f"{self.group}__had_history"
        found = wanted.join(first, F.expr("_e = _xe"), "left").select("_e", "_t", F.when(F.col("_first") <= F.col("_t"), 1).otherwise(0).alias(name))
        columns = [name]
        for h in self.half_lives:
            tag = half_life_name(h)
            out = [f"{self.group}__event_decay_count_{tag}d", *(f"{self.group}__{v}__laplace_{tag}d" for v in self.values)]
            found = found.join(self._decayed(wanted, h).withColumnsRenamed({f"s{k}": c for k, c in enumerate(out)}), ["_e", "_t"], "left")
            columns += out
        found = found.withColumnsRenamed({"_e": "_fe", "_t": "_ft"})
        joined = keyed.join(found, (F.col(self.entity) == F.col("_fe")) & (F.col("_at") == F.col("_ft")), "left")
        return joined.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0 if c == name else 0.0)) for c in columns}).drop("_at", "_fe", "_ft")


class FeatureSpace:
    """Several fitted transformers as one; and which columns' products explain what is left of a target."""

    def __init__(self, transformers: Sequence):
        self.transformers = list(transformers)

    def fit(self, df: DataFrame) -> FeatureSpace:
        for t in self.transformers:
            t.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for t in self.transformers:
            df = t.transform(df)
        return df

    def explain(self, values: dict[str, float]) -> dict[str, float]:
        """Values of output columns summed by the column or group before ``__``."""
        out: dict[str, float] = {}
        for name, value in values.items():
            source = name.split("__", 1)[0]
            out[source] = out.get(source, 0.0) + value
        return out


def suggest_interactions(df: DataFrame, columns: Sequence[str], target: str, top: int = 5) -> DataFrame:
    """a, b, score: correlation of the centered product with what a linear fit on a and b leaves of the target."""
    x = {c: F.col(c).cast("double") for c in columns}
    y = F.col(target).cast("double")
    means = df.agg(F.avg(y).alias("y"), *(F.avg(v).alias(c) for c, v in x.items())).first()
    centered = df.select((y - means["y"]).alias("_y"), *((v - means[c]).alias(c) for c, v in x.items()))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    packed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("p"), F.col(b).alias("q")) for a, b in pairs))
    long = centered.select("_y", F.explode(packed).alias("k")).select("_y", "k.*").where("_y is not null and p is not null and q is not null").withColumn("r", F.col("p") * F.col("q"))
    names = ("_y", "p", "q", "r")
    moment = {(u, v): F.avg(F.col(u) * F.col(v)) for i, u in enumerate(names) for v in names[i:]}
    sums = long.groupBy("a", "b").agg(*(e.alias(f"{u}{v}") for (u, v), e in moment.items()), F.avg("r").alias("mr"), F.avg("_y").alias("my"), F.avg("p").alias("mp"), F.avg("q").alias("mq"))
    cov = lambda u, v: F.col(f"{u}{v}") - F.col(f"m{u.strip('_')}") * F.col(f"m{v.strip('_')}")
    det = cov("p", "p") * cov("q", "q") - cov("p", "q") * cov("p", "q")
    cy = {"p": cov("_y", "p"), "q": cov("_y", "q")}
    beta_p = (cy["p"] * cov("q", "q") - cy["q"] * cov("p", "q")) / det
    beta_q = (cy["q"] * cov("p", "p") - cy["p"] * cov("p", "q")) / det
    left_r = cov("_y", "r") - beta_p * cov("p", "r") - beta_q * cov("q", "r")
    left = cov("_y", "_y") - beta_p * cy["p"] - beta_q * cy["q"]
    score = F.abs(left_r) / F.sqrt(left * cov("r", "r"))
    return sums.select("a", "b", score.alias("score")).orderBy(F.desc("score"), "a", "b").limit(top)
