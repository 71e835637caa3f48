"""Reconciling two sets of waypoints.

A rule says when two waypoints match. Key rules (name, identifier, geocode prefix) are equi-joins.
The distance rule is a range join: points fall into cells at least as wide as the limit (``cells``), one side
looks into the nine cells around it, and the exact distance decides. An arbitrary predicate is tried
within groups that agree in a key; a comparison of all pairs has to be asked for. The result is a table of edges (left_id, right_id, rule).

Edges may be as many as the product of the sides, so nothing is sorted or gathered by edge: each rule gives a pair of rows once, so edges need no
``distinct`` where ids are unique, and of key rules only those between ids of several keys need one elsewhere; the pairs of one key are made by blocks in many tasks (``paired``); and what key rules say about single
waypoints (matched or not, how often) or about groups of them comes from counts by key, where a frequent key's waypoints are looked up by blocks too (``looked_up``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geocode import Geocode
from ..functions.geodesy import NM, distance
from ..scratch import settle
from .cells import Cells

NEAR = 0.05
BLOCK = 2_048
PAIRS = 1 << 24
ROWS = 1 << 18
KEYS = 1 << 16


def paired(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The inner join of two sides by columns ``key`` (no nulls). Beyond ``PAIRS`` pairs a key of many is dealt into blocks of some ``BLOCK`` rows of either side, and each pair
    of blocks is a key of its own; there are as many partitions as make some ``PAIRS`` pairs each. So neither a frequent key nor a large product is one task."""
    sizes = a.groupBy(*key).agg(F.count(F.lit(1)).alias("na_")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("nb_")), key)
    cost = F.col("na_").cast("double") * F.col("nb_")
    total = sizes.agg(F.sum(cost)).first()[0] or 0
    if total <= PAIRS:
        return a.join(b, key)
    # Keys that hold so many of the pairs are at most 50,000, whatever the sides.
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    hot = F.broadcast(sizes.filter(cost > max(PAIRS / 16, total / 50_000)).select(*key, parts("na_"), parts("nb_")))
    number = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(total // PAIRS) + 1))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other)
        return df.join(hot, key, "left").select(*df.columns, mine, every).repartition(number, *key, "na_", "nb_")

    return dealt(a, "na_", "nb_").join(dealt(b, "nb_", "na_"), [*key, "na_", "nb_"]).drop("na_", "nb_")


def looked_up(a: DataFrame, b: DataFrame, key: list[str], how: str, most: int, others: int) -> DataFrame:
    """The join of ``a`` with ``b``, which has a key (no nulls) once, ``how`` left_semi or inner. A key of more than ``ROWS`` rows of ``a`` is dealt into blocks of some ``ROWS``, each a key of its own
    that ``b`` has as well: else all rows of a frequent key are sorted by one task. Such keys are looked for where ``a`` has rows enough, of which there are ``most`` at most.
    If ``b``, made of ``others`` rows, comes of the smaller side and has ``KEYS`` keys or fewer, it is broadcast instead, and ``a`` isn't shuffled."""
    if most <= ROWS:
        return a.join(b, key, how)
    if others <= most and b.limit(KEYS + 1).count() <= KEYS:
        return a.join(F.broadcast(b), key, how)
    blocks = F.ceil(F.col("blocks_") / ROWS).cast("int").alias("blocks_")
    hot = a.groupBy(*key).agg(F.count(F.lit(1)).alias("blocks_")).filter(F.col("blocks_") > ROWS).select(*key, blocks)
    if hot.isEmpty():
        return a.join(b, key, how)
    hot, of = F.broadcast(hot), F.coalesce("blocks_", F.lit(1))
    rows = a.join(hot, key, "left").select(*a.columns, F.pmod(F.xxhash64(*a.columns), of).cast("int").alias("block_"))
    every = b.join(hot, key, "left").select(*b.columns, F.explode(F.sequence(F.lit(0), of - 1)).alias("block_"))
    return rows.join(every, [*key, "block_"], how).drop("block_")


@dataclass(frozen=True)
class KeyRule:
    """Waypoints match where the keys agree; with ``null_matches`` two missing keys agree as well."""

    name: str
    key: Callable[[str], Column]
    null_matches: bool = False

    def edges(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = self.keyed(left, "left", F.col("id").alias("left_id")), self.keyed(right, "right", F.col("id").alias("right_id"))
        return paired(a, b, ["key", "no_key"]).select("left_id", "right_id", F.lit(self.name).alias("rule"))

    def distinct_edges(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The distinct edges where ids may stand twice. Of waypoints that are distinct by id and key an edge comes twice only where both of its ids have several keys: only those edges are gathered."""
        keys = ["key", "no_key"]
        a, b = self.keyed(left, "left", F.col("id").alias("left_id")).distinct(), self.keyed(right, "right", F.col("id").alias("right_id")).distinct()
        many = {c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(c) for df, c in ((a, "left_id"), (b, "right_id"))}
        if any(some.isEmpty() for some in many.values()):
            parts = [paired(a, b, keys)]
        else:
            several = lambda df, c: df.join(many[c], c, "left_semi").unionByName(df.filter(F.col(c).isNull()))
            single = lambda df, c: df.filter(F.col(c).isNotNull()).join(many[c], c, "left_anti")
            far = several(a, "left_id")
            both = paired(far, several(b, "right_id"), keys).select("left_id", "right_id").distinct()
            parts = [both, paired(single(a, "left_id"), b, keys), paired(far, single(b, "right_id"), keys)]
        return reduce(DataFrame.unionByName, (p.select("left_id", "right_id", F.lit(self.name).alias("rule")) for p in parts))

    def keyed(self, points: DataFrame, side: str, *columns: Column) -> DataFrame:
        """``columns`` with key and no_key (whether it is missing); points that can't match are left out."""
        rows = points.select(*columns, self.key(side).alias("key_"))
        rows = rows.select(*rows.columns[:-1], F.coalesce(F.col("key_").cast("string"), F.lit("")).alias("key"), F.col("key_").isNull().alias("no_key"))
        return rows if self.null_matches else rows.filter("not no_key")


@dataclass(frozen=True)
class NearRule:
    """Waypoints match within ``limit`` nautical miles on the equirectangular chart; with ``wrap`` the short way across 180° counts."""

    name: str = "distance"
    limit: float = NEAR
    radius: float = NM
    wrap: bool = False

    def edges(self, left: DataFrame, right: DataFrame) -> DataFrame:
        cells = Cells(self.limit, self.radius, self.wrap)

        def points(df: DataFrame, side: str, cell: Column) -> DataFrame:
            return df.select(F.col("id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"), cell.alias("cell")).select(f"{side}_id", f"{side}_lat", f"{side}_lon", "cell.*")

        a = points(left, "left", cells.cell(F.col("lat"), F.col("lon")))
        b = points(right, "right", F.explode(cells.around(F.col("lat"), F.col("lon"))))
        near = distance(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon"), self.radius, self.wrap) <= self.limit
        return paired(a.dropna(subset=["row", "column"]), b.dropna(subset=["row", "column"]), ["row", "column"]).filter(near).select("left_id", "right_id", F.lit(self.name).alias("rule"))


@dataclass(frozen=True)
class CodeRule:
    """Waypoints match whose geocodes' cells are the same or touch, by any ``Geocode``; with a ``limit`` (nautical miles, no more than a cell is high and wide) only those within it."""

    name: str
    geocode: Geocode
    limit: float | None = None
    radius: float = NM

    def edges(self, left: DataFrame, right: DataFrame) -> DataFrame:
        code = self.geocode.encode(F.col("lat"), F.col("lon"))
        a = left.select(F.col("id").alias("left_id"), F.col("lat").alias("left_lat"), F.col("lon").alias("left_lon"), code.alias("code"))
        b = right.select(F.col("id").alias("right_id"), F.col("lat").alias("right_lat"), F.col("lon").alias("right_lon"), code.alias("own"))
        b = b.withColumn("code", F.explode(self.geocode.neighbours(F.col("own"))))
        pairs = paired(a.dropna(subset=["code"]), b.dropna(subset=["code"]), ["code"])
        if self.limit is not None:
            pairs = pairs.filter(distance(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon"), self.radius, wrap=True) <= self.limit)
        return pairs.select("left_id", "right_id", F.lit(self.name).alias("rule"))


@dataclass(frozen=True)
class PredicateRule:
    """Waypoints match where a predicate of the two sides' columns holds (aliases ``l`` and ``r``), among those that
    agree in ``key``. Without a key every pair is compared, which grows with the product of the sides: only with ``all_pairs``."""

    name: str
    predicate: Callable[[], Column]
    key: Callable[[], Column] | None = None
    all_pairs: bool = False

    def edges(self, left: DataFrame, right: DataFrame) -> DataFrame:
        if self.key is None and not self.all_pairs:
            raise ValueError(f"rule {self.name!r} has no key to join by; ask for all_pairs to compare every pair")
        key = F.lit(0) if self.key is None else self.key()
        # Structs under the aliases' names: the predicate's ``l.lat`` is a field of one.
        l, r = (df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), key.alias("rule_key")).dropna(subset=["rule_key"]) for df, name in ((left, "l"), (right, "r")))
        return paired(l, r, ["rule_key"]).filter(self.predicate()).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.lit(self.name).alias("rule"))


def by_name() -> KeyRule:
    return KeyRule("name", lambda side: F.col("name"), null_matches=True)


def by_guid() -> KeyRule:
    return KeyRule("guid", lambda side: F.lower(F.regexp_replace("guid", "[{}]", "")))


def by_geocode(n: int) -> KeyRule:
    """The first ``n`` characters of the geocode agree (the separator counts)."""
    return KeyRule(f"geocode{n}", lambda side: F.substring("geocode", 1, n))


def unique(points: DataFrame) -> bool:
    """Whether no id stands twice."""
    return points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _by_counts(left: DataFrame, right: DataFrame, rules: list) -> bool:
    """Whether edges can be counted by key: key rules of different names, and unique ids."""
    return all(isinstance(r, KeyRule) for r in rules) and len({r.name for r in rules}) == len(rules) and unique(left) and unique(right)


def match(left: DataFrame, right: DataFrame, rules: list) -> DataFrame:
    """Distinct edges of all rules."""
    every = lambda of: reduce(DataFrame.unionByName, map(of, rules))
    usual = lambda rule: rule.edges(left, right)
    if not all(isinstance(r, (KeyRule, NearRule, CodeRule, PredicateRule)) for r in rules) or len({r.name for r in rules}) < len(rules):
        return every(usual).distinct()
    return every(usual) if unique(left) and unique(right) else every(lambda rule: rule.distinct_edges(left, right) if isinstance(rule, KeyRule) else usual(rule).distinct())


def touched(left: DataFrame, right: DataFrame, rules: list, side: str) -> DataFrame:
    """id (not always once) of the waypoints of a ``side`` (left, right) that an edge touches; of key rules without making the edges."""
    points, others, other = (left, right, "right") if side == "left" else (right, left, "left")
    sizes = (points.count(), others.count()) if any(isinstance(r, KeyRule) for r in rules) else ()

    def of(rule) -> DataFrame:
        if not isinstance(rule, KeyRule):
            return rule.edges(left, right).select(F.col(f"{side}_id").alias("id"))
        return looked_up(rule.keyed(points, side, F.col("id")), rule.keyed(others, other).distinct(), ["key", "no_key"], "left_semi", *sizes).select("id")

    return reduce(DataFrame.unionAll, map(of, rules))


def rank(left: DataFrame, right: DataFrame, rules: list) -> DataFrame:
    """``rank_by_matches`` of the left waypoints, of key rules without making the edges."""
    if not _by_counts(left, right, rules):
        return rank_by_matches(left, match(left, right, rules), "left_id")
    sizes = left.count(), right.count()
    each = [looked_up(rule.keyed(left, "left", F.col("id")), rule.keyed(right, "right").groupBy("key", "no_key").agg(F.count(F.lit(1)).alias("n")), ["key", "no_key"], "inner", *sizes).select("id", "n") for rule in rules]
    counts = reduce(DataFrame.unionAll, each).groupBy("id").agg(F.sum("n").alias("match_count"))
    return left.select("id").join(counts, "id", "left").select("id", F.coalesce("match_count", F.lit(0)).alias("match_count")).orderBy(F.desc("match_count"), "id")


def crosswalk_by(left: DataFrame, right: DataFrame, rules: list, column: str = "sym") -> DataFrame:
    """``crosswalk`` of the edges of rules; of key rules without making the edges: pairs that agree in several keys are counted in and out by turns."""
    if not _by_counts(left, right, rules):
        return crosswalk(left, right, match(left, right, rules), column)

    def counted(some: tuple, points: DataFrame, side: str) -> DataFrame:
        rows = points.select(F.col(column).alias("value_"), *(F.col(f"`{c}`") for c in points.columns))
        for k, rule in enumerate(some):
            rows = rule.keyed(rows, side, *(F.col(f"`{c}`") for c in rows.columns)).withColumnsRenamed({"key": f"key{k}_", "no_key": f"no{k}_"})
        keys = [f"{c}{k}_" for k in range(len(some)) for c in ("key", "no")]
        return rows.groupBy(F.col("value_").alias(f"{side}_{column}"), *keys).agg(F.count(F.lit(1)).alias(f"{side}_n"))

    parts = []
    for size in range(1, len(rules) + 1):
        for some in combinations(rules, size):
            a, b = counted(some, left, "left"), counted(some, right, "right")
            keys = [c for c in a.columns if c in b.columns]
            parts.append(a.join(b, keys).select(f"left_{column}", f"right_{column}", (F.lit((-1) ** (size + 1)) * F.col("left_n") * F.col("right_n")).alias("n")))
    return reduce(DataFrame.unionAll, parts).groupBy(f"left_{column}", f"right_{column}").agg(F.sum("n").alias("n")).filter("n > 0")


def outer_merge(left: DataFrame, right: DataFrame, edges: DataFrame, rules: list | None = None) -> DataFrame:
    """One row per edge, then the unmatched of either side: left_id, right_id, rule, status (both, first, second). With the ``rules`` that the edges come from the unmatched are found without them."""
    both = edges.select("left_id", "right_id", "rule", F.lit("both").alias("status"))
    none = F.lit(None).cast("string")
    found = {side: edges.select(F.col(f"{side}_id").alias("id")) if rules is None else touched(left, right, rules, side) for side in ("left", "right")}
    first = left.join(found["left"], "id", "left_anti").select(F.col("id").alias("left_id"), F.lit(None).cast(edges.schema["right_id"].dataType).alias("right_id"), none.alias("rule"), F.lit("first").alias("status"))
    second = right.join(found["right"], "id", "left_anti").select(F.lit(None).cast(edges.schema["left_id"].dataType).alias("left_id"), F.col("id").alias("right_id"), none.alias("rule"), F.lit("second").alias("status"))
    return both.unionByName(first).unionByName(second)


def only(points: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """The waypoints of one side that no edge touches."""
    return points.join(edges.select(F.col(side).alias("id")), "id", "left_anti")


def matched(points: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """The waypoints of one side that an edge touches, once each."""
    return points.join(edges.select(F.col(side).alias("id")), "id", "left_semi")


def crosswalk(left: DataFrame, right: DataFrame, edges: DataFrame, column: str = "sym") -> DataFrame:
    """left_<column>, right_<column>, n: how often the sides' values stand on the ends of an edge."""
    pairs = edges.select("left_id", "right_id").distinct()
    a, b = (df.select(F.col("id").alias(f"{side}_id"), F.col(column).alias(f"{side}_{column}")) for df, side in ((left, "left"), (right, "right")))
    return pairs.join(a, "left_id").join(b, "right_id").groupBy(f"left_{column}", f"right_{column}").agg(F.count(F.lit(1)).alias("n"))


def rank_by_matches(points: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """id and match_count, most matches first (ties by id)."""
    counts = edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("match_count"))
    return points.select("id").join(counts, "id", "left").select("id", F.coalesce("match_count", F.lit(0)).alias("match_count")).orderBy(F.desc("match_count"), "id")


def matches_by_rule(edges: DataFrame) -> DataFrame:
    """Per left waypoint and rule the sorted right ids."""
    return edges.groupBy("left_id", "rule").agg(F.sort_array(F.collect_set("right_id")).alias("right_ids"))


def deduplicate(points: DataFrame, prefix: int = 10, preferred_only: bool = False) -> DataFrame:
    """Of the waypoints whose geocodes share a prefix the last updated stays (ties: the last id).

    ``preferred_only`` leaves out those that had no double. Agreeing in a prefix is transitive, so
    a cluster is one key; its best row comes from a partial aggregate, not a window.
    """
    rows = F.struct(F.coalesce("last_updated", F.lit("1900-01-01").cast("timestamp")).alias("at"), "id", F.struct(*points.columns).alias("row"))
    best = points.groupBy(F.substring("geocode", 1, prefix).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*points.columns), F.struct(rows["at"], rows["id"])).alias("row"))
    return (best.filter("n > 1") if preferred_only else best).select("row.*")


def survey(left: DataFrame, right: DataFrame, rules: list) -> DataFrame:
    """The difference report: line_no, text. Matched left waypoints with their partners by rule, then ``+`` lines for what only the right has."""
    if _by_counts(left, right, rules):
        return _survey_by_counts(left, right, rules)
    edges = match(left, right, rules)
    named = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.coalesce("name", F.lit("")).alias(f"{side}_name"), F.col("geocode").alias(f"{side}_code"))
    lines = edges.join(named(left, "left"), "left_id").join(named(right, "right"), "right_id")
    common = lines.select(F.lit(0).alias("part"), F.col("left_name").alias("k1"), F.col("left_id").cast("string").alias("k2"), F.col("rule").alias("k3"), F.format_string("  %s %s = %s (%s)", F.col("rule"), "left_name", "right_name", "right_code").alias("text"))
    new = only(right, edges, "right_id").select(F.lit(1).alias("part"), F.coalesce("name", F.lit("")).alias("k1"), F.col("id").cast("string").alias("k2"), F.lit("").alias("k3"), F.format_string("+ %s %s", F.coalesce("name", F.lit("")), "geocode").alias("text"))
    every = common.unionByName(new)
    return numbered(every, ["part", "k1", "k2", "k3", "text"], "line_no").select("line_no", "text")


def _survey_by_counts(left: DataFrame, right: DataFrame, rules: list) -> DataFrame:
    """The lines of ``survey`` without sorting them: a line's number is that of its waypoint's and rule's first line, which the counts by key say, and the partner's place among those of its key."""
    name = F.coalesce("name", F.lit("")).alias("name")
    tail = F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("geocode", F.lit("null")), F.lit(")")).alias("tail")
    in_key = Window.partitionBy("key", "no_key").orderBy("tail")
    partners = {rule.name: rule.keyed(right, "right", tail).withColumn("at", F.row_number().over(in_key) - 1) for rule in rules}
    counted = lambda rule: partners[rule.name].groupBy("key", "no_key").agg(F.count(F.lit(1)).alias("n"))
    heads = reduce(DataFrame.unionAll, (rule.keyed(left, "left", F.lit(rule.name).alias("rule"), name, F.col("id").cast("string").alias("id")).join(counted(rule), ["key", "no_key"]) for rule in rules))
    order = ["name", "id", "rule"]
    ordered = settle(heads.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33))
    ranges = ordered.groupBy("range").agg(F.sum("n").alias("lines"))  # as many rows as ranges
    base = ranges.select("range", (F.sum("lines").over(Window.orderBy("range")) - F.col("lines")).alias("base"))
    before = F.sum("n").over(Window.partitionBy("range").orderBy("place")) - F.col("n")
    heads = settle(ordered.withColumn("first", before).join(F.broadcast(base), "range").select("rule", "name", "key", "no_key", (F.col("base") + F.col("first")).alias("first")))

    def lines(rule: KeyRule) -> DataFrame:
        pairs = paired(heads.filter(F.col("rule") == rule.name).select("key", "no_key", "name", "first"), partners[rule.name], ["key", "no_key"])
        return pairs.select((F.col("first") + F.col("at")).alias("line_no"), F.concat(F.lit(f"  {rule.name} "), "name", F.lit(" = "), "tail").alias("text"))

    total = ranges.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    new = right.join(touched(left, right, rules, "right"), "id", "left_anti").select(name, F.col("id").cast("string").alias("id"), F.format_string("+ %s %s", F.coalesce("name", F.lit("")), "geocode").alias("text"))
    new = numbered(new, ["name", "id", "text"], "line_no").select((F.col("line_no") + total).alias("line_no"), "text")
    return reduce(DataFrame.unionAll, [*map(lines, rules), new])


def duplicates_report(points: DataFrame, prefix: int = 10) -> DataFrame:
    """line_no, text: of each group of doubles (geocodes that share a prefix) a line for the group, the one that stays, and those it stands for."""
    keyed = points.select(F.substring("geocode", 1, prefix).alias("cluster"), "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("last_updated", F.lit("1900-01-01").cast("timestamp")).alias("at"))
    best = keyed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "id")).alias("best")).filter("n > 1")
    heads = best.select("cluster", F.lit(0).alias("part"), F.lit("").alias("k"), F.format_string("%s: %d", "cluster", "n").alias("text"))
    rows = keyed.join(best, "cluster")
    stays = F.struct("at", "id") == F.col("best")
    lines = rows.select("cluster", F.when(stays, 1).otherwise(2).alias("part"), F.col("id").cast("string").alias("k"), F.concat(F.when(stays, "  * ").otherwise("    "), F.col("name"), F.lit(" "), F.date_format("at", "yyyy-MM-dd")).alias("text"))
    return numbered(heads.unionByName(lines), ["cluster", "part", "k", "text"], "line_no").select("line_no", "text")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in an order, by ranges: each range's rows are counted where they lie, and only the counts meet in one place."""
    ordered = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("place", F.monotonically_increasing_id())
    ordered = ordered.withColumn("range", F.shiftright("place", 33))
    counts = ordered.groupBy("range").count()  # as many rows as ranges
    base = counts.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("base"))
    return ordered.join(F.broadcast(base), "range").withColumn(name, F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("range", "base", "place")
