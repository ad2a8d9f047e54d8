"""Typed requests over a semantic layer, lowered to DataFrame operations.

A pack names tables, relations, dimensions, entities and measures; a Request names what is asked. `completed`
fills in what a request leaves open, `checked` refuses what the pack does not declare or what would mix things
that don't add up, and `answer` states the request as DataFrame operations, which Catalyst plans. There is no
parser and no optimizer here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import ContractError, latest, ranked, relation_join

#: The aggregations that each class of measure allows, the first that is not "sum" or "mean" being its default.
ALLOWED = {
    "additive": ("sum", "mean", "median", "min", "max"),
    "ordinal": ("median", "min", "max"),
    "snapshot_stock": ("median", "mean", "min", "max"),
    "proxy_window": ("median", "min", "max"),
    "ratio": ("share", "median", "mean"),
    "count": ("count",),
    "undeclared": ("median", "min", "max"),
}
#: Why an aggregation of a class is refused, where the class itself is the reason.
REFUSALS = {
    ("ordinal", "mean"): "stars are an ordinal scale, whose mean is no star; ask for the median",
    ("ordinal", "sum"): "stars are an ordinal scale; their sum is no quantity",
    ("proxy_window", "sum"): "a proxy of an unconfirmed window counts the same sale again in each snapshot",
    ("snapshot_stock", "sum"): "the sum of several listings' prices is no price; ask for the median",
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "share": lambda c: F.avg(c.cast("double")),
}
COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == F.lit(v), "ne": lambda c, v: c != F.lit(v), "lt": lambda c, v: c < F.lit(v), "lte": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v), "gte": lambda c, v: c >= F.lit(v), "in": lambda c, v: c.isin(*v), "contains": lambda c, v: F.contains(c, F.lit(v)),
}
#: Older names of comparisons.
ALIASES = {"le": "lte", "ge": "gte"}
#: How many rows a ranking shows that asks for one, for "the top" without a number, and at most.
RANK_ONE, RANK_PLURAL, RANK_MOST = 1, 5, 10

Where = tuple[str, str, object]


@dataclass(frozen=True)
class Relation:
    """A declared edge from the base table: keys (base to table), and dates to align if both have one.

    many: the other side repeats its keys; rows are then deduplicated by the pack's grain before a measure of
    the base is aggregated. family: the taxonomy that the table belongs to, if any.
    """

    table: str
    keys: dict[str, str]
    columns: dict[str, str]
    date: tuple[str, str] | None = None
    small: bool = False
    many: bool = False
    family: str | None = None
    name: str = ""


@dataclass(frozen=True)
class Dimension:
    """label: a column that depends on this one and is shown beside it; filters: the comparisons that it takes."""

    column: str
    label: str | None = None
    groupable: bool = True
    filters: tuple[str, ...] = tuple(COMPARISONS)
    family: str | None = None


@dataclass(frozen=True)
class Exclusion:
    """A reviewed rule that takes values out of a measure: those equal to one, all nines, or beside a companion of zero."""

    decision: str
    equals: tuple[float, ...] = ()
    nines: int | None = None
    companion: str | None = None
    approved: bool = True

    def hits(self, column: str) -> Column:
        rules = [F.col(column).isin(*self.equals)] if self.equals else []
        if self.nines:
            rules.append(F.col(column).cast("decimal(20,0)").cast("string").rlike(f"^9{{{self.nines},}}$") & (F.col(column) == F.floor(column)))
        if self.companion:
            rules.append(F.col(self.companion) == 0)
        return F.coalesce(reduce(lambda a, b: a | b, rules, F.lit(False)), F.lit(False))


@dataclass(frozen=True)
class Measure:
    column: str
    kind: str = "undeclared"
    monetary: bool = False
    unit: str | None = None
    exclude: tuple[Exclusion, ...] = ()
    proxy: bool = False


@dataclass(frozen=True)
class Qualifier:
    """A named condition: column, comparison and value, and the same negated."""

    column: str
    op: str = "eq"
    value: object = True
    not_op: str = "eq"
    not_value: object = False


@dataclass(frozen=True)
class Pack:
    base: str
    tables: dict[str, Callable[..., DataFrame]]
    relations: tuple[Relation, ...] = ()
    dimensions: dict[str, str | Dimension] = field(default_factory=dict)
    entities: dict[str, str] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    qualifiers: dict[str, Qualifier] = field(default_factory=dict)
    snapshot: str | None = None
    currency: str | None = None
    #: The keys of a row of the base table.
    grain: tuple[str, ...] = ()

    def dimension(self, name: str) -> Dimension:
        found = self.dimensions.get(name)
        if found is None:
            raise ContractError("UNKNOWN_DIMENSION", name)
        return found if isinstance(found, Dimension) else Dimension(found)

    def available(self, *names: str) -> None:
        """Refuse tables that were not collected."""
        missing = sorted(n for n in names if n not in self.tables)
        if missing:
            raise ContractError("DATASET_NOT_AVAILABLE", ", ".join(missing))


@dataclass(frozen=True)
class Request:
    """also: further (measure, aggregation) of the same rows. above: (measure, comparison, value, unit) of rows to keep.

    having: qualifiers by name, and whether they are to hold. dates: several days that are read as one window.
    """

    measure: str
    aggregation: str | None = None
    by: tuple[str, ...] = ()
    where: tuple[Where, ...] = ()
    snapshot: object = None
    limit: int | None = None
    offset: int = 0
    descending: bool = True
    also: tuple[tuple[str, str], ...] = ()
    above: tuple[tuple[str, str, object, str | None], ...] = ()
    having: tuple[tuple[str, bool], ...] = ()
    dates: tuple = ()
    rank: str | None = None  # "one", "some" or None


def comparison(name: str, op: str, value: object) -> list[Where]:
    """A condition in today's words: old names are mapped and a range is split; anything else is refused."""
    op = ALIASES.get(op, op)
    if op == "between":
        low, high = value
        return [(name, "gte", low), (name, "lte", high)]
    if op not in COMPARISONS:
        raise ContractError("UNKNOWN_OPERATOR", f"{op} on {name}")
    return [(name, op, value)]


def default_aggregation(pack: Pack, measure: str) -> str:
    """count for what is counted, else the median, else the first that the measure allows."""
    if measure in pack.entities:
        return "count"
    if measure not in pack.measures:
        raise ContractError("UNKNOWN_MEASURE", measure)
    legal = ALLOWED[pack.measures[measure].kind]
    return "median" if "median" in legal else legal[0]


def needs_snapshot(pack: Pack, request: Request) -> bool:
    dated = bool(request.dates) or request.snapshot is not None or any(pack.dimension(n).column == pack.snapshot for n in (*request.by, *(w[0] for w in request.where)))
    crossing = [m for m, _ in ((request.measure, None), *request.also) if m in pack.measures and pack.measures[m].kind in ("snapshot_stock", "proxy_window", "ordinal", "undeclared")]
    return pack.snapshot is not None and bool(crossing) and not dated


def completed(pack: Pack, request: Request) -> Request:
    """The request with its defaults: aggregation, the latest snapshot if no date at all is named, and the size of a ranking.

    A ranking of "one" has one row, one of "some" five, and a stated number at most ten.
    """
    made = replace(request, where=tuple(c for w in request.where for c in comparison(*w)), aggregation=request.aggregation or default_aggregation(pack, request.measure))
    if pack.snapshot and not request.dates and request.snapshot is None and not any(pack.dimension(n).column == pack.snapshot for n in (*made.by, *(w[0] for w in made.where))):
        made = replace(made, snapshot="latest")
    if made.rank:
        limit = {"one": RANK_ONE, "some": RANK_PLURAL}[made.rank] if made.limit is None else min(made.limit, RANK_MOST)
        made = replace(made, limit=limit)
    return made


def checked(pack: Pack, request: Request) -> None:
    """Refuse what the pack does not declare or what would mix things that don't add up; nothing is replaced or relaxed."""
    pack.available(pack.base, *(r.table for r in pack.relations))
    for name in request.by:
        if not pack.dimension(name).groupable:
            raise ContractError("NOT_GROUPABLE", name)
    fixed: dict[str, object] = {}
    for name, op, value in request.where:
        if op not in COMPARISONS:
            raise ContractError("UNKNOWN_OPERATOR", f"{op} on {name}")
        if op not in pack.dimension(name).filters:
            raise ContractError("FILTER_NOT_ALLOWED", f"{op} on {name}")
        if op == "eq" and fixed.setdefault(name, value) != value:
            raise ContractError("CLASHING_FILTERS", f"{name} is {fixed[name]} and {value}")
    for name, _ in request.having:
        if name not in pack.qualifiers:
            raise ContractError("UNKNOWN_QUALIFIER", name)
    for name, op, _, unit in request.above:
        if name not in pack.measures:
            raise ContractError("UNKNOWN_MEASURE", name)
        if op not in ("lt", "lte", "gt", "gte", "eq"):
            raise ContractError("UNKNOWN_OPERATOR", f"{op} on {name}")
        if unit is not None and unit != pack.measures[name].unit:
            raise ContractError("UNIT_MISMATCH", f"{name} is in {pack.measures[name].unit}, not {unit}")
    for measure_name, aggregation in ((request.measure, request.aggregation), *request.also):
        if aggregation == "count" and measure_name in pack.entities:
            continue
        measure = pack.measures.get(measure_name)
        if measure is None:
            raise ContractError("NOT_COUNTABLE" if aggregation == "count" else "UNKNOWN_MEASURE", measure_name)
        if aggregation not in ALLOWED[measure.kind]:
            raise ContractError("ILLEGAL_AGGREGATION", REFUSALS.get((measure.kind, aggregation), f"{aggregation} of {measure.kind} {measure_name}"))
        pinned = pack.currency in fixed
        if measure.monetary and pack.currency and not pinned and pack.currency not in request.by:
            raise ContractError("CURRENCY_MIX", f"{measure_name} over several of {pack.currency}")
    if needs_snapshot(pack, request):
        raise ContractError("SNAPSHOT_SCOPE", "a cross-section has to name its snapshot")
    families = {f for n in (*request.by, *fixed) if (f := pack.dimension(n).family)}
    if len(families) > 1:
        raise ContractError("TWO_TAXONOMIES", " and ".join(sorted(families)))
    if request.limit is not None and not 1 <= request.limit <= 10_000:
        raise ContractError("RANK_LIMIT", str(request.limit))


def columns_of(pack: Pack, request: Request) -> set[str]:
    """The physical columns that a request reads."""
    found = {c for n in (*request.by, *(w[0] for w in request.where)) for c in (pack.dimension(n).column, pack.dimension(n).label) if c}
    for name in (request.measure, *(m for m, _ in request.also), *(a[0] for a in request.above)):
        measure = pack.measures.get(name)
        found |= {pack.entities[name]} if measure is None else {measure.column, *(x.companion for x in measure.exclude if x.companion)}
    return found | {pack.qualifiers[n].column for n, _ in request.having}


def scope(pack: Pack, request: Request, **source) -> DataFrame:
    """The rows that a request speaks of, before values are excluded and aggregated.

    A relation whose other side repeats its keys multiplies rows; where only it is filtered on, a row of the
    base is kept once.
    """
    df, needed, fans = pack.tables[pack.base](**source), columns_of(pack, request), False
    for relation in pack.relations:
        if needed & set(relation.columns.values()):
            df = relation_join(df, pack.tables[relation.table](**source), relation.keys, relation.columns, relation.date, relation.small, relation.many)
            fans |= relation.many
    conditions = [COMPARISONS[op](F.col(pack.dimension(name).column), value) for name, op, value in request.where]
    conditions += [COMPARISONS[op](F.col(pack.measures[name].column), value) for name, op, value, _ in request.above]
    for name, wanted in request.having:
        q = pack.qualifiers[name]
        conditions.append(COMPARISONS[q.op if wanted else q.not_op](F.col(q.column), q.value if wanted else q.not_value))
    if request.dates:
        conditions.append(F.col(pack.snapshot).isin(*request.dates))
    elif request.snapshot == "latest":
        last = df.agg(F.max(pack.snapshot).alias("__last"))
        df = df.join(F.broadcast(last), F.col(pack.snapshot) == F.col("__last"), "left_semi")
    elif request.snapshot is not None:
        conditions.append(F.col(pack.snapshot) == F.lit(request.snapshot))
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    if fans:
        if not pack.grain:
            raise ContractError("DEDUPE_BEFORE_AGGREGATE", "a relation multiplies rows and the pack names no grain")
        shown = [c for n in request.by for c in (pack.dimension(n).column, pack.dimension(n).label) if c]
        df = df.dropDuplicates([*dict.fromkeys((*pack.grain, *shown))])
    return df


def kept_value(measure: Measure) -> Column:
    """A measure's value, or null where an approved rule excludes it."""
    out = F.col(measure.column)
    for rule in measure.exclude:
        if rule.approved:
            out = F.when(~rule.hits(measure.column), out)
    return out


def answer(pack: Pack, request: Request, **source) -> DataFrame:
    """The request's rows: its dimensions (and their labels), `value`, further values, and if ranked position and tie_at_cut.

    Values that a reviewed rule excludes are in no aggregate. All values come from one scan of the scope.
    """
    checked(pack, request)
    df = scope(pack, request, **source)

    def value(name: str, aggregation: str) -> Column:
        if name in pack.measures:
            return AGGREGATES[aggregation](kept_value(pack.measures[name]))
        return F.count_distinct(pack.entities[name])

    made = [value(request.measure, request.aggregation).alias("value"), *(value(n, a).alias(f"{a}_{n}") for n, a in request.also)]
    shown = [F.col(pack.dimension(n).column).alias(n) for n in request.by]
    labels = [F.col(d.label).alias(f"{n}_label") for n in request.by if (d := pack.dimension(n)).label]
    out = df.groupBy(*shown, *labels).agg(*made)
    if request.limit is None:
        return out
    if request.by and (request.measure in pack.measures):
        out = out.where(F.col("value").isNotNull())
    return ranked(out, "value", request.limit, list(request.by), request.offset, request.descending)


def extreme_row(pack: Pack, request: Request, **source) -> DataFrame:
    """The row of the base that holds the largest (smallest) value in scope, rather than the value alone; ties go by the grain."""
    checked(pack, request)
    measure = pack.measures[request.measure]
    rows = scope(pack, request, **source).withColumn("value", kept_value(measure)).where(F.col("value").isNotNull())
    order = F.col("value").desc() if request.descending else F.col("value").asc()
    return rows.orderBy(order, *pack.grain).limit(request.limit or 1).select(*pack.grain, *(F.col(pack.dimension(n).column).alias(n) for n in request.by), "value")


def excluded_rows(pack: Pack, request: Request, **source) -> DataFrame:
    """(decision, n): rows of the scope whose value each approved rule takes out."""
    measure = pack.measures[request.measure]
    counted = scope(pack, request, **source).agg(*(F.count_if(x.hits(measure.column)).alias(x.decision) for x in measure.exclude if x.approved))
    cells = [F.struct(F.lit(x.decision).alias("decision"), F.col(x.decision).alias("n")) for x in measure.exclude if x.approved]
    return counted.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def boundary_report(pack: Pack, request: Request, rows: DataFrame) -> DataFrame:
    """Rows of a ranking, a minimum or a maximum (with the measure's column) that a rule without approval would take out.

    Such an extreme has to be reviewed before it is shown.
    """
    measure = pack.measures[request.measure]
    open_rules = [F.when(x.hits(measure.column), F.lit(x.decision)) for x in measure.exclude if not x.approved]
    return rows.withColumn("decision", F.coalesce(*open_rules, F.lit(None).cast("string"))).where(F.col("decision").isNotNull())


def absent_literals(pack: Pack, request: Request, **source) -> DataFrame:
    """(dimension, value) of each literal of the request that no row of the dataset has.

    An empty answer is valid only where there is none of these: a value that exists, but not in the scope, has
    zero as its answer, and nothing is relaxed to avoid that.
    """
    wanted = [(n, str(v)) for n, op, value in request.where if op in ("eq", "in") for v in (value if op == "in" else [value])]
    df, needed = pack.tables[pack.base](**source), columns_of(pack, request)
    for relation in pack.relations:
        if needed & set(relation.columns.values()):
            df = relation_join(df, pack.tables[relation.table](**source), relation.keys, relation.columns, relation.date, relation.small, relation.many)
    spark = df.sparkSession
    asked = spark.createDataFrame(wanted, "dimension string, value string")
    hits = [F.max((F.col(pack.dimension(n).column).cast("string") == F.lit(v))).alias(f"h{k}") for k, (n, v) in enumerate(wanted)]
    if not hits:
        return asked
    found = df.agg(*hits).select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.lit(v).alias("value"), F.col(f"h{k}").alias("hit")) for k, (n, v) in enumerate(wanted)))).alias("c"))
    return found.where(~F.coalesce(F.col("c.hit"), F.lit(False))).select("c.dimension", "c.value")


def plan_breaks(pack: Pack, request: Request) -> list[str]:
    """The codes of all rules about plans that a request breaks, rather than the first as an error."""
    try:
        checked(pack, request)
    except ContractError as e:
        return [e.code]
    return []


def caveats(pack: Pack, request: Request) -> list[str]:
    """What has to be said beside an answer: proxies are estimates, and excluded values were left out."""
    found = []
    for name in dict.fromkeys((request.measure, *(m for m, _ in request.also))):
        measure = pack.measures.get(name)
        if measure and measure.proxy:
            found.append(f"PROXY_NOT_VERIFIED: {name} is an estimate")
        found += [f"EXCLUDED_BY:{x.decision}" for x in measure.exclude if x.approved] if measure else []
    return found


def latest_of(pack: Pack, keys: list[str], **source) -> DataFrame:
    """The base table's last row of each key."""
    return latest(pack.tables[pack.base](**source), keys, pack.snapshot, list(pack.grain))
