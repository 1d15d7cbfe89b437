"""Questions about one table: SQL, DataFrame functions or aggregation stages, and chart-ready answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import coerce_numeric_columns, col, numeric_columns
from vistrata.functions.names import category_for_id, flatten, underscore_names
from vistrata.operators.histogram import QUERY_BINS, histograms
from vistrata.operators.preview import head
from vistrata.operators.statistics import query_statistics
from vistrata.session import stage

# Shown rows, points, slices and bars.
RESPONSE_ROWS = 200
SHOWN_POINTS = 20
PIE_ROWS, BAR_ROWS = 10, 20
# Words that ask for a chart, in their inflected forms (plots, charted, plotting, shown, visualise, visualization, ...).
CHART_STEMS = ["plot", "chart", "graph", "show", "display", "histogram", "bar", "pie", "scatter", "trend", "distribution"]
CHART_WORDS = re.compile(rf"\b(?:(?:{'|'.join(CHART_STEMS)})(?:s|t?ed|t?ing|plots?)?|shown|visuals?|visuali[sz]\w*)\b", re.IGNORECASE)


# --- running a query -------------------------------------------------------------------------------------

def register(df_raw: DataFrame, df_clean: DataFrame, name: str) -> None:
    """Views of a loaded table: `<name>_raw` as read, `<name>` as cleaned."""
    df_raw.createOrReplaceTempView(f"{name}_raw")
    df_clean.createOrReplaceTempView(name)


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's parser reads a text as a query: no command, and no part of its plan that writes."""
    classes = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
               for name in ("Command", "ParsedStatement")]

    def reads(plan) -> bool:
        children = plan.children()
        return not any(c.isInstance(plan) for c in classes) and all(reads(children.apply(i)) for i in range(children.size()))

    return reads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def sql_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """One query over registered views, or over frames given by name; statements are refused before they run.

    Names given here hold for this query only: a view of the same name is there again afterwards.
    """
    if not is_query(spark, sql):
        raise ValueError("only queries are run, no statements")
    views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name.lower() in views}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def frame_query(df: DataFrame, question: Callable[[DataFrame], object]) -> DataFrame | object:
    """A function of a DataFrame, whose answer is a frame or a scalar; if it fails on types, it runs again with
    numeric-looking text as numbers.

    A frame is staged, so type errors that only appear at run time are found and nothing runs twice.
    """
    def ask(frame: DataFrame) -> DataFrame | object:
        answer = question(frame)
        return stage(answer, "answer") if isinstance(answer, DataFrame) else answer

    try:
        return ask(df)
    except (PySparkException, TypeError, ValueError):
        return ask(coerce_numeric_columns(df))


def _field(path: str) -> Column:
    parts = path.split(".")
    return reduce(lambda c, p: c.getField(p), parts[1:], col(parts[0]))


# Operators of expressions; each is one function of the operands.
EXPRESSIONS: dict[str, Callable[..., Column]] = {
    "$add": lambda *v: reduce(lambda a, b: a + b, v), "$multiply": lambda *v: reduce(lambda a, b: a * b, v),
    "$subtract": lambda a, b: a - b, "$divide": lambda a, b: F.try_divide(a, b), "$mod": lambda a, b: F.try_mod(a, b),
    "$abs": F.abs, "$round": lambda v, n=None: F.round(v) if n is None else F.round(v, n), "$floor": F.floor, "$ceil": F.ceil,
    "$concat": F.concat, "$toLower": F.lower, "$toUpper": F.upper, "$ifNull": F.coalesce, "$year": F.year, "$month": F.month,
    "$dayOfMonth": F.dayofmonth, "$size": F.size, "$cond": lambda test, yes, no: F.when(test, yes).otherwise(no),
    "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b), "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$and": lambda *v: reduce(lambda a, b: a & b, v),
    "$or": lambda *v: reduce(lambda a, b: a | b, v), "$not": lambda a: ~a,
}


def _operand(value) -> Column:
    """A field (`$name`), an expression (`{"$op": operands}`) or a literal."""
    if isinstance(value, str) and value.startswith("$"):
        return _field(value[1:])
    if isinstance(value, dict) and len(value) == 1:
        (op, operands), = value.items()
        if op == "$literal":
            return F.lit(operands)
        if op not in EXPRESSIONS:
            raise ValueError(f"unsupported expression: {op}")
        return EXPRESSIONS[op](*map(_operand, operands if isinstance(operands, list) else [operands]))
    return F.lit(value)


# First and last follow the order of the fields, since rows have none: the least and the greatest value.
ACCUMULATORS: dict[str, Callable[[Column], Column]] = {
    "$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.min, "$last": F.max,
    "$push": lambda c: F.array_sort(F.collect_list(c)), "$addToSet": lambda c: F.array_sort(F.collect_set(c)),
    "$stdDevSamp": F.stddev_samp, "$stdDevPop": F.stddev_pop,
}
# Missing values equal NULL and nothing else, so that $ne keeps them.
COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)), "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: _among(c, v), "$nin": lambda c, v: ~_among(c, v),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(), "$regex": lambda c, v: c.rlike(v),
}


def _among(c: Column, values: list) -> Column:
    known = F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False))
    return known | c.isNull() if None in values else known


def _group(df: DataFrame, spec: dict) -> DataFrame:
    key = spec["_id"]
    measures = []
    for name, accumulator in spec.items():
        if name == "_id":
            continue
        (op, operand), = accumulator.items()
        if op != "$count" and op not in ACCUMULATORS:
            raise ValueError(f"unsupported accumulator: {op}")
        measure = F.count(F.lit(1)) if op == "$count" else ACCUMULATORS[op](_operand(operand))
        measures.append(measure.alias(name))
    if isinstance(key, dict) and not any(k.startswith("$") for k in key):
        identity = F.struct(*[_operand(v).alias(k) for k, v in key.items()])
    else:
        identity = _operand(key)
    if key is None:
        return df.groupBy().agg(*measures).select(F.lit(None).cast("string").alias("_id"), "*")
    return df.groupBy(identity.alias("_id")).agg(*measures)


def _project(df: DataFrame, spec: dict) -> DataFrame:
    hidden = [k for k, v in spec.items() if v in (0, False)]
    shown = {k: v for k, v in spec.items() if v not in (0, False)}
    if not shown:
        return df.drop(*hidden)
    names = ["_id"] if "_id" in df.columns and "_id" not in spec else []
    kept = [col(n) for n in names]
    kept += [(col(k) if v in (1, True) else _operand(v)).alias(k) for k, v in shown.items()]
    return df.select(*kept)


def _test(spec: dict) -> Column:
    """The condition of a `$match`; fields and operators hold together."""
    tests = []
    for name, test in spec.items():
        if name in ("$and", "$or", "$nor"):
            parts = [_test(t) for t in test]
            whole = reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), parts)
            tests.append(~F.coalesce(whole, F.lit(False)) if name == "$nor" else whole)
        elif name == "$expr":
            tests.append(_operand(test))
        elif name.startswith("$"):
            raise ValueError(f"unsupported operator: {name}")
        else:
            for op, value in (test if isinstance(test, dict) else {"$eq": test}).items():
                if op not in COMPARISONS:
                    raise ValueError(f"unsupported operator: {op}")
                tests.append(COMPARISONS[op](_field(name), value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _unwind(df: DataFrame, spec: str | dict) -> DataFrame:
    path, keep = (spec, False) if isinstance(spec, str) else (spec["path"], spec.get("preserveNullAndEmptyArrays", False))
    name = path.removeprefix("$")
    return df.withColumn(name, (F.explode_outer if keep else F.explode)(col(name)))


def stage_query(df: DataFrame, stages: Sequence[dict]) -> DataFrame:
    """Aggregation stages in order: `$match`, `$project`, `$addFields`, `$group`, `$unwind`, `$count`, `$sort`, `$limit`.

    Nested results get one level of columns. `$limit` after a `$sort` takes ties in the order of all columns; without a
    sort it takes the first rows in that order.
    """
    order: list[Column] = []
    for step in stages:
        (name, spec), = step.items()
        if name == "$match":
            df = df.where(_test(spec))
        elif name == "$project":
            df = _project(df, spec)
        elif name == "$group":
            df = _group(df, spec)
        elif name in ("$addFields", "$set"):
            df = df.withColumns({k: _operand(v) for k, v in spec.items()})
        elif name == "$unwind":
            df = _unwind(df, spec)
        elif name == "$count":
            df = df.agg(F.count("*").alias(spec))
        elif name == "$sort":
            order = [_field(k).asc() if way > 0 else _field(k).desc() for k, way in spec.items()]
            df = df.orderBy(*order)
        elif name == "$limit":
            df = head(df, spec, [*order, *all_columns(df)])
        else:
            raise ValueError(f"unsupported stage: {name}")
        if name in ("$project", "$group", "$unwind", "$count"):
            order = []
    return flatten(df, depth=1)


# --- shaping an answer -----------------------------------------------------------------------------------

def all_columns(df: DataFrame) -> list[Column]:
    """Every column that has an order; structs and arrays compare, maps by their text."""
    return [F.to_json(col(f.name)) if isinstance(f.dataType, T.MapType) else col(f.name) for f in df.schema.fields]


@dataclass
class Answer:
    """Either a scalar or a table; `rows` holds the shown part."""
    scalar: object | None
    table: DataFrame | None
    row_count: int
    columns: list[str]

    @property
    def rows(self) -> DataFrame | None:
        return None if self.table is None else response(self.table)


def shape(result: DataFrame | object) -> Answer:
    """Scalars stay apart, an empty table is no table, names are plain text with `_` for nesting."""
    if not isinstance(result, DataFrame):
        return Answer(result, None, 0, [])
    # Staged, so that the count and the rows come from one evaluation.
    table = stage(flatten(result, separator="_"), "shaped")
    count = table.count()
    return Answer(None, table if count else None, count, table.columns if count else [])


def grouped_names(df: DataFrame, keys: Sequence[str], measures: dict[str, Sequence[str]]) -> DataFrame:
    """Several aggregates of several columns under flat `column_aggregate` names."""
    functions = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp,
                 "median": F.median}
    return df.groupBy(*[col(k) for k in keys]).agg(*[
        functions[m](col(c)).alias(f"{c}_{m}") for c, names in measures.items() for m in names])


def response(table: DataFrame, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first 200 rows, by the given order and then by all columns."""
    return head(table, RESPONSE_ROWS, [*order_by, *all_columns(table)])


# --- charts of an answer ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Chart:
    needed: bool
    kind: str
    x: str | None
    y: str | None


def choose_chart(question: str, df: DataFrame, needed: bool = False, kind: str | None = None,
                 x: str | None = None, y: str | None = None) -> Chart:
    """Chart for a result: wishes that fit are kept, the rest follows from the column types.

    x defaults to the first column and y to the first numeric one. A chart word in the question forces a
    chart. Category and number make a bar (a pie when asked for and small enough), a time and a number a
    line, two numbers a scatter, one number a histogram.
    """
    columns = df.columns
    if not columns:
        return Chart(False, "none", None, None)
    forced = bool(CHART_WORDS.search(question))
    numeric = numeric_columns(df)
    x = x if x in columns else columns[0]
    y = y if y in columns else (numeric[0] if numeric else None)
    if kind is None:
        kind = _kind(question.lower(), df, x, y, numeric)
    return Chart(needed or forced, kind if needed or forced else "none", x, y)


def _kind(question: str, df: DataFrame, x: str, y: str | None, numeric: list[str]) -> str:
    for word in ("histogram", "scatter", "pie", "line", "bar"):
        if re.search(rf"\b{word}s?\b", question):
            few = word != "pie" or len(df.select(col(x)).distinct().limit(PIE_ROWS + 1).collect()) <= PIE_ROWS
            return word if few else "bar"
    kinds = {f.name: f.dataType for f in df.schema.fields}
    timed = isinstance(kinds[x], (T.DateType, T.TimestampType, T.TimestampNTZType))
    if x in numeric:
        if len(df.columns) == 1 or y is None or "distribution" in question:
            return "histogram"
        return "scatter" if y != x else "histogram"
    if timed or "trend" in question:
        return "line"
    return "bar"


def chart_rows(df: DataFrame, chart: Chart, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """Rows under a chart of a result.

    histogram: 30 bins; pie: first 10 rows, or top 10 counts without y; line: rows, or counts by key;
    scatter: rows, or as bar without y; bar: first 20 rows, or top 20 counts.
    """
    x, y = chart.x, chart.y
    plain = df.dropna(subset=[x] + ([y] if y else []))
    if chart.kind == "histogram":
        return histograms(plain, [x], bins=QUERY_BINS)
    pairs = None
    if y:
        pairs = plain.select(col(x).alias("x"), col(y).alias("y"))
        order_by = [{x: "x", y: "y"}.get(o, o) if isinstance(o, str) else o for o in order_by]
    counts = plain.groupBy(col(x).alias("x")).agg(F.count("*").alias("y"))
    top = [F.desc("y"), "x"]
    if chart.kind == "pie":
        return _shown(pairs, PIE_ROWS, order_by) if y else head(counts, PIE_ROWS, top)
    if chart.kind == "line":
        return pairs if y else counts.orderBy("x")
    if chart.kind == "scatter" and y:
        return pairs
    return _shown(pairs, BAR_ROWS, order_by) if y else head(counts, BAR_ROWS, top)


def _shown(rows: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    return head(rows, n, [*order_by, *all_columns(rows)])


def chart_payload(df: DataFrame, chart: Chart, order_by: Sequence[str | Column] = ()) -> dict[str, object]:
    """Series preview and statistics of a result's chart.

    Names lose their dots, and a grouping key is shown as `category`.
    """
    plain = category_for_id(underscore_names(df))
    x = {"_id": "category"}.get(chart.x, chart.x.replace(".", "_"))
    y = chart.y.replace(".", "_") if chart.y else None
    shown = [col(x).cast("string").alias("x")] + ([col(y).alias("y")] if y else [])
    out: dict[str, object] = {
        "chart_type": chart.kind, "x_name": x, "y_name": y or "value", "total_points": plain.count(),
        "points": head(plain, SHOWN_POINTS, [*order_by, *all_columns(plain)]).select(*shown)}
    numeric = [c for c in dict.fromkeys([x, y]) if c in numeric_columns(plain)]
    if numeric:
        out["statistics"] = query_statistics(plain, numeric)
    return out


def context_lines(kpis: DataFrame, profile_lines: DataFrame, insights: str = "", anomaly_report: str = "",
                  characters: int | None = None) -> DataFrame:
    """section, text: what is told about a table next to a question; `characters` cuts the profile to that length.

    Its inputs have a few rows per column, so each section is one short text.
    """
    spark = kpis.sparkSession
    figures = kpis.agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(
        "=", "metric", F.col("value").cast("string")).alias("t")))).alias("a")).select(
        F.lit("KPIs").alias("section"), F.concat_ws("\n", "a.t").alias("text"))
    profile = profile_lines.agg(F.array_sort(F.collect_list(F.struct("part", "position", "line"))).alias("a")).select(
        F.lit("Dataset Profile").alias("section"), F.concat_ws("\n", "a.line").alias("text"))
    if characters is not None:
        profile = profile.withColumn("text", F.substring("text", 1, characters))
    texts = spark.createDataFrame([("Insights", insights), ("Anomaly Report", anomaly_report)],
                                  "section string, text string").where("text != ''")
    return figures.unionByName(texts).unionByName(profile)
