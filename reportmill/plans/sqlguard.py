"""A guard for SQL that somebody else wrote: one SELECT over the catalog's one table, and nothing else.

The statement is parsed, not analysed or run, and its logical plan is walked: relations first, then the kind of
statement, then node types and functions, which have to be on a list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

TABLE = "reports"
REFUSAL = "허용되지 않은 SQL입니다. reports 테이블에 대한 SELECT 문만 실행할 수 있습니다."
#: Nodes that may surround the SELECT at the root.
WRAPPERS = {"Sort", "GlobalLimit", "LocalLimit", "Offset", "WithWindowDefinition"}
SELECTS = {"Project", "Aggregate", "UnresolvedHaving", "Distinct", "Deduplicate"}
NODES = WRAPPERS | SELECTS | {
    "Filter", "Join", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "OneRowRelation", "Union", "Intersect", "Except", "UnresolvedInlineTable", "LocalRelation", "Window",
}
SET_OPERATIONS = {"Union", "Intersect", "Except"}
#: The functions that a statement may call: aggregates, windows, text, dates and arithmetic over the table's own values.
FUNCTIONS = frozenset(
    """
    abs any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_size array_sort avg
    bool_and bool_or bround btrim cast ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains count
    count_if cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff datepart day
    dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp extract first first_value floor format_number format_string get greatest
    hour if ifnull initcap instr isnotnull isnull lag last last_day last_value lcase lead least left len length like listagg ln locate log log10
    lower lpad ltrim make_date max max_by mean median min min_by minute mod mode month months_between next_day nth_value ntile nullif nvl nvl2
    percent_rank percentile percentile_approx pmod position pow power quarter rank regexp_count regexp_extract regexp_extract_all regexp_like
    regexp_replace replace reverse right rlike round row_number rpad rtrim second sign size some sort_array split split_part sqrt startswith std
    stddev stddev_pop stddev_samp string string_agg struct substr substring sum to_char to_date to_timestamp translate trim trunc try_cast try_to_date
    ucase upper var_pop var_samp variance weekday weekofyear when year
    """.split()
)
#: A join by few values has few partitions with rows, whose pairs are many times their bytes: partitions are not put together,
#: and one that is larger than this is cut on both sides, each piece of one side meeting each of the other in a task of its own.
PIECES = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@dataclass(frozen=True)
class Rejected:
    """reason: parse, table, kind, node or function."""

    reason: str
    detail: str


class SqlRejected(Exception):
    def __init__(self, rejected: Rejected):
        super().__init__(f"{REFUSAL} ({rejected.reason}: {rejected.detail})")
        self.rejected = rejected


def _seq(s) -> Iterator:
    return (s.apply(i) for i in range(s.size()))


def _plans(plan) -> Iterator:
    """A plan's nodes, those of subqueries in its expressions and of the bodies of WITH included."""
    yield plan
    for child in _seq(plan.children()):
        yield from _plans(child)
    if plan.nodeName() == "UnresolvedWith":
        for relation in _seq(plan.cteRelations()):
            yield from _plans(relation._2())
    for expression in _seq(plan.expressions()):
        for e in _expressions(expression):
            if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                yield from _plans(e.plan())


def _expressions(e) -> Iterator:
    yield e
    for child in _seq(e.children()):
        yield from _expressions(child)


def _parts(names) -> list[str]:
    return [str(x) for x in _seq(names)]


def _replaced(spark: SparkSession, name: str) -> bool:
    """Whether the session has a function of its own under a built-in's name."""
    found = spark._jsparkSession.sessionState().catalog().lookupFunctionInfo(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.getSource() != "built-in"


def check(spark: SparkSession, sql: str, table: str = TABLE) -> Rejected | None:
    """Why the statement may not run, or None."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        return Rejected("parse", str(e).split("\n")[0][:200])
    nodes = list(_plans(plan))
    for node in nodes:
        kind = node.nodeName()
        if kind == "UnresolvedRelation":
            parts = _parts(node.multipartIdentifier())
        elif kind in ("UnresolvedIdentifier", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedView"):
            parts = _parts(node.nameParts() if kind == "UnresolvedIdentifier" else node.multipartIdentifier())
        elif kind == "UnresolvedTableValuedFunction":
            return Rejected("table", "table function " + ".".join(_parts(node.name())))
        else:
            continue
        if len(parts) != 1 or parts[0].lower() != table:
            return Rejected("table", ".".join(parts))
    root = plan
    while root.nodeName() in WRAPPERS:
        root = root.children().apply(0)
    inner = root.children().apply(0).nodeName() if root.nodeName() == "Distinct" else ""
    if root.nodeName() not in SELECTS or inner in SET_OPERATIONS:
        return Rejected("kind", inner or root.nodeName())
    for node in nodes:
        if node.nodeName().split(" ")[0] not in NODES:
            return Rejected("node", node.nodeName())
        for expression in _seq(node.expressions()):
            for e in _expressions(expression):
                if e.getClass().getSimpleName() == "UnresolvedFunction":
                    parts = _parts(e.nameParts())
                    if len(parts) != 1 or parts[0].lower() not in FUNCTIONS or _replaced(spark, parts[0]):
                        return Rejected("function", ".".join(parts))
    return None


def run(spark: SparkSession, sql: str, reports: DataFrame, table: str = TABLE) -> DataFrame:
    """The statement's result over the reports, which it sees as a view; SqlRejected if it may not run. Nothing is collected.

    It runs in a session of its own, with the caller's settings and PIECES, so views and settings of the caller's stay as
    they are.
    """
    rejected = check(spark, sql, table)
    if rejected:
        raise SqlRejected(rejected)
    own, name = spark.newSession(), f"{table}_{uuid.uuid4().hex}"
    for key, value in (spark.conf.getAll | PIECES).items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    reports.createGlobalTempView(name)
    try:
        own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}").createOrReplaceTempView(table)
        return own.sql(sql)
    finally:  # the result is analysed by now and keeps its own plan
        spark.catalog.dropGlobalTempView(name)
