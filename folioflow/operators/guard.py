"""What a handed-in SQL statement would do, judged by its parsed plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Statements that write rows, by the name of their plan; all other commands are refused.
WRITES = {"InsertIntoStatement": "insert", "UpdateTable": "update", "DeleteFromTable": "delete", "AppendData": "insert"}
#: Commands that only tell.
TELLS = {"ExplainCommand", "ShowTables", "ShowNamespaces", "ShowColumns", "ShowFunctions", "DescribeRelation", "DescribeColumn", "DescribeNamespace", "DescribeQueryCommand"}
#: What the plan of a query consists of. A node of any other name is refused, so a new kind of command is too.
READS = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "AsOfJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "SubqueryAlias", "Union", "Except", "Intersect",
    "OneRowRelation", "OneRowRelation$", "LocalRelation", "Range", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases",
    "UnresolvedWith", "UnresolvedHaving", "UnresolvedHint", "UnresolvedOrdinal", "WithWindowDefinition", "Window", "Generate", "Expand", "Pivot", "Unpivot", "Sample", "Repartition", "RepartitionByExpression",
    "RebalancePartitions", "RelationTimeTravel", "UnresolvedIdentifier", "UnresolvedNamespace", "UnresolvedTable", "UnresolvedTableOrView", "TableValuedFunction", "AliasedRelation",
    "WithCTE", "CTERelationDef", "CTERelationRef", "UnionLoop", "UnionLoopRef",
}
#: Functions that run code of any kind.
RUNS = {"reflect", "java_method", "try_reflect"}


@dataclass(frozen=True)
class Verdict:
    """kind: query, insert, update, delete, or refused with a reason; targets: the tables that it writes."""

    kind: str
    targets: tuple[str, ...] = ()
    reason: str = ""


def _all(plan):
    """The plan's nodes, those of its subqueries and of its common table expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for seq in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [x for x in (seq.apply(i) for i in range(seq.size())) if hasattr(x, "children") and hasattr(x, "subqueries")]


def judge(spark: SparkSession, statement: str, writable: tuple[str, ...] = ()) -> Verdict:
    """What a statement does. Only one statement is allowed; what Spark's parser doesn't understand is refused.

    Queries are allowed, and writes of rows to the tables in `writable` (names as they are written, in any case of letters).
    Truncating, dropping, altering, merging and all other commands are refused, as are functions that run code.
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(statement)
    except ParseException as e:
        return Verdict("refused", reason=f"no single statement that can be parsed: {str(e).splitlines()[0][:200] if str(e) else 'empty'}")
    kinds: set[str] = set()
    targets: list[str] = []
    for node in _all(plan):
        name = node.getClass().getSimpleName()
        run = RUNS & _functions(node)
        if run:
            return Verdict("refused", reason="function " + ", ".join(sorted(run)))
        if name in WRITES:
            kinds.add(WRITES[name])
            targets.append(_target(node))
        elif name not in TELLS and name not in READS:
            return Verdict("refused", reason=f"{name} is no part of a query")
    if not kinds:
        return Verdict("query")
    if len(kinds) > 1 or not {t.lower() for t in targets} <= {w.lower() for w in writable}:
        return Verdict("refused", tuple(targets), "writes to " + ", ".join(targets))
    return Verdict(kinds.pop(), tuple(targets))


def _functions(node) -> set[str]:
    """Names of the functions that the node's own expressions call, without their catalog and schema."""
    out: set[str] = set()
    seq = node.expressions()
    todo = [seq.apply(i) for i in range(seq.size())]
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            parts = e.nameParts()
            out.add(parts.apply(parts.size() - 1).lower())
        kids = e.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    if node.getClass().getSimpleName() == "UnresolvedTableValuedFunction":
        name = node.name()
        out.add(name.apply(name.size() - 1).lower())
    return out


def _target(node) -> str:
    """The table of a write, as it was written."""
    table = node.table()
    while table.getClass().getSimpleName() == "SubqueryAlias":
        table = table.child()
    parts = table.multipartIdentifier()
    return ".".join(parts.apply(i) for i in range(parts.size()))


def read_only(spark: SparkSession, statement: str) -> bool:
    """Whether a statement is a single query."""
    return judge(spark, statement).kind == "query"
