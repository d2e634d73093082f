"""What a read-only query may contain, judged on Catalyst's trees, never on the query's text.

The parsed tree is walked before anything is resolved, so no file is opened and no
function found for a query that is refused.  It may read names of the permitted views and of
the common table expressions in scope, literal rows, and nothing else.  The
analysed tree is walked as well: its leaves must lie inside a permitted view, and no
expression may leave the engine, under whatever name it was called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

_CATALYST = "org.apache.spark.sql.catalyst"
#: Leaves of a parsed tree that read nothing.
ROWS_WITHOUT_SOURCE = {"OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "ResolvedInlineTable"}
#: Leaves of an analysed tree outside the views; a reference stands for a definition that is walked too.
ANALYSED_LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"}
#: Functions that call into the virtual machine, and the expressions that stand for them.
JVM_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
FOREIGN_EXPRESSIONS = {"CallMethodViaReflection", "ScalaUDF", "PythonUDF", "ScalaAggregator", "ScalaUDAF", "PythonUDAF"}


class ReadOnlyViolation(ValueError):
    """The text is not a single read-only query."""


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class TreeGuard:
    """Walks the trees of queries of one session that may read ``views``."""

    def __init__(self, spark: SparkSession, views: Iterable[str]):
        self.spark, self.views = spark, {v.lower() for v in views}
        self.gateway = spark.sparkContext._gateway

    def check(self, query: str) -> DataFrame:
        """The query's DataFrame if it only reads the views; :class:`ReadOnlyViolation` otherwise."""
        self._parsed(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset())
        df = self.spark.sql(query)
        self._analysed(df._jdf.queryExecution().analyzed())
        return df

    def _expressions(self, node: JavaObject) -> Iterator[JavaObject]:
        pending = list(_items(node.expressions()))
        while pending:
            e = pending.pop()
            yield e
            pending.extend(_items(e.children()))

    def _subquery(self, e: JavaObject) -> JavaObject | None:
        held = is_instance_of(self.gateway, e, f"{_CATALYST}.expressions.PlanExpression")
        return e.plan() if held else None

    def _parsed(self, node: JavaObject, scope: frozenset[str]) -> None:
        kind = _kind(node)
        if kind == "UnresolvedWith":
            for definition in _items(node.cteRelations()):
                name = definition._1().lower()
                inner = scope | {name} if node.allowRecursion() else scope
                self._parsed(definition._2(), inner)
                scope |= {name}
        elif kind == "UnresolvedRelation":
            name = list(_items(node.multipartIdentifier()))
            if len(name) > 1 or name[0].lower() not in self.views | scope:
                raise ReadOnlyViolation(f"only the views {', '.join(sorted(self.views))} can be read, not {'.'.join(name)}")
        elif not node.children().size() and kind not in ROWS_WITHOUT_SOURCE:
            raise ReadOnlyViolation(f"a query reads views and literal rows, not {kind}")
        for e in self._expressions(node):
            if _kind(e) == "UnresolvedFunction" and (name := list(_items(e.nameParts()))[-1]).lower() in JVM_FUNCTIONS:
                raise ReadOnlyViolation(f"the function {name} is not permitted")
            if (plan := self._subquery(e)) is not None:
                self._parsed(plan, scope)
        for child in _items(node.children()):
            self._parsed(child, scope)

    def _analysed(self, node: JavaObject) -> None:
        kind = _kind(node)
        if kind == "View":
            name = node.desc().identifier()
            if not node.isTempView() or name.database().isDefined() or name.table().lower() not in self.views:
                raise ReadOnlyViolation(f"the view {name.table()} is not permitted")
            return
        if not node.children().size() and kind not in ANALYSED_LEAVES:
            raise ReadOnlyViolation(f"a query reads views and literal rows, not {kind}")
        for e in self._expressions(node):
            if _kind(e) in FOREIGN_EXPRESSIONS or ".hive." in e.getClass().getName():
                raise ReadOnlyViolation(f"the function {e.prettyName()} is not permitted")
            if (plan := self._subquery(e)) is not None:
                self._analysed(plan)
        for child in _items(node.children()):
            self._analysed(child)
