"""Read-only SQL over named views: what the parser made of a query decides, not its words.

The parsed plan is walked as a whole, subqueries and WITH clauses included, before
anything is analysed or run. Three lists bound it: the relational steps below, the views
that the caller names (or every temporary view), and Spark's own functions of the groups
that only compute. So files, catalogs, commands, scripts and calls into the JVM have no
way in, whatever they are called.

What passes may still be too much. Before it runs, the optimised plan's own statistics bound what it
reads and the pairs that a join without an equality looks at (``excess``); while it runs, a
deadline interrupts it by its tag (``answer``).
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, SparkSession

ROWS = 1000
PLANS = "org.apache.spark.sql.catalyst.plans.logical."
UNRESOLVED = "org.apache.spark.sql.catalyst.analysis."
#: Steps that read, combine and reduce rows.
STEPS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin Union Except Intersect Window WithWindowDefinition Pivot UnresolvedPivot Unpivot "
    "Generate Sample SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation".split()
)
#: Groups of Spark's function documentation; misc_funcs, with its calls into Java, is not among them.
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs "
    "predicate_funcs string_funcs struct_funcs window_funcs".split()
)
ROW_SOURCES = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "stack"))


class _Walk:
    """One query's parsed plan, looked at through the JVM."""

    def __init__(self, spark: SparkSession, views: frozenset[str]):
        state, jvm = spark._jsparkSession.sessionState(), spark.sparkContext._jvm
        self.state, self.jvm, self.views = state, jvm, views
        kind = jvm.java.lang.Class.forName
        self.is_product, self.is_many, self.is_plan = kind("scala.Product").isInstance, kind("scala.collection.Iterable").isInstance, kind(f"{PLANS}LogicalPlan").isInstance

    def parts(self, value) -> Iterator:
        """What a node, tuple or collection holds."""
        step = value.iterator() if self.is_many(value) else value.productIterator() if self.is_product(value) else None
        while step is not None and step.hasNext():
            yield step.next()

    def faults(self, value, known: frozenset[str]) -> Iterator[str]:
        """Why this part of the plan is refused; ``known``: names of WITH that it may use."""
        if not hasattr(value, "getClass"):  # text and numbers arrive as Python's own
            return
        name = value.getClass().getName()
        short = name.rpartition(".")[2]
        if short == "UnresolvedWith":
            for entry in self.parts(value.cteRelations()):
                own = list(self.parts(entry))
                yield from self.faults(own[1], known)
                known |= {own[0].lower()}
            yield from self.faults(value.child(), known)
            return
        if short == "UnresolvedRelation":
            words = list(self.parts(value.multipartIdentifier()))
            if len(words) != 1 or words[0].lower() not in known | self.views:
                yield f"there is no view {'.'.join(words)}"
            return
        if short in ("UnresolvedFunction", "UnresolvedGenerator", "UnresolvedTableValuedFunction"):
            yield from self.of_function(value, short)
        elif self.is_plan(value) and (short not in STEPS or not name.startswith((PLANS, UNRESOLVED))):
            yield f"{short} is not allowed"
        elif "UnresolvedIdentifier" in short:
            yield "names must be written out"
        for part in self.parts(value):
            yield from self.faults(part, known)

    def of_function(self, value, short: str) -> Iterator[str]:
        if short == "UnresolvedFunction":
            words = list(self.parts(value.nameParts()))
        else:
            words = [value.name().funcName()] if short == "UnresolvedGenerator" else list(self.parts(value.name()))
        told = ".".join(words)
        if short != "UnresolvedFunction":
            if told.lower() not in ROW_SOURCES:
                yield f"{told} is not allowed as a source of rows"
            return
        found = self.state.functionRegistry().lookupFunction(self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(told)) if len(words) == 1 else None
        info = found.get() if found is not None and found.isDefined() else None
        if info is None or info.getGroup() not in GROUPS or not info.getClassName().startswith("org.apache.spark.sql.catalyst.expressions."):
            yield f"the function {told} is not allowed"


def fault(spark: SparkSession, query: str, views: Iterable[str] | None = None) -> str | None:
    """Why the query is refused; None if it isn't."""
    if views is None:
        views = (t.name for t in spark.catalog.listTables() if t.isTemporary)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except (ParseException, AnalysisException) as why:
        return f"not a query: {why.getCondition() or 'it cannot be parsed'}"
    return next(_Walk(spark, frozenset(v.lower() for v in views)).faults(plan, frozenset()), None)


#: Rows that any source may have, and pairs that a join may compare one by one.
MOST_ROWS, MOST_PAIRS = 10**12, 10**10


def _rows(node) -> int:
    """How many rows the optimiser thinks that a node has: its count, or its bytes by the width of a row."""
    told = node.stats()
    if told.rowCount().isDefined():
        return int(str(told.rowCount().get()))
    width = max(1, 8 + sum(int(node.output().apply(i).dataType().defaultSize()) for i in range(node.output().size())))
    return int(str(told.sizeInBytes())) // width


def excess(df: DataFrame, rows: int = MOST_ROWS, pairs: int = MOST_PAIRS) -> str | None:
    """Why a query is too large to be run, by its optimised plan; None if it isn't."""
    jvm = df.sparkSession.sparkContext._jvm
    keys = jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        name, children = node.nodeName(), node.children()
        below = [children.apply(i) for i in range(children.size())]
        if not below and _rows(node) > rows:
            return f"{name} has some {_rows(node):.0e} rows, more than {rows:.0e}"
        if name == "Join" and not keys.unapply(node).isDefined():
            compared = _rows(below[0]) * _rows(below[1])
            if compared > pairs:
                return f"a join without an equality compares some {compared:.0e} pairs, more than {pairs:.0e}"
        todo.extend(below)
        inner = node.subqueries()
        todo.extend(inner.apply(i) for i in range(inner.size()))
    return None


def run_sql(spark: SparkSession, query: str, rows: int = ROWS, args=None, views: Iterable[str] | None = None) -> DataFrame:
    """At most ``rows`` rows of the query; ValueError if it is refused."""
    if reason := fault(spark, query, views):
        raise ValueError(reason)
    found = spark.sql(query, args=args).limit(rows)
    if reason := excess(found):
        raise ValueError(reason)
    return found


def answer(spark: SparkSession, query: str, rows: int = ROWS, args=None, views: Iterable[str] | None = None, seconds: float = 60.0) -> list[Row]:
    """The rows of ``run_sql``; TimeoutError if they take longer than ``seconds``, and its jobs end."""
    found, tag, late = run_sql(spark, query, rows, args, views), f"answer-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.2):  # again, as the next stage's job may start meanwhile
            context.cancelJobsWithTag(tag)

    context = spark.sparkContext
    done, timer = threading.Event(), threading.Timer(seconds, stop)
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    timer.start()
    try:
        return found.collect()
    except Exception as why:
        if late.is_set():
            raise TimeoutError(f"the query took longer than {seconds} seconds") from why
        raise
    finally:
        done.set()
        timer.cancel()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
