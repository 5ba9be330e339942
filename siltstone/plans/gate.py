"""What SQL may do: one read-only query over `logs`."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from .tree import expressions, items, kind, nodes

TABLE = "logs"
#: Nodes of the parsed plan that a read-only query may have.
ALLOWED = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving "
    "UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation OneRowRelation$ OneRowRelation Generate Window WithWindowDefinition UnresolvedTableValuedFunction UnresolvedTVFAliases "
    "Pivot Unpivot Expand UnresolvedHint Sample PipeOperator PipeExpression UnresolvedStarExcept".split()
)
#: Functions that reach beyond rows.
FORBIDDEN = frozenset("reflect java_method try_reflect raise_error assert_true input_file_name input_file_block_start input_file_block_length from_avro to_avro from_protobuf to_protobuf ai_query".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple collations sql_keywords variant_explode".split()) - {"collations", "sql_keywords"}


class InvalidSql(ValueError):
    """Not a read-only query over the one table."""


def check(spark: SparkSession, sql: str) -> None:
    """Raises InvalidSql unless the text is one query whose nodes, relations and functions are allowed."""
    if not sql.strip():
        raise InvalidSql("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise InvalidSql("the statement does not parse") from e
    seen = list(nodes(plan))
    names = {TABLE}
    for node in seen:
        if kind(node) == "UnresolvedWith":
            names |= {x._1().lower() for x in items(node.cteRelations())}
    for node in seen:
        what = kind(node)
        if what not in ALLOWED:
            raise InvalidSql("only a query is allowed")
        if what == "UnresolvedRelation":
            parts = items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise InvalidSql("unknown table")
        if what == "UnresolvedTableValuedFunction" and (len(parts := items(node.name())) != 1 or parts[0].lower() not in TABLE_FUNCTIONS):
            raise InvalidSql("unknown table function")
        for e in expressions(node):
            if kind(e) == "UnresolvedFunction" and items(e.nameParts())[-1].lower() in FORBIDDEN:
                raise InvalidSql("this function is not allowed")
