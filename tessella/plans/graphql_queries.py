"""GraphQL reads over the data folder's property graph, with their DuckDB SQL."""

from __future__ import annotations

from ..catalog import edges, nodes
from . import graphql
from .library import query


def _asked(name: str, text: str, oracle: str, relations: tuple[str, ...] = ("LOCATED_IN", "PART_OF"), variables: dict | None = None) -> None:
    def run(spark, sf_dir):
        return graphql.run(text, nodes(spark, sf_dir), edges(spark, sf_dir, *relations), variables)

    run.__name__ = name
    query(oracle)(run)


_asked(
    "graphql_filter_first",
    '{ region(first: 3) { id label } one: nation(id: "nation:7") { key: id __typename } }',
    """SELECT 'region' AS field, '[' || string_agg('{"id":"region:' || r_regionkey || '","label":"region"}', ',' ORDER BY r_regionkey) || ']' AS data FROM region WHERE r_regionkey < 3
    UNION ALL SELECT 'one', '[{"key":"nation:7","__typename":"nation"}]'""",
)
_asked(
    "graphql_nested",
    "{ region { id in_PART_OF { id } } }",
    """SELECT 'region' AS field, '[' || string_agg('{"id":"region:' || r_regionkey || '","in_PART_OF":[' || ns || ']}', ',' ORDER BY 'region:' || r_regionkey) || ']' AS data
    FROM region JOIN (SELECT n_regionkey, string_agg('{"id":"nation:' || n_nationkey || '"}', ',' ORDER BY 'nation:' || n_nationkey) AS ns FROM nation GROUP BY 1) ON n_regionkey = r_regionkey""",
)
_asked(
    "graphql_fragments_variables",
    "query q($n: String = \"nation:3\", $deep: Boolean = true, $no: Boolean = true) { nation(id: $n) { ...short PART_OF @include(if: $deep) { ...short } label @skip(if: $no) } } fragment short on nation { id ... on nation { kind: label } }",
    """SELECT 'nation' AS field, '[{"id":"nation:3","kind":"nation","PART_OF":[{"id":"region:' || n_regionkey || '","kind":"region"}]}]' AS data FROM nation WHERE n_nationkey = 3""",
)
_asked(
    "graphql_connection",
    '{ region_connection(first: 2, after: "region:1") { edges { cursor node { id } } pageInfo { hasNextPage endCursor } } }',
    """SELECT 'region_connection' AS field, '{"edges":[{"cursor":"region:2","node":{"id":"region:2"}},{"cursor":"region:3","node":{"id":"region:3"}}],"pageInfo":{"hasNextPage":true,"hasPreviousPage":false,"endCursor":"region:3"}}' AS data""",
)
_asked(
    "graphql_connection_last",
    '{ region_connection(last: 2) { edges { node { id } } } }',
    """SELECT 'region_connection' AS field, '{"edges":[{"cursor":"region:3","node":{"id":"region:3"}},{"cursor":"region:4","node":{"id":"region:4"}}],"pageInfo":{"hasNextPage":false,"hasPreviousPage":true,"endCursor":"region:4"}}' AS data""",
)
