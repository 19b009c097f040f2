"""Entities: mentions in texts, ownership chains and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import mentions as mt
from suite.registry import query
from suite.tables import ENTITIES, entities, table


def aliases(spark, sf):
    """Aliases drawn from the benchmark passages: their first one, two and three words."""
    b = table(spark, sf, "benchmark")
    ws = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return b.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("entity_id"),
        F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.array_join(F.slice(ws, F.lit(1), n), " "))).alias("alias"),
    ).filter(F.length("alias") >= 8)


# The boundary pattern ends on a lookalike of a lookahead: a consumed non-word character is fine,
# because only whether an alias occurs is asked.
_NOT_WORD = r"[^\p{L}\p{N}_]"

MENTIONED = f"""w AS (SELECT 'b' || item_id AS entity_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
al AS (SELECT entity_id, array_to_string(w[1:n], ' ') AS alias FROM w, (VALUES (1), (2), (3)) v(n)),
low AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents),
near AS MATERIALIZED (SELECT doc_id, t, entity_id, alias FROM low JOIN al ON length(alias) >= 8 AND contains(t, lower(alias))),
hit AS (SELECT doc_id, entity_id, alias FROM near WHERE regexp_matches(t, '(^|{_NOT_WORD})' || regexp_escape(lower(alias)) || '($|{_NOT_WORD})')),
best AS (SELECT doc_id, entity_id, arg_max(alias, length(alias)) AS alias FROM hit GROUP BY ALL)"""


@query(
    "entity_mentions",
    f"""WITH {MENTIONED} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, entity_id) AS mention_rank FROM best""",
)
def _mentions(spark, sf):
    return mt.mentions(table(spark, sf, "documents").select("doc_id", "text"), aliases(spark, sf))


CHAIN = """up AS (SELECT entity_id, entity_id AS owner, 0 AS distance, [entity_id] AS path FROM entities
  UNION ALL SELECT u.entity_id, p.entity_id, u.distance + 1, list_append(u.path, p.entity_id)
  FROM up u JOIN entities e ON e.entity_id = u.owner JOIN entities p ON p.entity_id = e.parent
  WHERE NOT list_contains(u.path, p.entity_id))"""


@query("ownership_chain", f"WITH RECURSIVE {ENTITIES}, {CHAIN} SELECT entity_id, owner, distance FROM up")
def _chain(spark, sf):
    return mt.ownership_chains(entities(spark, sf))


@query(
    "ownership_statement",
    f"""WITH RECURSIVE {ENTITIES}, {CHAIN}, told AS (SELECT u.entity_id, count(*) AS n, string_agg(CASE WHEN distance = 0 THEN o.name
        WHEN o.kind = 'sponsor' THEN 'portfolio company of ' || o.name ELSE 'parent: ' || o.name END, ' — ' ORDER BY distance) AS line
      FROM up u JOIN entities o ON o.entity_id = u.owner GROUP BY 1)
    SELECT entity_id, CASE WHEN n = 1 AND ticker IS NOT NULL THEN name || ' — shareholder-owned, ' || ticker ELSE line END AS statement
    FROM told JOIN entities USING (entity_id)""",
)
def _statement(spark, sf):
    return mt.ownership_statements(entities(spark, sf))
