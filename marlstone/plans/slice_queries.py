"""The flagship: which newly added records pass the gate, what class do they get, and which are the first three of each class?"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import classifiers, gates, merging, ranking
from marlstone.plans.classifier_queries import STEP_SQL, STEPS
from marlstone.plans.gate_queries import B5_CTE, COMPETING, CORE, titled
from marlstone.plans.registering import Group

group = Group()


@group.add(
    "slice_weekly_top",
    B5_CTE + f""", k AS (SELECT doc_id, n_chars, {STEP_SQL} AS kind FROM r WHERE reason IN ('explicit_title', 'metadata_term', 'repeated_mention') AND doc_id % 5 = 0),
 t AS (SELECT kind, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM k) SELECT * FROM t WHERE rank <= 3""",
)
def slice_weekly_top(spark, sf):
    """Base and incoming records by id, upsert, semi-join to the added ones, gate, class, top three."""
    d = titled(spark, sf).select("doc_id", "n_chars", "source", "title", "body", "low")
    incoming = d.where("doc_id % 5 = 0")
    added = merging.upsert(d.where("doc_id % 5 <> 0").select("doc_id", "n_chars"), incoming.select("doc_id", "n_chars"), "doc_id").where("change = 'added'")
    fresh = incoming.join(added.select("doc_id"), "doc_id", "left_semi")
    gate = gates.relevance(F.col("title"), F.col("body"), F.array("source"), CORE, COMPETING)
    kept = fresh.where(gate["keep"]).select("doc_id", "n_chars", classifiers.by_steps(F.col("low"), STEPS, "other").alias("kind"))
    return ranking.top_k(kept, ["kind"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("kind", "doc_id", "n_chars", "rank")
