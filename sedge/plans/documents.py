"""Document and evidence queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import text as t
from sedge.operators import documents as d
from sedge.operators import evidence as ev
from sedge.plans.events import _EST
from sedge.plans.sql import frame


def _tree(docs):
    return d.hierarchy(d.blocks(docs))


def _page_tree(pages):
    return d.hierarchy(d.blocks(pages, "page_id", "html", is_html=True), "page_id")


def _verify(conversations):
    turns = conversations.select((F.col("conv_id") * 100000 + F.col("turn")).alias("answer"), "conv_id", "turn", "text")
    evidence = turns.alias("a").join(turns.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") == F.col("b.turn") + 1)).select(F.col("a.answer").alias("answer"), F.col("b.answer").cast("string").alias("item"), F.lit(0).alias("position"), F.col("b.text").alias("text"), F.lit("chunk").alias("kind"))
    return ev.report(ev.verdicts(ev.claims(turns), evidence).withColumn("conv_id", F.floor(F.col("answer") / 100000)), ["conv_id"])


def _pack(docs):
    rows = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id")).alias("rank"), F.col("lang").alias("section"), t.estimate_tokens(F.col("text")).alias("tokens"), F.col("doc_id").alias("seed"))
    return ev.packed(rows, 3000, {"de": 500})


_DUCK_NAMES = r"SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}])([A-Z][A-Za-z0-9]{3,})', 1)) AS name FROM documents"

PLANS = {
    "html_blocks": frame("pages", lambda p: d.blocks(p, "page_id", "html", is_html=True).select("page_id", "ordinal", "kind", "level", F.sha2("text", 256).alias("hash"))),
    "document_blocks": frame(
        "documents",
        lambda x: d.blocks(x).groupBy("doc_id").agg(F.count_if(F.col("kind") != "heading").alias("n"), F.sum(F.octet_length("text")).alias("bytes")),
    ),
    "section_tree": frame("pages", lambda p: _page_tree(p).groupBy("page_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.col("parent").isNull()).alias("tops"))),
    "chunk_stats": frame("documents", lambda x: d.chunks(_tree(x)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("tokens").alias("largest"), F.sum("tokens").alias("tokens"))),
    "context_edges": frame("pages", lambda p: d.context_edges(_page_tree(p), "page_id").groupBy("page_id", "kind").agg(F.count("*").alias("n"))),
    "name_salience": frame("documents", lambda x: d.salience(x), f"WITH f AS ({_DUCK_NAMES}), c AS (SELECT doc_id, name, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS rank FROM c) SELECT * FROM r WHERE rank <= 8"),
    "summaries": frame("documents", lambda x: d.summaries(x).select("doc_id", F.length("summary").alias("n"), F.sha2("summary", 256).alias("hash"))),
    "query_routes": frame("conversations", lambda c: c.groupBy("role", ev.route(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("What did you say about ", "What do I think of ", "Give a summary of ", "Compare this with ", "On page 3, ", ""))), (F.col("turn") % 6 + 1).cast("int")), "text")).alias("kind")).agg(F.count("*").alias("n")), "SELECT role, ['CONVERSATION_HISTORY', 'USER_MEMORY', 'GLOBAL_SUMMARY', 'DOCUMENT_MULTI_HOP', 'DOCUMENT_LOCAL', 'GENERAL_SEMANTIC'][turn % 6 + 1] AS kind, count(*) AS n FROM conversations GROUP BY 1, 2"),
    "claim_verdicts": frame("conversations", _verify),
    "budget_packing": frame(
        "documents",
        _pack,
        f"""WITH RECURSIVE d AS (SELECT source, doc_id, lang IS NOT DISTINCT FROM 'de' AS de, {_EST} AS size, row_number() OVER (PARTITION BY source ORDER BY n_chars NULLS FIRST, doc_id) AS k FROM documents),
        f AS (SELECT DISTINCT source, NULL::BIGINT AS id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS capped, false AS took FROM documents UNION ALL
        SELECT d.source, d.doc_id, d.k, f.used + x.took::INT * d.size, f.capped + (x.took AND d.de)::INT * d.size, x.took FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.k = f.k + 1, LATERAL (SELECT f.used + d.size <= 3000 AND (NOT d.de OR f.capped + d.size <= 500) AS took) x)
        SELECT source AS query, id, used FROM f WHERE took""",
    ),
}
