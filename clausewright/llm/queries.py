"""Queries over the test tables, one group per problem, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..retrieval.arms import MAX_QUERY_TOKENS
from ..sources.tables import table
from . import chunking, leakage, markup, neardup, rankwalk, residue, tokens, vptree

#: The least factor of those tried that finds every planted pair from 0.85 to 0.87, the
#: lowest band; 0.15 found 94 % of them. Recall by band: see the README.
PAIR_RULE = vptree.VpRule(min_cosine=0.85, factor=0.3)
ARMS = ("lexical", "dense", "rerank", "keyword")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized clause with the first level at which its units fit."""
    pieces = chunking.split_oversized(table(spark, d, "clauses", "chunk_id", "text"), only_oversized=True)
    return pieces.where(F.col("piece") == 0).select("chunk_id", "boundary")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every clause as pieces within the embedding window."""
    return chunking.split_oversized(table(spark, d, "clauses", "chunk_id", "text"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query with their five scores, null where there is none."""
    hits = table(spark, d, "hit_out", "query_id", "chunk_id", "arm", "score")
    arms = hits.groupBy("query_id", "chunk_id").agg(*[F.max(F.when(F.col("arm") == a, F.col("score"))).alias(a) for a in ARMS])
    terms = table(spark, d, "query_terms", "query_id", "term_id", F.col("weight").cast("double").alias("qw"))
    # postings of terms that no query has go before anything is shuffled
    own = terms.select("term_id").distinct()
    own = F.broadcast(own) if terms.count() <= MAX_QUERY_TOKENS else own
    postings = table(spark, d, "clause_sparse", "chunk_id", "term_id", "weight").join(own, "term_id", "left_semi").groupBy("chunk_id", "term_id").agg(F.max("weight").cast("double").alias("w"))
    sparse = (
        arms.select("query_id", "chunk_id")
        .join(terms, "query_id")
        .join(postings, ["chunk_id", "term_id"])
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("qw") * F.col("w")), 9).alias("sparse"))
    )
    return arms.join(sparse, ["query_id", "chunk_id"], "left")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.rank_by_walk(p2_scores(spark, d), "query_id", "chunk_id", [*ARMS, "sparse"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best clauses of each query."""
    return p2_ranking(spark, d).where(F.col("rank") <= 5).select("query_id", "chunk_id")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every clause as clean text with spans of its structure; paths are judged over all clauses."""
    clauses = table(spark, d, "clauses", "chunk_id", "text")
    return markup.clean_markup(clauses, residue=markup.corpus_residue(clauses))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each clause that holds markup with each kind; rules find the kinds, the ratios play no part."""
    marked = markup.clean_markup(table(spark, d, "clauses", "chunk_id", "text"), only_marked=True)
    return marked.select("chunk_id", F.explode("kinds").alias("markup"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every clause that takes part with its group of near-duplicates."""
    clauses = table(spark, d, "clauses", "chunk_id", "heading", "text")
    return neardup.near_duplicates(clauses, "chunk_id", "text", "heading", neardup.CLAUSE_RULE).select("chunk_id", F.col("group").alias("group_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The clauses of groups of at least two."""
    groups = p5_groups(spark, d)
    shared = groups.groupBy("group_id").count().where("count > 1").select("group_id")
    return groups.join(shared, "group_id").select("chunk_id", "group_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clauses, each among the other's five most similar, from 0.85 on.

    Only neighbours from 0.85 on can make such a pair, and whatever is nearer
    than one of those is one itself, so the search may take that as its reach.
    """
    near = vptree.nearest(table(spark, d, "clauses", "chunk_id", "embedding"), "chunk_id", "embedding", PAIR_RULE)
    pairs = vptree.mutual(near, "chunk_id").where(F.col("cosine") >= 0.85)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar clauses of every clause whose id is divisible by 100, exactly."""
    clauses = table(spark, d, "clauses", "chunk_id", "embedding")
    near = vptree.nearest(clauses, "chunk_id", "embedding", vptree.VpRule(), clauses.where(F.col("chunk_id") % 100 == 0))
    return near.select("chunk_id", "neighbour", F.round("cosine", 4).alias("cosine"), "rank")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the items of which it holds twelve words in a row."""
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents", "doc_id", "text", "source"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are templates, filler, error pages or script notices."""
    return p9_residue(spark, d).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_ranking, p3_found, p3_clean, p5_found, p5_groups, p6_found, p6_neighbours, p7_ids, p8_found, p8_leaks, p9_found, p9_residue)
}
# The same in SQL where it can be stated exactly; the other results depend on parsers, hashes or libraries.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LEVEL = "list_max(list_transform(string_split_regex({0}, '{1}'), lambda u: length(u))) <= 2000"
_USABLE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0"
_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '[\x{200B}\x{AD}]', '', 'g')), '[\p{L}\p{N}]+')"
_PLAIN = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{L}\p{N}]+')"
_GRAMS = "select distinct id, list_aggregate(ws[i:i + 11], 'string_agg', ' ') as g from (select id, ws, unnest(generate_series(1, len(ws) - 11)) as i from (select {id} as id, {words} as ws from {t} where text is not null))"
SQL: dict[str, str] = {
    "p1_found": "select chunk_id, case when " + _LEVEL.format("text", r"\r?\n(?:[ \t]*\r?\n)+") + " then 'paragraph' when " + _LEVEL.format("text", r"\r?\n") + " then 'line' when "
    + _LEVEL.format(f"regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(10), 'g')", r"\r?\n") + f" then 'sentence' when " + _LEVEL.format("text", f"{_SPACE}+") + " then 'word' else 'none' end as boundary from clauses where length(text) > 2000",
    # the same say for each score: the mean of the ranks, those without a score last and level
    "p2_found": "with h as (select query_id, chunk_id, max(score) filter (where arm = 'lexical') as a, max(score) filter (where arm = 'dense') as b, max(score) filter (where arm = 'rerank') as c, max(score) filter (where arm = 'keyword') as d from hit_out group by all), "
    "s as (select q.query_id, p.chunk_id, sum(q.weight::double * p.w) as e from query_terms q join (select chunk_id, term_id, max(weight)::double as w from clause_sparse group by all) p using (term_id) group by all), j as (select h.*, round(s.e, 9) as e from h left join s using (query_id, chunk_id)), "
    "r as (select query_id, chunk_id, " + " + ".join(f"(rank() over (partition by query_id order by {x} desc nulls last) + (count(*) over (partition by query_id, {x}) - 1) / 2.0::double)" for x in "abcde") + " as total from j) "
    "select query_id, chunk_id from (select *, row_number() over (partition by query_id order by total, chunk_id) as n from r) where n <= 5",
    "p6_neighbours": f"with v as (select chunk_id, embedding::double[] as x from clauses where {_USABLE}), c as (select a.chunk_id, b.chunk_id as neighbour, list_cosine_similarity(a.x, b.x) as s from v a join v b on a.chunk_id <> b.chunk_id where a.chunk_id % 100 = 0), r as (select *, row_number() over (partition by chunk_id order by round(s, 6) desc, neighbour) as rank from c) select chunk_id, neighbour, round(s, 4) as cosine, rank::int as rank from r where rank <= 5",
    # exact: every pair by its common shingles, groups by reachability (small tables only)
    "p5_found": "with recursive w as (select chunk_id, " + _PLAIN.replace("{0}", "heading") + " || " + _PLAIN.replace("{0}", "text") + " as ws, len(" + _PLAIN.replace("{0}", "text") + ") as n from clauses), "
    "g as (select distinct chunk_id, list_aggregate(ws[i:i + 2], 'string_agg', ' ') as g from (select chunk_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from w where n >= 30)), "
    "k as (select chunk_id, count(*) as n, md5(string_agg(g, '|' order by g)) as h from g group by 1), first as (select h, min(chunk_id) as one, any_value(n) as n from k group by 1), "
    "s as (select f.one as id, g.g, f.n from first f join g on g.chunk_id = f.one), "
    "l as (select a.id as a, b.id as b from s a join s b on a.g = b.g and a.id < b.id group by a.id, b.id having count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9), "
    "e as (select a, b from l union select b, a from l), r(id, c) as (select one, one from first union select r.id, e.b from r join e on e.a = r.c), m as (select id, min(c) as c from r group by 1), "
    "o as (select k.chunk_id, m.c from k join first f using (h) join m on m.id = f.one), z as (select chunk_id, min(chunk_id) over (partition by c) as group_id, count(*) over (partition by c) as n from o) select chunk_id, group_id from z where n > 1",
    "p6_found": f"with v as (select chunk_id, embedding::double[] as x from clauses where {_USABLE}), c as (select a.chunk_id, b.chunk_id as other, list_cosine_similarity(a.x, b.x) as s from v a join v b on a.chunk_id <> b.chunk_id), r as (select *, row_number() over (partition by chunk_id order by round(s, 6) desc, other) as n from c) select a.chunk_id as chunk_a, a.other as chunk_b from r a join r b on a.chunk_id = b.other and a.other = b.chunk_id where a.n <= 5 and b.n <= 5 and a.s >= 0.85 and a.chunk_id < a.other",
    "p8_found": "with d as (" + _GRAMS.format(id="doc_id", words=_WORDS.replace("{0}", "text"), t="documents") + "), i as (" + _GRAMS.format(id="item_id", words=_WORDS.replace("{0}", "text"), t="eval_items") + ") select distinct d.id as doc_id, i.id as item_id from d join i using (g)",
}
