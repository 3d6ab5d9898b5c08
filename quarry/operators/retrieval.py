"""Retrieval: tokens, TF-IDF ranking, keyword routes and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.documents import truncated

#: Words that are no terms.
STOP_WORDS = ["the", "a", "an", "is", "are", "of", "to", "in", "for", "and", "or", "on", "at", "with", "by", "from", "的", "了", "在", "是", "和", "与", "或", "等", "及", "之"]
#: CJK runs, Latin words, decimals.
TOKEN = r"[一-鿿]+|[a-zA-Z_]+|[0-9]+\.?[0-9]*"
#: Documents that keywords lead to.
KEYWORD_DOCS = {
    "fault": ["01_fault_detection"],
    "断层": ["01_fault_detection"],
    "horizon": ["02_horizon_tracking"],
    "层位": ["02_horizon_tracking"],
    "facies": ["03_facies_analysis"],
    "沉积相": ["03_facies_analysis"],
    "channel": ["03_facies_analysis"],
    "河道": ["03_facies_analysis"],
    "reservoir": ["03_facies_analysis", "05_seismic_attributes"],
    "储层": ["03_facies_analysis", "05_seismic_attributes"],
    "fracture": ["05_seismic_attributes", "01_fault_detection"],
    "裂缝": ["05_seismic_attributes", "01_fault_detection"],
    "log": ["04_well_log_analysis"],
    "测井": ["04_well_log_analysis"],
    "well": ["04_well_log_analysis"],
    "lithology": ["04_well_log_analysis"],
    "岩性": ["04_well_log_analysis"],
    "fluid": ["04_well_log_analysis"],
    "流体": ["04_well_log_analysis"],
    "gas": ["04_well_log_analysis"],
    "oil": ["04_well_log_analysis"],
    "attribute": ["05_seismic_attributes"],
    "属性": ["05_seismic_attributes"],
    "envelope": ["05_seismic_attributes"],
    "sweetness": ["05_seismic_attributes"],
    "seismic": ["05_seismic_attributes"],
}


def tokens(text: Column) -> Column:
    """Lower-cased tokens longer than one character that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf``: the share of a document's tokens that a term is."""
    toks = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("_t"))
    total = F.size("_t")
    return toks.select(id_col, total.alias("_n"), F.explode("_t").alias("term")).groupBy(id_col, "_n", "term").agg(F.count("*").alias("n")).select(id_col, "term", (F.col("n") / F.col("_n")).alias("tf"))


def tfidf_scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, id, score``: sum of query tf, document tf and idf (once), above 0.

    Queries are the stated few; their terms are a small broadcast table. A text
    is cut into tokens once, in the row; what is shuffled are the counts of
    the terms asked for. Scores need the number of documents and their document
    frequencies, which are aggregates of these postings.
    """
    q = term_frequencies(queries, "query_id", "query").withColumnRenamed("tf", "qtf")
    asked = F.broadcast(q.agg(F.collect_set("term").alias("_asked")))  # one row
    toks = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("_t")).crossJoin(asked)
    kept = toks.select(id_col, F.size("_t").alias("_n"), F.filter("_t", lambda t: F.array_contains("_asked", t)).alias("_t"))
    post = kept.select(id_col, "_n", F.explode("_t").alias("term")).groupBy(id_col, "_n", "term").agg(F.count("*").alias("n"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    size = docs.agg(F.count("*").alias("N"))
    idf = df.crossJoin(F.broadcast(size)).select("term", (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    hits = post.withColumn("tf", F.col("n") / F.col("_n"))
    return hits.join(F.broadcast(q.join(idf, "term")), "term").groupBy("query_id", id_col).agg(F.sum(F.col("qtf") * F.col("tf") * F.col("idf")).alias("score")).where("score > 0")


def top_k(scores: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """The best ``k`` of each query by unrounded score, then id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_table(spark: SparkSession) -> DataFrame:
    """``keyword, doc_name``: the fixed routes."""
    rows = [F.struct(F.lit(k).alias("keyword"), F.lit(d).alias("doc_name")) for k, ds in KEYWORD_DOCS.items() for d in ds]
    return spark.range(1).select(F.inline(F.array(*rows)))


def keyword_route(parts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``query_id, doc_name`` for keywords contained in a part, whatever the case."""
    hit = F.lower("part").contains(F.lower("keyword"))
    return parts.join(F.broadcast(keywords), hit).select("query_id", "doc_name").distinct()


def hybrid(routed: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """Routed documents first, filled up to ``k`` by rank, cut at ``k``; each document once."""
    both = routed.select("query_id", "doc", F.lit(0).alias("src"), "rank").unionByName(ranked.select("query_id", "doc", F.lit(1).alias("src"), "rank"))
    once = both.groupBy("query_id", "doc").agg(F.min(F.struct("src", "rank")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.src", "b.rank", "doc")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "doc", F.col("b.src").alias("src"), "place")


#: What stands before knowledge that is put into a prompt, and after a text that was cut.
KNOWLEDGE_HEAD, CUT_MARK, CUT_AT = "\n=== 领域知识参考 (RAG检索) ===\n", "\n...(截断)", 1500


def knowledge_text(chosen: DataFrame, docs: DataFrame, doc_col: str, text_col: str, limit: int = CUT_AT) -> DataFrame:
    """``query_id, knowledge``: the texts chosen for a query, in their order, as one text for a prompt.

    ``chosen`` (query_id, doc, place) are the few of ``hybrid``; their texts alone are
    fetched. A text over ``limit`` characters is cut and marked; documents without a text are
    left out, and a query whose documents all have none has the head alone.
    """
    found = docs.select(F.col(doc_col).cast("string").alias("doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.select("doc").distinct()), "doc", "left_semi")
    part = F.concat(F.lit("--- "), F.col("doc"), F.lit(" ---\n"), truncated(F.col("_text"), limit, CUT_MARK), F.lit("\n"))
    each = chosen.join(found, "doc", "left").withColumn("_part", F.when(F.length("_text") > 0, part))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("place", "doc", "_part")))), lambda x: x["_part"])
    return each.groupBy("query_id").agg(F.concat_ws("\n", F.lit(KNOWLEDGE_HEAD), listed).alias("knowledge"))
