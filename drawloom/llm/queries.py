"""The registered queries of this subpackage; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawloom.llm.linkage import cluster_drawings, describe_clusters
from drawloom.llm.mixing import mix
from drawloom.llm.neighbours import nearest_drawings, similar_pairs
from drawloom.llm.oracle import ORACLE
from drawloom.llm.overlap import overlap_report, overlaps
from drawloom.llm.packing import pack, packing_report, split_documents
from drawloom.llm.proportions import proportional_sample, unmet
from drawloom.llm.spam import spam_pages
from drawloom.llm.variety import varied_subsets
from drawloom.sources.tables import read_table


def p1_found(spark, d):
    """Pairs of an evaluation and a train drawing that are the same drawing."""
    pairs = overlaps(read_table(spark, d, "examples"))
    return pairs.select(F.least("eval_id", "train_id").alias("row_a"), F.greatest("eval_id", "train_id").alias("row_b"))


def p1_report(spark, d):
    """The overlaps counted by evaluation split and source."""
    examples = read_table(spark, d, "examples")
    return overlap_report(overlaps(examples), examples)


def p2_subset(spark, d):
    """A varied subset of the train drawings for every request."""
    return varied_subsets(read_table(spark, d, "examples"), read_table(spark, d, "subset_requests"))


def _proportional(spark, d):
    return proportional_sample(read_table(spark, d, "examples"), read_table(spark, d, "class_targets"))


def p3_found(spark, d):
    """Rows of class_targets whose target cannot be met: those the drawn sample is short of, if all rows there are would not do either."""
    return unmet(*_proportional(spark, d))


def p3_sample(spark, d):
    """The sampled row_ids of every plan."""
    return _proportional(spark, d)[0]


def p3_report(spark, d):
    """Needed and available rows of every row of class_targets."""
    return _proportional(spark, d)[1].drop("sampled")


def p3_deviation(spark, d):
    """Rows drawn for every row of class_targets, and how far that is from its share of the sample."""
    off = F.round(F.col("sampled") - F.col("target_share") * F.col("sample_rows"), 6)
    return _proportional(spark, d)[1].select("plan_id", "label", "sampled", off.alias("deviation"))


def p4_found(spark, d):
    """Pairs of drawings of which one is among the five most similar of the other."""
    return similar_pairs(nearest_drawings(read_table(spark, d, "examples")))


def p5_found(spark, d):
    """The cluster of every usable train drawing."""
    return cluster_drawings(read_table(spark, d, "examples"), vectors=False).select("row_id", "cluster_row")


def p5_sizes(spark, d):
    """The size of every cluster."""
    return p5_found(spark, d).groupBy("cluster_row").agg(F.count(F.lit(1)).alias("size"))


def p5_clusters(spark, d):
    """Size and most typical drawings of every cluster."""
    return describe_clusters(cluster_drawings(read_table(spark, d, "examples")))


def _packed(spark, d):
    """The packing under plan window; plans other than it are packed by other calls."""
    plan = read_table(spark, d, "pack_plans").where("plan_id = 'window'").select("capacity_tokens").first()
    return pack(read_table(spark, d, "documents"), plan[0]), plan[0]


def p6_found(spark, d):
    """Documents that had to be split."""
    return split_documents(_packed(spark, d)[0])


def p6_containers(spark, d):
    """The contents of every container."""
    return _packed(spark, d)[0]


def p6_report(spark, d):
    """Containers used, the fewest possible, and the share left unused."""
    return packing_report(*_packed(spark, d))


def _mixed(spark, d):
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_found(spark, d):
    """Rows of mix_targets whose source cannot reach its target: those that got too little, if all uses there are would not do either."""
    return _mixed(spark, d)[1].where("got < wanted and not reachable").select("mix_id", "source")


def p7_drawn(spark, d):
    """The drawn documents and how often each is used."""
    return _mixed(spark, d)[0]


def p7_shares(spark, d):
    """What each source was to give and gave."""
    return _mixed(spark, d)[1]


def p8_found(spark, d):
    """Pages of keywords, links or product tags."""
    return spam_pages(read_table(spark, d, "documents")).where("is_spam").select("doc_id")


def p8_pages(spark, d):
    """Every page with its own and its smoothed probability."""
    return spam_pages(read_table(spark, d, "documents"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("p") and name[1].isdigit()}

__all__ = ["ORACLE", "QUERIES"]
