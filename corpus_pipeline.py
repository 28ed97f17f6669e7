"""The corpus pipeline over ``documents``: toxicity, quality rules, SimHash near-dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to
the cluster's shared folder and reads it again as the next stage's ``docs``. All but the last return the
columns of documents. Stages drop what their operator rejects and nothing else:

* toxicity: rows scoring 0.5 or more go; the classifier learns from the training fold of ``labels``;
* quality rules: rows that the rules don't keep go;
* SimHash near-dedup: of each class of texts that are linked by a five-word Jaccard similarity of 0.8 or
  more, the row with the smallest doc_id stays; of repeated rows one stays. SimHash finds the candidates,
  the similarity itself decides;
* best-fit packing: all that is left, packed into sequences of at most 1024 tokens.

Null texts are empty texts; they fail the quality rules. An empty table stays empty. Further columns of
documents pass through the stages, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import best_fit, divergence, simhash_gph, toxicity_cnn
from weftgraph.llm.ppm import crc_mod
from weftgraph.llm.queries import VOCABULARY
from weftgraph.llm.runtime import exact, settle, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = exact(docs, "doc_id", "text")
    net = toxicity_cnn.train(own, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity_cnn.with_scores(own, net, name="__toxicity").filter("__toxicity < 0.5").drop("__toxicity").toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = exact(docs, "doc_id", "text", "lang")
    return divergence.quality(own).filter("kept").select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = exact(docs, "doc_id", "text")
    first = settle(simhash_gph.first_of_similar(own).toDF("__id", "__own", "__copies"), "first-of-class")
    named = own.withColumn("__text", simhash_gph.digest_of())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__own"))
    once = named.join(first.filter("__copies = 1"), same, "left_semi")
    several = named.join(first.filter("__copies > 1"), same, "left_semi")
    twin = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.lit(1)))
    single = several.withColumn("__twin", twin).filter("__twin = 1")
    return once.select(*own.columns).union(single.select(*own.columns)).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(docs, VOCABULARY)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("best-fit packing", packing)]

#: A trained network decides the first stage, which SQL can't express; the tests hold it to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
