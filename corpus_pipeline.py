"""From documents to packed training sequences in five stages.

Every stage takes what its predecessor kept, from Parquet in the shared folder, and returns the columns of documents,
the last one the pieces of sequences:

1. toxicity: documents that score the threshold or more go;
2. ngram_jaccard_join: of each group of documents linked by five-word shingles (0.8 or more), the one with the smallest
   id stays;
3. suffix_array_dedup: strings of 200 bytes that also start elsewhere are taken out of the texts, up to whole
   characters, and ``n_chars`` follows; a text may become empty, its document stays;
4. benchmark_decontamination: documents with a window of a benchmark item go;
5. packing: token ids of what is left, in sequences of 4096.

Null texts pass all stages as empty ones; repeated rows leave one row after stage 2; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanward.llm import decontam, jaccard, packing, suffix, toxicity
from spanward.llm.queries import table, tokenizer_file
from spanward.session import materialise

KEY = "_corpus_pipeline_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, jaccard.row_key("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = jaccard.link_components(docs, width=5, num=80, den=100)
    kept = linked.where("doc_id <=> component_id").select(F.col("doc_key").alias(KEY)).distinct()
    return _keyed(docs).join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    windows = decontam.windows_of(table(spark, sf_dir, "benchmark"))
    hit = decontam.find_windows(decontam.build_index(keyed, id_col=KEY), windows).where(F.size("spans") > 0)
    return keyed.join(hit.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", remove_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenizing, learned scores and link components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
