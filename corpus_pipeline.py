"""From documents to a training mix, in five stages; each is written and read again before the next.

toxicity: documents that the lexicon model rejects go. The model learns from sf_dir's
    labels, those held out excepted.
simhash: of each near-duplicate component the document with the least id stays; links
    are SimHashes within 4 bits and five-word Jaccard similarities of 0.8 or more.
suffix: every byte that a repeated 400-byte string or a repeated passage of over 50
    words covers is cut out of the texts; documents of which nothing but white space is left after a cut go.
decontaminate: documents with a window of a benchmark item go.
mix: documents that the mix takes, with size, source_size, target, copies and taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm.common import bucketed, cut, new_path, scratch, text_key
from scenespark.llm.components import components
from scenespark.llm.decontaminate import decontaminate
from scenespark.llm.entry import held_out
from scenespark.llm.mixing import mix
from scenespark.llm.resemblance import resembling
from scenespark.llm.simhash import near_duplicates
from scenespark.llm.suffix import dedup_substrings
from scenespark.llm.toxicity import fit, score

#: A passage of over 50 words that repeats is cut, whatever its length in bytes.
WORDS = 51

#: Texts of this five-word Jaccard similarity or more are near-duplicates, whatever their SimHashes.
SIMILAR = 0.8

# A stage deletes no table that a frame still to run could read, its own included: run() drops each
# stage's scratch tables once its rows are written, and a caller of one stage can do so with scratch().
#
# All stages: a null text counts as empty and stays null where its row stays; an empty
# table gives an empty table; whole texts are read, however long; columns that a stage
# doesn't use pass through unchanged, whatever their names and types. Only doc_id and
# text must be there, and source for the mix.


def _guarded(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones renamed, so that none clashes with what an operator adds, and the columns that undo it."""
    names = {c: c if c in used else f"__in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model predicts to be toxic. Equal texts, so repeated rows too, share their fate; an empty text stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = _guarded(docs, "doc_id", "text")
    model = fit(rows, labels.where(~held_out()))
    return score(rows, model).where("predicted = 0").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicate texts: that with the least id, nulls last.

    Equal texts, empty and null ones together, are one component, so of repeated rows one
    stays; of rows with equal id and text that whose other columns have the least hash.
    """
    k1, k2 = text_key(F.col("text"))
    rows, back = _guarded(docs, "doc_id", "text")
    # Of each text its first row: whole rows are shuffled once, copies combined before, and lie by their text from there on.
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(F.col("text").isNull(), *[F.col(c).cast("string") for c in rest])
    row = F.min_by(F.struct(*rows.columns), F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", tie.alias("t"))).alias("r")
    first = bucketed(rows.groupBy(k1.alias("__k1"), k2.alias("__k2")).agg(row).select("__k1", "__k2", "r.*"), "near_rows", "__k1", "__k2")
    found = cut(near_duplicates(first, keep=["__k1", "__k2"]), "near_found")
    texts = first.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda x: found.select(F.col("__k1").alias(f"{x}1"), F.col("__k2").alias(f"{x}2"), F.col("component").alias(x))
    edges = resembling(texts, SIMILAR).join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    wider = components(edges.where("a <> b"), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("wider"))
    found = found.join(wider, "component", "left").withColumn("component", F.coalesce("wider", "component"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k1", "__k2")).alias("b")
    kept = found.groupBy("component").agg(least).select("b.__k1", "b.__k2")
    return first.join(kept, ["__k1", "__k2"], "left_semi").select(*back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated strings and passages cut out of their texts, and n_chars, where it is there, counted again.

    Every place of a repeat is cut, so of repeated rows long enough nothing is left. A
    document of which only white space is left after a cut goes; others stay, also empty ones.
    """
    rows, back = _guarded(docs.withColumn("__null", F.col("text").isNull()), "text")
    null = f"__in{len(docs.columns)}"
    found = dedup_substrings(rows, with_text=True, words=WORDS)
    found = found.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    # The kept text is the whole text where nothing was cut, so the old one needn't be carried along.
    new = {"text": F.when(~F.col(null), F.col("kept"))}
    if "n_chars" in docs.columns:
        old = F.col(f"__in{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("n_removed") == 0, old).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new[c].alias(c) if c in new else x for c, x in zip(docs.columns, back)])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item. Equal texts share their fate; a text without words stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, back = _guarded(docs, "text")
    return decontaminate(rows, items).where(~F.col("contaminated")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken in place of columns of those names.

    A null source is a source of its own; repeated rows share their fate; a document without words isn't taken.
    """
    return mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: XXH64, the learned model and the suffix order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline_{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
