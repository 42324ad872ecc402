"""Tables the registered queries share, derived from the driver's tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillprint.operators.structural import structural_features

# Code put in front of every derived snippet; {id} becomes the document's key.
PYTHON_HEAD = (
    "import os\n"
    "class K{id}:\n"
    "    def m(self):\n"
    "        pass\n"
    "for i in r:\n"
    "    pass\n"
    "while w:\n"
    "    break\n"
    "try:\n"
    "    pass\n"
    "except E as e:\n"
    "    pass\n"
)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a plain scan that has fewer tasks than there are cores.

    The driver's tables are single files of one row group: one task however
    many cores wait. Inputs that already split that far are returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as snippets ``(id, code, language)``."""
    documents = spread(table(spark, sf_dir, "documents"))
    return documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("lang").alias("language")
    )


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as snippets ``(id, code)``."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("code"))


def split_of(key: Column) -> Column:
    return F.when(key % 10 < 8, "train").when(key % 10 == 8, "val").otherwise("test")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, split)`` of labelled documents."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("int").alias("label"),
        split_of(F.col("doc_id")).alias("split"),
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents ``(id, code, language, label, split)``."""
    return texts(spark, sf_dir).join(labels(spark, sf_dir), "id")


def python_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python snippet per document: a fixed head, then a line per word of the text."""
    head = F.replace(F.lit(PYTHON_HEAD), F.lit("{id}"), F.col("id").cast("string"))
    body = F.regexp_replace(
        "code", "[^A-Za-z]*([A-Za-z]+)[^A-Za-z]*", "if v_$1: v_$1 = g(1)\n"
    )
    body = F.when(F.col("code").rlike("[A-Za-z]"), body).otherwise("")
    language = F.when(F.col("id") % 3 == 0, "Python ").when(F.col("id") % 3 == 1, "java")
    return texts(spark, sf_dir).select(
        "id", F.concat(head, body).alias("code"), language.alias("language")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of three made-up models over the labelled documents.

    Only keys and sizes are read, so the join moves narrow rows.
    """
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    joined = sizes.join(labels(spark, sf_dir), "id")
    score_a = (F.col("n_chars") % 100) / 100.0
    score_b = ((F.col("id") * 7919 + F.col("n_chars") * 104729) % 1000003) / 1000003.0
    flipped = F.when(F.col("id") % 11 == 0, 1 - F.col("label")).otherwise(F.col("label"))

    def model(name: str, y_pred: Column, y_proba: Column) -> Column:
        return F.struct(
            F.lit(name).alias("model"),
            y_pred.cast("int").alias("y_pred"),
            y_proba.cast("double").alias("y_proba"),
        )

    return joined.select(
        "id",
        "split",
        F.col("label").alias("y_true"),
        F.inline(
            F.array(
                model("A", F.col("n_chars") % 3 == 0, score_a),
                model("B", score_b > 0.5, score_b),
                model("C", flipped, F.lit(None)),
            )
        ),
    )


def tag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening tags of each page as a node table; the depth counts open tags."""
    tags = markup(spark, sf_dir).select(
        "id",
        F.posexplode(F.regexp_extract_all("code", F.lit("<(/?[a-z][^>]*)>"), F.lit(1))).alias(
            "node_id", "tag"
        ),
    )
    opens = ~F.col("tag").startswith("/")
    order = Window.partitionBy("id").orderBy("node_id")
    running = F.sum(F.when(opens, 1).otherwise(-1)).over(order)
    name = F.regexp_extract("tag", "^[a-z0-9]+", 0)
    kinds = {
        "a": "identifier",
        "li": "call_expression",
        "p": "function_declaration",
        "div": "class_body",
        "meta": "import_statement",
        "h1": "if_statement",
        "article": "for_statement",
        "ul": "while_statement",
    }
    mapping = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    return (
        tags.withColumn("depth", running.cast("int"))
        .where(opens)
        .select(
            "id",
            F.col("node_id").cast("long").alias("node_id"),
            F.lit(None).cast("long").alias("parent_id"),
            "depth",
            F.coalesce(F.try_element_at(mapping, name), name).alias("node_type"),
            F.when(name == "a", F.col("tag")).alias("name"),
        )
    )


def nested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening tags of each page with the tag they lie in, and no depth: the last tag before them one level up."""
    tags = tag_nodes(spark, sf_dir).select("id", "node_id", "depth", "node_type")
    sides = F.array(
        F.struct(F.col("depth").alias("level"), F.col("node_id").alias("holder"), F.lit(False).alias("inner")),
        F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast("long").alias("holder"), F.lit(True).alias("inner")),
    )
    order = Window.partitionBy("id", "level").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = tags.select("id", "node_id", "node_type", F.inline(sides))
    held = placed.withColumn("parent_id", F.last("holder", ignorenulls=True).over(order))
    return held.where("inner").select("id", "node_id", "parent_id", "node_type")


def flat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a feature table ``(id, truth, label, features, split)``: the first feature is the label, rarely wrong in truth."""
    documents = table(spark, sf_dir, "documents")
    marks = documents.select(
        F.col("doc_id").alias("id"),
        (F.col("n_chars") % 2).cast("int").alias("label"),
        (F.col("n_chars") % 5).alias("rest"),
        split_of(F.col("doc_id")).alias("split"),
    )
    truth = F.when(F.col("id") % 11 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    vector = array_to_vector(F.array(F.col("label").cast("double"), F.col("rest").cast("double")))
    return marks.select("id", truth.alias("truth"), "label", vector.alias("features"), "split")


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' language and source as snippets, labelled by language: one word decides."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", "lang", "source").alias("code"),
        F.col("lang").isin("en", "es").cast("int").alias("label"),
        split_of(F.col("doc_id")).alias("split"),
    )


def broken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Python snippets, every seventh with an end that cannot be parsed."""
    end = F.when(F.col("id") % 7 == 0, "def f(:\n").otherwise("")
    return python_texts(spark, sf_dir).withColumn("code", F.concat("code", end))


def marked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural features ``(id, label, split, ..)`` of documents behind a line with none to two semicolons: the label says whether any."""
    documents = spread(table(spark, sf_dir, "documents"))
    marks = F.col("n_chars") % 3
    snippets = documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("x"), F.repeat(F.lit(";"), marks.cast("int")), F.lit("\n"), F.regexp_replace("text", ";", ",")).alias("code"),
        (marks > 0).cast("int").alias("label"),
        split_of(F.col("doc_id")).alias("split"),
    )
    return structural_features(snippets, keep=("id", "label", "split"))
