"""Graph, instruction, generation and label tables derived from the star schema.

Parts are entities in blocks of ``BLOCK``; a block is a graph. Two parts of a
graph are linked when they follow each other, by key, among the parts shipped
on one day with one return flag. A world is a ship month: a root part is true in
the months in which it shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsets.functions.draws import chance, draw
from graphsets.functions.text import boxed
from graphsets.operators import graph
from graphsets.operators.score import canonical_answers
from graphsets.plans.dataset import DatasetBuilder, DatasetConfig, GraphTables, prepare_nodes
from graphsets.session import dealt, durable

BLOCK = 20
SEED = 42
FIRST_YEAR = 1995

CONFIG = dict(
    num_entities=BLOCK,
    node_or_prob=0.6,
    sample_ratio_from_worlds=0.002,
    num_observation_templates=10,
    num_explanation_templates=10,
    num_copies_explanations=1,
    add_instruction_datapoints=2500,
    val_ratio=0.1,
    test_ratio=0.1,
    seed=SEED,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(key) -> F.Column:
    """Text order equals key order."""
    return F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0"))


def graph_of(key) -> F.Column:
    return F.floor(key / BLOCK).cast("bigint")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        graph_of(key).alias("graph_idx"), entity(key).alias("entity"), (key % BLOCK).alias("ord")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the lines, which are moved once: a day and flag of a graph is one row with a bit for each part."""
    key = F.col("l_partkey")
    together = (
        table(spark, sf_dir, "lineitem")
        .filter(key.isNotNull())
        .groupBy(graph_of(key).alias("graph_idx"), "l_shipdate", "l_returnflag")
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(l_partkey, {BLOCK}) as int))")).alias("_bits"))
        .filter(F.bit_count("_bits") > 1)
    )
    parts = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda place: F.getbit("_bits", place) == 1)
    following = F.arrays_zip(F.col("_parts").alias("_a"), F.slice("_parts", 2, BLOCK).alias("_b"))
    linked = together.withColumn("_parts", parts).select("graph_idx", F.inline(following).alias("_a", "_b"))
    first = F.col("graph_idx") * BLOCK
    return (
        linked.filter(F.col("_b").isNotNull())
        .select("graph_idx", entity(first + F.col("_a")).alias("parent"), entity(first + F.col("_b")).alias("child"))
        .distinct()
    )


def world_of(date) -> F.Column:
    return ((F.year(date) - FIRST_YEAR) * 12 + F.month(date) - 1).cast("bigint")


def num_worlds(spark: SparkSession, sf_dir: str) -> int:
    """Months up to the last shipment; one number from the scan."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.agg(world_of(F.max("l_shipdate")).alias("w")).first()["w"] + 1


def root_words(spark: SparkSession, sf_dir: str, node_table: DataFrame, edge_table: DataFrame, worlds: int) -> DataFrame:
    """Packed facts of the roots: one bit per ship month."""
    world = world_of(F.col("l_shipdate"))
    sold = (
        table(spark, sf_dir, "lineitem")
        .select(
            entity(F.col("l_partkey")).alias("entity"),
            F.floor(world / graph.WORD).cast("int").alias("word"),
            (world % graph.WORD).cast("int").alias("_bit"),
        )
        .groupBy("entity", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_sold"))
    )
    last = (worlds - 1) // graph.WORD
    roots = graph.root_nodes(node_table.select("graph_idx", "entity"), edge_table)
    return (
        roots.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .join(dealt(sold), ["entity", "word"], "left")
        .select("graph_idx", "entity", "word", F.coalesce("_sold", F.lit(0).cast("bigint")).alias("bits"))
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows; a drawn half states an answer."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("instruction")
    )
    replied = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_reply")
    )
    says = chance(0.5, draw(SEED, "says", "conv_id", "turn"))
    stated = F.concat("_reply", F.lit(" The answer is "), F.col("turn").cast("string"), F.lit("."))
    return asked.join(dealt(replied), ["conv_id", "turn"]).select(
        "conv_id", "turn", "instruction", F.when(says, stated).otherwise(F.col("_reply")).alias("output")
    )


def line_key() -> F.Column:
    """A name for a line; integers, whole cents and days, so that engines print it alike."""
    return F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("bigint"), F.floor(F.col("l_extendedprice") * 100 + 0.5),
        F.datediff("l_shipdate", F.lit("1970-01-01")),
    )


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their name as ``row_key``."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_returnflag", "l_linestatus",
    )
    return items.withColumn("row_key", line_key())


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled rows: one to three distinct labels each."""
    extra = F.col("_extra")
    more = (
        F.when(extra == 3, F.array(F.lit("X"), F.lit("Y")))
        .when(extra == 2, F.array(F.lit("X")))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        _line_items(spark, sf_dir)
        .withColumn("_extra", draw(SEED, "label", "row_key") % 4)
        .select(
            "row_key",
            F.col("l_returnflag").alias("split"),
            F.col("l_linestatus").alias("key"),
            F.col("l_suppkey").alias("supplier"),
            F.concat(F.array("l_linestatus"), more).alias("inference_types"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers: an order is an example, each of its lines a sample.

    Of ten drawn forms one has no box, one two boxes, one blanks in the box and
    one nested braces.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("example_id"),
        F.col("o_orderstatus").alias("answer"),
        F.col("o_orderpriority").alias("primary_inference_type"),
    )
    orders = canonical_answers(orders, "answer", "canonical_answer")
    form = F.col("_form")
    said = F.col("l_linestatus")
    wording = (
        F.when(form == 0, F.concat(F.lit("I think it is "), said))
        .when(form == 1, F.concat(F.lit("First "), boxed(F.lit("Z")), F.lit(", no: "), boxed(said), F.lit(".")))
        .when(form == 2, F.concat(F.lit("So "), boxed(F.concat(F.lit("  "), said, F.lit(" ")))))
        .when(form == 3, F.concat(F.lit("So "), boxed(F.concat(F.lit("\\text{"), said, F.lit("}")))))
        .otherwise(F.concat(F.lit("The answer is "), boxed(said), F.lit(".")))
    )
    generated = (
        _line_items(spark, sf_dir)
        .withColumn("_form", draw(SEED, "form", "row_key") % 10)
        .select(F.col("l_orderkey").alias("example_id"), "row_key", wording.alias("generated_text"))
    )
    return orders.join(generated, "example_id")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples as one row per example with its texts in line order, and the example's other fields."""
    rows = samples(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("row_key", "generated_text")))
    texts = rows.groupBy("example_id").agg(F.transform(ordered, lambda s: s["generated_text"]).alias("generated_text"))
    status = F.col("o_orderstatus")
    examples = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("example_id"),
        F.concat(F.lit("Status of order "), "o_orderkey", F.lit("?")).alias("prompt"),
        status.alias("answer"),
        F.concat(F.lit("C"), "o_custkey").alias("query_entity"),
        F.col("o_orderpriority").alias("primary_inference_type"),
        F.array("o_orderpriority", status).alias("inference_types"),
        F.when(status == "F", "rule").alias("explanation_type"),
    )
    return canonical_answers(examples, "answer", "canonical_answer").join(texts, "example_id")


class Tables:
    """Derived tables of one data directory, each computed once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict = {}

    def once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def edges(self) -> DataFrame:
        return self.once("edges", lambda: durable(edges(self.spark, self.sf_dir)))

    def nodes(self) -> DataFrame:
        """With ord, rule and component_id."""
        return self.once(
            "nodes",
            lambda: prepare_nodes(
                nodes(self.spark, self.sf_dir), self.edges(), CONFIG["node_or_prob"], SEED
            ),
        )

    def num_worlds(self) -> int:
        return self.once("worlds", lambda: num_worlds(self.spark, self.sf_dir))

    def graph_tables(self) -> GraphTables:
        def make():
            words = root_words(self.spark, self.sf_dir, self.nodes(), self.edges(), self.num_worlds())
            return GraphTables(
                self.nodes(), self.edges(), durable(words),
                durable(instructions(self.spark, self.sf_dir)), ("conv_id", "turn"),
            )

        return self.once("graph_tables", make)

    def builder(self, **changes) -> DatasetBuilder:
        """Builders with the same settings share their tables."""
        settings = {**CONFIG, "num_worlds": self.num_worlds(), **changes}
        name = f"builder {sorted(settings.items())}"
        return self.once(name, lambda: DatasetBuilder(self.graph_tables(), DatasetConfig(**settings)))

    def examples(self) -> DataFrame:
        """The whole data set of the default settings.

        The narrow tables below it are written, not its texts: most readers need few of its columns.
        """
        return self.once("examples", lambda: self.builder().examples())
