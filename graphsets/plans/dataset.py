"""From node, edge, fact and instruction tables to the finished example rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsets.functions.templates import FAMILIES
from graphsets.operators import caps, closure, examples, graph, specs, splits
from graphsets.session import dealt_once, durable

# A graph with more facts (words of 64 worlds) or sampled specs than this is large: its joins are dealt by all their columns.
NEAR_ROWS = 1024
NEAR_ASKED = 1_000_000


# Parameter names, defaults and unit texts of the metadata record.
@dataclass(frozen=True)
class DatasetConfig:
    """Parameters of a data set; a cap of None means no cap."""

    num_graphs: int = 10
    num_entities: int = 20
    edge_prob: float = 0.2
    node_or_prob: float = 1.0
    num_worlds: int = 1000
    sample_ratio_from_worlds: float = 0.01
    root_prior: float = 0.5
    max_obs_size: int = 2
    num_observation_templates: int = 10
    num_explanation_templates: int = 10
    max_observations: int | None = None
    max_observations_per_component_probability_bin: int | None = None
    max_explanations: int | None = None
    num_copies_explanations: int = 4
    add_instruction_datapoints: int = 2500
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    heldout_scope: str = "nodes"
    per_component_data: bool = False
    seed: int = 0

    def __post_init__(self):
        if not 0.0 <= self.sample_ratio_from_worlds <= 1.0:
            raise ValueError(f"sample_ratio_from_worlds must lie in [0, 1]: {self.sample_ratio_from_worlds}")
        for name in (
            "max_observations", "max_observations_per_component_probability_bin", "max_explanations",
            "num_copies_explanations", "add_instruction_datapoints",
        ):
            value = getattr(self, name)
            if value is not None and value < 0:
                raise ValueError(f"{name} must not be negative: {value}")
        if self.max_observations_per_component_probability_bin is not None and not self.per_component_data:
            raise ValueError("max_observations_per_component_probability_bin needs per_component_data=True")
        if self.heldout_scope not in ("nodes", "graphs"):
            raise ValueError(f"heldout_scope must be 'nodes' or 'graphs': {self.heldout_scope!r}")

    def metadata(self) -> dict:
        """The parameters as the metadata record names them."""
        return {
            **asdict(self),
            "max_observations_unit": "per split and inference_type",
            "max_observations_per_component_probability_bin_unit": (
                "per train graph_idx, query component_idx, observed_probability_bin"
            ),
            "max_explanations_unit": "per split and explanation_type before train copies",
        }


@dataclass(frozen=True)
class GraphTables:
    """What examples are made from.

    nodes(graph_idx, entity, ord, rule, component_id), edges(graph_idx, parent,
    child), root_words(graph_idx, entity, word, bits), instructions(…order,
    instruction, output).
    """

    nodes: DataFrame
    edges: DataFrame
    root_words: DataFrame
    instructions: DataFrame
    instruction_order: tuple[str, ...]
    made: dict = field(default_factory=dict, compare=False, repr=False)

    def related(self) -> DataFrame:
        """Reachability as bitmaps; it depends on no setting, so all builders share it."""
        if "related" not in self.made:
            self.made["related"] = durable(closure.related_words(self.nodes, self.edges))
        return self.made["related"]

    def words(self) -> DataFrame:
        """Packed facts of all nodes, shared as well."""
        if "words" not in self.made:
            self.made["words"] = durable(graph.propagate(self.nodes, self.edges, self.root_words))
        return self.made["words"]


def prepare_nodes(nodes: DataFrame, edges: DataFrame, node_or_prob: float, seed: int) -> DataFrame:
    """Add rules and components to nodes(graph_idx, entity, ord)."""
    ruled = graph.assign_rules(nodes, edges, node_or_prob, seed)
    return durable(graph.weak_components(ruled, edges).drop("component_root"))


class DatasetBuilder:
    """The steps of one data set; each shared table is computed once."""

    def __init__(self, tables: GraphTables, config: DatasetConfig):
        self.tables = tables
        self.config = config
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = durable(make())
        return self._made[name]

    def metadata(self) -> dict:
        """The parameters of the record; what the given tables decide is counted there.

        Graphs and their size are counted. The probabilities that drew edges and root
        facts are unknown for given tables, so they are null.
        """
        groups = self.tables.nodes.groupBy("graph_idx").agg(F.count(F.lit(1)).alias("n"))
        counted = groups.agg(F.count(F.lit(1)).alias("graphs"), F.max("n").alias("largest")).first()
        return self.config.metadata() | {
            "num_graphs": counted["graphs"], "num_entities": counted["largest"], "edge_prob": None, "root_prior": None,
        }

    def related(self) -> DataFrame:
        return self.tables.related()

    def words(self) -> DataFrame:
        return self.tables.words()

    def splits(self) -> DataFrame:
        c = self.config
        return self._once(
            "splits",
            lambda: splits.entity_splits(
                self.tables.nodes, c.heldout_scope, c.val_ratio, c.test_ratio, c.seed
            ),
        )

    def specs(self) -> DataFrame:
        """All numbered and labelled specs, with the component of the query; no other step reads them, so they are not written."""
        c = self.config
        found = specs.observation_specs(self.tables.nodes, c.max_obs_size, c.per_component_data)
        return self.by_size(found, lambda rows, near: specs.label_specs(rows, self.related(), c.max_obs_size, near))

    def large(self) -> DataFrame:
        """(graph_idx) of large graphs."""
        c = self.config
        facts = F.count(F.lit(1)) * (c.num_worlds // graph.WORD + 1)
        asked = specs.keep_count(F.sum("_specs"), c.sample_ratio_from_worlds) * c.num_worlds
        return self._once("large", lambda: self.queries().groupBy("graph_idx").agg(
            facts.alias("_facts"), asked.alias("_asked")
        ).filter(f"_facts > {NEAR_ROWS} OR _asked > {NEAR_ASKED}").select("graph_idx"))

    def parted(self, rows: DataFrame) -> list[tuple[DataFrame, bool]]:
        """The rows of small graphs, marked True, and, if there are any, those of large ones."""
        if self.large().isEmpty():
            return [(rows, True)]
        return [(rows.join(self.large(), "graph_idx", how), near) for how, near in (("left_anti", True), ("left_semi", False))]

    def by_size(self, rows: DataFrame, make) -> DataFrame:
        """``make(rows, near)`` for the rows of small graphs and, if there are any, those of large ones."""
        return reduce(DataFrame.unionByName, [make(part, near) for part, near in self.parted(rows)])

    def placed(self) -> DataFrame:
        return self._once("placed", lambda: specs.placed_nodes(self.tables.nodes, self.config.per_component_data))

    def queries(self) -> DataFrame:
        """Every node as a query, with the range of its spec numbers."""
        c = self.config
        return self._once("queries", lambda: specs.spec_queries(self.placed(), c.max_obs_size, c.per_component_data))

    def sampled(self) -> DataFrame:
        """Spec numbers per world."""
        c = self.config
        return self._once(
            "sampled",
            lambda: specs.sample_per_world(
                specs.spec_counts(self.queries()), c.num_worlds, c.sample_ratio_from_worlds, c.seed
            ),
        )

    def observed(self) -> DataFrame:
        """Sampled specs with the values seen and the answer, one row per world and spec."""
        c = self.config

        def looked_up(numbers, near):
            found = specs.unrank_specs(numbers, self.placed(), self.queries(), c.max_obs_size, c.per_component_data, near)
            labelled = specs.label_specs(found, self.related(), c.max_obs_size, near)
            return examples.observe(labelled, self.words(), c.max_obs_size, near)

        def made(part, near):
            if not near:
                return durable(looked_up(part, False))
            with dealt_once(part.sparkSession):
                return durable(looked_up(part, True))

        if "observed" not in self._made:
            # What is looked up may come from hot keys, so it is written before.
            for step in (self.placed, self.queries, self.related, self.words):
                step()
            self._made["observed"] = self.by_size(self.sampled(), made)
        return self._made["observed"]

    def observation_rows(self) -> DataFrame:
        """Narrow observation rows; with their deciles if a cap needs them."""
        rows = self.observed()
        if self.config.max_observations_per_component_probability_bin is not None:
            trained = rows.withColumn("split", F.lit("train"))
            wordings = min(self.config.num_observation_templates, len(FAMILIES["observation_single"]))

            def binned(part, near):
                found = caps.probability_bins(part, near)
                # Large graphs have no count of their bins, so their rows are all ranked.
                counted = caps.with_bin_rows(found) if near else found.withColumn("bin_rows", F.lit(None).cast("bigint"))
                return counted.withColumn("bin_rows", F.col("bin_rows") * wordings)

            rows = self._once("binned", lambda: self.by_size(trained, binned))
        elif self.config.max_observations is None:
            rows = examples.state_facts(rows)  # no cap moves these rows, so they may be wide
        return examples.observation_rows(rows, self.config.num_observation_templates)

    def explanation_parts(self) -> list[DataFrame]:
        """Narrow explanation rows by family; they are made again where they are read, which takes less than writing them."""
        c = self.config
        return examples.explanation_parts(
            self.tables.nodes, self.tables.edges, self.related(), self.splits(),
            c.num_explanation_templates, c.per_component_data,
        )

    def explanation_rows(self) -> DataFrame:
        """All narrow explanation rows."""
        return reduce(DataFrame.unionByName, self.explanation_parts())

    def capped_explanations(self) -> list[DataFrame]:
        """Narrow explanation rows after their cap, as one table; where there is no cap, still by family."""
        c = self.config
        parts = self.explanation_parts() if c.max_explanations is None else [self.explanation_rows()]
        key = ["split", "explanation_type"]
        return [caps.cap_by_key(rows, c.max_explanations, key, "row_key", c.seed) for rows in parts]

    def capped_observations(self) -> DataFrame:
        """Narrow observation rows after their caps."""
        return caps.cap_multilabel(self.bin_capped(), self.config.max_observations, "row_key", self.config.seed)

    def bin_capped(self) -> DataFrame:
        cap = self.config.max_observations_per_component_probability_bin
        rows = self.observation_rows()
        if cap is None:
            return rows
        return self._once("bin_capped", lambda: caps.cap_component_bin(rows, cap, "row_key", self.config.seed))

    def capped(self) -> tuple[DataFrame, DataFrame]:
        """Narrow observation and explanation rows after the caps, in this order."""
        return self.capped_observations(), reduce(DataFrame.unionByName, self.capped_explanations())

    def examples(self) -> DataFrame:
        """All example rows: observations, explanations with copies, instructions.

        Copies are made of narrow rows, and families are rendered apart, so each has its own wordings only.
        """
        c = self.config
        parts = [examples.render_observations(self.capped_observations())]
        for explanations in self.capped_explanations():
            copied = examples.train_explanation_copies(explanations, c.num_copies_explanations)
            parts.append(examples.render_explanations(copied))
        if c.add_instruction_datapoints > 0:
            parts.append(
                examples.instruction_rows(
                    self.tables.instructions,
                    list(self.tables.instruction_order),
                    c.add_instruction_datapoints,
                )
            )
        return reduce(DataFrame.unionByName, parts)
