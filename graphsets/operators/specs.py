"""What can be asked about a world, and which of it is asked.

A spec is a query entity with a set of observed entities. Specs do not depend
on worlds and are numbered per graph. A number is drawn, and the spec it stands for is
computed, so samples need no table of specs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.functions.combinations import choose, set_rank, unrank_sets
from graphsets.functions.draws import draw
from graphsets.operators.closure import with_relation
from graphsets.operators.pairing import copied, near_join, parts_of, salted
from graphsets.operators.ranking import bucket_ranked, group_indexed, running_before
from graphsets.schema import INFERENCE_PRIORITY
from graphsets.session import durable, small_side, spread

CHUNK = 1 << 16
FEW_TRIES = 1 << 12  # up to this many draws of a world are made in one row
ORD_BUCKET = 1 << 12


def _group(per_component: bool) -> list[str]:
    return ["graph_idx", "component_id"] if per_component else ["graph_idx"]


def placed_nodes(nodes: DataFrame, per_component: bool = False) -> DataFrame:
    """Nodes with ``pos``, their 0-based place by ``ord`` in the graph (or component)."""
    on = _group(per_component)
    kept = nodes.select(*dict.fromkeys([*on, "graph_idx", *(c for c in nodes.columns if c == "component_id")]), "entity", "ord")
    return group_indexed(kept, on, ["ord"], "pos")


def spec_queries(placed: DataFrame, max_obs_size: int, per_component: bool = False) -> DataFrame:
    """Every node as a query: ``_others`` to observe, how many ``_specs`` it has and ``_first``, its first spec_ord.

    How many specs a query has follows from the size of its group, so specs are
    numbered without counting them.
    """
    on = _group(per_component)
    sizes = placed.groupBy(*on).agg((F.count(F.lit(1)) - 1).alias("_others"))
    home = [] if "component_id" not in placed.columns else ["component_id"]
    queries = placed.join(sizes, on).select(
        "graph_idx",
        *home,
        F.col("entity").alias("query_entity"),
        F.col("ord").cast("bigint").alias("query_ord"),
        F.col("pos").alias("_place"),
        "_others",
        sum((choose(F.col("_others"), k) for k in range(1, max_obs_size + 1)), F.lit(0).cast("bigint")).alias("_specs"),
    )
    bucket = F.floor(F.col("query_ord") / ORD_BUCKET)
    return running_before(queries, ["graph_idx"], bucket, ["query_ord"], "_specs", "_first")


def spec_counts(queries: DataFrame) -> DataFrame:
    """(graph_idx, n): how many specs each graph has."""
    return queries.groupBy("graph_idx").agg(F.sum("_specs").cast("bigint").alias("n")).filter("n > 0")


def observation_specs(nodes: DataFrame, max_obs_size: int, per_component: bool = False) -> DataFrame:
    """Every query with every set of 1..max_obs_size other entities, in ``ord`` order.

    Columns graph_idx, [component_id,] query_entity, query_ord, obs_size,
    observed_entities, observed_ords and spec_ord, 0-based and dense per graph
    (by query, size, observed). The sets are the result asked for: one self join
    per slot with rising ``ord`` yields each once. A set's number follows from its
    positions, so only the nodes are shuffled and nothing is sorted.
    """
    on = _group(per_component)
    placed = durable(placed_nodes(nodes, per_component))
    queries = durable(spec_queries(placed, max_obs_size, per_component))
    parts = parts_of(queries, on)
    grown = (
        salted(queries, on, "query_entity", parts)
        .withColumn("observed_entities", F.array().cast("array<string>"))
        .withColumn("observed_ords", F.array().cast("array<bigint>"))
        .withColumn("_places", F.array().cast("array<bigint>"))
    )
    slot = copied(
        placed.select(*on, F.col("entity").alias("_e"), F.col("ord").cast("bigint").alias("_o"), F.col("pos").alias("_p")), on, parts
    )
    # Among the others, those behind the query move up by one.
    place = F.col("_p") - (F.col("_p") > F.col("_place")).cast("bigint")
    sizes = []
    smaller = F.lit(0).cast("bigint")
    for size in range(1, max_obs_size + 1):
        rising = F.lit(True) if size == 1 else F.col("_o") > F.col("observed_ords")[size - 2]
        grown = (
            grown.join(slot, [*on, "_salt"])
            .filter(rising & (F.col("_o") != F.col("query_ord")))
            .withColumn("observed_entities", F.array_append("observed_entities", F.col("_e")))
            .withColumn("observed_ords", F.array_append("observed_ords", F.col("_o")))
            .withColumn("_places", F.array_append("_places", place))
            .drop("_e", "_o", "_p")
        )
        number = set_rank([F.col("_places")[i] for i in range(size)], F.col("_others"))
        sizes.append(
            grown.withColumn("spec_ord", F.col("_first") + smaller + number)
            .withColumn("obs_size", F.lit(size).cast("bigint"))
            .drop("_salt", "_others", "_first", "_specs", "_place", "_places")
        )
        smaller = smaller + choose(F.col("_others"), size)
    return reduce(DataFrame.unionByName, sizes)


def unrank_specs(
    numbers: DataFrame, placed: DataFrame, queries: DataFrame, max_obs_size: int, per_component: bool = False,
    near: bool = False,
) -> DataFrame:
    """``numbers(graph_idx, spec_ord, ...)`` with the query and the observed entities of each spec.

    The columns of ``observation_specs``, without a table of specs. A query's specs are one
    range of numbers: ranges are cut at multiples of their mean width in the graph, so
    there are at most twice as many pieces as queries, and a number meets two of them on
    average whatever the sizes of the groups. What is left of a number gives the size and
    the positions in closed form, and a join per slot their entities. ``near`` says that all
    graphs are small: a number is then compared with all ranges of its graph (see ``near_join``).
    """
    on = _group(per_component)
    asked = queries.filter("_specs > 0")
    inside = (F.col("spec_ord") >= F.col("_first")) & (F.col("spec_ord") < F.col("_first") + F.col("_specs"))
    if near:
        rows = near_join(numbers, asked, "graph_idx", inside)
    else:
        widths = small_side(
            asked.groupBy("graph_idx").agg(F.expr("sum(_specs) div count(1) + 1").cast("bigint").alias("_width"))
        )
        pieces = asked.join(widths, "graph_idx").withColumn(
            "_piece", F.explode(F.expr("sequence(_first div _width, (_first + _specs - 1) div _width)"))
        ).drop("_width")
        rows = (
            numbers.join(widths, "graph_idx").withColumn("_piece", F.expr("spec_ord div _width")).drop("_width")
            .join(small_side(pieces), ["graph_idx", "_piece"])
            .filter(inside).drop("_piece")
        )
    size, smaller = F.lit(max_obs_size), F.lit(0).cast("bigint")
    ahead = [smaller]
    for k in range(1, max_obs_size):
        ahead.append(ahead[-1] + choose(F.col("_others"), k))
    left = F.col("spec_ord") - F.col("_first")
    for k in range(max_obs_size - 1, 0, -1):
        size = F.when(left < ahead[k], k).otherwise(size)
    rows = rows.withColumn("obs_size", size.cast("bigint"))
    before = F.lit(0).cast("bigint")
    for k in range(2, max_obs_size + 1):
        before = F.when(F.col("obs_size") >= k, ahead[k - 1]).otherwise(before)
    rows = unrank_sets(rows, left - before, "_others", "obs_size", max_obs_size, "_places")
    rows = rows.drop("_first", "_specs", "_others")
    known = placed.select(*on, F.col("pos").alias("_p"), F.col("entity").alias("_e"), F.col("ord").cast("bigint").alias("_o"))
    known = known if near else small_side(known)
    slots = []
    for slot in range(max_obs_size):
        place = F.get("_places", F.lit(slot))
        rows = rows.withColumn("_p", place + (place >= F.col("_place")).cast("bigint"))
        key = [*on, "_p"]
        rows = near_join(rows, known, key[0], key[1:], "left") if near else rows.join(known, key, "left")
        rows = rows.drop("_p").withColumnsRenamed({"_e": f"_e{slot}", "_o": f"_o{slot}"})
        slots.append(slot)
    names, ords = [f"_e{s}" for s in slots], [f"_o{s}" for s in slots]
    return (
        rows.withColumn("observed_entities", F.array_compact(F.array(*names)))
        .withColumn("observed_ords", F.array_compact(F.array(*ords)))
        .drop("_places", "_place", *names, *ords)
    )


def prioritised(labels: list[str]) -> Column:
    """The distinct labels of these columns in priority order; independent if there is none.

    One fixed array for each set of labels, chosen by plain comparisons.
    """
    found = F.array(F.lit("independent"))
    for size in range(1, len(INFERENCE_PRIORITY) + 1):
        for names in combinations(INFERENCE_PRIORITY, size):
            # Larger sets are asked first.
            held = [reduce(Column.__or__, [F.col(c).eqNullSafe(F.lit(name)) for c in labels], F.lit(False)) for name in names]
            found = F.when(reduce(Column.__and__, held), F.array(*map(F.lit, names))).otherwise(found)
    return found


def label_specs(specs: DataFrame, related: DataFrame, max_obs_size: int, near: bool = False) -> DataFrame:
    """Add ``inference_types`` and ``primary_inference_type``.

    ``related`` are the bitmaps of ``closure.related_words``: one join per observed slot
    with a row for 64 nodes, broadcast if its counted number allows, and one bit test; a
    slot without a relation is independent. If all graphs are small (``near``), one shuffle serves all slots.
    """
    related = related if near else small_side(related)
    out = specs
    slots = []
    for slot in range(max_obs_size):
        name = f"_r{slot}"
        out = with_relation(out, related, F.get("observed_entities", F.lit(slot)), "query_ord", name, near)
        slots.append(name)
    return (
        out.withColumn("inference_types", prioritised(slots))
        .withColumn("primary_inference_type", F.col("inference_types")[0])
        .drop(*slots)
    )


def keep_count(count: Column, ratio: float) -> Column:
    """How many of ``count`` specs a world keeps: half-even share, at least one."""
    if ratio >= 1.0:
        return count
    if ratio <= 0.0:
        return F.lit(0).cast("bigint")
    share = F.bround(count * F.lit(float(ratio)), 0).cast("bigint")
    return F.least(count, F.greatest(share, F.lit(1)))


def _attempts(groups: DataFrame, seed: int) -> DataFrame:
    """``tries`` draws of an ordinal below ``n`` for each (graph_idx, world_id).

    Ordinals come in chunks that are spread first, so neither an array nor a
    task grows with a hot graph.
    """
    start = F.col("_chunk") * CHUNK
    stop = F.least(start + CHUNK, F.col("tries")) - 1
    ordinal = draw(seed, "spec", "graph_idx", "world_id", "_try") % F.col("n")
    return (
        groups.withColumn("_try", F.explode(F.sequence(start, stop)))
        .withColumn("spec_ord", ordinal)
        .groupBy("graph_idx", "world_id", "spec_ord")
        .agg(F.min("_try").alias("_try"), F.min("want").alias("want"))
    )


def _ranked_attempts(groups: DataFrame, seed: int) -> DataFrame:
    """Distinct ordinals with their rank by first try, and how many there are."""
    world = ["graph_idx", "world_id"]
    chunks = groups.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("tries") - 1) / CHUNK)))
    )
    tried = durable(_attempts(spread(chunks, *world, "_chunk"), seed))
    return bucket_ranked(tried, world, F.floor(F.col("_try") / CHUNK), ["_try"], "_rank", "_distinct")


def _drawn_at_once(groups: DataFrame, seed: int) -> DataFrame:
    """The same for groups of few tries: a group's draws are one array, so nothing is shuffled but the groups."""
    def ordinal(number: Column) -> Column:
        return draw(seed, "spec", "graph_idx", "world_id", number) % F.col("n")

    found = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tries") - 1), ordinal))
    drawn = spread(groups, "graph_idx", "world_id").select("graph_idx", "world_id", "want", found.alias("_found"))
    return drawn.select(
        "graph_idx", "world_id", F.explode(F.slice("_found", F.lit(1), F.col("want").cast("int"))).alias("spec_ord"),
        (F.size("_found") >= F.col("want")).alias("_full"),
    )


def _first_distinct(groups: DataFrame, seed: int) -> DataFrame:
    """The first ``want`` distinct ordinals of each group's endless draw sequence."""
    found, factor = [], 1
    while True:
        # A quarter more than the expected number of draws, and a few; the loop covers bad luck.
        expected = -F.col("n") * F.ln(1 - F.col("want") / F.col("n"))
        tries = ((expected * 1.25 + 8) * factor).cast("bigint")
        tried = groups.withColumn("tries", tries)
        ranked = _drawn_at_once(tried.filter(F.col("tries") <= FEW_TRIES), seed)
        many = tried.filter(F.col("tries") > FEW_TRIES)
        if not many.isEmpty():
            ranked = ranked.unionByName(
                _ranked_attempts(many, seed)
                .filter(F.col("_rank") <= F.col("want"))
                .select("graph_idx", "world_id", "spec_ord", (F.col("_distinct") >= F.col("want")).alias("_full"))
            )
        ranked = durable(ranked)
        found.append(ranked.filter("_full").drop("_full"))
        short = ranked.filter("NOT _full").select("graph_idx", "world_id").distinct()
        if short.isEmpty():
            return reduce(DataFrame.unionByName, found)
        groups = durable(groups.join(short, ["graph_idx", "world_id"], "left_semi"))
        factor *= 2


def _numbers(counts: DataFrame) -> DataFrame:
    """(graph_idx, spec_ord): all numbers below ``n``, in chunks that are spread first."""
    chunks = counts.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    numbers = F.expr(f"sequence(_chunk * {CHUNK}, least((_chunk + 1) * {CHUNK}, n) - 1)")
    return spread(chunks, "graph_idx", "_chunk").select("graph_idx", F.explode(numbers).alias("spec_ord"))


def sample_per_world(counts: DataFrame, num_worlds: int, ratio: float, seed: int) -> DataFrame:
    """Distinct (graph_idx, world_id, spec_ord): a fresh exact-size sample per world.

    ``counts(graph_idx, n)`` says how many specs a graph has; no spec is read. Simple
    random sampling without replacement by drawing ordinals and skipping repeats. The
    work follows the sample, not worlds x specs. Where more than half is kept, the
    specs left out are drawn instead.
    """
    worlds = F.explode(F.expr(f"sequence(0L, {num_worlds - 1}L)"))
    keep = counts.withColumn("keep", keep_count(F.col("n"), ratio)).filter("keep > 0")
    groups = durable(keep.select("*", worlds.alias("world_id")))
    mostly = F.col("keep") * 2 > F.col("n")
    drawn = []
    direct = groups.filter(~mostly).withColumn("want", F.col("keep"))
    inverse = groups.filter(mostly)
    if not direct.isEmpty():
        drawn.append(_first_distinct(direct, seed))
    if not inverse.isEmpty():
        every = _numbers(inverse.select("graph_idx", "n").distinct()).withColumn("world_id", worlds).select(
            "graph_idx", "world_id", "spec_ord"
        )
        partial = inverse.withColumn("want", F.col("n") - F.col("keep")).filter("want > 0")
        if not partial.isEmpty():
            left_out = _first_distinct(partial, seed)
            every = every.join(left_out, ["graph_idx", "world_id", "spec_ord"], "left_anti")
        drawn.append(every)
    if not drawn:
        return groups.select("graph_idx", "world_id", F.col("n").alias("spec_ord")).limit(0)
    return reduce(DataFrame.unionByName, drawn)
