"""Generators fitted on the reference only, emitted onto each target's outflows and scored."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions.spread import lookup_join
from odflow.operators import metrics
from odflow.operators.flows import align, column_sums, row_sums, spread_over, zone_counts
from odflow.operators.generators.emission import ROW_TOLERANCE, emit
from odflow.operators.generators.gravity import (
    closed_form_weights,
    fit_gravity,
    fitted_probabilities,
    fitted_weights,
)
from odflow.operators.generators.ipf import ipf_emit_reported, train_columns
from odflow.operators.generators.radiation import radiation_probabilities
from odflow.operators.zones import AREA, attach_zone, with_distance, zone_pairs
from odflow.plans.factors import share_scores
from odflow.session import write_table

# Law names, the row order of the generator table, and the few-shot masks.
GRAVITY_LAWS = {"power": "Gravity_power", "exp": "Gravity_exp"}
LAW_ORDER = (
    "Gravity_power", "Gravity_exp", "Radiation", "DeepGravity", "ClosedFormGravity", "meta-Gravity",
    "neuroGravity_zeroshot", "neuroGravity_1pct_edges", "neuroGravity_10pct_edges", "RandomForest",
    "IPF_G-row", "Oracle",
)
FEWSHOT_MASKS = ("1pct_edges", "10pct_edges", "10pct_zones")


def generator_pairs(zones: DataFrame, area: Sequence[str] = AREA) -> DataFrame:
    """The pair table with the zone attributes the laws use; N² rows are formed where they are read, and never written."""
    has = zones.columns
    attributes = {"attractiveness": "m", "pop": "pop", "features": "features"}
    named = {c: n for c, n in attributes.items() if c in has}
    return zone_pairs(zones, {c: f"{n}_o" for c, n in named.items()}, {c: f"{n}_d" for c, n in named.items()}, area)


def all_train(zones: DataFrame, area: Sequence[str] = AREA) -> DataFrame:
    """One fold in which every origin trains."""
    return zones.select(*area, F.lit(0).alias("fold"), F.col("zone").alias("origin"))


def train_origins(folds: DataFrame, area: Sequence[str] = AREA) -> DataFrame:
    """Training origins (area, fold, origin) of a fold table (area, fold, zone, role)."""
    return folds.where(F.col("role") == "train").select(*area, "fold", F.col("zone").alias("origin"))


def aligned_with_target(
    emitted: DataFrame, targets: DataFrame, keys: Sequence[str], target_keys: Sequence[str]
) -> DataFrame:
    """Cells (keys, a = emitted, b = target), the target repeated for every generator of its key."""
    wanted = emitted.select(*keys).distinct() if list(keys) != list(target_keys) else None
    spread = targets if wanted is None else spread_over(
        targets.select(*target_keys, "origin", "destination", "flow"), wanted, target_keys, keys
    )
    return align(keys, a=emitted, b=spread)


def score_condition_g(
    emitted: DataFrame,
    targets: DataFrame,
    zones: DataFrame,
    keys: Sequence[str],
    target_keys: Sequence[str],
    area: Sequence[str] = AREA,
    tolerance: float = ROW_TOLERANCE,
) -> DataFrame:
    """Scores of (emitted, target) per key; the job fails if any origin misses its target outflow."""
    cells = aligned_with_target(emitted, targets, keys, target_keys)
    gaps = cells.groupBy(*keys, "origin").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    missed = F.abs(F.col("_a") - F.col("_b")) > tolerance + tolerance * F.abs("_b")
    checks = gaps.groupBy(*keys).agg(F.count_if(missed).alias("_missed"))
    scores = metrics.score_pair(cells, keys, zone_counts(zones, area), area, zones)
    checked = lookup_join(scores, checks, list(keys), spread=["CPC"])
    failure = F.raise_error(F.lit("emitted row sums miss the target outflows")).cast("double")
    return checked.withColumn("CPC", F.when(F.col("_missed") > 0, failure).otherwise(F.col("CPC"))).drop("_missed")


@dataclass(frozen=True)
class Law:
    """A generator's table: shares ``p`` or, for laws that also fit inflows, flows; by fold, or one for all folds.

    Laws known at single pairs give weights as ``p``, and ``met``: the targets' cells with their weight (keys[, fold], origin, destination, flow, p).
    Their tables are neither written nor shuffled.
    """

    name: str
    table: DataFrame
    by_fold: bool = True
    flows: bool = False
    met: DataFrame | None = None


def weighted_law(
    name: str, weights: Callable[[DataFrame], DataFrame], pairs: DataFrame, targets: DataFrame, zones: DataFrame,
    keys: Sequence[str], area: Sequence[str] = AREA, by_fold: bool = True,
) -> Law:
    """A law from the weight ``w`` that ``weights`` adds to rows with distance and mass: all pairs, and the targets' cells."""
    placed = attach_zone(with_distance(targets, zones, area), zones, {"attractiveness": "m_d"}, "destination", area)
    at = [*keys, *(["fold"] if by_fold else []), "origin", "destination", "flow"]
    met = weights(placed).select(*at, F.col("w").alias("p"))
    return Law(name, weights(pairs).withColumnRenamed("w", "p"), by_fold, met=met)


def generator_laws(
    pairs: DataFrame,
    targets: DataFrame,
    reference: DataFrame,
    zones: DataFrame,
    keys: Sequence[str],
    train: DataFrame,
    area: Sequence[str] = AREA,
    mechanism: bool = False,
    fewshot: bool = False,
    max_cycles: int = 1000,
) -> tuple[list[Law], DataFrame, DataFrame]:
    """The fitted laws, and marks of those by fold and of those for all folds.

    Marks (keys[, fold], law_model, settled) say for the laws that are searched for whether the search ended by itself.
    """
    from odflow.operators.generators import learned, softmax_net

    outflows = row_sums(targets, keys)
    named = F.create_map(*[F.lit(x) for pair in GRAVITY_LAWS.items() for x in pair])
    betas = fit_gravity(pairs, reference, area, tuple(GRAVITY_LAWS), train, area=area)
    oracle_betas = fit_gravity(pairs, targets, keys, ("power",), train, area=area)
    # Meta-gravity is the prior of the residual laws too: fitted once, written, shared.
    prior = write_table(learned.meta_flows(pairs, reference, train, area))
    laws = [
        weighted_law(name, lambda rows, law=law: fitted_weights(rows, betas.where(F.col("law") == law), area), pairs, targets, zones, keys, area)
        for law, name in GRAVITY_LAWS.items()
    ]
    laws += [
        Law("Radiation", radiation_probabilities(pairs, reference, zones, train, area)),
        Law("Oracle", fitted_probabilities(pairs, oracle_betas, area)),
        Law("meta-Gravity", learned.meta_probabilities(pairs, reference, train, area, prior)),
    ]
    by_row, row_ended = ipf_emit_reported(
        pairs, reference, outflows, column_sums(targets, keys), zones, keys, area, max_cycles=max_cycles
    )
    columns = train_columns(reference, outflows, zones, keys, train, area)
    fold_outflows = outflows.join(train.select(*area, "fold").distinct(), list(area))
    by_column, column_ended = ipf_emit_reported(
        pairs, reference, fold_outflows, columns, zones, [*keys, "fold"], area, max_cycles=max_cycles
    )
    laws += [Law("IPF_G-row", by_row, by_fold=False, flows=True), Law("IPF_G-row-traincol", by_column, flows=True)]
    if mechanism:
        residual = write_table(learned.residual_probabilities(pairs, reference, train, area, prior))
        laws += [
            weighted_law("ClosedFormGravity", closed_form_weights, pairs, targets, zones, keys, area, by_fold=False),
            Law("DeepGravity", softmax_net.net_probabilities(pairs, reference, train, area)),
            Law("RandomForest", learned.forest_probabilities(pairs, reference, train, area)),
            Law("neuroGravity_zeroshot", residual),
        ]
        for mask in FEWSHOT_MASKS if fewshot else ():
            p = learned.fewshot_probabilities(pairs, reference, targets, zones, train, keys, mask, area, prior=prior, residual=residual)
            laws.append(Law(f"neuroGravity_{mask}", p))
    by_fold = [*keys, "fold", "law_model"]
    searched = lookup_join(
        betas.select(*area, "fold", named[F.col("law")].alias("law_model"), "settled"),
        targets.select(*keys).distinct(), list(area), spread=["law_model"],
    )
    marks = searched.select(*by_fold, "settled")
    marks = marks.unionByName(oracle_betas.select(*keys, "fold", F.lit("Oracle").alias("law_model"), "settled"))
    ended = column_ended.select(*keys, "fold", F.lit("IPF_G-row-traincol").alias("law_model"), F.col("converged").alias("settled"))
    steady_marks = row_ended.select(*keys, F.lit("IPF_G-row").alias("law_model"), F.col("converged").alias("settled"))
    return laws, marks.unionByName(ended), steady_marks


def _stacked(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    return whole


def emit_generators(
    pairs: DataFrame,
    targets: DataFrame,
    reference: DataFrame,
    zones: DataFrame,
    keys: Sequence[str],
    train: DataFrame,
    area: Sequence[str] = AREA,
    mechanism: bool = False,
    fewshot: bool = False,
    max_cycles: int = 1000,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Emitted flows of the laws that depend on the fold, and of those that do not, and both laws' marks.

    Flows are long tables keyed by (keys[, fold], law_model), for callers that want the matrices; scores need none of them.
    """
    laws, marks, steady_marks = generator_laws(pairs, targets, reference, zones, keys, train, area, mechanism, fewshot, max_cycles)
    outflows = row_sums(targets, keys)

    def flows_of(law: Law) -> DataFrame:
        at = [*keys, *(["fold"] if law.by_fold else []), "law_model"]
        table = law.table.withColumn("law_model", F.lit(law.name))
        return (table if law.flows else emit(table, outflows, at, area)).select(*at, "origin", "destination", "flow")

    per_fold, steady = ([flows_of(x) for x in laws if x.by_fold is which] for which in (True, False))
    return _stacked(per_fold), _stacked(steady), marks, steady_marks


def score_laws(laws: Sequence[Law], targets: DataFrame, zones: DataFrame, keys: Sequence[str], area: Sequence[str] = AREA) -> tuple[DataFrame | None, DataFrame | None]:
    """Scores of the laws by fold, and of those for all folds (None if there are none), from their shares: no matrix is emitted.

    Shares with the same keys are stacked, written and scored together; they are read for the origins, for all cells and at the target's cells.
    Flows are not written, nor are laws that know their weights at the target's cells.
    """
    found: dict[bool, list[DataFrame]] = {True: [], False: []}
    kinds: dict[tuple, list[tuple[DataFrame, DataFrame | None]]] = {}
    for law in laws:
        own = [k for k in (*keys, "fold") if k in law.table.columns and (k != "fold" or law.by_fold)]
        value = F.col("flow" if law.flows else "p").alias("p")
        table = law.table.select(*own, F.lit(law.name).alias("law_model"), "origin", "destination", "distance", value)
        met = None if law.met is None else law.met.withColumn("law_model", F.lit(law.name))
        kinds.setdefault((law.by_fold, law.flows, met is not None, *own), []).append((table, met))
    for (by_fold, flows, known, *own), tables in kinds.items():
        at = [*keys, *(["fold"] if by_fold else []), "law_model"]
        shares = _stacked([table for table, _ in tables])
        shares = shares if flows or known else write_table(shares)
        met = _stacked([m for _, m in tables]) if known else None
        found[by_fold].append(share_scores(shares, targets, zones, at, keys, area, emitted=flows, met=met))
    by_fold, once = (_stacked(found[which]) if found[which] else None for which in (True, False))
    return by_fold, once


def run_generators(
    targets: DataFrame,
    reference: DataFrame,
    zones: DataFrame,
    keys: Sequence[str],
    train: DataFrame | None = None,
    area: Sequence[str] = AREA,
    mechanism: bool = False,
    fewshot: bool = False,
    max_cycles: int = 1000,
) -> DataFrame:
    """Scores per (keys, fold, law_model) over whole matrices, and ``settled``: false where a fit was cut off.

    The fold is a key of one job, not a loop. Laws that ignore the training origins are scored once
    and listed under every fold.
    """
    pairs = generator_pairs(zones, area)
    origins = all_train(zones, area) if train is None else train
    laws, marks, steady_marks = generator_laws(pairs, targets, reference, zones, keys, origins, area, mechanism, fewshot, max_cycles)
    by_fold, once = score_laws(laws, targets, zones, keys, area)
    by_fold = _marked(by_fold, marks, [*keys, "fold", "law_model"])
    once = _marked(once, steady_marks, [*keys, "law_model"])
    repeated = once.join(origins.select(*area, "fold").distinct(), list(area))
    return by_fold.unionByName(repeated.select(by_fold.columns))


def _marked(scores: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = scores.join(write_table(marks), list(keys), "left")
    return joined.withColumn("settled", F.coalesce("settled", F.lit(True)))
