"""The whole jobs: raw answers → named people → scored people → communities; and the simple network."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.functions.cleaning import valid_records, with_country_code, with_person_id
from layerweave.operators import community as M
from layerweave.operators import cp
from layerweave.operators import graph as G
from layerweave.operators import layers as L
from layerweave.operators import score_classes as K
from layerweave.operators import tensor as T
from layerweave.operators.ordering import dense_index
from layerweave.operators.people import MOST_GOALS, assign_goals, pick_names
from layerweave.operators.score_line import OUT
from layerweave.operators.scores import FACTORS, score_people
from layerweave.sources.delimited import array_to_text, write_sorted_csv
from layerweave.sources.fixed_width import Field, read_fixed_width
from layerweave.sources.tables import export_as_one, export_layers, write_table


def name_people(
    spark: SparkSession, path: str, layout: Sequence[Field], names: DataFrame, countries: DataFrame | None = None,
    out: str | None = None, single_file: bool = False, seed: int = 0,
) -> DataFrame:
    """Fixed-width answer file → typed people with a random fitting name, optionally written sorted by case."""
    people = read_fixed_width(spark, path, layout)
    if countries is not None:
        people = with_country_code(people, "country", countries).drop("country").withColumnRenamed("country_code", "country")
    named = pick_names(people, names, seed)
    if out:
        write_sorted_csv(named, out, ["case"], single_file)
    return named


def score_answers(
    answers: DataFrame, scorecard: DataFrame, goals: DataFrame, first: int | None = None, out: str | None = None,
    kind: str = "parquet", most_goals: int = MOST_GOALS, factors: Sequence[str] = FACTORS,
) -> DataFrame:
    """Answers → factor sums, z-scores, quintiles and goals, optionally written in the order of the ids.

    ``first`` takes the people with the smallest ids, as the job's size argument does.
    """
    people = valid_records(with_person_id(answers))
    if first:
        people = people.orderBy("uuid").limit(first)
    scored = score_people(people, scorecard, factors=factors)
    scored = assign_goals(scored, goals, "uuid", most_goals)
    if out:
        write_table(scored.orderBy("uuid"), out, kind, "overwrite")
    return scored


@dataclass(frozen=True)
class Communities:
    """What the community job leaves: model tables, scores, and the best members of either side."""

    community: DataFrame
    personality: DataFrame
    weights: DataFrame
    scores: dict[str, DataFrame]
    component: dict[str, str]
    members: dict[str, DataFrame]


def find_communities(
    scored: DataFrame, layers: Sequence[str] = FACTORS, rank: int = 2, tolerance: float = 0.002, max_sweeps: int = 20,
    profile: Mapping[str, float] = M.RUN_PROFILE, top: int = 5, first: int | None = None, id_column: str = "uuid",
    listed: bool = False, out: str | None = None, version: str = "results", init: str = "gaussian",
) -> Communities:
    """Scored people → layer networks → decomposition → the members that fit a profile best.

    By default the layer tensor is never listed: its products come from the score classes, so the
    job is linear in the people.  ``listed=True`` builds the edges, for export or for small inputs;
    both give the same model.  ``out`` receives adjacency, community, personality, weights and input as one export
    under ``version`` (``read_export`` reads it); an export that broke off is resumed.  Unless edges are listed, the
    adjacency is that of the scores: head count, place, and the places of the partners.
    """
    people = scored.select(F.col(id_column).alias("id"), *[f"{layer}_Z" for layer in layers]).na.drop()
    if first:
        people = people.orderBy("id").limit(first)
    vertices = L.layer_vertices(people, layers)
    rules = {layer: L.rule_for(layer) for layer in layers}
    index = dense_index(people.select("id"), [F.col("id")])
    total = index.count()
    if listed:
        cells, index = G.indexed_edges(G.build_graph(vertices, rules=rules))
        source = T.from_layers(cells, layers, total)
    else:
        points = L.layer_vertices(people.join(index, "id").drop("id"), layers, "idx").withColumnRenamed("id", "idx")
        source = K.ScoreSource(points, layers, total, rules)
    model = cp.cp_als(source, rank, max_sweeps, tolerance, init=init)
    community, personality = cp.community_table(model, index), cp.personality_table(model, layers)
    scores, component, members = {}, {}, {}
    for side in ("A", "B"):
        scores[side] = M.component_scores(community, personality, side)
        component[side] = M.match_component(scores[side], profile)
        best = M.top_members(community, f"{side}_{component[side]}", top)
        members[side] = M.member_profiles(people, best)
    found = Communities(community, personality, cp.weight_table(model), scores, component, members)
    if out:
        adjacency = cells if listed else source.line.positions(source.line.classes.select("layer", "z", "n", "_part", "_at"), OUT).drop("_part", "_at")
        tables = {"adjacency": adjacency, "community": community, "personality": personality, "lambda": found.weights, "input": scored}
        export_as_one(scored.sparkSession, tables, out, version)
        if listed:
            export_layers(vertices, L.fit_edges(vertices, rules), f"{out}/layers")
    return found


def simple_network(people: DataFrame, iterations: int = 10) -> DataFrame:
    """One layer under the simple rule: ``id, z, rank, component`` of everyone.  ``people`` holds ``id, z``."""
    rows = people.select(F.lit("all").alias("layer"), "id", "z")
    rules = {"all": L.SIMPLE_RULE}
    ranks, groups = K.pagerank(rows, rules, iterations), K.components(rows, rules)
    return people.select("id", "z").join(ranks.drop("layer"), "id").join(groups.drop("layer"), "id")


def input_table(scored: DataFrame) -> DataFrame:
    """Scored people in a form that fits a text file: goals as one delimited field."""
    return scored.withColumn("goals", array_to_text(F.col("goals")))
