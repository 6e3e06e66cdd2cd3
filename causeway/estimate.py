"""Effect estimation on tables, and its preparation from a graph."""

from __future__ import annotations

import warnings
from collections import namedtuple
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import CausalGraph, DiGraph, backdoor_adjustment_set, validate_causal_graph

Effect = namedtuple("Effect", "estimate std_error n n_cells")
Specification = namedtuple("Specification", "graph treatment outcome confounders data node_names is_identifiable")


def _names(g: DiGraph, node_names: Mapping[int, str] | None) -> dict[int, str] | None:
    if node_names is None and isinstance(g, CausalGraph):
        node_names = g.get_node_names() or None
    return dict(node_names) if node_names is not None else None


def prepare_for_tmle(g: DiGraph, x: int, y: int, node_names: Mapping[int, str] | None = None) -> tuple[list, bool]:
    """Confounders (names where there are any; a missing one is a KeyError) and
    whether the effect is identifiable."""
    names = _names(g, node_names)
    found = sorted(backdoor_adjustment_set(g, x, y))
    return [names[v] for v in found] if names is not None else found, True


def get_tmle_confounders(g: DiGraph, x: int, y: int, node_names: Mapping[int, str] | None = None) -> list:
    return prepare_for_tmle(g, x, y, node_names)[0]


def _cells(data: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """Sums by stratum in one pass; rows with a null are left out."""
    a, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    rows = data.select(*[F.col(c) for c in confounders], a.alias("a__"), y.alias("y__")).dropna()
    total = lambda c: F.sum(c)
    return rows.groupBy(*confounders).agg(
        F.count(F.lit(1)).cast("double").alias("n__"),
        total(F.col("a__")).alias("n1__"),
        total(F.col("a__") * F.col("y__")).alias("s1__"),
        total((1 - F.col("a__")) * F.col("y__")).alias("s0__"),
        total(F.col("a__") * F.col("y__") ** 2).alias("q1__"),
        total((1 - F.col("a__")) * F.col("y__") ** 2).alias("q0__"),
    )


def effect_table(data: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """``estimate, std_error, n, n_cells``: the average effect of a treatment in
    {0, 1} over discrete confounders, as one lazy plan.

    With saturated models of outcome and treatment, targeted maximum likelihood,
    the g-formula and inverse weighting agree: the mean over strata of the
    difference in means.  The error is that of the influence curve.  Strata
    without both treatments are left out."""
    c = _cells(data, treatment, outcome, confounders).filter("n1__ > 0 and n1__ < n__")
    c = c.withColumn("n0__", F.col("n__") - F.col("n1__"))
    c = c.withColumn("d__", F.col("s1__") / F.col("n1__") - F.col("s0__") / F.col("n0__"))
    # Sums of squares around the means of both arms, weighted as in the influence curve.
    v1 = (F.col("q1__") - F.col("s1__") ** 2 / F.col("n1__")) * (F.col("n__") / F.col("n1__")) ** 2
    v0 = (F.col("q0__") - F.col("s0__") ** 2 / F.col("n0__")) * (F.col("n__") / F.col("n0__")) ** 2
    out = c.agg(
        F.sum("n__").alias("n"),
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.col("n__") * F.col("d__")).alias("nd"),
        F.sum(F.col("n__") * F.col("d__") ** 2).alias("ndd"),
        F.sum(v1 + v0).alias("within"),
    )
    estimate = F.col("nd") / F.col("n")
    variance = (F.col("within") + F.col("ndd") - F.col("n") * estimate**2) / (F.col("n") - 1)
    return out.select(estimate.alias("estimate"), F.sqrt(variance / F.col("n")).alias("std_error"), F.col("n").cast("long").alias("n"), "n_cells")


def effect_continuous(data: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> Effect:
    """Targeted estimate with a linear outcome and a logistic treatment model.
    Treatment probabilities are kept within 0.01 and 0.99; the linear fluctuation
    along the clever covariate has a closed form."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    rows = data.select(*[F.col(c).cast("double").alias(c) for c in confounders], F.col(treatment).cast("double").alias("a__"), F.col(outcome).cast("double").alias("y__")).dropna()
    rows = VectorAssembler(inputCols=list(confounders), outputCol="w__").transform(rows)
    rows = VectorAssembler(inputCols=["a__", *confounders], outputCol="aw__").transform(rows)
    g = LogisticRegression(featuresCol="w__", labelCol="a__", probabilityCol="p__", predictionCol="c__", rawPredictionCol="r__").fit(rows)
    q = LinearRegression(featuresCol="aw__", labelCol="y__", predictionCol="q__").fit(rows)
    effect = float(q.coefficients[0])
    rows = q.transform(g.transform(rows)).withColumn("g__", F.least(F.greatest(vector_to_array("p__")[1], F.lit(0.01)), F.lit(0.99)))
    h1, h0 = 1 / F.col("g__"), -1 / (1 - F.col("g__"))
    rows = rows.withColumn("h__", F.when(F.col("a__") == 1, h1).otherwise(h0)).withColumn("e__", F.col("y__") - F.col("q__"))
    fit = rows.agg(F.sum(F.col("h__") * F.col("e__")).alias("he"), F.sum(F.col("h__") ** 2).alias("hh"), F.count(F.lit(1)).alias("n")).first()
    if not fit["n"]:
        raise RuntimeError("no complete rows")
    eps = fit["he"] / fit["hh"]
    own = F.lit(effect) + eps * (h1 - h0)
    curve = F.col("h__") * (F.col("e__") - eps * F.col("h__")) + own
    out = rows.agg(F.avg(own).alias("estimate"), F.variance(curve).alias("v")).first()
    return Effect(out["estimate"], (out["v"] / fit["n"]) ** 0.5, fit["n"], None)


#: More distinct values than this make a numeric confounder continuous.
MOST_LEVELS = 20


def estimate_effect(g: DiGraph, *args, node_names: Mapping[int, str] | None = None, method: str = "tmle", discrete: bool | None = None) -> Effect:
    """``estimate_effect(g, data, x, y)`` or, with attached data, ``(g, x, y)``.

    ``discrete`` decides between strata and regression; by default strata are
    taken unless a floating-point confounder has many values."""
    if len(args) == 3:
        data, x, y = args
    else:
        x, y = args
        data = g.get_data() if isinstance(g, CausalGraph) else None
        if data is None:
            raise RuntimeError("the graph has no data attached")
    g.check(x, y)
    names = _names(g, node_names)
    confounders, _ = prepare_for_tmle(g, x, y, names)
    if not confounders:
        warnings.warn("no confounders found: the estimate is a difference in means", stacklevel=2)
    if method != "tmle":
        raise RuntimeError(f"unknown method {method!r}")
    treatment, outcome = (names[x], names[y]) if names is not None else (str(x), str(y))
    confounders = [str(c) for c in confounders]
    if discrete is None:
        floats = [c for c in confounders if dict(data.dtypes)[c] in ("double", "float")]
        levels = data.agg(*[F.approx_count_distinct(c).alias(c) for c in floats]).first() if floats else {}
        discrete = not any(levels[c] > MOST_LEVELS for c in floats)
    if not discrete:
        return effect_continuous(data, treatment, outcome, confounders)
    row = effect_table(data, treatment, outcome, confounders).first()
    if not row["n_cells"]:
        raise RuntimeError("no stratum has both treatments")
    return Effect(*row)


def prepare_for_turing(g: DiGraph, x: int, y: int, node_names: Mapping[int, str] | None = None, data=None) -> Specification:
    """What a probabilistic program needs, in seven fields."""
    names = _names(g, node_names)
    if data is None and isinstance(g, CausalGraph):
        data = g.get_data()
    validate_causal_graph(g)
    confounders, identifiable = prepare_for_tmle(g, x, y, names)
    of = lambda v: names.get(v, v) if names is not None else v
    return Specification(g, of(x), of(y), confounders, data, names, identifiable)


prepare_for_rxinfer = prepare_for_turing

#: Rows that get_data_for_ppl hands to the driver at most.
MOST_ROWS = 1_000_000


def get_data_for_ppl(g: CausalGraph, format: str = "dataframe"):
    """Attached data: as it is, or its columns as a named tuple or dict of lists."""
    data = g.get_data()
    if data is None or format == "dataframe":
        return data
    if format not in ("namedtuple", "dict"):
        raise ValueError(f"unknown format {format!r}")
    if isinstance(data, DataFrame):
        if data.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise RuntimeError(f"more than {MOST_ROWS} rows; use format='dataframe'")
        rows = data.collect()
        columns = {c: [r[c] for r in rows] for c in data.columns}
    else:
        columns = {c: list(data[c]) for c in (data.columns if hasattr(data, "columns") else data)}
    return columns if format == "dict" else namedtuple("Columns", columns)(**columns)
