"""Causal-graph analytics on Spark: graphs as tables, questions in batches."""

from .estimate import (
    estimate_effect,
    get_data_for_ppl,
    get_tmle_confounders,
    prepare_for_rxinfer,
    prepare_for_tmle,
    prepare_for_turing,
)
from .functions import powerset
from .graph import (
    CausalGraph,
    DiGraph,
    SimpleDiGraph,
    backdoor_adjustment_set,
    create_causal_graph,
    d_separated,
    find_all_adjustment_sets,
    find_backdoor_paths,
    find_directed_paths,
    find_frontdoor_mediators,
    find_instruments,
    frontdoor_adjustment_set,
    get_ancestors,
    get_children,
    get_descendants,
    get_parents,
    has_path,
    identify_formula,
    is_backdoor_adjustable,
    is_dag,
    is_identifiable,
    is_valid_adjustment_set,
    is_valid_instrument,
    markov_boundary,
    minimal_adjustment_set,
    validate_causal_graph,
)
from .hypergraph import HyperedgeData, Hypergraph
from .scm import (
    AbstractSCM,
    DoIntervention,
    GraphSCM,
    SymbolicSCM,
    apply_intervention,
    counterfactual_graph,
    create_symbolic_scm,
    do_intervention,
)
from .viz import plot_backdoor_paths, plot_causal_graph, plot_with_adjustment_set

__all__ = [n for n in dir() if not n.startswith("_")]
