"""Credit-risk scoring analytics as DataFrame-to-DataFrame operators on Spark.

The operators and flows can be imported from here by name. They are loaded when they are asked for, so
that Python workers, which import this package for a function of theirs, don't load what they don't use.
"""

from importlib import import_module

__version__ = "0.2.0"
_PLACES = {
    "functions": "labels",
    "operators.binning": "best_splits chi_merge_rounds distinct_counts merged_sketches optimal_binning sketch_edges sketch_quantiles",
    "operators.discrimination": "accuracy_ratio auc concentration confusion coverage histogram impurity impurity_reduction lorenz lorenz_gini_area operating_points roc trapezoid_gini",
    "operators.evidence": "bin_statistics information_value iv_ranking rate_table with_woe",
    "operators.fit": "compare_scores delong delong_compare deviance fit_summary gini_difference gini_interval",
    "operators.independence": "chi2_ranking contingency counted crosstab goodness_of_fit independence",
    "operators.lift": "lift_summary lift_table",
    "operators.models": "apply_scorecard coefficients fit_logistic hashed_split predict stratified_split",
    "operators.segments": "assign calinski_harabasz centre_table fit_kmeans k_sweep kmeans profile",
    "operators.stability": "psi psi_between psi_ranking psi_table shares",
    "operators.transforms": "chi_merge equal_frequency_bins equal_width_bins fixed_bins label_encode min_max_scale optimal_bins quantiles z_score",
    "plans.flows": "build_scorecard evaluate_features monitor_stability project_portfolio",
}
_WHERE = {name: place for place, names in _PLACES.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    place = import_module(f".{_WHERE[name]}", __name__)
    return import_module(".functions.labels", __name__) if name == "labels" else getattr(place, name)
