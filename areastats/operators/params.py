"""Arguments of the regression models: defaults and accepted ranges.

``None`` means the default, and so does a value outside the accepted range.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _positive(value: Any) -> bool:
    return value > 0


class _Checked:
    """Replace every unset or unaccepted value by its default."""

    _accepted: dict[str, Any] = {}
    _defaults: dict[str, Any] = {}

    def __post_init__(self) -> None:
        for field in fields(self):
            value = getattr(self, field.name)
            accepted = self._accepted.get(field.name, lambda _: True)
            if value is None or not accepted(value):
                setattr(self, field.name, self._defaults[field.name])


@dataclass
class LinearParams(_Checked):
    loss: str | None = None
    solver: str | None = None
    aggregation_depth: int | None = None
    max_iterations: int | None = None
    elastic_net: float | None = None
    epsilon: float | None = None
    reg_param: float | None = None
    tolerance: float | None = None
    fit_intercept: bool | None = None
    standardization: bool | None = None

    # fixed values: defaults and accepted ranges
    _defaults = {
        "loss": "squaredError",
        "solver": "auto",
        "aggregation_depth": 2,
        "max_iterations": 10,
        "elastic_net": 0.0,
        "epsilon": 1.35,
        "reg_param": 0.5,
        "tolerance": 1e-6,
        "fit_intercept": True,
        "standardization": True,
    }
    _accepted = {
        "loss": _text,
        "solver": _text,
        "aggregation_depth": lambda v: 2 <= v <= 10,
        "max_iterations": lambda v: 0 <= v < 100,
        "elastic_net": lambda v: 0 <= v <= 1,
        "epsilon": lambda v: 1 < v <= 10,
        "reg_param": lambda v: 0 <= v <= 10,
        "tolerance": lambda v: 0 <= v <= 10,
    }


# fixed values: what both kinds of tree accept
_TREE_ACCEPTED = {
    "subsampling_rate": lambda v: 0 < v <= 1,
    "feature_subset_strategy": _text,
    "impurity": _text,
    "max_depth": _positive,
    "max_bins": _positive,
    "train_split": lambda v: 0 < v < 1,
    "min_info_gain": _positive,
    "min_instances_per_node": lambda v: v >= 1,
    "min_weight_fraction_per_node": lambda v: 0 <= v < 0.5,
    "num_trees": _positive,
    "loss_type": _text,
    "max_iter": _positive,
    "step_size": lambda v: 0 < v <= 1,
}

# fixed values: defaults of both kinds of tree
_TREE_DEFAULTS = {
    "subsampling_rate": 1.0,
    "feature_subset_strategy": "auto",
    "impurity": "variance",
    "max_depth": 5,
    "max_bins": 32,
    "train_split": 0.8,
    "min_info_gain": 0.0,
    "min_instances_per_node": 1,
    "min_weight_fraction_per_node": 0.0,
    "bootstrap": True,
    "num_trees": 1,
    "loss_type": "squared",
    "max_iter": 20,
    "step_size": 0.1,
    "seed": 42,
}


@dataclass
class _TreeParams(_Checked):
    subsampling_rate: float | None = None
    feature_subset_strategy: str | None = None
    impurity: str | None = None
    max_depth: int | None = None
    max_bins: int | None = None
    train_split: float | None = None
    min_info_gain: float | None = None
    min_instances_per_node: int | None = None
    min_weight_fraction_per_node: float | None = None
    seed: int | None = None

    _accepted = _TREE_ACCEPTED
    _defaults = _TREE_DEFAULTS

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.impurity != "variance":
            raise ValueError("regression trees measure impurity by variance")


@dataclass
class ForestParams(_TreeParams):
    num_trees: int | None = None
    bootstrap: bool | None = None


@dataclass
class BoostParams(_TreeParams):
    loss_type: str | None = None
    max_iter: int | None = None
    step_size: float | None = None

    _defaults = {**_TREE_DEFAULTS, "feature_subset_strategy": "all"}

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.loss_type not in ("squared", "absolute"):
            raise ValueError("the loss of boosted trees is 'squared' or 'absolute'")
