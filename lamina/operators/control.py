"""How models are fitted: the optimiser, its tolerances, and what checks of the design do."""

from __future__ import annotations

from dataclasses import dataclass

ACTIONS = ("ignore", "message", "warning", "stop")


@dataclass(frozen=True)
class Control:
    """``optimizer`` is one of the registered optimisers; ``tolerance`` and ``max_evaluations`` go to it (None: its own).
    ``boundary_tol`` is how near a bound counts as on it; the check_* fields say what a failed check of the design does."""

    optimizer: str = "simplex"
    tolerance: float | None = None
    max_evaluations: int | None = None
    boundary_tol: float = 1e-4
    check_nobs_vs_nlev: str = "stop"
    check_nlev_gtr_1: str = "stop"
    check_nlev_gtreq_5: str = "ignore"
    check_nobs_vs_rank_z: str = "ignore"
    check_rank_x: str = "message"
    check_scale_x: str = "warning"
    check_singular: str = "message"

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if name.startswith("check_") and value not in ACTIONS:
                raise ValueError(f"{name} is one of {', '.join(ACTIONS)}, not {value!r}")
        if self.max_evaluations is not None and self.max_evaluations < 1:
            raise ValueError("max_evaluations is positive")

    def settings(self) -> dict:
        """What the optimiser is called with."""
        return {k: v for k, v in (("tol", self.tolerance), ("limit", self.max_evaluations)) if v is not None}


@dataclass(frozen=True)
class GeneralisedControl(Control):
    """Also: the tolerance and number of inner iterations."""

    tol_pwrss: float = 1e-10
    inner_iterations: int = 100


def lmer_control(**settings) -> Control:
    return Control(**settings)


def glmer_control(**settings) -> GeneralisedControl:
    return GeneralisedControl(**settings)
