"""Run settings: required and conditional keys, values from a mapping or the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Keys every run needs, and keys needed when a switch is on.
REQUIRED = ("RunName", "StartDate", "EndDate", "Res", "LonMin", "LonMax", "LatMin", "LatMax", "nBufferClusters", "PriorError", "ObsError", "Gamma")
CONDITIONAL = {
    "OptimizeBCs": ("PriorErrorBCs", "PerturbValueBCs"),
    "OptimizeOH": ("PriorErrorOH", "PerturbValueOH"),
    "KalmanMode": ("UpdateFreqDays", "NudgeFactor"),
    "LognormalErrors": ("PriorErrorBufferElements",),
    "ReducedDimensionStateVector": ("ClusteringMethod", "NumberOfElements"),
}
STEPS = {"0.125x0.15625": (0.125, 0.15625), "0.25x0.3125": (0.25, 0.3125), "0.5x0.625": (0.5, 0.625), "2.0x2.5": (2.0, 2.5), "4.0x5.0": (4.0, 5.0)}


def float_list(value: object) -> list[float]:
    """A number or a list of numbers as a list of floats; TypeError for anything else (booleans included)."""
    values = value if isinstance(value, (list, tuple)) else [value]
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in values):
        raise TypeError(f"not a number or a list of numbers: {value!r}")
    return [float(v) for v in values]


@dataclass(frozen=True)
class RunConfig:
    """Checked settings; ``missing`` names what a run would lack."""

    values: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, values: Mapping[str, object], prefix: str = "FLUXLOOM_", env: Mapping[str, str] | None = None) -> RunConfig:
        """Settings with those of the environment (``prefix`` + key, read as JSON where possible) put over them."""
        out = dict(values)
        for key, text in (os.environ if env is None else env).items():
            if key.startswith(prefix):
                try:
                    out[key.removeprefix(prefix)] = json.loads(text)
                except ValueError:
                    out[key.removeprefix(prefix)] = text
        return cls(out)

    @property
    def missing(self) -> list[str]:
        needed = set(REQUIRED) | {k for switch, keys in CONDITIONAL.items() if self.values.get(switch) is True for k in keys}
        return sorted(needed - set(self.values))

    def checked(self) -> RunConfig:
        """This configuration; ValueError with all missing keys and impossible bounds otherwise."""
        if self.missing:
            raise ValueError("missing settings: " + ", ".join(self.missing))
        if not (self.values["LonMin"] < self.values["LonMax"] and self.values["LatMin"] < self.values["LatMax"]):
            raise ValueError("the domain is empty")
        if self.values["Res"] not in STEPS:
            raise ValueError(f"unknown resolution {self.values['Res']!r}")
        return self
