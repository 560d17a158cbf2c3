"""Parameters of factors, signals and positions, with their defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class FactorConfig:
    days: int = 400
    forward: int = 5

    @property
    def window(self) -> int:
        """Bars that a rolling information coefficient looks back over."""
        return min(60, self.days // 3)


@dataclass(frozen=True)
class SignalConfig:
    quantile_window: int = 120
    divergence_lookback: int = 20
    quantile: bool = True
    reversal: bool = True
    divergence: bool = True


@dataclass(frozen=True)
class TurtleConfig:
    entry_z: float = 1.5
    add_step: float = 0.5
    stop: float = 2.0
    max_units: int = 4
    unit_share: float = 0.25
    cooldown: int = 3
    lookback: int = 60
