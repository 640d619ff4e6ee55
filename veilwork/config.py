"""Run settings. Plain frozen dataclasses that live on the driver only."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("focused", "strict", "smart", "aggressive")
AMOUNT_MODES = ("token", "fuzzy", "fixed")
STYLES = ("token", "alias")
ROLES = ("adjudicator", "detector", "both")


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the smart mode."""

    auto_mask: float = 0.85
    suggest_mask: float = 0.60


@dataclass(frozen=True)
class AssistConfig:
    """Limits of model-assisted detection."""

    enabled: bool = False
    role: str = "adjudicator"
    batch_size: int = 20
    max_calls: int | None = None  # a budget; without one every candidate is reviewed
    max_consecutive_errors: int = 3
    chunk_chars: int = 1500


@dataclass(frozen=True)
class MaskConfig:
    """Everything one masking run needs to know besides its tables."""

    mode: str = "smart"
    thresholds: Thresholds = field(default_factory=Thresholds)
    statuses: tuple[str, ...] = ("auto_mask",)
    irreversible: bool = False
    amount_mode: str = "token"
    style: str = "token"
    manual_words: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    auto_detect: bool = True
    batch_id: str = ""
    assist: AssistConfig = field(default_factory=AssistConfig)

    def __post_init__(self) -> None:
        if self.amount_mode not in AMOUNT_MODES:
            raise ValueError(f"amount_mode must be one of {AMOUNT_MODES}, got {self.amount_mode!r}")
        if self.style not in STYLES:
            raise ValueError(f"style must be one of {STYLES}, got {self.style!r}")
