"""All settings of the engine, with their defaults, checked when they are set."""

from __future__ import annotations

from dataclasses import dataclass, replace

SCHEMES = ("raw", "log", "binary", "bm25")
HISTORY_SCHEMES = ("raw", "log", "binary")
UNITS = ("visitorid", "sessionid")
#: What an event counts for (any other counts 1), BM25's constants, the half-life of recency.
EVENT_WEIGHTS = {"view": 1.0, "addtocart": 4.0, "transaction": 10.0}
BM25_K1, BM25_B = 1.2, 0.8
HALF_LIFE_DAYS = 30.0


@dataclass(frozen=True)
class Settings:
    #: The defaults.
    min_user_interactions: int = 3
    min_item_interactions: int = 3
    max_filter_passes: int = 10
    min_known_interactions: int = 1
    k_neighbors: int = 20
    weight_scheme: str = "bm25"
    use_idf: bool = True
    shrinkage: float = 25.0
    similarity_power: float = 1.0
    history_weight_scheme: str = "log"
    max_user_items: int | None = 200
    position_decay: float = 1.0
    co_occurrence_unit: str = "visitorid"
    sequence_weight: float = 0.0
    sequence_window: int = 3
    sequence_position_decay: float = 0.7
    sequence_max_items: int = 5
    max_session_length: int = 50
    normalize_rows: bool = True
    current_session_only: bool = False
    max_history_items: int | None = None
    session_gap_minutes: float = 30

    def __post_init__(self) -> None:
        for value, allowed in (
            (self.weight_scheme, SCHEMES),
            (self.history_weight_scheme, HISTORY_SCHEMES),
            (self.co_occurrence_unit, UNITS),
        ):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {', '.join(allowed)}")

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


#: The tuned settings, and the axes of the sweep with what it tries on each, in this order.
TUNED = Settings(
    min_user_interactions=2,
    min_item_interactions=2,
    k_neighbors=100,
    weight_scheme="log",
    shrinkage=50.0,
    similarity_power=0.5,
    history_weight_scheme="binary",
    position_decay=0.7,
    sequence_weight=0.2,
    sequence_position_decay=1.0,
    sequence_max_items=3,
    current_session_only=True,
    max_history_items=5,
)
AXES = {
    "position_decay": [1.0, 0.95, 0.9, 0.8, 0.7, 0.5],
    "sequence_weight": [0.0, 0.1, 0.2, 0.3, 0.5, 0.7],
    "sequence_window": [1, 2, 3, 5],
    "sequence_position_decay": [1.0, 0.7, 0.5],
    "sequence_max_items": [1, 3, 5, 10],
    "current_session_only": [False, True],
    "max_history_items": [None, 5, 10, 20],
    "co_occurrence_unit": ["visitorid", "sessionid"],
    "shrinkage": [10.0, 25.0, 50.0, 100.0],
    "k_neighbors": [50, 100, 200],
    "history_weight_scheme": ["raw", "log", "binary"],
    "similarity_power": [0.5, 1.0, 1.5],
}
