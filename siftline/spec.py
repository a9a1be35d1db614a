"""What a table looks like to the operators: key, features, category column and label map."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of one table. Operators never name a column outside a spec."""

    key: tuple[str, ...]
    features: tuple[str, ...]
    category: str
    label_map: Mapping[str, int]
    label: str = "label"
    split: str = "split"
    positive_categories: tuple[str, ...] = ()
    positive_text: str = "Positive"
    negative_text: str = "Negative"
    ranges: Mapping[str, tuple[float, float, float]] = field(default_factory=dict)

    def positives(self) -> tuple[str, ...]:
        if self.positive_categories:
            return self.positive_categories
        return tuple(name for name, value in self.label_map.items() if value == 1)


# The catalogue's feature order, label map and form ranges (min, max, default).
KOI = TableSpec(
    key=("record_id",),
    features=(
        "koi_period", "koi_depth", "koi_prad", "koi_teq",
        "koi_impact", "koi_duration", "koi_model_snr", "koi_steff",
        "koi_slogg", "koi_srad", "koi_kepmag", "koi_insol",
    ),
    category="koi_disposition",
    label_map={"FALSE POSITIVE": 0, "CANDIDATE": 1, "CONFIRMED": 1},
    positive_text="Planet",
    negative_text="False Positive",
    ranges={
        "koi_period": (0.0, 1000.0, 10.0),
        "koi_depth": (0.0, 10000.0, 500.0),
        "koi_prad": (0.0, 50.0, 2.0),
        "koi_teq": (0.0, 3000.0, 800.0),
        "koi_impact": (0.0, 2.0, 0.5),
        "koi_duration": (0.0, 20.0, 3.0),
        "koi_model_snr": (0.0, 1000.0, 30.0),
        "koi_steff": (0.0, 10000.0, 5800.0),
        "koi_slogg": (0.0, 5.0, 4.4),
        "koi_srad": (0.0, 10.0, 1.0),
        "koi_kepmag": (0.0, 20.0, 14.0),
        "koi_insol": (0.0, 5000.0, 100.0),
    },
)

# Columns shown when a catalogue is profiled.
KOI_PROFILE_FEATURES = ("koi_period", "koi_depth", "koi_prad", "koi_teq", "koi_score")
