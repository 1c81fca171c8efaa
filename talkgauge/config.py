"""Settings of a dataset run, checked on creation and kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

# Lengths the tokenised form may have, and the warning limits of the profile.
ALLOWED_LENGTHS = (128, 256, 384, 512)
IMBALANCE_WARNING = 1.5
TRUNCATION_WARNING_PERCENT = 10.0


@dataclass(frozen=True)
class DatasetSettings:
    """Columns, split ratios and cleaning switches of a labelled-text dataset."""

    data_path: str = "data/labeled_data.csv"
    output_dir: str = "results"
    id_column: str | None = None
    text_column: str = "text"
    label_column: str = "label"
    max_length: int = 256
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    replace_urls: bool = True
    replace_emails: bool = True
    min_text_length: int = 3
    remove_duplicates: bool = True
    seed: int = 42
    n_trials: int = 20
    early_stopping_patience: int = 3

    def __post_init__(self):
        total = self.train_ratio + self.val_ratio + self.test_ratio
        if abs(total - 1.0) > 1e-9:
            raise ValueError(f"split ratios sum to {total}, not 1")
        if self.max_length not in ALLOWED_LENGTHS:
            raise ValueError(f"max_length must be one of {ALLOWED_LENGTHS}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> DatasetSettings:
        return cls(**json.loads(text))
