"""Every tunable constant of the dialogue engine, in one immutable place."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

#: Weights of the bubble classifier. Their order is the order in which a score is summed.
BOX_WEIGHTS = {
    "bbox_area": 0.03,
    "word_count": 0.07,
    "text_density": 0.10,
    "aspect_ratio": 0.05,
    "punctuation": 0.15,
    "dictionary_ratio": 0.15,
    "alphabet_ratio": 0.20,
    "word_frequency": 0.15,
    "trigram_score": 0.07,
    "ocr_noise": 0.03,
}

#: Weights of the text classifier, in summing order.
TEXT_WEIGHTS = {
    "bbox_area": 0.08,
    "aspect_ratio": 0.07,
    "text_density": 0.08,
    "word_count": 0.10,
    "punctuation_count": 0.07,
    "dictionary_ratio": 0.20,
    "alphabet_ratio": 0.15,
    "word_frequency_score": 0.12,
    "trigram_language_score": 0.08,
    "ocr_noise_score": 0.05,
}


def checked_box_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if they sum to 1 within 0.001; else ValueError."""
    total = sum(weights.values())
    if abs(total - 1.0) > 0.001:
        raise ValueError(f"weights of the bubble classifier must sum to 1, not {total}")
    return weights


def scaled_text_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, divided by their sum where that is off 1 by more than 0.01."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if abs(total - 1.0) > 0.01 else dict(weights)


@dataclass(frozen=True)
class Params:
    """Defaults of all operators; numeric limits of 0 fall back to the default where noted."""

    # words to bubbles
    max_vertical_gap: int = 100  # 0 means default
    max_center_shift: int = 150  # reported only
    wide_reject_px: float = 100.0
    wide_reject_widths: float = 2.5
    same_line_overlap: float = 0.5
    same_line_gap_px: float = 25.0
    same_line_gap_widths: float = 0.8
    stacked_gap_px: float = 150.0
    wide_bubble_px: int = 500
    tall_bubble_px: int = 800
    wide_cut_px: float = 100.0
    wide_cut_floor_px: float = 60.0
    wide_cut_widths: float = 1.5
    tall_cut_px: float = 100.0
    # continuation across panels
    edge_gap_px: int = 50
    min_alignment: float = 0.6
    min_width_similarity: float = 0.7
    max_candidates: int = 10
    # classifiers
    box_threshold: float = 0.60
    box_weights: dict = field(default_factory=lambda: dict(BOX_WEIGHTS))
    text_threshold: float = 0.55
    text_weights: dict = field(default_factory=lambda: dict(TEXT_WEIGHTS))
    # text
    max_repeats: int = 2
    # providers
    max_images: int = 150
    ocr_batch: int = 16
    ocr_retry_first_s: float = 1.0
    ocr_retry_factor: float = 2.0
    ocr_retry_max_s: float = 10.0
    ocr_deadline_s: float = 60.0
    tts_parallel: int = 5
    tts_model: str = "eleven_turbo_v2"
    tts_stability: float = 0.5
    tts_similarity: float = 0.75
    pause_ms: int = 700  # 0 means default
    audio_format: str = "mp3"
    ocr_credentials: str = ""
    tts_key: str = ""
    tts_voice: str = ""

    def __post_init__(self):
        for name in ("max_vertical_gap", "pause_ms"):
            if not getattr(self, name):
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)
        checked_box_weights(self.box_weights)
        object.__setattr__(self, "text_weights", scaled_text_weights(self.text_weights))

    @property
    def ocr_configured(self) -> bool:
        """SRC7: there is a path to credentials, and something at it."""
        return bool(self.ocr_credentials) and os.path.exists(self.ocr_credentials)

    @property
    def tts_configured(self) -> bool:
        """SRC7: there are a key and a voice."""
        return bool(self.tts_key) and bool(self.tts_voice)

    @classmethod
    def from_env(cls, prefix: str = "INKSPOOL_") -> Params:
        """Params with numbers and strings overridden by environment variables, as INKSPOOL_PAUSE_MS."""
        given = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ and isinstance(f.default, int | float | str)}
        return cls(**given)


DEFAULTS = Params()
