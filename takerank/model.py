"""The scoring model: which features make which dimension, with direction and weight."""

from __future__ import annotations

from dataclasses import dataclass

# Feature -> (direction, weight) of each dimension, and the defaults of the model.
WINDOW_DIMENSIONS: dict[str, dict[str, tuple[int, float]]] = {
    "sonido": {"flatness": (-1, 0.40), "silence_ratio": (-1, 0.25), "clip_ratio": (-1, 0.20), "crest_db": (1, 0.15)},
    "timing": {"ibi_cv": (-1, 0.35), "tempo_drift": (-1, 0.25), "onset_dev_mad": (-1, 0.40)},
    "groove": {"pulse_clarity": (1, 0.40), "band_sync": (1, 0.35), "beat_strength": (1, 0.25)},
    "afinacion": {"tuning_dev": (-1, 0.55), "key_clarity": (1, 0.45)},
    "tonal_outlier": {"fuera_tono_med": (-1, 0.55), "fuera_tono_p95": (-1, 0.45)},
}
FILE_DIMENSIONS: dict[str, dict[str, tuple[int, float]]] = {
    "desarrollo": {"tempo_consistency": (1, 0.55), "arco_dinamico": (1, 0.45)},
    "creatividad": {"novedad_armonica": (1, 0.40), "harmonic_flux": (1, 0.35), "variedad_textura": (1, 0.25)},
}
WEIGHTS = {"timing": 0.35, "groove": 0.30, "afinacion": 0.15, "desarrollo": 0.20, "tonal_outlier": 0.10, "creatividad": 0.20}
EXECUTION = ("timing", "groove", "afinacion", "tonal_outlier")
EXECUTION_CLEAN = ("timing", "groove", "afinacion")
INTEREST = ("creatividad", "desarrollo")
BALANCE = ("timing", "groove", "afinacion", "desarrollo")
PROFILES = {"balance": "balance", "performances": "ejecucion", "ideas": "interes", "gems": "gems"}
DIAGNOSTIC = ("centroid", "rolloff85", "rms_db", "noise_floor_db", "tempo", "n_beats", "onset_rate", "band_lag_ms", "low_energy_ratio", "dc_offset", "harmonic_flux", "spectral_contrast", "chroma_entropy", "snr_proxy_db", "dyn_range_db", "fuera_tono_picos")
CHROMA = tuple(f"chroma_{i}" for i in range(12))


def register_dimension(name: str, spec: dict[str, tuple[int, float]], level: str = "window") -> None:
    """Add a dimension of windows or files."""
    (WINDOW_DIMENSIONS if level == "window" else FILE_DIMENSIONS)[name] = dict(spec)


def register_profile(name: str, column: str) -> None:
    """Add a profile that ranks files by a column."""
    PROFILES[name] = column


@dataclass(frozen=True)
class Settings:
    """Options of a scoring run; mode is "mixto" or "veto"; weights: of the dimensions in the composites, WEIGHTS without."""

    profile: str = "balance"
    mode: str = "mixto"
    weight_sound: float = 0.35
    weight_execution: float = 0.65
    least_sound: float = 0.15
    best_quantile: float = 0.95
    shrink: float = 4.0
    weights: dict[str, float] | None = None

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile: {self.profile}")
        if self.mode not in {"mixto", "veto"}:
            raise ValueError(f"unknown mode: {self.mode}")
        if self.weights and set(self.weights) - set(WEIGHTS) - set(WINDOW_DIMENSIONS) - set(FILE_DIMENSIONS):
            raise ValueError(f"unknown dimension among the weights: {sorted(self.weights)}")

    @property
    def idea(self) -> bool:
        return self.profile in {"ideas", "gems"}
