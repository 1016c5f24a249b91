"""Typed configuration with the published default values."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Survey:
    bands: tuple = ("g", "r", "i", "z")
    nside_chunk: int = 32


@dataclass(frozen=True)
class QualityCuts:
    mag_min: float = 17.0
    mag_max: float = 20.0
    magerr_max: float = 0.05
    flags_max: int = 0
    class_star_min: float = 0.8
    min_detections_per_star: int = 2
    max_detections_per_star: int = 25
    exclude_ccdnums: tuple = (61,)
    instrument: str = "c4d"


@dataclass(frozen=True)
class Solve:
    max_iterations: int = 5000
    precondition: bool = False      # by the diagonal; the published solves do without
    tolerance: float = 1.0e-5
    des_anchor_weight: float = 1.0e6
    tikhonov_reg: float = 1.0e-10
    gradient_detrend: str = "gaia"
    exposure_reg_weight: float = 0.0


@dataclass(frozen=True)
class OutlierRejection:
    n_iterations: int = 5
    star_chi2_cut: float = 3.0
    detection_sigma_cut: float = 4.0
    exposure_zp_cut: float = 0.3


@dataclass(frozen=True)
class EpochBoundaries:
    # MJDs of camera hardware changes.
    all_ccds: tuple = (56404, 56516, 56730)
    per_ccd: dict = field(default_factory=lambda: {2: (56626, 57751), 41: (58350,)})


@dataclass(frozen=True)
class StarFlat:
    enabled: bool = True
    polynomial_order: int = 3
    min_stars_per_bin: int = 50
    gray_smooth_sigma: float = 0.0
    epoch_boundaries: EpochBoundaries = field(default_factory=EpochBoundaries)


@dataclass(frozen=True)
class Config:
    survey: Survey = field(default_factory=Survey)
    quality_cuts: QualityCuts = field(default_factory=QualityCuts)
    solve: Solve = field(default_factory=Solve)
    outlier_rejection: OutlierRejection = field(default_factory=OutlierRejection)
    starflat: StarFlat = field(default_factory=StarFlat)


# A_band / E(B-V) of each photometric system.
EXTINCTION = {
    "decam_g": 3.237, "decam_r": 2.176, "decam_i": 1.595, "decam_z": 1.217,
    "gaia_g": 2.740, "gaia_bp": 3.374, "gaia_rp": 1.941,
    "ps1_g": 3.172, "ps1_r": 2.271, "ps1_i": 1.682, "ps1_z": 1.322,
}

# Named sky boxes (ra_min, ra_max, dec_min, dec_max) in degrees.
REGIONS = {
    "test-region": (50.0, 70.0, -40.0, -25.0),
    "test-patch": (50.0, 60.0, -35.0, -25.0),
}


def _coerce(default, value):
    """Cast a YAML value to the type of the default it replaces.

    YAML 1.1 reads ``1.0e6`` as text, hence the explicit float().
    """
    if isinstance(default, bool):
        return bool(value)
    if isinstance(default, float):
        return float(value)
    if isinstance(default, int):
        return int(value)
    if isinstance(default, tuple):
        return tuple(value)
    if isinstance(default, str):
        return str(value) if value else ""
    return value


def _merge(section, overrides):
    changes = {}
    for f in fields(section):
        if f.name not in overrides:
            continue
        current = getattr(section, f.name)
        given = overrides[f.name]
        if is_dataclass(current):
            changes[f.name] = _merge(current, given or {})
        elif f.name == "per_ccd":
            changes[f.name] = {int(k): tuple(v) for k, v in (given or {}).items()}
        else:
            changes[f.name] = _coerce(current, given)
    return replace(section, **changes)


def load_config(path=None) -> Config:
    """Defaults, overridden by the sections found in a YAML file."""
    if path is None:
        return Config()
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    flat = raw.get("starflat") or {}
    bounds = flat.get("epoch_boundaries")
    if isinstance(bounds, dict) and "global" in bounds:
        flat["epoch_boundaries"] = {"all_ccds": bounds["global"],
                                    "per_ccd": bounds.get("per_ccd") or {}}
    return _merge(Config(), raw)
