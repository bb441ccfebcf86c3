"""Default parameters of every operator, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Averaging:
    method: str = "trimmed"      # mean | trimmed | median | recency | seasonal
    window: int = 12
    trim_pct: float = 10.0
    half_life: float = 6.0
    drop_suspended_zeros: bool = True
    drop_estimated: bool = False
    min_valid: int = 3


# Demand coefficients per catalogue class.
TARIFF_CLASSES: dict[str, dict[str, float]] = {
    "BT Residencial": dict(a=0.0002, b=0.0300, ca=0.20, cb=0.80, cos_phi=0.92, load_factor=0.42, k_loss=0.30),
    "BT Comercial": dict(a=0.00025, b=0.0350, ca=0.30, cb=0.70, cos_phi=0.90, load_factor=0.50, k_loss=0.25),
    "BT Industrial": dict(a=0.00030, b=0.0400, ca=0.50, cb=0.50, cos_phi=0.88, load_factor=0.65, k_loss=0.18),
    "MT Industrial": dict(a=0.00035, b=0.0450, ca=0.70, cb=0.30, cos_phi=0.92, load_factor=0.75, k_loss=0.15),
}

# Plausible monthly kWh per catalogue class.
PLAUSIBLE_KWH: dict[str, tuple[float, float]] = {
    "BT Residencial": (0.0, 5000.0),
    "BT Comercial": (0.0, 30000.0),
    "BT Industrial": (0.0, 200000.0),
    "MT Industrial": (0.0, 5000000.0),
}


@dataclass(frozen=True)
class Demand:
    method: str = "velander"     # velander | load_factor
    days: float = 30.0
    v_ln: float = 127.0
    v_ll: float = 220.0
    min_coincidence: float = 0.15


@dataclass(frozen=True)
class Segmentation:
    base_percentile: float = 0.75
    residential_cuts: tuple[float, ...] = (50, 100, 130, 200, 300, 500, 1000)
    other_cuts: tuple[float, ...] = (200, 1000, 5000, 20000, 100000)
    large_kwh: float = 5000.0
    min_peers: int = 8


# Peer levels from finest to coarsest, with their confidence.
PEER_LEVELS: list[tuple[str, list[str], float]] = [
    ("CLASE_TENSION_FASES_RUTA", ["consumption_class", "voltage_level", "phases", "route"], 1.00),
    ("CLASE_TENSION_RUTA", ["consumption_class", "voltage_level", "route"], 0.90),
    ("CLASE_TENSION_FASES", ["consumption_class", "voltage_level", "phases"], 0.70),
    ("CLASE_TENSION", ["consumption_class", "voltage_level"], 0.60),
    ("CLASE", ["consumption_class"], 0.40),
]


@dataclass(frozen=True)
class Signals:
    s1_drop_pct: float = 40.0
    s1_min_months: int = 3
    s1_recovery_pct: float = 15.0
    s3_change_pct: float = 30.0
    s4_min_zeros: int = 3
    s5_percentile: float = 0.05
    s5_min_peers: int = 5
    s7_cv_max: float = 0.05
    s8_min_units: int = 3
    s8_cv_min: float = 0.60
    s9_min_deficit: float = 0.35
    contamination: float = 0.05


SIGNALS = ["S1", "S3", "S4", "S5", "S7", "S8", "S9"]

# The reason shown for each signal.
REASONS: dict[str, str] = {
    "S1": "Caída y recuperación de consumo (patrón de manipulación temporal)",
    "S3": "Ruptura de nivel de consumo sin causa comercial",
    "S4": "Consumo en cero con servicio activo",
    "S5": "Consumo muy por debajo de su grupo par (misma ruta/clase)",
    "S7": "Consumo anómalamente plano (posible consumo fijo declarado)",
    "S8": "Consumo muy por debajo de sus vecinos del mismo transformador",
    "S9": "Consumo muy por debajo de su propio nivel histórico habitual",
    "UNSUP": "Patrón atípico detectado por análisis no supervisado",
}


@dataclass(frozen=True)
class Losses:
    k_by_feeder_type: dict[str, float] = field(default_factory=lambda: {"U": 0.30, "R": 0.20})
    k_default: float = 0.25
    t_operation: float = 50.0
    t_reference: float = 20.0
    alpha_al: float = 0.00403
    alpha_cu: float = 0.00393
    neutral: bool = True
    imbalance_factor: float = 1.02
    # Meter self-consumption in watts by meter type.
    meter_watts: dict[str, float] = field(default_factory=lambda: {
        "Electromecánico": 1.8, "Electrónico": 0.8, "Inteligente": 1.0, "_default": 1.0})


@dataclass(frozen=True)
class Lighting:
    days: float = 30.0
    hours_min: float = 10.0
    hours_max: float = 13.0
    # Auxiliary losses in watts by lamp technology.
    aux_watts: dict[str, float] = field(default_factory=lambda: {
        "LED": 4.0, "Sodio": 25.0, "Mercurio": 30.0, "Metal Halide": 28.0, "Inducción": 8.0, "_default": 20.0})


@dataclass(frozen=True)
class Balance:
    own_use_pct: float = 0.1
    c02_max_pct: float = 60.0
    c04_max_pct: float = 20.0
    c05_pct: float = 10.0
    c06_min_pct: float = 70.0


# Loading thresholds of a transformer (ratio of peak to capacity).
LOADING = dict(critical=1.20, overloaded=1.00, high=0.80, adequate=0.30, underused=0.15)
