"""The declarative description of a sample: sources, windows, crops, constants, dropout.  YAML in and out."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field

PROVIDERS = ("ukv", "ecmwf", "gfs", "icon_eu", "icon-eu", "cloudcasting", "mo_global", "gencast", "fgn")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class TimeWindow:
    interval_start_minutes: int
    interval_end_minutes: int
    time_resolution_minutes: int

    def __post_init__(self):
        _require(self.time_resolution_minutes > 0, "time_resolution_minutes must be positive")
        _require(self.interval_start_minutes <= self.interval_end_minutes, "interval_start_minutes must be <= interval_end_minutes")
        for name in ("interval_start_minutes", "interval_end_minutes"):
            _require(getattr(self, name) % self.time_resolution_minutes == 0, f"{name} must be divisible by time_resolution_minutes")

    @property
    def steps(self) -> int:
        return (self.interval_end_minutes - self.interval_start_minutes) // self.time_resolution_minutes + 1


@dataclass(frozen=True)
class Dropout:
    dropout_timedeltas_minutes: tuple[int, ...] = ()
    dropout_fraction: float | tuple[float, ...] = 0.0
    dropout_value: float = 0.0

    def __post_init__(self):
        deltas, f = self.dropout_timedeltas_minutes, self.dropout_fraction
        _require(all(d <= 0 for d in deltas), "dropout timedeltas must be <= 0")
        if isinstance(f, (list, tuple)):
            _require(len(f) > 0 and all(0 <= x <= 1 for x in f) and sum(f) <= 1 + 1e-9, "dropout fractions must lie in [0, 1] and sum to 1 at most")
            _require(len(f) == len(deltas), "one dropout fraction for each timedelta")
            none = sum(f) == 0
        else:
            _require(0 <= f <= 1, "dropout fraction must lie in [0, 1]")
            none = f == 0
        _require(none == (not deltas), "dropout needs both timedeltas and a fraction above 0, or neither")


@dataclass(frozen=True)
class SpatialWindow:
    image_size_pixels_width: int
    image_size_pixels_height: int

    def __post_init__(self):
        _require(min(self.image_size_pixels_width, self.image_size_pixels_height) >= 0, "image sizes must be >= 0")


@dataclass(frozen=True)
class Normalisation:
    mean: float
    std: float
    clip_min: float | None = None
    clip_max: float | None = None

    def __post_init__(self):
        _require(self.std > 0, "std must be positive")
        _require(self.clip_min is None or self.clip_max is None or self.clip_min < self.clip_max, "clip_min must be < clip_max")


@dataclass(frozen=True)
class Gridded:
    path: str
    channels: tuple[str, ...]
    window: TimeWindow
    crop: SpatialWindow
    constants: dict[str, Normalisation]
    dropout: Dropout = field(default_factory=Dropout)
    public: bool = False

    def constant_key(self, channel: str) -> str:
        return channel

    def __post_init__(self):
        _require(not (gone := [c for c in self.channels if self.constant_key(c) not in self.constants]), f"normalisation constants missing for {gone}")


@dataclass(frozen=True)
class Satellite(Gridded):
    pass


@dataclass(frozen=True)
class NWP(Gridded):
    provider: str = "ukv"
    max_staleness_minutes: int | None = None
    accum_channels: tuple[str, ...] = ()

    def constant_key(self, channel: str) -> str:
        return f"diff_{channel}" if channel in self.accum_channels else channel

    def __post_init__(self):
        super().__post_init__()
        _require(self.provider.lower() in PROVIDERS, f"unknown provider {self.provider}")
        _require(set(self.accum_channels) <= set(self.channels), "accum_channels must be among channels")
        _require(all(d < 0 for d in self.dropout.dropout_timedeltas_minutes) and not isinstance(self.dropout.dropout_fraction, (list, tuple)), "forecast dropout takes timedeltas below 0 and one fraction")


@dataclass(frozen=True)
class Generation:
    path: str
    window: TimeWindow
    dropout: Dropout = field(default_factory=Dropout)
    public: bool = False


@dataclass(frozen=True)
class T0Embedding:
    embeddings: tuple[tuple[str, str], ...]

    def __post_init__(self):
        for period, kind in self.embeddings:
            m = re.fullmatch(r"(\d+)([hy])", period)
            _require(bool(m) and int(m[1]) >= 1 and (m[2] == "y" or int(m[1]) <= 24), f"bad embedding period {period!r}")
            _require(kind in ("cyclic", "linear"), f"bad embedding kind {kind!r}")


@dataclass(frozen=True)
class Configuration:
    generation: Generation | None = None
    satellite: Satellite | None = None
    nwp: dict[str, NWP] = field(default_factory=dict)
    solar_position: TimeWindow | None = None
    t0_embedding: T0Embedding | None = None
    name: str = ""
    description: str = ""


_BUILD = {"window": TimeWindow, "crop": SpatialWindow, "dropout": Dropout, "generation": Generation, "satellite": Satellite, "solar_position": TimeWindow, "t0_embedding": T0Embedding}


def from_dict(raw: dict) -> Configuration:
    """A Configuration of nested dictionaries; unknown keys are refused."""

    def build(kind: type, x: dict):
        known = {f.name for f in dataclasses.fields(kind)}
        _require(not (extra := set(x) - known), f"{kind.__name__}: unknown keys {sorted(extra)}")
        out = {}
        for k, v in x.items():
            if k == "nwp":
                v = {name: build(NWP, y) for name, y in (v or {}).items()}
            elif k == "constants":
                v = {name: build(Normalisation, y) for name, y in v.items()}
            elif k == "embeddings":
                v = tuple((str(a), str(b)) for a, b in v)
            elif k in _BUILD and isinstance(v, dict):
                v = build(_BUILD[k], v)
            elif isinstance(v, list):
                v = tuple(v)
            out[k] = v
        return kind(**out)

    return build(Configuration, raw)


def load(path: str, spark=None) -> Configuration:
    """From YAML, with ${NAME} of the environment filled in; with a session from any file system that Spark reads."""
    import yaml

    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path) as f:
            text = f.read()
    return from_dict(yaml.safe_load(os.path.expandvars(text)))


def save(config: Configuration, path: str) -> None:
    """As YAML; an existing file is not overwritten."""
    import yaml

    def plain(x):
        if dataclasses.is_dataclass(x):
            return {k: y for f in dataclasses.fields(x) if (y := plain(getattr(x, k := f.name))) not in (None, {}, "")}
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    with open(path, "x") as f:
        yaml.safe_dump(plain(config), f, sort_keys=False)
