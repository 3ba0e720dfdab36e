"""Settings: defaults, a YAML file's values, and the environment over both."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any, Mapping


@dataclass(frozen=True)
class Filters:
    filter_outliers: bool = True
    tails_percentile: float = 0.01
    min_velocity: float = 1.0
    apply_2d_median: bool = True
    median_window_size: int = 5
    median_threshold_factor: float = 3.0


@dataclass(frozen=True)
class Clustering:
    features: tuple[str, ...] = ("speed", "angle_deg")
    n_components: int = 8
    weight_concentration_prior: float = 0.5
    max_iter: int = 100
    random_state: int = 42
    covariance_type: str = "full"


@dataclass(frozen=True)
class Database:
    host: str = "localhost"
    port: str = "5432"
    name: str = ""
    user: str = ""
    password: str = field(default="", repr=False)


@dataclass(frozen=True)
class Api:
    host: str = "localhost"
    port: str = "8080"
    image_view: str = ""


@dataclass(frozen=True)
class Output:
    base_dir: str = "output"
    save_plots: bool = True
    plot_dpi: int = 300


@dataclass(frozen=True)
class Settings:
    filters: Filters = Filters()
    clustering: Clustering = Clustering()
    database: Database = Database()
    api: Api = Api()
    output: Output = Output()
    target_date: str = ""
    camera_names: tuple[str, ...] = ()
    roi_path: str = ""
    n_jobs: int = 1
    log_level: str = "INFO"

    def get(self, key: str, default: Any = None) -> Any:
        """The value at a dotted key, or the default if there is none."""
        at: Any = self
        for part in _own_key(key).split("."):
            if not is_dataclass(at) or part not in {f.name for f in fields(at)}:
                return default
            at = getattr(at, part)
        return at

    @property
    def db_url(self) -> str:
        d = self.database
        return f"postgresql://{d.user}:{d.password}@{d.host}:{d.port}/{d.name}"

    @property
    def jdbc_url(self) -> str:
        d = self.database
        return f"jdbc:postgresql://{d.host}:{d.port}/{d.name}"

    @property
    def api_url(self) -> str:
        return f"http://{self.api.host}:{self.api.port}"

    def get_api_url(self, endpoint: str = "") -> str:
        """The URL of an endpoint; of the base without one."""
        return f"{self.api_url}/{endpoint.lstrip('/')}" if endpoint else self.api_url


# Other names of sections and keys in a settings file, and what they are here. An empty name is the top.
SECTIONS = {"dic": "filters", "data": "", "processing": ""}
KEYS = {"clustering.variables_names": "clustering.features", "data.polygon_roi_file": "roi_path"}
# The columns that such a file calls otherwise.
COLUMNS = {"V": "speed", "magnitude": "speed"}


def _own_key(key: str) -> str:
    if key in KEYS:
        return KEYS[key]
    section, dot, rest = key.partition(".")
    return f"{SECTIONS[section]}.{rest}".lstrip(".") if dot and section in SECTIONS else key


def _own_names(values: Mapping[str, Any]) -> dict:
    """A settings file's values under the names that they have here."""
    out: dict = {}
    for section, held in values.items():
        for key, value in (held or {}).items() if isinstance(held, Mapping) else [("", held)]:
            at, target = _own_key(f"{section}.{key}".rstrip(".")), out
            *path, leaf = at.split(".")
            for part in path:
                target = target.setdefault(part, {})
            target[leaf] = [COLUMNS.get(x, x) for x in value] if at == "clustering.features" else value
    return out


# Environment variables that override the settings.
ENVIRONMENT = {
    "DB_HOST": "database.host",
    "DB_PORT": "database.port",
    "DB_NAME": "database.name",
    "DB_USER": "database.user",
    "DB_PASSWORD": "database.password",
    "APP_HOST": "api.host",
    "APP_PORT": "api.port",
    "GET_IMAGE_VIEW": "api.image_view",
}


def merged(base: Any, values: Mapping[str, Any]) -> Any:
    """A settings object with nested values put in; an unknown key is an error."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    new = {}
    for key, value in values.items():
        if key not in known:
            raise KeyError(f"no setting {key!r} in {type(base).__name__}")
        if is_dataclass(known[key]):
            value = merged(known[key], value)
        elif isinstance(known[key], tuple):
            value = tuple(value)
        elif isinstance(known[key], str):
            value = "" if value is None else str(value)
        new[key] = value
    return replace(base, **new)


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Defaults, then the YAML file, then the environment."""
    settings = Settings()
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            settings = merged(settings, _own_names(yaml.safe_load(f) or {}))
    env = os.environ if environment is None else environment
    for name, key in ENVIRONMENT.items():
        if name in env:
            section, _, leaf = key.partition(".")
            settings = merged(settings, {section: {leaf: env[name]}})
    return settings
