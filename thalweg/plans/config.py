"""A typed configuration from keyword arguments, YAML or JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from thalweg.sources.io import discharge_names

CHOICES = {
    "grid_accumulation_type": ("incremental", "cumulative"),
    "runoff_processing_mode": ("sequential", "ensemble"),
    "log_level": ("DEBUG", "INFO", "PROGRESS", "WARNING", "ERROR", "CRITICAL"),
    "strategy": ("auto", "grouped", "levels", "chunks"),
}
#: What a path option is: one path or several, and whether it must be there or be written.
PATHS = {
    "params_file": ("one", "read"), "channel_state_init_file": ("one", "read"), "grid_weights_file": ("one", "read"), "uh_kernel_file": ("one", "read"), "uh_state_init_file": ("one", "read"),
    "qlateral_files": ("many", "read"), "grid_runoff_files": ("many", "read"), "discharge_files": ("many", "written"),
    "channel_state_final_file": ("one", "written"), "uh_state_final_file": ("one", "written"), "discharge_dir": ("one", "folder"), "network_cache_dir": ("one", "folder"),
}


def is_local(path: str) -> bool:
    return "://" not in path


@dataclass
class Config:
    """Every option of a run. Paths become absolute; local inputs and the folders of local outputs must exist; others are left to Spark."""

    params_file: str | None = None
    #: Whether the parameters must come in topological order; those of positional states and kernels do.
    params_in_order: bool = False
    #: A folder that keeps checked networks for other runs.
    network_cache_dir: str | None = None
    discharge_dir: str | None = None
    discharge_files: list[str] = field(default_factory=list)
    channel_state_init_file: str | None = None
    channel_state_final_file: str | None = None

    dt_routing: int = 0
    dt_total: int = 0
    dt_discharge: int = 0
    dt_runoff: int = 0
    start_datetime: str = "1970-01-01"

    qlateral_files: list[str] = field(default_factory=list)
    grid_runoff_files: list[str] | None = field(default_factory=list)
    grid_weights_file: str | None = None
    grid_accumulation_type: str = "incremental"
    runoff_processing_mode: str = "sequential"
    uh_kernel_file: str | None = None
    uh_state_init_file: str | None = None
    uh_state_final_file: str | None = None

    force_positive_runoff: bool = False
    force_uniform_timesteps: bool = False
    runoff_depth_unit: str | None = None

    log: bool = True
    progress_bar: bool = True
    log_level: str = "PROGRESS"
    log_stream: str = "stdout"
    log_format: str = "%(levelname)s - %(asctime)s - %(message)s"
    var_river_id: str = "river_id"
    var_discharge: str = "Q"
    var_grid_runoff: str = "ro"
    var_x: str = "x_index"
    var_y: str = "y_index"
    var_t: str = "time"
    var_qlateral: str = "qlateral"
    strategy: str = "auto"

    def __post_init__(self) -> None:
        if wrong := [n for n, allowed in CHOICES.items() if getattr(self, n) not in allowed]:
            raise ValueError("; ".join(f"{n} is {getattr(self, n)!r}, which is none of {', '.join(CHOICES[n])}" for n in wrong))
        if not self.params_file:
            raise ValueError("missing option: params_file")
        self.progress_bar = bool(self.log and self.progress_bar)
        resolved = {name: self._resolved(name) for name in PATHS}
        resolved["discharge_files"] = discharge_names(resolved["qlateral_files"] or resolved["grid_runoff_files"], next(iter(resolved["discharge_dir"]), None), resolved["discharge_files"])
        for name, paths in resolved.items():
            many, use = PATHS[name]
            for path in filter(is_local, paths):
                if use == "read" and not os.path.exists(path):
                    raise FileNotFoundError(f"{name}: {path}")
                if use == "written" and not os.path.isdir(os.path.dirname(path)):
                    raise NotADirectoryError(f"no folder for the output {path}")
            setattr(self, name, paths if many == "many" else next(iter(paths), None))

    def _resolved(self, name: str) -> list[str]:
        """An option's paths, none, one or several, local ones from the root."""
        value = getattr(self, name) or []
        given = [value] if isinstance(value, str | os.PathLike) else value
        return [os.path.abspath(p) if is_local(str(p)) else str(p) for p in given]

    @classmethod
    def load(cls, path: str | None = None, **options: Any) -> Config:
        """From a file, with keyword arguments over it. Names that are no option stop it, but keys that begin with an underscore are ignored."""
        found: dict[str, Any] = {}
        if path:
            kind = Path(path).suffix.lower()
            if kind not in (".yaml", ".yml", ".json"):
                raise RuntimeError(f"unknown configuration file type: {kind}")
            with open(path, encoding="utf-8") as f:
                if kind == ".json":
                    found = json.load(f)
                else:
                    import yaml

                    found = yaml.safe_load(f) or {}
        found = {k: v for k, v in (found | options).items() if not k.startswith("_")}
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise TypeError(f"unknown options: {sorted(unknown)}")
        return cls(**found)
