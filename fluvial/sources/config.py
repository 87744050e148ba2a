"""Run configurations: a YAML mapping, checked by a table of rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

# What a configuration must have and may say.
REQUIRED = ("data_dir", "train_basin_file", "validation_basin_file", "test_basin_file", "train_start_date", "train_end_date", "validation_start_date", "validation_end_date", "test_start_date", "test_end_date", "forcing", "static", "targets")
CHOICES = {
    "io_mode": {"auto", "preload", "lazy"},
    "forcing.file_mode": {"single_file", "multi_file", "multi_zarr_yearly", "per_variable", "zarr", "auto"},
    "static.file_mode": {"single_file", "per_variable", "zarr", "auto"},
    "runoff_model.type": {"lstm", "spatial_lstm", "temporal_conv", "tcn", "spatial_temporal_conv", "precomputed", "identity", "passthrough"},
    "execution.mode": {"unified", "split_devices"},
    "routing.graph.mode": {"load", "build"},
    "routing.graph.builder": {"grid_4_neighbor", "grid_8_neighbor", "flow_direction_d8", "dem_downhill_d8", "flowline_network", "river_network", "flowlines"},
    "training.jkge_benchmark": {"moving_average", "section_mean"},
    "training.loss_target_space": {"normalized", "physical", "original", "unscaled"},
    "curriculum.early_stopping_scope": {"global", "stage"},
    "runoff_transfer.type": {"fixed", "neural", "learned"},
    "runoff_transfer.weight_strategy": {"stored", "cell_area", "inverse_distance", "exp_distance", "downhill", "downhill_distance"},
}
POSITIVE = ("windowing.sequence_years", "windowing.sequence_days", "windowing.stride_years", "windowing.stride_days", "windowing.spinup_years", "training.peak_flow_power", "training.peak_flow_max_weight", "training.jkge_window", "training.jkge_section_length", "training.jkge_eps", "curriculum.stage_learning_rate_decay", "curriculum.outlet_gauge_weight", "runoff_transfer.hidden_dim")
NOT_NEGATIVE = ("runoff_model.warmup_days", "runoff_model.lstm_warmup_days", "routing_model.routing_lag_context_days", "training.weight_decay", "training.mse_loss_weight", "training.kge_loss_weight", "training.peak_flow_weight")
EXCLUSIVE = (("windowing.sequence_years", "windowing.sequence_days"), ("windowing.stride_years", "windowing.stride_days"), ("spinup_length", "windowing.spinup_years"))
NOT_EMPTY = ("forcing.variables", "targets.variables")


def get(config: Mapping, path: str, default: Any = None) -> Any:
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, Mapping) or at.get(part) is None:
            return default
        at = at[part]
    return at


def _is(value: Any, ok: Callable[[float], bool]) -> bool:
    """Whether a value is a number, or reads as one, that is ok."""
    try:
        return ok(float(value))
    except (TypeError, ValueError):
        return False


def _number(config: Mapping, path: str, ok: Callable[[float], bool], what: str) -> None:
    value = get(config, path)
    if value is not None and not _is(value, ok):
        raise ValueError(f"{path} must be {what}, not {value!r}")


def _weights(name: str, weights: Any) -> None:
    """Weights of gauges: all that are wrong are named at once."""
    if weights is not None and not isinstance(weights, Mapping):
        raise ValueError(f"{name} must map gauges to positive weights")
    wrong = {g: w for g, w in (weights or {}).items() if not str(g).strip() or not _is(w, lambda x: x > 0)}
    if wrong:
        raise ValueError(f"{name} must map named gauges to positive weights; wrong: {wrong}")


def validate(config: Mapping) -> Mapping:
    """The configuration itself; an error names the first rule that it breaks."""
    for key in REQUIRED:
        if config.get(key) is None:
            raise ValueError(f"{key!r} is required")
    for key in ("forcing", "static", "targets"):
        if not isinstance(config[key], Mapping):
            raise ValueError(f"{key!r} must be a mapping")
    if all(get(config, k) is None for k in ("sequence_length", "windowing.sequence_years", "windowing.sequence_days")):
        raise ValueError("a window needs sequence_length, windowing.sequence_years or windowing.sequence_days")
    for a, b in EXCLUSIVE:
        if get(config, a) and get(config, b):
            raise ValueError(f"{a} and {b} exclude each other")
    a, b = get(config, "runoff_model.warmup_days"), get(config, "runoff_model.lstm_warmup_days")
    if a is not None and b is not None and int(a) != int(b):
        raise ValueError("runoff_model.warmup_days and runoff_model.lstm_warmup_days differ")
    for path, allowed in CHOICES.items():
        value = get(config, path)
        if value is not None and str(value).lower() not in allowed:
            raise ValueError(f"{path} must be one of {sorted(allowed)}, not {value!r}")
    for path in NOT_EMPTY:
        if not get(config, path):
            raise ValueError(f"{path} must not be empty")
    for path in POSITIVE:
        _number(config, path, lambda x: x > 0, "a positive number")
    for path in NOT_NEGATIVE:
        _number(config, path, lambda x: x >= 0, "a number that isn't negative")
    if get(config, "routing.graph.builder") in ("flowline_network", "river_network", "flowlines") and not (get(config, "routing.graph.flowlines") or get(config, "routing.graph.flowline")):
        raise ValueError("a flowline network needs routing.graph.flowlines")
    if get(config, "routing.graph.edge_features") is not None and not isinstance(get(config, "routing.graph.edge_features"), Mapping):
        raise ValueError("routing.graph.edge_features must be a mapping")
    _weights("curriculum.gauge_weights", get(config, "curriculum.gauge_weights"))
    stages = get(config, "curriculum.stages")
    if stages is not None and not isinstance(stages, list):
        raise ValueError("curriculum.stages must be a list")
    for k, stage in enumerate(stages or [], 1):
        if not isinstance(stage, Mapping):
            raise ValueError(f"stage {k} must be a mapping")
        for key in ("epochs", "learning_rate", "outlet_gauge_weight"):
            _number(stage, key, lambda x: x > 0, f"a positive number in stage {k}")
        _weights(f"gauge_weights of stage {k}", stage.get("gauge_weights"))
    return config


def load(path: str) -> Mapping:
    from fluvial.sources.sinks import read_yaml

    return validate(read_yaml(path))


def learning_rates(config: Mapping) -> list[float]:
    """Each stage's rate: its own, or the base rate times decay for each stage before."""
    base, decay = float(get(config, "training.learning_rate", 1e-3)), float(get(config, "curriculum.stage_learning_rate_decay", 1.0))
    return [float(s.get("learning_rate") or base * decay**k) for k, s in enumerate(get(config, "curriculum.stages", []) or [])]
