"""One run at a time, in the background: start, stop, state, reprojection and metrics."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import all_metrics
from ..operators.pairs import normalized, normalized_pairs
from ..operators.projection import project
from ..sources import registry, sinks
from ..storage import shared_path
from ..streaming import run_log
from . import config as cfg
from .fit import Fit, fit_embedding


class Status(str, Enum):
    IDLE = "idle"
    PRECOMPUTING = "precomputing"
    RUNNING = "running"
    COMPLETED = "completed"
    STOPPED = "stopped"
    ERROR = "error"


@dataclass(frozen=True)
class State:
    """What is known of the current or last run."""

    status: Status = Status.IDLE
    run_id: str | None = None
    curvature: float | None = None
    iteration: int = 0
    iterations: int = 0
    loss: float | None = None
    phase: str = ""
    losses: tuple[float, ...] = ()
    message: str = ""
    metrics: dict[str, float | None] | None = None


@dataclass
class RunService:
    """Runs fits for a session. ``on_update`` and ``on_status`` get the state whenever it changes."""

    spark: SparkSession
    config: dict = field(default_factory=cfg.defaults)
    path: str | None = None
    log: str | None = None
    on_update: Callable[[State], None] | None = None
    on_status: Callable[[State], None] | None = None

    def __post_init__(self) -> None:
        self._lock, self._state, self._stop = threading.RLock(), State(), threading.Event()
        self._thread: threading.Thread | None = None
        self._data: dict[tuple, registry.Dataset] = {}
        self._fit: Fit | None = None
        self.log = self.log or shared_path(self.spark, "run-log")

    @property
    def state(self) -> State:
        with self._lock:
            return self._state

    def _set(self, tell: Callable[[State], None] | None, **changes: object) -> None:
        with self._lock:
            self._state = replace(self._state, **changes)
            state = self._state
        if tell:
            tell(state)

    def busy(self) -> bool:
        return self.state.status in (Status.RUNNING, Status.PRECOMPUTING)

    def datasets(self) -> list[str]:
        return registry.names()

    def get_config(self) -> dict:
        return self.config

    def set_config(self, config: dict) -> tuple[bool, str]:
        """Takes a valid configuration over; cached data goes."""
        ok, message = cfg.validate(config)
        if ok:
            self.config = config
            self._data.clear()
        return ok, message

    def reset_config(self) -> dict:
        self.config = cfg.defaults()
        self._data.clear()
        return self.config

    def _dataset(self) -> registry.Dataset:
        """The configured points, normalised, cached by what they depend on."""
        name, n = self.config["data"]["dataset"], self.config["data"].get("n_samples", -1)
        key = (name, n, self.path)
        if key not in self._data:
            if n < 1 and name != "embeddings":
                raise ValueError("generated data sets need n_samples")
            data = registry.load(self.spark, name, n, path=self.path)
            data = registry.sample(data, n) if n > 0 else data
            points = data.points.persist() if data.distances is not None else normalized(data.points).persist()
            self._data[key] = registry.Dataset(points, normalized_pairs(data.distances).persist() if data.distances is not None else None)
        return self._data[key]

    def start(self, curvature: float, config: dict | None = None) -> tuple[bool, str]:
        """Starts a run unless one is under way or the configuration is not valid."""
        config = self.config if config is None else config
        ok, message = cfg.validate(config)
        if not ok:
            return False, message
        with self._lock:
            if self.busy():
                return False, "a run is under way"
            self.config = config
            self._stop.clear()
            self._state = State(Status.PRECOMPUTING, uuid.uuid4().hex, curvature, iterations=config["embedding"]["n_iterations"])
        self._thread = threading.Thread(target=self._run, args=(curvature,), daemon=True)
        self._thread.start()
        return True, "started"

    def _run(self, k: float) -> None:
        try:
            self._set(self.on_status)
            data, e = self._dataset(), self.config["embedding"]
            scale = self.config["hyperparameters"].get("init_scale", "auto")
            self._set(self.on_status, status=Status.RUNNING)
            self._fit = fit_embedding(
                data.points, k, e["embed_dim"], e["n_iterations"], e["perplexity"], cfg.learning_rate(self.config, k), e["early_exaggeration_iterations"], e["early_exaggeration_factor"],
                e["momentum_early"], e["momentum_main"], e["centering_weight"], e["scaling_loss_type"], e["init_method"], None if scale == "auto" else float(scale), data.distances, self._seen,
            )
            if self._stop.is_set():
                self._set(self.on_status, status=Status.STOPPED)
                return
            self._set(None, metrics=self.metrics())
            self._set(self.on_status, status=Status.COMPLETED)
        except Exception as error:  # noqa: BLE001  a failed run is a state of the service
            self._set(self.on_status, status=Status.ERROR, message=str(error))

    def _seen(self, iteration: int, loss: float, points: DataFrame, phase: str) -> bool:
        if self._stop.is_set():
            return False
        run_log.append(project(points, self.state.curvature), self.log, self.state.run_id, iteration, loss, phase)
        self._set(self.on_update, iteration=iteration, loss=loss, phase=phase, losses=(*self.state.losses, loss))
        return True

    def stop(self) -> None:
        self._stop.set()

    def wait(self, seconds: float | None = None) -> None:
        if self._thread:
            self._thread.join(seconds)

    def reset(self) -> None:
        """Back to idle; raises RuntimeError during a run."""
        with self._lock:
            if self.busy():
                raise RuntimeError("a run is under way")
            self._state, self._fit = State(), None

    def _low(self) -> DataFrame:
        if self._fit is None:
            raise RuntimeError("nothing is fitted")
        return self._fit.points.join(self._dataset().points.select("id", "label"), "id")

    def reproject(self, **options: object) -> DataFrame:
        """The fitted points in the plane with colours; options as for a projection."""
        return sinks.colored(project(self._low(), self._fit.k, **options))

    def metrics(self, k: int = 10) -> dict[str, float | None]:
        return all_metrics(self._dataset().points, self._low(), self._fit.k, k).first().asDict()
