"""Resamplers by name, the two-step resampler interface, and options."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from abc import ABC, abstractmethod
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame

from gridloom.plans.area import AreaSpec

GROUP = "gridloom.resamplers"

_known: dict[str, type] = {}
_loaded = False

#: Options and their defaults; ``GRIDLOOM_<NAME>`` in the environment overrides.
DEFAULTS = {"cache_dir": "", "cache_geometry_slices": False, "tile": 256}
_options: dict[str, object] = {}


def option(name: str):
    if name in _options:
        return _options[name]
    if name not in DEFAULTS:
        raise KeyError(name)
    found = os.environ.get(f"GRIDLOOM_{name.upper()}")
    return DEFAULTS[name] if found is None else type(DEFAULTS[name])(json.loads(found) if not isinstance(DEFAULTS[name], str) else found)


@contextlib.contextmanager
def options(**values):
    """Options for the length of a block."""
    unknown = set(values) - set(DEFAULTS)
    if unknown:
        raise KeyError(sorted(unknown)[0])
    before = dict(_options)
    _options.update(values)
    try:
        yield
    finally:
        _options.clear()
        _options.update(before)


def digest(*parts) -> str:
    """SHA-1 of geometries and parameters, for naming persisted tables."""
    show = lambda p: p.digest() if isinstance(p, AreaSpec) else p
    return hashlib.sha1(json.dumps([show(p) for p in parts], sort_keys=True, default=str).encode()).hexdigest()


def cached_json(name: str, make: Callable, *args):
    """``make(*args)``, kept as JSON in the ``cache_dir`` option if caching of slices is on; slices survive."""
    if not option("cache_geometry_slices") or not option("cache_dir"):
        return make(*args)
    folder = os.path.join(option("cache_dir"), f"{name}_v1")
    path = os.path.join(folder, f"{digest(*args)}.json")
    if os.path.exists(path):
        with open(path) as file:
            return tuple(slice(*v["slice"]) if isinstance(v, dict) else v for v in json.load(file))
    out = make(*args)
    os.makedirs(folder, exist_ok=True)
    with open(path, "w") as file:
        json.dump([{"slice": [v.start, v.stop, v.step]} if isinstance(v, slice) else v for v in out], file)
    return out


class Resampler(ABC):
    """Geometry first, data later: ``plan`` makes a table that ``apply`` gathers any data through."""

    version = "1.0"

    def __init__(self, source, target: AreaSpec, **params):
        self.source, self.target, self.params = source, target, params
        self.table: DataFrame | None = None

    def hash(self) -> str:
        own = [p for p in (self.source, self.target) if isinstance(p, AreaSpec)]
        return digest(type(self).__name__, self.version, *own, {k: v for k, v in self.params.items() if not callable(v)})

    @property
    def same_geometry(self) -> bool:
        return isinstance(self.source, AreaSpec) and self.source == self.target

    @abstractmethod
    def plan(self) -> DataFrame: ...

    @abstractmethod
    def apply(self, data: DataFrame, values: list[str]) -> DataFrame: ...

    def precompute(self, path: str | None = None) -> "Resampler":
        """Makes the table now; with a path it is kept there and read back."""
        self.table = self.plan()
        if path is not None:
            self.table.write.mode("overwrite").parquet(path)
            self.table = self.table.sparkSession.read.parquet(path)
        return self

    def resample(self, data: DataFrame, values: list[str]) -> DataFrame:
        if self.same_geometry:
            return data.select("row", "col", *values)
        if self.table is None:
            self.precompute()
        return self.apply(data, values)


class Nearest(Resampler):
    """``source``: a DataFrame with row, col, lon, lat."""

    def plan(self):
        from gridloom.operators.knn import neighbours

        return neighbours(self.source, self.target, self.params.get("radius", 10_000.0), 1)

    def apply(self, data, values):
        from gridloom.operators.knn import gather

        return gather(self.table, data, ["row", "col"], values).selectExpr("t_row as row", "t_col as col", *values)


class Gauss(Resampler):
    def plan(self):
        from gridloom.operators.knn import neighbours

        return neighbours(self.source, self.target, self.params["radius"], self.params.get("k", 8))

    def apply(self, data, values):
        from gridloom.operators.knn import gauss, weighted

        return weighted(self.table, data, gauss(self.params["sigma"]), values, uncertainty=self.params.get("uncertainty", False))


class Bilinear(Resampler):
    def plan(self):
        from gridloom.operators.bilinear import weights

        return weights(self.source, self.target, self.params["radius"], self.params.get("k", 32))

    def apply(self, data, values):
        from gridloom.operators.bilinear import blend

        return blend(self.table, data, values, limit=self.params.get("limit", False))


class Gradient(Resampler):
    """``source``: an AreaSpec, or a swath DataFrame with a ``radius``."""

    def plan(self):
        from gridloom.operators.gradient import area_indices, swath_indices

        if isinstance(self.source, AreaSpec):
            return area_indices(self.params["spark"], self.source, self.target)
        return swath_indices(self.source, self.target, self.params["radius"])

    def apply(self, data, values):
        from gridloom.operators.gradient import take_bilinear, take_nearest

        return (take_bilinear if self.params.get("method", "bilinear") == "bilinear" else take_nearest)(self.table, data, values)


class Ewa(Resampler):
    def plan(self):
        from gridloom.operators.ewa import ll2cr

        return ll2cr(self.source, self.target)

    def apply(self, data, values):
        from gridloom.operators.ewa import fornav

        more = {k: v for k, v in self.params.items() if k != "rows_per_scan"}
        placed = self.table.select("row", "col", "gc", "gr").join(data.select("row", "col", *values), ["row", "col"])
        return fornav(placed, self.target, values, self.params["rows_per_scan"], **more)


def register(name: str, resampler: type) -> None:
    if name in known():
        raise ValueError(f"{name!r} is registered already")
    _known[name] = resampler


def unregister(name: str) -> None:
    known().pop(name)


def known() -> dict[str, type]:
    global _loaded
    if not _loaded:
        _loaded = True
        _known.update({"nearest": Nearest, "gauss": Gauss, "bilinear": Bilinear, "gradient": Gradient, "ewa": Ewa})
        for point in entry_points(group=GROUP):
            _known.setdefault(point.name, point.load())
    return _known


def names() -> list[str]:
    return sorted(known())


def create(source, target: AreaSpec, resampler: str = "nearest", **params) -> Resampler:
    if resampler not in known():
        raise KeyError(f"no resampler {resampler!r}")
    return known()[resampler](source, target, **params)
