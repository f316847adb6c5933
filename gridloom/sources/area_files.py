"""Area files: YAML and the older REGION format, CF attributes, raster transforms."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

import numpy as np
import yaml

from gridloom.errors import AreaNotFound
from gridloom.functions.crs import Crs, format_proj
from gridloom.plans.area import AreaSpec
from gridloom.plans.create import DynamicArea, create_area


def update_nested(base: dict, new: Mapping) -> dict:
    """``new`` over ``base``, dicts merged level by level."""
    for key, value in new.items():
        base[key] = update_nested(dict(base.get(key) or {}), value) if isinstance(value, Mapping) and isinstance(base.get(key), Mapping) else value
    return base


def _content(source) -> str:
    if hasattr(source, "read"):
        return source.read()
    if "\n" in str(source) or not os.path.exists(source):
        return str(source)
    with open(source) as file:
        return file.read()


def parse_areas(sources, *names: str) -> list:
    """All areas of files or texts, or those of ``names`` in order; later sources override earlier ones."""
    sources = sources if isinstance(sources, (list, tuple)) else [sources]
    merged: dict = {}
    legacy: dict = {}
    for source in sources:
        text = _content(source)
        try:
            found = yaml.safe_load(text)
            if found is not None and not isinstance(found, Mapping):
                raise yaml.YAMLError("not a mapping")
            update_nested(merged, found or {})
        except yaml.YAMLError:
            legacy |= {a.area_id: a for a in parse_legacy(text)}
    known = {**{k: None for k in merged}, **{k: None for k in legacy}}
    wanted = names or tuple(known)
    out = []
    for name in wanted:
        if name in merged:
            out.append(area_from_dict(name, merged[name]))
        elif name in legacy:
            out.append(legacy[name])
        else:
            raise AreaNotFound(f"no area {name!r}")
    return out


def load_area(source, *names: str):
    """One area, or a list where several are named or the file holds several."""
    found = parse_areas(source, *names)
    return found[0] if len(found) == 1 else found


load_area_from_string = load_area


def area_from_dict(name: str, params: Mapping):
    params = dict(params)
    known = {k: params.pop(k, None) for k in ("projection", "shape", "area_extent", "center", "resolution", "radius", "upper_left_extent", "units", "width", "height")}
    description = params.pop("description", "") or ""
    if isinstance(known["projection"], Mapping) and set(known["projection"]) == {"EPSG"}:
        known["projection"] = int(known["projection"]["EPSG"])
    return create_area(name, known.pop("projection"), description=description, **known, **params)


_REGION = re.compile(r"REGION:\s*(\S+)\s*\{(.*?)\}\s*;", re.DOTALL)


def parse_legacy(text: str) -> list[AreaSpec]:
    """Areas of ``REGION: id { KEY: value ... };`` blocks; ``#`` starts a comment."""
    text = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#"))
    out = []
    for name, body in _REGION.findall(text):
        fields = {}
        for line in body.splitlines():
            if ":" in line:
                key, value = line.split(":", 1)
                fields[key.strip().upper()] = value.strip().strip(";")
        params = dict(p.strip().split("=", 1) for p in fields["PCS_DEF"].strip("'\"").split(",") if "=" in p)
        extent = [float(v) for v in fields["AREA_EXTENT"].strip("()").split(",")]
        out.append(AreaSpec.make({k.strip(): v.strip() for k, v in params.items()}, int(float(fields["XSIZE"])), int(float(fields["YSIZE"])), extent, name, fields.get("NAME", "")))
    return out


def dump_area(area) -> str:
    """YAML that ``parse_areas`` reads back."""
    if isinstance(area, DynamicArea):
        body = {"description": area.description, "projection": dict(area.crs.params)}
        if area.resolution:
            body["resolution"] = list(area.resolution)
        if area.width and area.height:
            body["shape"] = {"height": area.height, "width": area.width}
        return yaml.safe_dump({area.area_id or "area": body}, sort_keys=False)
    llx, lly, urx, ury = area.extent
    units = area.crs.units
    body = {
        "description": area.description,
        "projection": dict(area.crs.params),
        "shape": {"height": area.height, "width": area.width},
        "area_extent": {"lower_left_xy": [llx, lly], "upper_right_xy": [urx, ury], "units": units},
    }
    return yaml.safe_dump({area.area_id or "area": body}, sort_keys=False)


def dump_legacy(area: AreaSpec) -> str:
    params = ", ".join(part.lstrip("+") for part in format_proj(dict(area.crs.params)).split())
    lines = [f"REGION: {area.area_id} {{", f"\tNAME:\t{area.description}", f"\tPCS_ID:\t{area.area_id}", f"\tPCS_DEF:\t{params}"]
    lines += [f"\tXSIZE:\t{area.width}", f"\tYSIZE:\t{area.height}", f"\tAREA_EXTENT: {tuple(area.extent)}", "};", ""]
    return "\n".join(lines)


def dump_areas(areas, path: str | None = None) -> str:
    text = "".join(dump_area(a) for a in areas)
    if path is not None:
        with open(path, "w") as file:
            file.write(text)
    return text


def convert_to_yaml(source, path: str) -> str:
    """A file of the older format as YAML."""
    return dump_areas(parse_areas(source), path)


def area_list_rst(source) -> str:
    """A reStructuredText list of a file's areas."""
    out = []
    for a in parse_areas(source):
        size = f"{a.height} x {a.width}" if isinstance(a, AreaSpec) else "open"
        out.append(f"{a.area_id}\n{'-' * len(a.area_id)}\n\n* {a.description}\n* ``{a.crs.to_proj()}``\n* {size}\n")
    return "\n".join(out)


# Grid mapping names of the CF conventions and the projections they stand for.
CF_MAPPINGS = {
    "latitude_longitude": "longlat",
    "polar_stereographic": "stere",
    "stereographic": "stere",
    "lambert_azimuthal_equal_area": "laea",
    "lambert_conformal_conic": "lcc",
    "albers_conical_equal_area": "aea",
    "mercator": "merc",
    "transverse_mercator": "tmerc",
    "geostationary": "geos",
    "oblique_mercator": "omerc",
    "rotated_latitude_longitude": "ob_tran",
}
# Attributes of a grid mapping and the parameters they set.
CF_PARAMETERS = {
    "semi_major_axis": "a",
    "semi_minor_axis": "b",
    "inverse_flattening": "rf",
    "earth_radius": "R",
    "longitude_of_central_meridian": "lon_0",
    "longitude_of_projection_origin": "lon_0",
    "straight_vertical_longitude_from_pole": "lon_0",
    "latitude_of_projection_origin": "lat_0",
    "false_easting": "x_0",
    "false_northing": "y_0",
    "perspective_point_height": "h",
    "sweep_angle_axis": "sweep",
    "scale_factor_at_projection_origin": "k_0",
    "scale_factor_at_central_meridian": "k_0",
    "azimuth_of_central_line": "alpha",
}


def crs_from_cf(mapping: Mapping) -> Crs:
    """The system of a CF grid mapping variable's attributes."""
    name = mapping.get("grid_mapping_name")
    if name not in CF_MAPPINGS:
        raise ValueError(f"unknown grid mapping {name!r}")
    params: dict = {"proj": CF_MAPPINGS[name]}
    for key, value in mapping.items():
        if key in CF_PARAMETERS:
            params[CF_PARAMETERS[key]] = value if isinstance(value, str) else float(value)
    parallels = mapping.get("standard_parallel")
    if parallels is not None:
        parallels = np.atleast_1d(parallels).astype(float).tolist()
        if params["proj"] in ("stere", "merc"):
            params["lat_ts"] = parallels[0]
            if params["proj"] == "stere":
                params.setdefault("lat_0", 90.0 if parallels[0] > 0 else -90.0)
        else:
            params |= {f"lat_{i}": p for i, p in enumerate(parallels, 1)}
    if name == "oblique_mercator" and "lon_0" in params:
        params["lonc"] = params.pop("lon_0")
    if name == "rotated_latitude_longitude":
        params |= {"o_proj": "longlat", "o_lat_p": float(mapping["grid_north_pole_latitude"]), "lon_0": float(mapping["grid_north_pole_longitude"]) + 180, "o_lon_p": float(mapping.get("north_pole_grid_longitude", 0))}
    return Crs.of(params)


def area_from_cf(mapping: Mapping, x: Mapping, y: Mapping, name: str = "") -> AreaSpec:
    """An area from the attributes of a grid mapping and of its two axes.

    An axis has ``first``, ``last``, ``n`` and ``units``; radians of a
    geostationary view are scaled by the height. Values are pixel centres.
    """
    crs = crs_from_cf(mapping)

    def edge(axis):
        first, last, n = float(axis["first"]), float(axis["last"]), int(axis["n"])
        units = str(axis.get("units", "degrees" if crs.geographic else "m"))
        scale = 1000.0 if units == "km" else float(crs.get("h", 1.0)) if units.startswith("rad") and crs.name == "geos" else 1.0
        half = (last - first) / (n - 1) / 2 if n > 1 else 0.5
        return (first - half) * scale, (last + half) * scale, n

    left, right, width = edge(x)
    top, bottom, height = edge(y)
    if top < bottom:  # rows run north
        bottom, top = top, bottom
    return AreaSpec.make(crs, width, height, (left, bottom, right, top), name)


def area_from_transform(transform, width: int, height: int, crs, name: str = "") -> AreaSpec:
    """An area from a raster's six-number geotransform (x0, dx, rx, y0, ry, dy); rotated ones raise."""
    x0, dx, rx, y0, ry, dy = (float(v) for v in transform)
    if rx or ry:
        raise ValueError("rotated rasters have no area")
    return AreaSpec.make(crs, width, height, (x0, y0 + dy * height, x0 + dx * width, y0), name)
