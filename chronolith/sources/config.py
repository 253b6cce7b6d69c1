"""Settings of the engine and of its read side, validated."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Comparison:
    geom_similarity_coef: float = 0.85
    geom_buffer_radius: float = 10.0
    geom_max_distance: float = 10.0
    epsg_code: str = "EPSG:2154"


@dataclass(frozen=True)
class Reading:
    default_lang: str = "fr"
    search_limit: int = 20
    time_delay_years: int = 20
    calendar: str = "gregorian"

    def __post_init__(self) -> None:
        if not isinstance(self.default_lang, str) or not 2 <= len(self.default_lang) <= 8:
            raise ValueError("default_lang is a language tag")
        if not isinstance(self.search_limit, int) or not 1 <= self.search_limit <= 1000:
            raise ValueError("search_limit lies in 1..1000")
        if not isinstance(self.time_delay_years, int) or not 0 <= self.time_delay_years <= 1000:
            raise ValueError("time_delay_years lies in 0..1000")


def reading(values: dict) -> Reading:
    """Settings from exactly the known keys."""
    known = {f.name for f in fields(Reading)}
    if set(values) != known:
        raise ValueError(f"settings are exactly {sorted(known)}")
    return Reading(**values)


# fixed values: the parts of a project's settings and the graphs that it names
SECTIONS = ("paths", "named_graphs", "labels", "comparison_settings", "namespaces")
GRAPHS = ("ontology", "facts", "inter_sources", "comparisons", "labels", "temporary", "metadata")


@dataclass(frozen=True)
class Project:
    """Settings of a build: what is compared how, names of graphs, prefixes, and what the user gave besides."""

    comparison: Comparison
    graphs: dict[str, str]
    prefixes: dict[str, str]
    labels: dict[str, str]
    paths: dict[str, str]
    user: dict[str, dict[str, str]]

    def graph_uri(self, name: str) -> str:
        """The IRI of a named graph: its name in the namespace of graphs, where one is given."""
        return self.prefixes.get("GRAPH", "") + self.graphs[name]


def _sections(path: str) -> dict[str, dict[str, str]]:
    """Sections of an INI or YAML file, by its ending."""
    own = Path(path)
    if own.suffix == ".ini":
        import configparser

        reader = configparser.ConfigParser(interpolation=None)
        reader.optionxform = str  # keys keep their case
        with own.open() as lines:
            reader.read_file(lines)
        return {name: dict(reader[name]) for name in reader.sections()}
    if own.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need PyYAML; INI needs nothing") from e
        found = yaml.safe_load(own.read_text()) or {}
    elif own.suffix == ".json":
        found = json.loads(own.read_text())
    else:
        raise ValueError(f"no settings: {path}")
    if not isinstance(found, dict) or not all(isinstance(v, dict) for v in found.values()):
        raise ValueError("settings are sections of keys and values")
    return found


def project(technical: str, user: str | None = None) -> Project:
    """A project from its technical file and the user's, each YAML, JSON or INI; values are checked here, once."""
    found = _sections(technical)
    missing = [x for x in SECTIONS if x not in found]
    if missing:
        raise ValueError(f"no section {missing[0]}")
    graphs = {k: str(v) for k, v in found["named_graphs"].items()}
    if set(graphs) != set(GRAPHS) or len(set(graphs.values())) < len(graphs):
        raise ValueError(f"named graphs are exactly {sorted(GRAPHS)}, each with a name of its own")
    given = found["comparison_settings"]
    own = Comparison(**{k: float(given[k]) if k != "epsg_code" else str(given[k]) for k in ("geom_similarity_coef", "geom_buffer_radius", "geom_max_distance", "epsg_code") if k in given})
    if not 0 <= own.geom_similarity_coef <= 1 or own.geom_buffer_radius < 0 or own.geom_max_distance < 0:
        raise ValueError("a coefficient lies in 0..1, distances aren't negative")
    text = lambda part: {k: str(v) for k, v in found[part].items()}
    return Project(own, graphs, text("namespaces"), text("labels"), text("paths"), _sections(user) if user else {})


class Store:
    """Settings in a file on the driver, replaced whole."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def get(self) -> Reading:
        return reading(json.loads(self.path.read_text())) if self.path.exists() else Reading()

    def put(self, values: dict) -> Reading:
        new = reading(values)
        handle, name = tempfile.mkstemp(dir=self.path.parent)
        with os.fdopen(handle, "w") as out:
            json.dump(asdict(new), out)
        os.replace(name, self.path)
        return new

    def reset(self) -> Reading:
        self.path.unlink(missing_ok=True)
        return Reading()
