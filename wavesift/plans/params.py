"""Parameter trees: attribute dictionaries, their schema, validation and loading."""

from __future__ import annotations

import argparse
import ast
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


class Param(dict):
    """A dictionary whose entries are attributes, too; dotted keys reach into branches."""

    def __init__(self, *args, **kwargs):
        super().__init__()
        self.update(*args, **kwargs)

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value) -> None:
        self[name] = value

    def __delattr__(self, name: str) -> None:
        try:
            del self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, key: str):
        head, dot, rest = key.partition(".") if isinstance(key, str) else (key, "", "")
        own = super().__getitem__(head)
        return own[rest] if dot else own

    def __setitem__(self, key: str, value) -> None:
        head, dot, rest = key.partition(".") if isinstance(key, str) else (key, "", "")
        if not dot:
            super().__setitem__(head, value)
        else:
            if not isinstance(self.get(head), Param):
                super().__setitem__(head, Param())
            super().__getitem__(head)[rest] = value

    def get(self, key, default=None):
        try:
            return self[key]
        except (KeyError, TypeError):
            return default

    def copy(self, depth: int = 0) -> Param:
        """Branches down to ``depth`` are copied, deeper ones are shared."""
        return Param({k: v.copy(depth - 1) if depth > 0 and isinstance(v, Param) else v for k, v in self.items()})

    def update(self, other: Mapping | None = None, in_place_depth: int = 0, convert: bool = False, **kwargs) -> None:
        """Entries of ``other`` replace own ones; branches down to ``in_place_depth`` are merged in place."""
        for source in (other or {}, kwargs):
            for k, v in dict(source).items():
                own = self.get(k)
                if in_place_depth > 0 and isinstance(own, Param) and isinstance(v, Mapping):
                    own.update(v, in_place_depth - 1, convert)
                else:
                    self[k] = as_param(v) if convert and isinstance(v, Mapping) else v

    def to_dict(self) -> dict:
        return {k: v.to_dict() if isinstance(v, Param) else v for k, v in self.items()}


def as_param(tree: Mapping) -> Param:
    """Nested mappings as nested Params."""
    return Param({k: as_param(v) if isinstance(v, Mapping) else v for k, v in tree.items()})


def from_json(path: str) -> Param:
    with open(path, encoding="utf-8") as f:
        return as_param(json.load(f))


def from_yaml(path: str) -> Param:
    """Needs a YAML reader, which is optional."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml module") from e
    with open(path, encoding="utf-8") as f:
        return as_param(yaml.safe_load(f))


def as_json(tree: Param) -> str:
    return json.dumps(tree.to_dict(), sort_keys=True, default=str)


PASS, FAIL, UNKNOWN, INVALID, MISSING = "PASS", "FAIL", "UNKNOWN", "INVALID", "MISSING"

_TYPES: dict[str, tuple[type, ...]] = {
    "int": (int,), "float": (float, int), "complex": (complex, float, int), "str": (str,), "bool": (bool,), "file": (str,),
    "tuple": (tuple, list), "list": (list, tuple), "Param": (dict,), "None": (type(None),),
}


@dataclass
class Entry:
    """One parameter: default, types, limits, choices; ``branch`` entries have children, '*' any name."""

    default: Any = None
    types: Sequence[str] = ()
    help: str = ""
    low: float | None = None
    high: float | None = None
    choices: Sequence[Any] | None = None
    userlevel: int = 1
    children: dict[str, Entry] = field(default_factory=dict)

    def problem(self, value) -> str | None:
        """Why the value is not allowed; None if it is."""
        if value is None:
            return None if not self.types or "None" in self.types or self.default is None else "is None"
        kinds = tuple(k for t in self.types for k in (_TYPES.get(t) or ()))
        wrong_bool = isinstance(value, bool) and "bool" not in self.types and bool(self.types)
        if "array" in self.types and hasattr(value, "shape"):
            return None
        if wrong_bool or kinds and not isinstance(value, kinds):
            return f"has type {type(value).__name__}, not {' or '.join(self.types)}"
        if self.choices is not None and value not in self.choices:
            return f"is none of {list(self.choices)}"
        if isinstance(value, int | float):
            if self.low is not None and value < self.low:
                return f"is below {self.low}"
            if self.high is not None and value > self.high:
                return f"is above {self.high}"
        return None


def _literal(text: str):
    """The number, text, tuple and so on that is written; other writing stands for itself. Nothing is evaluated."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def _entry(own: Mapping[str, str]) -> Entry:
    types = tuple(t.strip() for t in own.get("type", "").split(",") if t.strip())
    default = _literal(own["default"]) if own.get("default") else None
    if types and set(types) <= {"str", "file"} and default is not None:
        default = str(default)
    values = {k: _literal(own[k]) if own.get(k) else None for k in ("lowlim", "uplim", "choices", "userlevel")}
    return Entry(default, types, own.get("help", ""), values["lowlim"], values["uplim"], values["choices"], 1 if values["userlevel"] is None else values["userlevel"])


@dataclass
class Schema:
    """A tree of entries."""

    root: Entry = field(default_factory=Entry)

    def add(self, path: str, entry: Entry) -> Schema:
        at = self.root
        *branch, leaf = path.split(".")
        for name in branch:
            at = at.children.setdefault(name, Entry(types=("Param",)))
        if leaf in at.children:
            entry.children = at.children[leaf].children | entry.children
        at.children[leaf] = entry
        return self

    def add_text(self, text: str, prefix: str = "") -> Schema:
        """Entries from text: a '[path]' line, then 'key = value' lines (default, type, help, lowlim, uplim, choices, userlevel).

        More lines than one of a value are joined by blanks. Values are literals; what is none stands for itself.
        """
        name, own, last = None, {}, None
        for line in (*text.splitlines(), "[]"):
            line = line.strip()
            if line.startswith("[") and line.endswith("]") and "=" not in line:
                if name:
                    self.add(prefix + name, _entry(own))
                name, own, last = line[1:-1].strip(), {}, None
            elif name and re.match(r"\w+\s*=", line):
                last, value = (x.strip() for x in line.split("=", 1))
                own[last] = value
            elif name and line and last:
                own[last] += " " + line
        return self

    def add_class(self, cls: type, prefix: str = "") -> Schema:
        """Entries in the docstrings of a class and its bases, the class's own last."""
        for c in reversed(cls.__mro__):
            self.add_text(c.__dict__.get("__doc__") or "", prefix)
        return self

    def arguments(self, parser: argparse.ArgumentParser | None = None) -> argparse.ArgumentParser:
        """An option '--path' for every entry that has no children and no wildcard."""
        parser = parser or argparse.ArgumentParser()
        for path, entry in self.paths():
            if not entry.children and "*" not in path.split("."):
                parser.add_argument("--" + path, dest=path, default=argparse.SUPPRESS, help=entry.help.replace("%", "%%"), type=lambda v, e=entry: v if set(e.types) & {"str", "file"} and v != "None" else _literal(v))
        return parser

    def from_arguments(self, argv: Sequence[str]) -> Param:
        """Defaults with what the options say; values that are not allowed raise ValueError."""
        out = self.defaults()
        for path, value in vars(self.arguments().parse_args(argv)).items():
            out[path] = value
        self.validate(out)
        return out

    def link(self, path: str, target: str) -> Schema:
        """``path`` has the children of ``target``."""
        return self.add(path, Entry(types=("Param",), children=self.at(target).children))

    def at(self, path: str) -> Entry:
        own = self.root
        for name in path.split("."):
            own = own.children[name]
        return own

    def paths(self, entry: Entry | None = None, prefix: str = "") -> Iterator[tuple[str, Entry]]:
        for name, child in (entry or self.root).children.items():
            yield prefix + name, child
            yield from self.paths(child, f"{prefix}{name}.")

    def defaults(self, depth: int = 99, entry: Entry | None = None) -> Param:
        out = Param()
        for name, child in (entry or self.root).children.items():
            if name != "*":
                out[name] = self.defaults(depth - 1, child) if child.children and depth > 0 else child.default
        return out

    def check(self, pars: Mapping, entry: Entry | None = None, prefix: str = "") -> dict[str, tuple[str, str]]:
        """path -> (code, reason) for everything that is in the tree or in the schema."""
        own, out = entry or self.root, {}
        for name, value in pars.items():
            path = prefix + str(name)
            child = own.children.get(name) or own.children.get("*")
            if child is None:
                out[path] = (UNKNOWN, "is not a parameter")
            elif child.children and value is not None and not isinstance(value, Mapping):
                out[path] = (INVALID, "is not a branch")
            elif child.children and isinstance(value, Mapping):
                out[path] = (PASS, "")
                out |= self.check(value, child, path + ".")
            else:
                why = child.problem(value)
                out[path] = (FAIL, why) if why else (PASS, "")
        for name, child in own.children.items():
            if name != "*" and name not in pars:
                out[prefix + name] = (MISSING, "is not given")
        return out

    def validate(self, pars: Mapping, raise_on: Sequence[str] = (FAIL, INVALID)) -> dict[str, tuple[str, str]]:
        found = self.check(pars)
        bad = [f"{p} {why}" for p, (code, why) in found.items() if code in raise_on]
        if bad:
            raise ValueError("; ".join(bad))
        return found


def engine_schema() -> Schema:
    """The parameters of a reconstruction run."""
    s = Schema()
    s.add("scan.source", Entry("moonflower", ("str",), "name of a source"))
    s.add("scan.num_frames", Entry(100, ("int",), low=1))
    s.add("scan.shape", Entry(64, ("int",), low=4))
    s.add("scan.density", Entry(0.2, ("float",), low=0.01, high=1.0))
    s.add("scan.photons", Entry(1e8, ("float",), low=1))
    s.add("scan.path", Entry(None, ("str", "None"), "file or folder of a source that reads"))
    s.add("scan.slow", Entry(None, ("str", "None"), "positions along the slow axis: a file, or a name in the file"))
    s.add("scan.fast", Entry(None, ("str", "None"), "positions along the fast axis"))
    s.add("scan.layout", Entry("generic", ("str",), "names of the datasets of a facility"))
    s.add("scan.resolution", Entry(1.0, ("float",), "size of an object pixel in the unit of positions", low=1e-300))
    s.add("scan.probe_radius", Entry(0.25, ("float",), "radius of the first probe, in frames", low=0.01, high=1.0))
    s.add("io.home", Entry(None, ("str", "None"), "folder of results"))
    s.add("engines.*.name", Entry("DM", ("str",)))
    s.add("engines.*.numiter", Entry(20, ("int",), low=1))
    s.add("engines.*.alpha", Entry(1.0, ("float",)))
    s.add("engines.*.beta", Entry(0.75, ("float",)))
    s.add("engines.*.probe_update_start", Entry(0, ("int",), low=0))
    s.add("engines.*.overlap_max_iterations", Entry(3, ("int",), low=1))
    s.add("engines.*.overlap_converge_factor", Entry(0.05, ("float",), low=0))
    s.add("engines.*.ml_type", Entry("gaussian", ("str",), choices=("gaussian", "poisson", "euclid")))
    s.add("engines.*.poly_line_coeffs", Entry("quadratic", ("str",), choices=("quadratic", "all")))
    s.add("engines.*.wavefield_precond", Entry(False, ("bool",), "gradients over the fluence"))
    s.add("engines.*.clip_object", Entry(None, ("tuple", "None")))
    return s
