"""Options of a learner, their defaults and cross-checks."""

from __future__ import annotations

import argparse
import re
import shlex
from dataclasses import dataclass, replace

ALGORITHMS = ("IB1", "IGTREE", "TRIBL", "IB2", "TRIBL2")
#: Metric codes (fixed values).
METRICS = {"O": "overlap", "N": "numeric", "E": "euclidean", "M": "value difference", "J": "jeffrey", "S": "jensen-shannon", "L": "levenshtein", "DC": "dice", "C": "cosine", "D": "dot product", "I": "ignore"}
NUMERICAL, SIMILARITY, STORABLE, PER_FEATURE = ("N", "E", "C", "D"), ("C", "D"), ("M", "J", "S", "L", "DC"), ("O", "N", "E", "M", "J", "S", "DC", "I")
#: Weighting codes and their numbers (fixed values).
WEIGHTINGS = {"nw": 0, "gr": 1, "ig": 2, "x2": 3, "sv": 4, "sd": 5}
DECAYS = ("Z", "ID", "IL", "ED")
#: What may be shown of an answer.
SHOWN = ("confidence", "distribution", "distance", "depth", "neighbours")
NORMALISATIONS = ("none", "probability", "add", "log")
#: Orders of features (fixed values).
TREE_ORDERS = ("DO", "UDO", "GRO", "IGO", "1/V", "1/S", "G/V", "I/V", "GxE", "IxE", "X2O", "SVO", "SDO", "X/V", "S/V", "SD/V")


def parse_metrics(text: str) -> tuple[str, dict[int, str]]:
    """``"O:N3:I2,5-7"``: the global metric, and those of single features (from 1)."""
    head, *parts = text.strip().split(":")
    if head not in METRICS or head == "I":
        raise ValueError(f"unknown metric {head!r}")
    own: dict[int, str] = {}
    for part in parts:
        m = re.fullmatch(r"(DC|[A-Z])(\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*)", part)
        if not m or m[1] not in PER_FEATURE:
            raise ValueError(f"bad metric of features {part!r}")
        if head in SIMILARITY and m[1] != "I":
            raise ValueError("a similarity metric only goes with ignored features")
        for span in m[2].split(","):
            first, _, last = span.partition("-")
            if int(first) < 1 or int(last or first) < int(first):
                raise ValueError(f"bad features {span!r}")
            for f in range(int(first), int(last or first) + 1):
                if own.setdefault(f, m[1]) != m[1]:
                    raise ValueError(f"feature {f} has two metrics")
    return head, own


@dataclass(frozen=True)
class Options:
    """Settings of a learner; a frozen value, changed with ``but``."""

    algorithm: str = "IB1"
    metric: str = "O"
    weighting: str = "gr"
    weights: dict[str, float] | None = None
    k: int = 1
    decay: str = "Z"
    decay_a: float = 1.0
    decay_b: float = 1.0
    normalisation: str = "none"
    add_factor: float = 1.0
    beam: int = 0
    bins: int = 20
    clip: int = 1
    matrix_clip: int = 10
    tribl_offset: int = 0
    ib2_seed: int = 0
    tree_order: str | None = None
    exact: str = "reference"
    diversify: bool = False
    random_seed: int | None = None
    max_neighbours: int = 500
    sloppy: bool = False
    max_features: int = 2500
    show: tuple[str, ...] = ()

    def __post_init__(self):
        head, own = parse_metrics(self.metric)
        for value, allowed in ((self.algorithm, ALGORITHMS), (self.weighting, (*WEIGHTINGS, "user")), (self.decay, DECAYS), (self.normalisation, NORMALISATIONS), (self.exact, ("reference", "on", "off"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")
        if self.tree_order is not None and self.tree_order not in TREE_ORDERS:
            raise ValueError(f"unknown order {self.tree_order!r}")
        if not 1 <= self.k <= 100_000:
            raise ValueError("k lies from 1 to 100000")
        if self.algorithm == "IGTREE" and (self.k != 1 or self.decay != "Z" or head not in ("O",) or set(own.values()) - {"I"}):
            raise ValueError("a decision tree has k = 1, no decay and the overlap metric")
        if self.algorithm == "TRIBL" and self.tribl_offset < 1:
            raise ValueError("TRIBL needs an offset")
        if self.algorithm != "TRIBL" and self.tribl_offset:
            raise ValueError("only TRIBL has an offset")
        if self.algorithm == "IB2" and self.ib2_seed < 1:
            raise ValueError("IB2 needs a number of first rows")
        if self.weighting == "user" and not self.weights:
            raise ValueError("weights of the user's own must be given")
        for item in self.show:
            if item not in SHOWN:
                raise ValueError(f"{item!r} is none of {SHOWN}")
        if "confidence" in self.show and self.normalisation == "none":
            raise ValueError("confidence needs a normalisation")
        if self.algorithm == "IGTREE" and {"neighbours", "distribution"} & set(self.show):
            raise ValueError("a decision tree shows no neighbours and keeps no distributions")
        if self.matrix_clip < 0 or self.max_features < 1:
            raise ValueError("matrix clip or number of features out of range")
        if self.bins < 2 or self.clip < 0 or self.beam < 0 or self.max_neighbours < 1:
            raise ValueError("bins, clip, beam or neighbours out of range")

    def but(self, **changes) -> Options:
        return replace(self, **changes)

    @property
    def global_metric(self) -> str:
        return parse_metrics(self.metric)[0]

    def metric_of(self, number: int) -> str:
        head, own = parse_metrics(self.metric)
        return own.get(number, head)

    @classmethod
    def parse(cls, text: str) -> Options:
        """Options from a line of switches, as ``-a IB1 -k 3 -w gr -d ED:0.3:1 -m O:N3 -G 0 +v di+db``."""
        p = argparse.ArgumentParser(prog="options", prefix_chars="-+", add_help=False, exit_on_error=False, allow_abbrev=False)
        for name in ("a", "k", "w", "m", "d", "L", "q", "b", "R", "B", "c", "G", "M", "N", "-Beam", "-Treeorder"):
            p.add_argument(f"-{name}", dest=name.lstrip("-"))
        for name in ("x", "-Diversify", "-sloppy"):
            p.add_argument(f"-{name}", dest=name.lstrip("-"), action="store_true")
        p.add_argument("+x", dest="no_x", action="store_true")
        p.add_argument("+v", dest="v", action="append", default=[])
        try:
            given, rest = p.parse_known_args(shlex.split(text))
        except argparse.ArgumentError as e:
            raise ValueError(str(e)) from None
        if rest:
            raise ValueError(f"unknown options {rest}")
        out: dict = {}
        if given.a is not None:
            out["algorithm"] = _named(given.a.upper(), ("IB1", "IGTREE", "TRIBL", "IB2", "TRIBL2"))
        if given.w is not None:
            out["weighting"] = _named(given.w.lower(), tuple(WEIGHTINGS))
        if given.d is not None:
            code, *numbers = given.d.split(":")
            out |= {"decay": code} | dict(zip(("decay_a", "decay_b"), map(float, numbers)))
        if given.G is not None:
            code, *numbers = given.G.split(":")
            out["normalisation"] = {"0": "probability", "1": "add", "2": "log"}.get(code, code)
            if numbers:
                out["add_factor"] = float(numbers[0])
        for name, field, kind in (("k", "k", int), ("m", "metric", str), ("L", "clip", int), ("q", "tribl_offset", int), ("b", "ib2_seed", int), ("R", "random_seed", int), ("B", "bins", int), ("c", "matrix_clip", int), ("M", "max_neighbours", int), ("N", "max_features", int), ("Beam", "beam", int), ("Treeorder", "tree_order", str)):
            if getattr(given, name) is not None:
                out[field] = kind(getattr(given, name))
        if given.x or given.no_x:
            out["exact"] = "on" if given.x else "off"
        out |= {"diversify": given.Diversify, "sloppy": given.sloppy}
        codes = {"cf": "confidence", "db": "distribution", "di": "distance", "md": "depth", "n": "neighbours", "k": "neighbours"}
        shown = [codes.get(c, c) for v in given.v for c in v.lower().split("+")]
        return cls(**out, show=tuple(dict.fromkeys(shown)))

    def output_name(self, test: str) -> str:
        """Name of a result file: the tested file, algorithm, metric, weighting and what differs from the defaults."""
        parts = [test, self.algorithm, self.metric.replace(":", "."), self.weighting]
        parts += [f"k{self.k}"] if self.algorithm != "IGTREE" else []
        parts += [self.decay.lower()] if self.decay != "Z" else []
        parts += [f"q{self.tribl_offset}"] if self.tribl_offset else []
        parts += [f"b{self.ib2_seed}"] if self.ib2_seed else []
        return ".".join([*parts, "out"])


def _named(code: str, names: tuple[str, ...]) -> str:
    """A name, or the name that a number stands for."""
    return names[int(code)] if code.isdigit() and int(code) < len(names) else code
