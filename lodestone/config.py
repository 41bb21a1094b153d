"""Configurations: frozen values with differences, fingerprints and expansion of variables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from itertools import product

from lodestone.errors import LinkError
from lodestone.sources.readers import fingerprint

SECTIONINGS = ("sentence", "fixed_length")
SAMPLERS = ("lookup", "inverse_frequency")
SCHEDULES = ("constant", "linear", "step", "exponential")


class Merged:
    def merge(self, diff: Mapping[str, object] | None):
        """A copy with the values of ``diff`` that aren't null; unknown names raise; nested configurations merge too."""
        changes = {}
        known = {f.name for f in fields(self)}
        for k, v in (diff or {}).items():
            if k not in known:
                raise TypeError(f"{type(self).__name__} has no {k}")
            if v is not None:
                old = getattr(self, k)
                changes[k] = old.merge(v) if isinstance(old, Merged) and isinstance(v, Mapping) else {**old, **v} if isinstance(old, dict) and isinstance(v, Mapping) else v
        return replace(self, **changes)

    @property
    def fingerprint(self) -> str:
        return fingerprint(asdict(self))


@dataclass(frozen=True)
class LexicalConfig(Merged):
    k1: float = 1.2
    b: float = 0.75
    language: str | None = None
    host: str = "localhost"
    port: int = 0


@dataclass(frozen=True)
class DenseConfig(Merged):
    metric: str = "inner_product"
    index: str = "Flat"
    nprobe: int = 16
    body: dict = field(default_factory=dict)
    host: str = "localhost"
    port: int = 0


@dataclass(frozen=True)
class HybridConfig(Merged):
    sparse: LexicalConfig | None = field(default_factory=LexicalConfig)
    dense: DenseConfig | None = field(default_factory=DenseConfig)


@dataclass(frozen=True)
class CollateConfig(Merged):
    prefetch: int = 100
    n_sections: int | None = 10
    max_positives: int | None = 3
    support: int | None = None
    do_sample: bool = False
    in_batch_negatives: bool = False
    lookup_engine: str = "sparse"
    query_template: str = "{{ query }}"
    section_template: str = "{% if title %}{{ title }}: {% endif %}{{ content }}"


@dataclass(frozen=True)
class DatasetConfig(Merged):
    name: str
    subsets: tuple[str, ...] = ()
    split: str | None = None
    link: str | None = None


def expand(value, variables: Mapping[str, list] | None = None) -> list:
    """Copies of ``value`` for each combination of its ``__vars__``, with ``{name}`` put in everywhere."""
    if isinstance(value, Mapping) and "__vars__" in value:
        variables = value["__vars__"]
        value = {k: v for k, v in value.items() if k != "__vars__"}
    if not variables:
        return [value]
    names = list(variables)
    return [_put(value, dict(zip(names, c))) for c in product(*variables.values())]


def _put(value, names: Mapping[str, object]):
    if isinstance(value, str):
        for k, v in names.items():
            value = value.replace("{" + k + "}", str(v))
        return value
    if isinstance(value, Mapping):
        return {k: _put(v, names) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(_put(v, names) for v in value)
    return value


def linked(queries: list[DatasetConfig], sections: list[DatasetConfig]) -> list[tuple[DatasetConfig, DatasetConfig]]:
    """Each set of queries with its set of sections; a single set of sections serves those that name none."""
    by = {s.name: s for s in sections}
    out = []
    for q in queries:
        link = q.link or (sections[0].name if len(sections) == 1 else None)
        if link not in by:
            raise LinkError(f"queries {q.name} link to {link}; sections are {sorted(by)}")
        out.append((replace(q, link=link), by[link]))
    return out


def engine_enabled(weight: float | None) -> bool:
    """An engine runs unless its weight is negative; 0 runs it for its raw scores."""
    return weight is None or weight >= 0


def update_steps(period: int | list[int], end: int) -> list[int]:
    """Steps at which indexes are made anew: 0, each period, the end."""
    steps = list(range(0, end, period)) if isinstance(period, int) else sorted({0, *period})
    return [*[s for s in steps if s < end], end]


def period_of(step: int, steps: list[int]) -> int:
    """Number of the period that a step is in."""
    return max(i for i, s in enumerate(steps[:-1]) if s <= step)
