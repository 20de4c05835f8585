"""Column roles of a labelled table, and the registry of known tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class DatasetSpec:
    """Roles of the columns of one labelled table.

    Models see every feature; privacy is measured on the quasi-identifiers only.
    """

    name: str
    features: tuple[str, ...]
    qis: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    label: str = "label"
    row_id: str = "row_id"
    string_categories: tuple[str, ...] = ()
    label_values: dict = field(default_factory=dict)
    entity: str | None = None
    order_in_entity: str | None = None
    sentinels: dict = field(default_factory=dict)
    continuous: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        unknown = sorted(set(self.qis) - set(self.features))
        if unknown:
            raise ValueError(f"quasi-identifiers must be features, these are not: {unknown}")
        unknown = sorted(set(self.numeric) - set(self.features))
        if unknown:
            raise ValueError(f"numeric columns must be features, these are not: {unknown}")

    @property
    def numeric_qis(self) -> tuple[str, ...]:
        return tuple(q for q in self.qis if q in self.numeric)

    @property
    def categorical_qis(self) -> tuple[str, ...]:
        return tuple(q for q in self.qis if q not in self.numeric)

    @property
    def categorical(self) -> tuple[str, ...]:
        return tuple(c for c in self.features if c not in self.numeric)

    def schema(self) -> T.StructType:
        """Explicit read schema: numbers as doubles, everything else as text."""
        fields = [
            T.StructField(c, T.DoubleType() if c in self.numeric else T.StringType())
            for c in self.features
        ]
        return T.StructType([*fields, T.StructField(self.label, T.StringType())])


_REGISTRY: dict[str, DatasetSpec] = {}


def register_spec(spec: DatasetSpec) -> DatasetSpec:
    """Make a table known under its name and its aliases."""
    for key in (spec.name, *spec.aliases):
        _REGISTRY[key.strip().lower()] = spec
    return spec


def get_spec(name: str) -> DatasetSpec:
    key = name.strip().lower()
    if key not in _REGISTRY:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[key]
