"""Index settings and their validity rules."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

STORAGES = ("plain", "compressed")
WEIGHTS = ("f32", "f16", "u8")
ELEMENTS = ("simple", "extended")


class SettingsError(ValueError):
    """The settings contradict each other or name something unknown."""


@dataclass(frozen=True)
class IndexSettings:
    """How segments are stored.

    storage: ``plain`` (snappy) or ``compressed`` (zstd, Parquet v2 pages); weight: logical weight type; element:
    ``extended`` adds the suffix maximum of each list; quantized: u8 codes with parameters per (segment, dim).
    """

    storage: str = "plain"
    weight: str = "f32"
    element: str = "simple"
    quantized: bool = False

    def __post_init__(self) -> None:
        for value, known, what in ((self.storage, STORAGES, "storage"), (self.weight, WEIGHTS, "weight"), (self.element, ELEMENTS, "element")):
            if value not in known:
                raise SettingsError(f"{what} {value!r} is not one of {', '.join(known)}")
        if self.quantized and self.element == "extended":
            raise SettingsError("quantized lists cannot be extended")
        if self.quantized and self.weight == "u8":
            raise SettingsError("u8 weights cannot be quantized")

    @property
    def supports_pruning(self) -> bool:
        return self.element == "extended" and self.storage == "plain"

    def writer_options(self) -> dict[str, str]:
        if self.storage == "compressed":
            return {"compression": "zstd", "parquet.writer.version": "v2"}
        return {"compression": "snappy"}

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexSettings:
        given = json.loads(text or "{}")
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise SettingsError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)
