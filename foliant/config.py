"""Settings from the environment, read once on the driver."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Settings:
    model_tokens: int = 8192
    output_tokens: int = 2048
    model_name: str = "stand-in"
    batch_pages: int = 20
    masked_names: tuple[str, ...] = field(default_factory=tuple)
    registry_secret: str | None = None

    @classmethod
    def from_environment(cls, prefix: str = "FOLIANT_") -> Settings:
        out = {}
        for name, f in cls.__dataclass_fields__.items():
            raw = os.environ.get(prefix + name.upper())
            if raw is not None:
                out[name] = tuple(raw.split(",")) if "tuple" in str(f.type) else int(raw) if f.type == "int" else raw
        return cls(**out)

    def shown(self, *, secrets: bool = False) -> dict:
        """The settings as a dictionary, secrets masked unless asked for."""
        return {k: "***" if v and "secret" in k and not secrets else v for k, v in asdict(self).items()}
