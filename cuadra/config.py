"""Client configuration: YAML or JSON, checked field by field."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from .errors import ConfigError

MODEL_VERSION = "2"
VERSION = "0.2.14"
CURRENCY = r"^[A-Z]{3}$"


@dataclass(frozen=True)
class Limits:
    """Caps on one input; going over one is an error, never a truncation."""

    max_input_bytes: int = 25_000_000
    max_tabular_rows: int = 200_000
    max_tabular_cells: int = 5_000_000
    max_pdf_pages: int = 200
    max_pdf_text_chars: int = 5_000_000
    max_xml_movimientos: int = 200_000

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ConfigError(f"limites_ingesta.{f.name}: must be an integer of 1 or more")


@dataclass(frozen=True)
class Config:
    cliente: str
    rut_mask: str | None = None
    ventana_dias_monto_fecha: int = 3
    umbral_autoconcilia: float = 0.85
    umbral_confianza_campos: float = 0.80
    permitir_ocr: bool = False
    mask_por_defecto: bool = True
    moneda_default: str = "CLP"
    limites_ingesta: Limits = field(default_factory=Limits)

    def __post_init__(self):
        if not isinstance(self.cliente, str) or not self.cliente:
            raise ConfigError("cliente: must be a text")
        if isinstance(self.ventana_dias_monto_fecha, bool) or not isinstance(self.ventana_dias_monto_fecha, int) or self.ventana_dias_monto_fecha < 0:
            raise ConfigError("ventana_dias_monto_fecha: must be an integer of 0 or more")
        for name in ("umbral_autoconcilia", "umbral_confianza_campos"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
                raise ConfigError(f"{name}: must be between 0 and 1")
        for name in ("permitir_ocr", "mask_por_defecto"):
            if not isinstance(getattr(self, name), bool):
                raise ConfigError(f"{name}: must be true or false")
        code = self.moneda_default
        if not isinstance(code, str) or len(code) != 3 or not (code.isascii() and code.isupper() and code.isalpha()):
            raise ConfigError("moneda_default: must be three capital letters")

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def make(data: Any) -> Config:
    """A Config from a parsed document; unknown keys are errors."""
    if not isinstance(data, dict):
        raise ConfigError("configuration must be a mapping")
    known, caps = {f.name for f in fields(Config)}, {f.name for f in fields(Limits)}
    limits = data.get("limites_ingesta") or {}
    if not isinstance(limits, dict):
        raise ConfigError("limites_ingesta: must be a mapping")
    unknown = sorted({str(k) for k in data if k not in known} | {f"limites_ingesta.{k}" for k in limits if k not in caps})
    if unknown:
        raise ConfigError(f"unknown keys: {', '.join(unknown)}")
    if "cliente" not in data:
        raise ConfigError("cliente: is required")
    return Config(**{k: v for k, v in data.items() if k != "limites_ingesta"}, limites_ingesta=Limits(**limits))


def load(path: str | Path) -> Config:
    """Read a configuration file: JSON by its suffix, else YAML."""
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"cannot read {path.name}: {e}") from e
    try:
        if path.suffix.lower() == ".json":
            return make(json.loads(text))
        import yaml

        return make(yaml.safe_load(text))
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"{path.name}: {e}") from e


def with_overrides(cfg: Config, *, enable_ocr: bool = False, **caps: int | None) -> Config:
    """Apply command line flags; caps are checked like those of a file."""
    given = {k: v for k, v in caps.items() if v is not None}
    cfg = replace(cfg, permitir_ocr=True) if enable_ocr else cfg
    return replace(cfg, limites_ingesta=replace(cfg.limites_ingesta, **given)) if given else cfg
