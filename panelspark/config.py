"""Settings with their defaults, overridden by whatever has attributes or keys of the right names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: The attribute that overrides each field.
ATTRIBUTES = {
    "listed": "URLMANGA", "direct": "URLCHAPTER", "font_folder": "FONT_PATH", "font_normal": "FONT_NORMAL", "font_bold": "FONT_BOLD", "font_italic": "FONT_ITALIC", "font_sound": "FONT_SFX",
    "instruction": "PROMPT_TRANSLATOR", "format_rules": "PROMPT_FORMAT_RULES",
}


@dataclass(frozen=True)
class Settings:
    """What a run needs to know. The limits of batches and strips are fixed values."""

    listed: tuple[str, ...] = ()
    direct: tuple[str, ...] = ()
    font_folder: str = "font"
    font_normal: str = "normal.ttf"
    font_bold: str = "bold.ttf"
    font_italic: str = "italic.ttf"
    font_sound: str = "sound.ttf"
    instruction: str = "Translate."
    format_rules: str = "Keep the separator."
    separator: str = "130495848"
    outer_chars: int = 1000
    outer_texts: int = 25
    inner_chars: int = 1500
    strip_height: int = 8000

    @classmethod
    def of(cls, source: object) -> Settings:
        """The defaults, but for the attributes that ``source`` has; lists of urls become tuples without blank ones."""
        given = {name: getattr(source, attribute) for name, attribute in ATTRIBUTES.items() if hasattr(source, attribute)}
        for name in ("listed", "direct"):
            if name in given:
                given[name] = tuple(u for u in given[name] if u.strip())
        return replace(cls(), **given)

    def fonts(self) -> dict[str, str]:
        """The file of each role's font."""
        return {role: f"{self.font_folder}/{getattr(self, f'font_{key}')}" for role, key in (("normal", "normal"), ("bold", "bold"), ("italic", "italic"), ("sfx", "sound"))}


@dataclass(frozen=True)
class Recognizer:
    """A recogniser's settings, which only describe where landed lines come from: sections of named values."""

    text_score: float = 0.5
    use_det: bool = True
    use_cls: bool = True
    use_rec: bool = True
    min_height: int = 30
    width_height_ratio: float = 8
    max_side_len: int = 2000
    min_side_len: int = 30
    sections: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    @classmethod
    def of(cls, mapping: Mapping[str, Mapping[str, object]]) -> Recognizer:
        """From a nested mapping: known names of ``Global`` are fields, all else stays in ``sections``."""
        known = {f.name for f in fields(cls)} - {"sections"}
        own = mapping.get("Global", {})
        rest = {k: dict(v) for k, v in mapping.items() if k != "Global"} | {"Global": {k: v for k, v in own.items() if k not in known}}
        return cls(**{k: v for k, v in own.items() if k in known}, sections=rest)

    @classmethod
    def read(cls, spark, path: str) -> Recognizer:
        """From a YAML file in any store that Spark reads. An empty file gives the defaults."""
        import yaml

        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        return cls.of(yaml.safe_load(text) or {})
