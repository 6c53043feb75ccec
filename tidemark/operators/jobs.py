"""Job configurations: strict reading, and the schema of the records they describe."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Options by section; None stands for a free value.
_SECTIONS = {
    "pagination": {"next", "infinite_scroll"},
    "crawl": {"include", "exclude", "max_depth", "same_origin", "sitemap"},
    "politeness": {"respect_robots", "delay", "max_concurrent_per_domain"},
    "retry": {"max_retries", "backoff", "respect_retry_after"},
    "capture": {"har", "console", "accessibility", "headers", "storage"},
    "proxy": {"server", "username", "password", "bypass"},
}
_PLAIN = {"target", "item", "fields", "change_detection", "resume", "session"}


class ConfigError(ValueError):
    """A configuration with an unknown key, a missing one or a value of the wrong type."""


@dataclass(frozen=True)
class Field:
    selector: str
    attr: str | None = None
    type: str = "string"


@dataclass(frozen=True)
class Job:
    target: str
    item: str | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def get(self, section: str, name: str, default=None):
        value = (self.options.get(section) or {}).get(name)
        return default if value is None else value

    def schema(self) -> T.StructType:
        kinds = {"string": T.StringType(), "number": T.DoubleType()}
        return T.StructType([T.StructField(n, kinds[f.type], True) for n, f in self.fields.items()])


def job(data: dict) -> Job:
    """A checked job; nothing unknown passes."""
    if type(data) is not dict:
        raise ConfigError("a job is a mapping")
    unknown = set(data) - _PLAIN - set(_SECTIONS)
    if unknown:
        raise ConfigError(f"unknown options: {sorted(unknown)}")
    if type(data.get("target")) is not str or not data["target"]:
        raise ConfigError("target is missing")
    if data.get("item") is not None and type(data["item"]) is not str:
        raise ConfigError("item must be a selector")
    fields = {}
    for name, spec in (data.get("fields") or {}).items():
        if type(spec) is not dict or type(spec.get("selector")) is not str or set(spec) - {"selector", "attr", "type"}:
            raise ConfigError(f"bad field {name!r}")
        kind = spec.get("type") or "string"
        if kind not in ("string", "number"):
            raise ConfigError(f"bad type of field {name!r}")
        fields[name] = Field(spec["selector"], spec.get("attr"), kind)
    for section, names in _SECTIONS.items():
        value = data.get(section)
        if value is not None and (type(value) is not dict or set(value) - names):
            raise ConfigError(f"bad section {section!r}")
    return Job(data["target"], data.get("item"), fields, {k: v for k, v in data.items() if k not in ("target", "item", "fields")})


def load(text: str) -> Job:
    """A job from YAML, or from JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return job(json.loads(text))
    return job(yaml.safe_load(text))
